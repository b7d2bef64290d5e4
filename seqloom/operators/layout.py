"""Layout of blocks as ribbons between tracks or chords of a circle, and their SVG."""

from __future__ import annotations

import math
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.sequence import polar

#: Fill colours by block (fixed values).
PALETTE = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2")


def genome_of(name: F.Column, default: str | None = None) -> F.Column:
    """What precedes a name's first point; names without one give ``default``, or themselves."""
    head = F.split_part(name, F.lit("."), F.lit(1))
    return head if default is None else F.when(name.contains("."), head).otherwise(F.lit(default))


def short_label(genome: F.Column, chrom: F.Column) -> F.Column:
    """A chromosome's name without its genome in front."""
    return F.when(F.startswith(chrom, F.concat(genome, F.lit("."))), F.substring(chrom, F.length(genome) + 2, F.length(chrom))).otherwise(chrom)


def inferred_sizes(blocks: DataFrame, default: str | None = None) -> DataFrame:
    """``(genome, chrom, length)`` as far as blocks reach, for want of size files."""
    return blocks.groupBy(F.col("seq_name").alias("chrom")).agg(F.max("end").alias("length")).select(genome_of(F.col("chrom"), default).alias("genome"), "chrom", "length")


def ribbon_tracks(sizes: DataFrame, width: float = 1000, height: float = 300) -> DataFrame:
    """``(genome, chrom, label, track, x, w, y, scale, th)``: each genome a track in name order, its chromosomes side by side, a hundredth of the longest genome apart; a single
    genome has two tracks, against itself.  ``th`` is a track's height."""
    per = sizes.groupBy("genome").agg(F.sum("length").alias("t"))
    longest = per.agg(F.max("t").alias("m"))
    track = per.select("genome", (F.row_number().over(Window.orderBy("genome")) - 1).alias("track"))
    n = track.agg(F.greatest(F.count("*"), F.lit(2)).alias("n"), (F.count("*") == 1).alias("alone"))
    scale = (F.lit(width) - 200) / F.greatest("m", F.lit(1))
    order = Window.partitionBy("track").orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.join(track, "genome").crossJoin(F.broadcast(longest)).crossJoin(F.broadcast(n))
    rows = rows.withColumn("track", F.explode(F.when(F.col("alone"), F.array(F.lit(0), F.lit(1))).otherwise(F.array("track"))))
    x = 100 + F.coalesce(F.sum((F.col("length") + F.col("m") * 0.01) * scale).over(order), F.lit(0.0))
    th = F.lit(height) / F.greatest("n", F.lit(1))
    label = short_label(F.col("genome"), F.col("chrom"))
    return rows.select("genome", "chrom", label.alias("label"), "track", x.alias("x"), (F.col("length") * scale).alias("w"), (50 + F.col("track") * th + th / 2).alias("y"), scale.alias("scale"), th.alias("th"))


def two_range_blocks(blocks: DataFrame) -> DataFrame:
    """The first two ranges of each block that has two, in one row."""
    w = blocks.where("ord <= 2").groupBy("block_id")
    pick = lambda i, c: F.max(F.when(F.col("ord") == i, F.col(c))).alias(f"{c}{i}")
    return w.agg(*[pick(i, c) for i in (1, 2) for c in ("seq_name", "start", "end", "strand")]).where("seq_name2 is not null")


def ribbons(blocks: DataFrame, tracks: DataFrame) -> DataFrame:
    """``(block_id, x1, x2, y1, x3, x4, y2, cy1, cy2, colour)``: source and target spans of each block whose sequences are known, and the heights to which its curve bends.

    Opposite strands cross.  A block inside one track leaves and ends below it, in an arc as high as a fifth of its span, 20 at least and four fifths of a track at most; where a
    genome is drawn against itself, blocks go from its first track to its second.
    """
    two = two_range_blocks(blocks)
    # of the two tracks of a single genome, the first one is where blocks begin
    for i, pick in ((1, F.min), (2, F.max)):
        own = tracks.groupBy("chrom").agg(pick(F.struct("track", "x", "y", "scale", "th")).alias("t"))
        two = two.join(own.select(F.col("chrom").alias(f"seq_name{i}"), F.col("t.track").alias(f"tr{i}"), F.col("t.x").alias(f"tx{i}"), F.col("t.y").alias(f"ty{i}"), F.col("t.scale").alias(f"sc{i}"), F.col("t.th").alias(f"th{i}")), f"seq_name{i}")
    at = lambda i, c: F.col(f"tx{i}") + F.col(f"{c}{i}") * F.col(f"sc{i}")
    cross = F.col("strand1") != F.col("strand2")
    x3, inside = F.when(cross, at(2, "end")).otherwise(at(2, "start")), F.col("tr1") == F.col("tr2")
    y1 = F.col("ty1") + 10
    y2 = F.when(inside, y1).otherwise(F.col("ty2"))
    arc = F.least(F.greatest(F.abs(at(1, "start") - x3) * 0.2, F.lit(20.0)), F.col("th1") * 0.8)
    bend = F.when(inside, arc).otherwise((y2 - y1) / 2)
    return two.select(
        "block_id", at(1, "start").alias("x1"), at(1, "end").alias("x2"), y1.alias("y1"),
        x3.alias("x3"), F.when(cross, at(2, "start")).otherwise(at(2, "end")).alias("x4"), y2.alias("y2"),
        (y1 + bend).alias("cy1"), F.when(inside, y2 + bend).otherwise(y2 - bend).alias("cy2"),
        F.element_at(F.array(*map(F.lit, PALETTE)), (F.col("block_id") % 7 + 1).cast("int")).alias("colour"),
    )


def circle_sectors(sizes: DataFrame, width: float = 800) -> DataFrame:
    """``(genome, chrom, begin, finish, label_x, label_y)``: sectors in radians from the top, two degrees apart."""
    whole = sizes.agg(F.sum("length").alias("t"), F.count("*").alias("n"))
    rows = sizes.crossJoin(F.broadcast(whole))
    per = F.radians(F.lit(360.0) - 2.0 * F.col("n")) / F.greatest("t", F.lit(1))
    order = Window.orderBy("genome", "chrom").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.radians(F.lit(-90.0)) + F.coalesce(F.sum(F.col("length") * per + F.radians(F.lit(2.0))).over(order), F.lit(0.0))
    placed = rows.withColumn("per", per).withColumn("begin", begin).withColumn("finish", F.col("begin") + F.col("length") * per)
    x, y = polar(F.lit(width / 2 - 50 + 15), (F.col("begin") + F.col("finish")) / 2, width / 2, width / 2)
    return placed.select("genome", "chrom", short_label(F.col("genome"), F.col("chrom")).alias("label"), "begin", "finish", "per", x.alias("label_x"), y.alias("label_y"))


def chords(blocks: DataFrame, sectors: DataFrame, width: float = 800, track: float = 20) -> DataFrame:
    """``(block_id, a1, a2, b1, b2, radius)`` of each block; on equal strands the second arc runs backwards."""
    two = two_range_blocks(blocks)
    for i in (1, 2):
        two = two.join(sectors.select(F.col("chrom").alias(f"seq_name{i}"), F.col("begin").alias(f"g{i}"), F.col("per").alias(f"p{i}")), f"seq_name{i}")
    at = lambda i, c: F.col(f"g{i}") + F.col(f"{c}{i}") * F.col(f"p{i}")
    same = F.col("strand1") == F.col("strand2")
    return two.select(
        "block_id", at(1, "start").alias("a1"), at(1, "end").alias("a2"),
        F.when(same, at(2, "end")).otherwise(at(2, "start")).alias("b1"), F.when(same, at(2, "start")).otherwise(at(2, "end")).alias("b2"),
        F.lit(width / 2 - 50 - track - 2).alias("radius"),
    )


def nice_length(most: float) -> tuple[int, str]:
    """The largest 1, 2 or 5 times a power of ten up to ``most``, and its label."""
    power = 10 ** math.floor(math.log10(max(most, 1)))
    n = int(next(m for m in (5, 2, 1) if m * power <= max(most, 1)) * power)
    return n, f"{n // 1_000_000} Mb" if n >= 1_000_000 else f"{n // 1000} kb" if n >= 1000 else f"{n} bp"


def ribbon_svg(blocks: DataFrame, sizes: DataFrame, width: float = 1000, height: float = 300, labels: bool = True) -> str:
    """A drawing of tracks and ribbons (a picture has room for few rows, which are read to the driver)."""
    tracks = ribbon_tracks(sizes, width, height).cache()
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height + 100:g}">']
    for r in ribbons(blocks, tracks).orderBy("block_id").collect():
        out.append(
            f'<path d="M {r.x1:.2f} {r.y1:.2f} C {r.x1:.2f} {r.cy1:.2f} {r.x3:.2f} {r.cy2:.2f} {r.x3:.2f} {r.y2:.2f} L {r.x4:.2f} {r.y2:.2f} C {r.x4:.2f} {r.cy2:.2f} {r.x2:.2f} {r.cy1:.2f} {r.x2:.2f} {r.y1:.2f} Z" fill="{r.colour}" fill-opacity="0.5"/>'
        )
    scale = 1.0
    for t in tracks.orderBy("track", "chrom").collect():
        scale = t["scale"]
        out.append(f'<rect x="{t.x:.2f}" y="{t.y:.2f}" width="{t.w:.2f}" height="10" fill="#ccc"/>')
        if labels:
            out.append(f'<text x="{t.x:.2f}" y="{t.y - 4:.2f}" font-size="10">{escape(t.label)}</text>')
    n, label = nice_length((width - 200) / scale / 5)
    out.append(f'<line x1="100" x2="{100 + n * scale:.2f}" y1="{height + 80:g}" y2="{height + 80:g}" stroke="black"/><text x="100" y="{height + 95:g}" font-size="10">{label}</text></svg>')
    tracks.unpersist()
    return "\n".join(out)


def circle_svg(blocks: DataFrame, sizes: DataFrame, width: float = 800, track: float = 20, labels: bool = True) -> str:
    """A drawing of sectors and chords."""
    sectors = circle_sectors(sizes, width).cache()
    mid, r = width / 2, width / 2 - 50
    large = lambda a, b: int(abs(b - a) > math.pi)
    point = lambda a, d: f"{mid + d * math.cos(a):.2f} {mid + d * math.sin(a):.2f}"
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{width:g}">']
    for c in chords(blocks, sectors, width, track).orderBy("block_id").collect():
        d = c.radius
        out.append(
            f'<path d="M {point(c.a1, d)} A {d:g} {d:g} 0 {large(c.a1, c.a2)} 1 {point(c.a2, d)} Q {mid:g} {mid:g} {point(c.b1, d)} A {d:g} {d:g} 0 {large(c.b1, c.b2)} {int(c.b2 > c.b1)} {point(c.b2, d)} Q {mid:g} {mid:g} {point(c.a1, d)} Z" fill="{PALETTE[c.block_id % 7]}" fill-opacity="0.5"/>'
        )
    for s in sectors.orderBy("begin").collect():
        large = int(s.finish - s.begin > math.pi)
        out.append(f'<path d="M {point(s.begin, r)} A {r:g} {r:g} 0 {large} 1 {point(s.finish, r)} L {point(s.finish, r - track)} A {r - track:g} {r - track:g} 0 {large} 0 {point(s.begin, r - track)} Z" fill="#ccc"/>')
        if labels:
            turn = math.degrees((s.begin + s.finish) / 2) % 360
            turn += 180 if 90 < turn < 270 else 0
            out.append(f'<text x="{s.label_x:.2f}" y="{s.label_y:.2f}" font-size="10" transform="rotate({turn:.1f} {s.label_x:.2f} {s.label_y:.2f})">{escape(s.label)}</text>')
    sectors.unpersist()
    return "\n".join([*out, "</svg>"])
