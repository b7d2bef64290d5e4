"""Queries on k-mers, minimizers, graphs, chains, blocks and layouts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqloom.functions.sequence import canonical, forward_strand
from seqloom.functions.shared import delete, shared_dir, stored
from seqloom.operators import align, chain, graph, layout, merge, minimizers, prefilter, synteny
from seqloom.plans import tables as t
from seqloom.plans.record_queries import six_frames_sql
from seqloom.sources import text as io

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
K, W, GAP = 15, 50, 400


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def _kmers_sql(k: int, source: str = "SELECT doc_id, text AS seq FROM documents") -> str:
    return f"src AS ({source}), km AS (SELECT doc_id, i AS pos, substr(seq, (i + 1)::INT, {k}) AS kmer FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - {k - 1})) AS i FROM src WHERE length(seq) >= {k}))"


_HASHED = f"{_kmers_sql(K)}, h AS (SELECT doc_id, pos, {t.HASH_SQL.format('kmer')} AS hash FROM km)"
_SLIDING = f"""{_HASHED}, win AS (SELECT doc_id, min({{'h': hash, 'p': pos}}) OVER w AS m, count(*) OVER w AS c FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING)),
mi AS (SELECT DISTINCT doc_id AS seq_id, m.p AS pos, m.h AS hash FROM win WHERE c = {W})"""
_EDGES = f"""{_SLIDING}, nx AS (SELECT seq_id, hash AS u, pos AS pos_u, lead(hash) OVER w AS v, lead(pos) OVER w AS pos_v FROM mi WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
ed AS (SELECT u, v, seq_id, pos_u, pos_v, pos_v - pos_u AS dist FROM nx WHERE v IS NOT NULL AND pos_v - pos_u <= {GAP}), wt AS (SELECT u, v, count(*) AS weight FROM ed GROUP BY u, v)"""


def _sketch(spark, sf, mode="sliding"):
    return minimizers.sketch(t.records(spark, sf), K, W, mode=mode, both_strands=False)


@query(f"WITH {_kmers_sql(9)} SELECT kmer, count(*) AS n FROM km GROUP BY kmer HAVING count(*) >= 2")
def kmer_count(spark, sf):
    return minimizers.kmer_rows(t.records(spark, sf), 9).groupBy("kmer").agg(F.count("*").alias("n")).where("n >= 2")


@query(f"WITH {_kmers_sql(11, t.DNA_SQL)} SELECT least(kmer, {t.RC_SQL.format('kmer')}) AS kmer, count(*) FILTER (kmer <= {t.RC_SQL.format('kmer')}) AS n_forward, count(*) AS n FROM km GROUP BY 1")
def kmer_canonical_strand(spark, sf):
    rows = minimizers.kmer_rows(t.dna(spark, sf), 11)
    return rows.select(canonical(F.col("kmer")).alias("c"), forward_strand(F.col("kmer")).alias("f")).groupBy(F.col("c").alias("kmer")).agg(F.count_if("f").alias("n_forward"), F.count("*").alias("n"))


@query(f"WITH {_SLIDING} SELECT * FROM mi")
def minimizers_sliding(spark, sf):
    return _sketch(spark, sf).select("seq_id", F.col("pos").cast("long").alias("pos"), "hash")


_PIECES = f"""{_kmers_sql(K, t.DNA_SQL)}, h AS (SELECT doc_id, pos, {t.HASH_SQL.format('kmer')} AS hash FROM km), win AS (SELECT doc_id, min({{'h': hash, 'p': pos}}) OVER w AS m, count(*) OVER w AS c FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING))"""


@query(f"WITH {_PIECES} SELECT DISTINCT 'd' || doc_id AS name, m.p AS pos, m.h AS hash FROM win WHERE c = {W}")
def minimizers_pieces(spark, sf):
    """Records written as lines of FASTA, read in pieces of a thousand symbols, and sketched piece by piece."""
    path = f"{shared_dir(spark)}/fasta/{uuid.uuid4().hex}"
    lines = F.regexp_replace("seq", "(.{60})", "$1\n")
    t.dna(spark, sf).select(io.fasta_lines(F.concat(F.lit("d"), F.col("name").cast("string")), lines).alias("line")).write.text(path, compression="gzip")
    _, pieces = io.read_fasta_pieces(spark, path, K + W - 2, 1000)
    out = stored(minimizers.sketch(pieces, K, W, "name", both_strands=False, offset="offset").select("name", F.col("pos").cast("long").alias("pos"), "hash"))
    delete(spark, path)
    return out


@query(f"WITH {_HASHED}, l AS (SELECT *, max(pos) OVER (PARTITION BY doc_id) AS n FROM h) SELECT doc_id AS seq_id, pos, hash FROM l WHERE pos >= 25 AND pos <= n - 25")
def minimizers_center(spark, sf):
    return minimizers.sketch(t.records(spark, sf), K, W + 1, mode="centre", both_strands=False).select("seq_id", F.col("pos").cast("long").alias("pos"), "hash")


@query(f"""WITH RECURSIVE {_HASHED}, win AS (SELECT doc_id, pos, min({{'h': hash, 'p': pos}}) OVER w AS m, count(*) OVER w AS c FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING)),
nx AS (SELECT doc_id, list(m.p ORDER BY pos) AS ps FROM win WHERE c = {W} GROUP BY doc_id),
jp AS (SELECT doc_id, ps, ps[1] AS p FROM nx UNION ALL SELECT doc_id, ps, ps[p + 2] FROM jp WHERE p + 2 <= len(ps)),
al AS (SELECT doc_id, p FROM jp UNION SELECT doc_id, ps[-1] FROM nx)
SELECT doc_id AS seq_id, h.pos::INT AS pos, hash, TRUE AS strand FROM al JOIN h USING (doc_id) WHERE h.pos = p""")
def minimizers_jumping(spark, sf):
    return _sketch(spark, sf, "jumping")


@query(f"WITH {_SLIDING} SELECT hash, count(*) AS n FROM mi GROUP BY hash HAVING count(*) BETWEEN 2 AND 1000")
def minimizer_freq(spark, sf):
    return minimizers.frequencies(_sketch(spark, sf))


@query(f"WITH {_kmers_sql(4)} SELECT doc_id AS seq_id, count(*) AS n FROM km WHERE NOT regexp_matches(kmer, '[a-z]') GROUP BY doc_id")
def soft_mask_filter(spark, sf):
    return minimizers.kmer_rows(t.records(spark, sf), 4).where("not rlike(kmer, '[a-z]')").groupBy("seq_id").agg(F.count("*").alias("n"))


def _edges(spark, sf):
    return graph.adjacency(_sketch(spark, sf), GAP)


@query(f"WITH {_EDGES} SELECT * FROM ed")
def graph_edges(spark, sf):
    return _edges(spark, sf).select("u", "v", "seq_id", *[F.col(c).cast("long").alias(c) for c in ("pos_u", "pos_v", "dist")])


@query(f"WITH {_EDGES} SELECT u, v, weight FROM wt WHERE weight >= 2")
def graph_prune(spark, sf):
    return graph.weights(graph.prune(_edges(spark, sf), 2))


@query(f"""WITH {_EDGES}, p AS (SELECT u, v FROM wt WHERE weight >= 2), n AS (SELECT u AS node, 1 AS o, 0 AS i FROM p UNION ALL SELECT v, 0, 1 FROM p)
SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM n GROUP BY node""")
def graph_degrees(spark, sf):
    return graph.degrees(graph.prune(_edges(spark, sf), 2))


@query()
def graph_transitive_reduction(spark, sf):
    return graph.weights(graph.transitive_reduction(graph.prune(_edges(spark, sf), 2)))


@query(f"""WITH RECURSIVE {_EDGES}, p AS (SELECT u, v FROM wt WHERE weight >= 2), ke AS (SELECT ed.* FROM ed SEMI JOIN p USING (u, v)),
fi AS (SELECT node, min(pl) AS pl FROM (SELECT u AS node, {{'s': seq_id, 'p': pos_u}} AS pl FROM ke UNION ALL SELECT v, {{'s': seq_id, 'p': pos_v}} FROM ke) GROUP BY node),
st AS (SELECT u, v FROM p WHERE u IN (SELECT u FROM p GROUP BY u HAVING count(*) = 1) AND v IN (SELECT v FROM p GROUP BY v HAVING count(*) = 1)),
wk AS (SELECT node AS path, 0::BIGINT AS ord, node FROM fi WHERE node NOT IN (SELECT v FROM st) UNION ALL SELECT path, ord + 1, v FROM wk JOIN st ON node = u),
cy AS (SELECT node AS path, 0::BIGINT AS ord, node FROM fi WHERE node NOT IN (SELECT node FROM wk) UNION ALL SELECT path, ord + 1, v FROM cy JOIN st ON node = u WHERE v <> path),
cm AS (SELECT path FROM cy JOIN fi USING (node) GROUP BY path HAVING arg_min(node, pl) = path)
SELECT * FROM wk UNION ALL SELECT * FROM cy WHERE path IN (SELECT path FROM cm)""")
def graph_linear_paths(spark, sf):
    return graph.linear_paths(graph.prune(_edges(spark, sf), 2))


@query()
def mmg_blocks(spark, sf):
    options = synteny.BlockOptions(k=K, rounds=(100, 50), chain_gap=GAP)
    return synteny.find_blocks(t.records(spark, sf), options)


_ANCHORS = """f AS (SELECT 'o' || o_orderkey AS acc, 'm' || (o_custkey % 10) AS mol, floor((o_orderkey * 200 + 50) / 2.0 + 0.5)::INT AS mid FROM orders),
mt AS (SELECT 'o' || l_orderkey AS acc1, 'o' || l_partkey AS acc2, (l_discount * 10)::FLOAT * 50::FLOAT AS score, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS line_no FROM lineitem),
j AS (SELECT a.mol AS m1, b.mol AS m2, acc1, acc2, a.mid AS p1, b.mid AS p2, score, line_no FROM mt JOIN f a ON acc1 = a.acc JOIN f b ON acc2 = b.acc WHERE acc1 <> acc2),
s AS (SELECT *, m1 > m2 OR (m1 = m2 AND (p1 > p2 OR (p1 = p2 AND acc1 > acc2))) AS sw FROM j),
pl AS (SELECT CASE WHEN sw THEN m2 ELSE m1 END AS mol1, CASE WHEN sw THEN m1 ELSE m2 END AS mol2, CASE WHEN sw THEN acc2 ELSE acc1 END AS a1, CASE WHEN sw THEN acc1 ELSE acc2 END AS a2,
  CASE WHEN sw THEN p2 ELSE p1 END AS x, CASE WHEN sw THEN p1 ELSE p2 END AS y, score, line_no FROM s),
be AS (SELECT mol1, mol2, a1, a2, x, y, max(score) AS score, min(line_no) AS line_no FROM pl GROUP BY ALL),
an AS (SELECT mol1, mol2, a1 AS acc1, a2 AS acc2, x, y, score FROM (SELECT *, row_number() OVER (PARTITION BY mol1, mol2, x, y ORDER BY line_no) AS n FROM be) WHERE n = 1)"""


def _anchors(spark, sf):
    return chain.anchors(t.matches(spark, sf), t.positions(spark, sf))


@query(f"WITH {_ANCHORS} SELECT mol1, mol2, acc1, acc2, x, y, round(score::DOUBLE, 3) AS score FROM an")
def dag_anchors(spark, sf):
    # the SQL has places of 32 bits
    return _anchors(spark, sf).withColumns({"score": F.round(F.col("score").cast("double"), 3)} | {c: F.col(c).cast("int") for c in "xy"})


STEP = chain.ChainOptions(max_distance=2000, gap_unit=300, min_pairs=2)


@query(f"""WITH {_ANCHORS}, pr AS (SELECT b.mol1, b.mol2, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj, b.x - a.x - 1 AS dx, b.y - a.y - 1 AS dy FROM an a JOIN an b ON a.mol1 = b.mol1 AND a.mol2 = b.mol2 AND a.x < b.x AND b.x - a.x - 1 <= 2000 AND a.y < b.y AND b.y - a.y - 1 <= 2000)
SELECT mol1, mol2, xi, yi, xj, yj, trunc(greatest(dx, dy)::FLOAT / 300::FLOAT + 0.5::FLOAT)::INT AS units FROM pr""")
def dag_predecessors(spark, sf):
    return chain.predecessors(_anchors(spark, sf), STEP).withColumns({c: F.col(c).cast("int") for c in ("xi", "yi", "xj", "yj")})


@query()
def dag_chains(spark, sf):
    return chain.chain_ranges(chain.chains(_anchors(spark, sf), STEP), t.positions(spark, sf))


_BLOCKS = """j AS (SELECT l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 AS block_id, c_nationkey AS cn, s_nationkey AS sn, l_orderkey * 10 AS s1, l_partkey * 10 AS s2, l_quantity::BIGINT AS q, l_quantity AS score, l_returnflag = 'R' AS back
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
r1 AS (SELECT block_id, min({'n': 'A' || (cn % 3) || '.c' || cn, 's': s1, 'e': s1 + q, 't': '+', 'q': score}) AS x FROM j GROUP BY block_id),
r2 AS (SELECT block_id, min({'n': 'B' || (sn % 3) || '.c' || sn, 's': s2, 'e': s2 + q, 't': CASE WHEN back THEN '-' ELSE '+' END, 'q': score}) AS y FROM j GROUP BY block_id),
tw AS (SELECT block_id, x, y FROM r1 JOIN r2 USING (block_id)),
c AS (SELECT split_part(chrom, '.', 1) AS genome, chrom, max(e) AS length FROM (SELECT x.n AS chrom, x.e AS e FROM tw UNION ALL SELECT y.n, y.e FROM tw) GROUP BY chrom)"""


@query(f"""WITH RECURSIVE {_BLOCKS}, bl AS (SELECT x.n AS f, row_number() OVER (PARTITION BY x.n ORDER BY x.s, block_id) AS k, x.s AS s1, x.e AS e1, x.q::DOUBLE AS q1, y.n AS n2, y.s AS s2, y.e AS e2, y.t AS t2, y.q::DOUBLE AS q2 FROM tw),
fo AS (SELECT *, 1::BIGINT AS island FROM bl WHERE k = 1 UNION ALL
  SELECT f, k, CASE WHEN ok THEN least(a1, s1) ELSE s1 END, CASE WHEN ok THEN greatest(b1, e1) ELSE e1 END, CASE WHEN ok THEN c1 + q1 ELSE q1 END, n2, CASE WHEN ok THEN least(a2, s2) ELSE s2 END, CASE WHEN ok THEN greatest(b2, e2) ELSE e2 END, t2, CASE WHEN ok THEN c2 + q2 ELSE q2 END, island + (NOT ok)::INT
  FROM (SELECT n.*, o.s1 AS a1, o.e1 AS b1, o.q1 AS c1, o.s2 AS a2, o.e2 AS b2, o.q2 AS c2, island, n.n2 = o.n2 AND n.t2 = o.t2 AND NOT (n.s1 < o.e1 AND n.s1 < o.s1) AND n.s1 - o.e1 <= 100000
    AND CASE WHEN n.t2 = '-' THEN n.e2 <= o.s2 AND o.s2 - n.e2 <= 100000 ELSE NOT (n.s2 < o.e2 AND n.s2 < o.s2) AND n.s2 - o.e2 <= 100000 END AS ok FROM fo o JOIN bl n ON n.f = o.f AND n.k = o.k + 1)),
la AS (SELECT * FROM fo QUALIFY row_number() OVER (PARTITION BY f, island ORDER BY k DESC) = 1)
SELECT f AS first_seq, island, 1::BIGINT AS ord, f AS seq_name, s1 AS start, e1 AS "end", '+' AS strand, q1 AS score FROM la UNION ALL SELECT f, island, 2, n2, s2, e2, t2, q2 FROM la""")
def merge_blocks(spark, sf):
    return merge.merge_blocks(t.two_ranges(spark, sf), 100_000)


@query()
def das_align(spark, sf):
    b = t.load(spark, sf, "benchmark").select("item_id", F.split("text", r"\s+").alias("tokens"))
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("tokens").alias("other")), "item_id")
    done = align.align_pairs(pairs, "tokens", "other")
    return done.select("item_id", F.array_join("row1", " ").alias("row1"), F.array_join("row2", " ").alias("row2"), F.round("score", 3).alias("score"))


_SIZES = "c AS (SELECT 'A' || (c_nationkey % 3) AS genome, 'A' || (c_nationkey % 3) || '.c' || c_nationkey AS chrom, sum(floor(abs(c_acctbal)))::BIGINT AS length FROM customer GROUP BY ALL)"


@query(f"""WITH {_SIZES}, g AS (SELECT genome, sum(length) AS t, row_number() OVER (ORDER BY genome) - 1 AS track FROM c GROUP BY genome), m AS (SELECT max(t) AS m, count(*) AS n FROM g)
SELECT genome, chrom, round(100 + coalesce(sum((length + m * 0.01) * (800.0 / greatest(m, 1))) OVER (PARTITION BY genome ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS x,
  round(length * (800.0 / greatest(m, 1)), 4) AS w, round(50 + track * 300.0 / n + 300.0 / n / 2, 4) AS y FROM c JOIN g USING (genome), m""")
def ribbon_layout(spark, sf):
    return layout.ribbon_tracks(t.sizes(spark, sf)).select("genome", "chrom", *[F.round(c, 4).alias(c) for c in ("x", "w", "y")])


@query(f"""WITH {_BLOCKS}, g AS (SELECT genome, sum(length) AS t, row_number() OVER (ORDER BY genome) - 1 AS track FROM c GROUP BY genome), m AS (SELECT max(t) AS m, count(*) AS n FROM g),
k AS (SELECT chrom, 800.0::DOUBLE / greatest(m, 1) AS sc, 50 + track * (300.0::DOUBLE / n) + 300.0::DOUBLE / n / 2 AS y0,
  100 + coalesce(sum((length + m * 0.01::DOUBLE) * (800.0::DOUBLE / greatest(m, 1))) OVER (PARTITION BY genome ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0 FROM c JOIN g USING (genome), m)
SELECT block_id, round(a.x0 + x.s * a.sc, 4) AS x1, round(a.x0 + x.e * a.sc, 4) AS x2, round(a.y0 + 10, 4) AS y1, round(b.x0 + CASE WHEN x.t <> y.t THEN y.e ELSE y.s END * b.sc, 4) AS x3,
  round(b.x0 + CASE WHEN x.t <> y.t THEN y.s ELSE y.e END * b.sc, 4) AS x4, round(b.y0, 4) AS y2, ({list(layout.PALETTE)})[block_id % 7 + 1] AS colour FROM tw JOIN k a ON a.chrom = x.n JOIN k b ON b.chrom = y.n""")
def ribbon_paths(spark, sf):
    blocks = t.two_ranges(spark, sf)
    found = layout.ribbons(blocks, layout.ribbon_tracks(layout.inferred_sizes(blocks)))
    return found.select("block_id", *[F.round(c, 4).alias(c) for c in ("x1", "x2", "y1", "x3", "x4", "y2")], "colour")


def _inside_sql(pattern: str, name: str) -> str:
    """Blocks whose two sequences are renamed, in tracks of one genome or more, their curves with them."""
    new = ", ".join(f"{{'n': regexp_replace({r}.n, '{pattern}', '{name}'), 's': {r}.s, 'e': {r}.e, 't': {r}.t, 'q': {r}.q}} AS {r}" for r in "xy")
    return f"""WITH {_BLOCKS.replace("SELECT block_id, x, y FROM r1", f"SELECT block_id, {new} FROM r1")}, g AS (SELECT genome, sum(length) AS t, row_number() OVER (ORDER BY genome) - 1 AS track FROM c GROUP BY genome), m AS (SELECT max(t) AS m, greatest(count(*), 2) AS n, count(*) = 1 AS alone FROM g),
k AS (SELECT chrom, track, alone, n, 800.0::DOUBLE / greatest(m, 1) AS sc, 300.0::DOUBLE / n AS th,
  100 + coalesce(sum((length + m * 0.01::DOUBLE) * (800.0::DOUBLE / greatest(m, 1))) OVER (PARTITION BY genome ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0 FROM c JOIN g USING (genome), m),
q AS (SELECT block_id, a.x0 + x.s * a.sc AS x1, b.x0 + CASE WHEN x.t <> y.t THEN y.e ELSE y.s END * b.sc AS x3, a.th, 50 + a.track * a.th + a.th / 2 + 10 AS y1, CASE WHEN a.alone THEN 50 + b.th + b.th / 2 ELSE 50 + b.track * b.th + b.th / 2 END AS yt, NOT a.alone AND a.track = b.track AS inside
  FROM tw JOIN k a ON a.chrom = x.n JOIN k b ON b.chrom = y.n),
r AS (SELECT *, CASE WHEN inside THEN y1 ELSE yt END AS y2, CASE WHEN inside THEN least(greatest(abs(x1 - x3) * 0.2, 20), th * 0.8) ELSE (yt - y1) / 2 END AS h FROM q)
SELECT block_id, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x3, 4) AS x3, round(y2, 4) AS y2, round(y1 + h, 4) AS cy1, round(CASE WHEN inside THEN y2 + h ELSE y2 - h END, 4) AS cy2 FROM r"""


def _inside(spark, sf, pattern, name):
    blocks = t.two_ranges(spark, sf).withColumn("seq_name", F.regexp_replace("seq_name", pattern, name))
    found = layout.ribbons(blocks, layout.ribbon_tracks(layout.inferred_sizes(blocks)))
    return found.select("block_id", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x3", "y2", "cy1", "cy2")])


@query(_inside_sql("^B", "A"))
def ribbon_arcs(spark, sf):
    """Blocks between three genomes of one set: arcs where both ends are in one track."""
    return _inside(spark, sf, "^B", "A")


@query(_inside_sql("^[AB][0-9]", "S"))
def ribbon_self(spark, sf):
    """A genome against itself, in two tracks."""
    return _inside(spark, sf, "^[AB][0-9]", "S")


@query(f"""WITH {_SIZES}, w AS (SELECT sum(length) AS t, count(*) AS n FROM c), p AS (SELECT genome, chrom, length, radians(360.0 - 2.0 * n) / greatest(t, 1) AS per FROM c, w),
b AS (SELECT *, radians(-90.0) + coalesce(sum(length * per + radians(2.0)) OVER (ORDER BY genome, chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM p)
SELECT genome, chrom, round(begin, 5) AS begin, round(begin + length * per, 5) AS finish, round(400 + 365 * cos(begin + length * per / 2), 3) AS label_x, round(400 + 365 * sin(begin + length * per / 2), 3) AS label_y FROM b""")
def circle_layout(spark, sf):
    return layout.circle_sectors(t.sizes(spark, sf)).select("genome", "chrom", F.round("begin", 5).alias("begin"), F.round("finish", 5).alias("finish"), F.round("label_x", 3).alias("label_x"), F.round("label_y", 3).alias("label_y"))


@query(f"""WITH {_BLOCKS}, w AS (SELECT sum(length) AS t, count(*) AS n FROM c), p AS (SELECT genome, chrom, length, radians(360.0 - 2.0 * n) / greatest(t, 1) AS per FROM c, w),
k AS (SELECT chrom, per, radians(-90.0) + coalesce(sum(length * per + radians(2.0)) OVER (ORDER BY genome, chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM p)
SELECT block_id, round(a.g + x.s * a.per, 5) AS a1, round(a.g + x.e * a.per, 5) AS a2, round(b.g + CASE WHEN x.t = y.t THEN y.e ELSE y.s END * b.per, 5) AS b1,
  round(b.g + CASE WHEN x.t = y.t THEN y.s ELSE y.e END * b.per, 5) AS b2, 328.0::DOUBLE AS radius FROM tw JOIN k a ON a.chrom = x.n JOIN k b ON b.chrom = y.n""")
def circle_chords(spark, sf):
    blocks = t.two_ranges(spark, sf)
    found = layout.chords(blocks, layout.circle_sectors(layout.inferred_sizes(blocks)))
    return found.select("block_id", *[F.round(c, 5).alias(c) for c in ("a1", "a2", "b1", "b2")], "radius")


def _sets_sql(source: str) -> str:
    """Distinct minimizers (k = 4, w = 2) of ``(sid, seq)``."""
    return f"""SELECT DISTINCT sid, m.h AS hash FROM (SELECT sid, min({{'h': hash, 'p': i}}) OVER w AS m, count(*) OVER w AS c FROM (SELECT sid, i, {t.HASH_SQL.format('substr(seq, (i + 1)::INT, 4)')} AS hash
  FROM (SELECT sid, seq, unnest(range(0, length(seq) - 3)) AS i FROM {source} WHERE length(seq) >= 4)) WINDOW w AS (PARTITION BY sid ORDER BY i ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)) WHERE c = 2"""


@query(f"""WITH fr AS ({six_frames_sql(15)}), op AS MATERIALIZED (SELECT *, row_number() OVER () AS sid FROM fr), q AS (SELECT sid, protein AS seq FROM op),
bm AS (SELECT item_id AS sid, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACDEFGHIKLMNPQRSTVWYACDEFG') AS seq FROM benchmark),
own AS ({_sets_sql('q')}), known AS (SELECT DISTINCT hash FROM ({_sets_sql('bm')})),
ct AS (SELECT sid, count(*) AS n_shared FROM own SEMI JOIN known USING (hash) GROUP BY sid)
SELECT name, strand, frame, start, "end", n_shared FROM op JOIN ct USING (sid)""")
def prefilter_hits(spark, sf):
    proteins = t.load(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACDEFGHIKLMNPQRSTVWYACDEFG").alias("seq"))
    return prefilter.prefilter(t.dna(spark, sf), proteins, k=4, w=2, least=15)
