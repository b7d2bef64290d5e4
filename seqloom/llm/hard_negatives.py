"""Hard negatives by one-dimensional distance keys: an exact search for the largest inner products under a bound.

A vector gets one more component, which lifts all of them to one length M; the nearest lifted vectors of an anchor (with a zero there) are then those of the largest
inner product.  Every vector is stored under the key (nearest pivot, distance to it), in order, and cut into segments of neighbouring keys.  What is within r of
an anchor has, for each pivot, a distance to it that is within r of the anchor's own: an interval of keys on either side, an annulus around the pivot.  The
search goes outwards: each round scans the segments that a wider radius adds, keeps the best, and ends for an anchor when what it still lacks must lie within
the radius that has been scanned.  Anchors go through this in blocks of neighbouring keys, so a segment meets a block, not each of its anchors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from seqloom.llm._store import clean_name, discard, map_arrow, materialise

#: Pivots, and rows (those of the least hashed ids) on which they are fitted: a sample that only decides how well the search prunes.
PIVOTS, SAMPLE_ROWS = 64, 4096
#: Rows of a segment and anchors of a block.
SEGMENT_ROWS, BLOCK_ROWS = 512, 1024
#: Parts of the largest distance that an unsatisfied search adds at least, and into which key intervals are cut to meet segments.
STEPS, CELLS = 16, 256


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 3
    #: Negatives score between these percentages of the positive.
    least: int = 50
    most: int = 95


@dataclass(frozen=True)
class _Space:
    """What all tasks know: pivots (lifted), the length M to which vectors are lifted, and the number of components."""

    pivots: np.ndarray
    length2: int
    dims: int

    @property
    def slack(self) -> float:
        # over the rounding of distances in double precision
        return 1e-6 * max(1.0, self.length2**0.5)

    @property
    def widest(self) -> float:
        return 2 * self.length2**0.5 + 2 * self.slack

    def distances(self, x: np.ndarray, lifted: bool) -> np.ndarray:
        """Distances of vectors to all pivots; anchors are not lifted."""
        n2 = (x * x).sum(axis=1)
        last = np.sqrt(np.maximum(self.length2 - n2, 0)) if lifted else np.zeros(len(x))
        p = self.pivots
        square = (n2 + last * last)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * (x @ p[:, :-1].T + last[:, None] * p[None, :, -1])
        return np.sqrt(np.maximum(square, 0))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as doubles, short ones filled with zeros."""
    ends = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.float64)
    sizes = np.diff(ends)
    if (sizes == dims).all():
        return values.reshape(len(lists), dims)
    out = np.zeros((len(lists), dims))
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], sizes)] = values
    return out


def integer_vectors(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``(id, label, v)``: rows that have an id, a label and a vector of finite components, each component times ``scale`` rounded down."""
    rows = clean_name(df, id_col, label_col, vector_col).toDF("id", "label", "v").where("id is not null and label is not null and v is not null")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform("v", lambda x: F.floor(x.cast("double") * float(scale)))
    small = F.forall(scaled, lambda x: F.abs(x) < (1 << 31) - 1)
    fits = F.when(small, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit("a component is beyond 31 bits")).cast("array<int>"))
    return rows.where(whole).select("id", "label", fits.alias("v"))


def _pivots(rows: DataFrame, length2: int, dims: int) -> np.ndarray:
    """Centres of the sample in the lifted space: the farthest vectors in turn, then some rounds of means."""
    sample = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE_ROWS).select("v").toArrow()
    x = _matrix(sample.column(0).combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.int32())), dims)
    x = np.concatenate([x, np.sqrt(np.maximum(length2 - (x * x).sum(axis=1), 0))[:, None]], axis=1)
    chosen, reach = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < PIVOTS and reach.max() > 0:
        chosen.append(int(reach.argmax()))
        reach = np.minimum(reach, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    p = x[chosen]
    for _ in range(6):
        own = ((p * p).sum(axis=1)[None, :] - 2 * x @ p.T).argmin(axis=1)
        counts = np.bincount(own, minlength=len(p))
        sums = np.zeros_like(p)
        np.add.at(sums, own, x)
        p = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], p)
    return p


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` stored in order, with ``rank`` from 0.  A task counts its rows as it writes them; a file then starts where those before it end."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(at, at + n))], [*batch.schema.names, "_shard", "_at"])
            at += n

    kept = materialise(ranged.mapInArrow(run, StructType([*ranged.schema.fields, StructField("_shard", IntegerType()), StructField("_at", LongType())])))
    # one row per file
    before = F.sum("n").over(Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = kept.groupBy("_shard").agg(F.count("*").alias("n")).select("_shard", F.coalesce(before, F.lit(0)).alias("_base"))
    out = kept.join(F.broadcast(bases), "_shard").withColumn("rank", F.col("_base") + F.col("_at")).drop("_shard", "_base", "_at")
    out._seqloom_path = kept._seqloom_path  # noqa: SLF001
    return out


def _keyed(rows: DataFrame, space: _Space) -> DataFrame:
    """``rows`` with ``(pivot, dist)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = space.distances(_matrix(batch.column(2), space.dims), lifted=True)
            pivot = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(d)), pivot])], [*batch.schema.names, "pivot", "dist"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return map_arrow(rows, run, f"id {kinds['id']}, label {kinds['label']}, v array<int>, pivot int, dist double")


def _block_spans(anchors: DataFrame, space: _Space) -> DataFrame:
    """``(block, pivot, near, far)``: the distances that a block's anchors have to each pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = space.distances(_matrix(batch.column(1), space.dims), lifted=False)
            blocks, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            near, far = np.full((len(blocks), d.shape[1]), np.inf), np.zeros((len(blocks), d.shape[1]))
            np.minimum.at(near, at, d)
            np.maximum.at(far, at, d)
            pivots = np.tile(np.arange(d.shape[1], dtype=np.int32), len(blocks))
            yield pa.record_batch([pa.array(np.repeat(blocks, d.shape[1])), pa.array(pivots), pa.array(near.ravel()), pa.array(far.ravel())], ["block", "pivot", "near", "far"])

    return map_arrow(anchors.select("block", "v"), run, "block long, pivot int, near double, far double").groupBy("block", "pivot").agg(F.min("near").alias("near"), F.max("far").alias("far"))


def _meetings(blocks: DataFrame, spans: DataFrame, segments: DataFrame, space: _Space) -> DataFrame:
    """``(block, seg)`` pairs that each block's radius ``r1`` adds to ``r0``.

    A segment lies as far outside as its keys are from the block's.  Key intervals are cut into cells, so this is an equi-join; a pair counts in the first cell that both have.
    """
    size = space.widest / CELLS
    cell = lambda x: F.greatest(F.floor(x / size), F.lit(-1))
    wide = blocks.join(spans, "block").withColumns({"c0": cell(F.col("near") - F.col("r1")), "c1": cell(F.least(F.col("far") + F.col("r1"), F.lit(2 * space.widest)))})
    wide = wide.select("*", F.explode(F.sequence("c0", "c1")).alias("cell"))
    held = segments.withColumns({"s0": cell(F.col("lo")), "s1": cell(F.col("hi"))}).select("*", F.explode(F.sequence("s0", "s1")).alias("cell"))
    gap = F.greatest(F.col("lo") - F.col("far"), F.col("near") - F.col("hi"), F.lit(0.0))
    return wide.join(held, ["pivot", "cell"]).where((F.col("cell") == F.greatest("c0", "s0")) & (gap > F.col("r0")) & (gap <= F.col("r1"))).select("block", "seg")


def _best(found: list[np.ndarray], new: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The first ``k`` of each target among ``(target, score, id)`` columns: larger scores first, then smaller ids."""
    target, score, own = (np.concatenate([a, b]) for a, b in zip(found, new, strict=True))
    order = np.lexsort((own, -score, target))
    target = target[order]
    first = np.searchsorted(target, target)
    keep = np.arange(len(target)) - first < k
    return [target[keep], score[order][keep], own[order][keep]]


def _scan(anchors: DataFrame, index: DataFrame, pairs: DataFrame, space: _Space, k: int, same: bool) -> DataFrame:
    """``(qid, target, id, score)``: of the segments that each anchor's block meets, the ``k`` best rows for each target, a few times over.

    Each anchor has the same number of targets ``caps`` and ``floors`` at most: a row counts for a target if its score is between them, and if its label is the anchor's (``same``) or not.
    A task reads a block's anchors, then the rows of one segment after the other against them.
    """
    left = pairs.join(anchors.select("block", "qid", "id", "label", "v", "caps", "floors"), "block").withColumn("kind", F.lit(0))
    right = pairs.join(index.select("seg", "id", "label", "v"), "seg").withColumn("kind", F.lit(1))
    both = left.unionByName(right, allowMissingColumns=True).select("block", "seg", "kind", "qid", "id", "label", "v", "caps", "floors")
    dealt = both.repartition("block", "seg").sortWithinPartitions("block", "seg", "kind")
    none = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = seg = None
        qid = ids = labels = vectors = caps = floors = low = None
        held: list[pa.RecordBatch] = []
        found = none

        def out() -> pa.RecordBatch:
            at, target = np.divmod(found[0], width)
            return pa.record_batch([pa.array(qid[at]), pa.array(target.astype(np.int32)), pa.array(found[2]), pa.array(found[1].astype(np.int64))], ["qid", "target", "id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                part, (own_block, own_seg, kind) = batch.slice(a, b - a), keys[a]
                if own_block != block and block is not None and len(found[0]):
                    yield out()
                if own_block != block:
                    block, found, qid = own_block, none, None
                    seg = None
                if own_seg != seg:
                    seg, held = own_seg, []
                if kind == 0:
                    # a block's anchors come again before each segment; they are needed once
                    held.append(part)
                    continue
                if qid is None:
                    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    qid, ids, labels = rows.column(3).to_numpy(), rows.column(4).to_numpy(), rows.column(5).to_numpy()
                    vectors = _matrix(rows.column(6), space.dims)
                    width = max(1, max((len(x) for x in rows.column(7)), default=1))
                    caps, floors = np.full((len(qid), width), -np.inf), np.full((len(qid), width), np.inf)
                    for i, (c, f) in enumerate(zip(rows.column(7).to_pylist(), rows.column(8).to_pylist(), strict=True)):
                        caps[i, : len(c)], floors[i, : len(f)] = c, f
                    low = floors.copy()
                own, kinds = part.column(4).to_numpy(), part.column(5).to_numpy()
                scores = vectors @ _matrix(part.column(6), space.dims).T
                alike = labels[:, None] == kinds[None, :]
                allowed = (alike if same else ~alike) & (ids[:, None] != own[None, :])
                new = [[], [], []]
                for j in range(width):
                    q, x = np.nonzero(allowed & (scores <= caps[:, j, None]) & (scores >= low[:, j, None]))
                    for column, values in zip(new, (q * width + j, scores[q, x], own[x]), strict=True):
                        column.append(values)
                new = [np.concatenate(c) for c in new]
                if len(new[0]):
                    found = _best(found, new, k)
                    # from now on only what is as good as the last of k can count
                    full, size = np.unique(found[0], return_counts=True)
                    last = np.searchsorted(found[0], full, side="right") - 1
                    done = size == k
                    low.ravel()[full[done]] = np.maximum(low.ravel()[full[done]], found[1][last[done]])
        if len(found[0]):
            yield out()

    kind = index.schema["id"].dataType.simpleString()
    return map_arrow(dealt, run, f"qid long, target int, id {kind}, score long")


def _distance(score: Column, space: _Space) -> Column:
    """How far from an anchor (column ``n2``: its squared length) a row of this score is, with some room for rounding."""
    return F.sqrt(F.greatest(F.col("n2") + F.lit(float(space.length2)) - 2.0 * score, F.lit(0.0))) * (1 + 1e-9) + space.slack


def _search(anchors: DataFrame, targets: DataFrame, index: DataFrame, spans: DataFrame, segments: DataFrame, space: _Space, k: int, same: bool) -> DataFrame:
    """``(qid, target, rank, id, score)``: the ``k`` best of every target, by rounds of growing radius.

    ``targets`` has ``(block, qid, target, n2, cap, floor, r)``, where ``r`` is a radius that the target needs in any case and ``floor`` null where any score counts.  A target
    is certain when all within the distance of its last row, or of its floor, has been scanned; a block's radius is what its anchors need most.
    """
    step = space.widest / STEPS
    blocks = materialise(targets.groupBy("block").agg(F.lit(-1.0).alias("r0"), F.max("r").alias("r1")))
    found = None
    best = Window.partitionBy("qid", "target").orderBy(F.desc("score"), "id")
    while True:
        pairs = materialise(_meetings(blocks, spans, segments, space))
        active = anchors.join(blocks.select("block"), "block", "left_semi")
        new = _scan(active, index, pairs, space, k, same)
        if found is not None:
            new = new.unionByName(found.select("qid", "target", "id", "score"))
        ranked = materialise(new.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        discard(pairs, *([found] if found is not None else []))
        found = ranked
        ends = found.where(F.col("rank") == k).select("qid", "target", F.col("score").alias("last"))
        open_ones = targets.join(blocks, "block").join(ends, ["qid", "target"], "left")
        farther = F.greatest(F.col("r1") * 2, F.col("r1") + step)
        limit = F.when(F.col("floor").isNotNull(), _distance(F.col("floor"), space)).otherwise(F.lit(space.widest))
        need = F.least(F.when(F.col("last").isNotNull(), _distance(F.col("last"), space)).otherwise(F.greatest(F.least(limit, farther), F.lit(0.0))), limit, F.lit(space.widest))
        wanting = open_ones.withColumn("need", need).where((F.col("need") > F.col("r1")) & (F.col("cap").isNull() | F.col("floor").isNull() | (F.col("floor") <= F.col("cap"))))
        following = materialise(wanting.groupBy("block").agg(F.max("r1").alias("r0"), F.max("need").alias("r1")))
        discard(blocks)
        blocks = following
        if blocks.isEmpty():
            discard(blocks)
            return found


def mine(rows: DataFrame, every: int = 50, mining: Mining | None = None) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``(id, label, v)`` rows of whole numbers, ``label`` not null.

    Anchors are the rows whose id is divisible by ``every``.  An anchor's positives are its first rows of the same label by inner product, ties by smaller id, and for each
    of them its negatives are the first rows of another label that score between two percentages of it.  The search is exact: pivots come from a sample, but all rows are
    indexed, and no row is left out unless its key proves that it can't count.

    Rows repeated with one id take part each by itself, but none is a positive or negative of its own id.  Equal vectors are told apart by their ids.  Vectors of unequal length are
    filled with zeros.  Squared lengths from 2^53 fail the query.  An empty table, or one without anchors, gives no rows.
    """
    o = mining or Mining()
    spark = rows.sparkSession
    given = materialise(rows.select("id", "label", "v"))
    # a null, where there are no rows
    squares = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    stats = given.agg(F.max(squares).alias("n2"), F.max(F.size("v")).alias("dims")).first()
    kind = given.schema["id"].dataType.simpleString()
    if stats["n2"] is None:
        discard(given)
        return spark.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long")
    if stats["n2"] >= 1 << 53:
        raise ValueError("inner products of vectors beyond a squared length of 2^53 are not exact")
    space = _Space(_pivots(given, stats["n2"], stats["dims"]), stats["n2"], stats["dims"])
    placed = _numbered(_keyed(given, space), "pivot", "dist", "id")
    index = placed.withColumn("seg", F.floor(F.col("rank") / SEGMENT_ROWS) * len(space.pivots) + F.col("pivot"))
    segments = materialise(index.groupBy("seg", "pivot").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi")))
    chosen = _numbered(placed.where(F.col("id") % every == 0).select("id", "label", "v", "pivot", "dist"), "pivot", "dist", "id")
    anchors = chosen.select(F.floor(F.col("rank") / BLOCK_ROWS).alias("block"), F.col("rank").alias("qid"), "id", "label", "v", squares.cast("double").alias("n2"))
    spans = materialise(_block_spans(anchors, space))

    # the positives: any score counts
    free = anchors.withColumns({"caps": F.array(F.lit(float("inf"))), "floors": F.array(F.lit(float("-inf")))})
    none = F.lit(None).cast("long")
    wanted = anchors.select("block", "qid", F.lit(0).alias("target"), "n2", none.alias("cap"), none.alias("floor"), F.lit(0.0).alias("r"))
    positives = _search(free, wanted, index, spans, segments, space, o.positives, same=True)

    # the negatives of each: scores under a cap, over a floor
    whole = F.col("score").cast("decimal(20,0)")
    cap = F.floor(whole * o.most / F.lit(100)).cast("long").alias("cap")
    floor = F.ceil(whole * o.least / F.lit(100)).cast("long").alias("floor")
    bounds = materialise(positives.select("qid", (F.col("rank") - 1).alias("target"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), cap, floor))
    lists = bounds.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("target", "cap", "floor"))).alias("b"))
    limited = anchors.join(lists, "qid").withColumns({"caps": F.col("b.cap").cast("array<double>"), "floors": F.col("b.floor").cast("array<double>")}).drop("b")
    wanted = anchors.select("block", "qid", "n2").join(bounds, "qid").where("floor <= cap").select("block", "qid", "target", "n2", "cap", "floor", _distance(F.col("cap"), space).alias("r"))
    negatives = _search(limited, wanted, index, spans, segments, space, o.negatives, same=False)

    named = negatives.select("qid", "target", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(bounds.select("qid", "target", "positive_id", "positive_score"), ["qid", "target"])
    result = materialise(named.join(anchors.select("qid", F.col("id").alias("anchor_id")), "qid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    discard(given, placed, segments, chosen, spans, positives, bounds, negatives)
    return result


def relabelled(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Rows whose id is divisible by ``every`` under the next label."""
    return rows.withColumn("label", F.when(F.col("id") % every == 0, ((F.col("label") + 1) % labels).cast(rows.schema["label"].dataType)).otherwise(F.col("label")))


#: DuckDB SQL for ``mine`` over the relabelled table, by comparing each anchor with every row.
ORACLE = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b AS pos, p.score AS ps, s.b AS neg, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS k FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, pos AS positive_id, k::INT AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 3"""
