"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model on text statistics gives each document's evidence.  Documents are grouped by host and, inside it, by
path; each group's rate of good documents is shrunk towards its parent's (path to host, host to the whole corpus) by a
strength that the spread between groups itself sets (method of moments).  A document's posterior joins its own evidence with its
path's rate, taken without the document itself.  Groups are summed by grouped aggregation, so a hot host costs one partial sum a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm._store import as_bytes, clean_name, map_arrow, materialise, slabs

#: Labelled documents that the logistic model is fitted on at most (those with the smallest hashes of their ids).
TRAINING_ROWS = 20_000
#: Groups of which so many at most are broadcast; of more each is dealt out to ``SALTS`` places, so that a hot host is split.
BROADCAST_GROUPS, SALTS = 100_000, 16
#: Bounds of the strengths, in documents, with which groups are shrunk.
STRENGTH = (2.0, 10_000.0)
#: Of sums at which logits are cut, so that one document's evidence stays finite.
LOGIT_MAX = 30.0

_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate(("", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?", "|/\\<>{}[]=_~^", "#$%&*@+", ".,;:'\"()-", " \t\r\f\v", "\n")):
    for _c in _chars:
        _CLASS[ord(_c)] = _i
_CLASS[128:] = 10
FEATURES = 22


def text_statistics(text: bytes) -> list[float]:
    """Statistics of one text; all zero for an empty one."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * FEATURES
    w = len(words)
    count = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=11).tolist()
    lines = text.split(b"\n")
    letters = count[1] + count[2] + 1
    distinct = len(set(words))
    low = text.lower().split()
    repeat = sum(map(eq, low, low[1:]))
    sizes = list(map(len, words))
    return [
        1.0,
        np.log(w),
        (n - count[8] - count[9]) / w,
        distinct / w,
        np.log(distinct) / np.log(w + 1),
        repeat / w,
        count[2] / letters,
        np.log1p(count[2] / letters * 20),
        count[3] / n,
        min(4.0, count[4] / w),
        min(4.0, count[5] / w),
        min(4.0, count[6] / w),
        min(4.0, count[7] / w),
        np.log1p(20 * count[4] / w),
        np.log1p(20 * count[5] / w),
        np.log1p(20 * count[6] / w),
        count[9] / w,
        1 - len(set(lines)) / len(lines),
        count[10] / n,
        sum(map((3).__ge__, sizes)) / w,
        max(sizes) / (n / w),
        float(w < 12),
    ]


@dataclass(frozen=True)
class LogisticModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> LogisticModel:
        """Ridge logistic regression by Newton steps.  Without both labels the model gives every document the prior."""
        n, width = x.shape if x.size else (0, FEATURES)
        good = float(y.sum()) if n else 0.0
        prior = float(np.log((good + 1) / (n - good + 1)))
        mean, scale = (x.mean(0), x.std(0)) if n else (np.zeros(width), np.ones(width))
        scale = np.where(scale < 1e-9, 1.0, scale)
        z = np.hstack([(x - mean) / scale, np.ones((n, 1))]) if n else np.zeros((0, width + 1))
        beta = np.append(np.zeros(width), prior)
        if 0 < good < n:
            penalty = np.append(np.full(width, ridge), 0.0)
            for _ in range(steps):
                p = 1 / (1 + np.exp(-np.clip(z @ beta, -LOGIT_MAX, LOGIT_MAX)))
                slope = z.T @ (p - y) + penalty * beta
                curve = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty + 1e-6)
                step = np.linalg.solve(curve, slope)
                beta -= step
                if np.abs(step).max() < 1e-6:
                    break
        return cls(mean, scale, beta[:-1], float(beta[-1]), prior)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weight + self.bias, -LOGIT_MAX, LOGIT_MAX)


def _statistics(texts: list[bytes]) -> np.ndarray:
    return np.array([text_statistics(t) for t in texts], float).reshape(-1, FEATURES)


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS) -> LogisticModel:
    """Fit on at most ``rows`` labelled ids (a parameter; those with the smallest hashes), and at most twice as many texts of theirs.

    Null ids and labels are left out; an id with several labels counts by their mean, an id with several texts once for each.
    """
    picked = (
        clean_name(labels, id_col, label_col)
        .toDF("id", "label")
        .dropna()
        .groupBy("id")
        .agg(F.avg(F.col("label").cast("double")).alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    # at most ``rows`` pairs of numbers, so their broadcast is bounded
    joined = clean_name(docs, id_col, text_col).toDF("id", "text").join(F.broadcast(picked), "id").select("label", F.xxhash64("text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [row for part in slabs(batch, "text") for row in map(text_statistics, as_bytes(part.column(2)))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(stats, pa.list_(pa.float64()))], ["label", "h", "x"])

    # texts become numbers before they are dealt out
    got = map_arrow(joined, run, "label double, h long, x array<double>").distinct().orderBy("h", "label", "x").limit(2 * rows).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, FEATURES)
    return LogisticModel.fit(x, (got.column("label").to_numpy() >= 0.5).astype(float))


def classify(docs: DataFrame, model: LogisticModel, text_col: str = "text") -> DataFrame:
    """``docs`` with the classifier's log-odds as a last column ``logit``; null texts count as empty, long ones are read whole; equal texts have equal log-odds, repeated rows stay; an empty table stays empty."""
    names = [*docs.columns, "logit"]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.logit(_statistics(as_bytes(part.column(at)))) for part in slabs(batch, batch.schema.names[at])]
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(scores) if scores else np.empty(0))], names)

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("logit", DoubleType())]))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, rate: Column, n: str, s: str) -> float:
    """Documents that a parent's rate counts for: from the spread of group rates beyond what sampling gives (method of moments)."""
    r = F.col(s) / F.col(n)
    row = groups.where(F.col(n) > 1).agg(
        F.sum(F.col(n) * (r - rate) * (r - rate)).alias("between"),
        F.sum(rate * (1 - rate)).alias("noise"),
        F.sum(F.col(n) * rate * (1 - rate)).alias("weight"),
        F.sum(rate * (1 - rate)).alias("groups"),
    ).first()
    if row["weight"] is None:
        return STRENGTH[1]
    # E[n (r - rate)^2] = v (1 + (n - 1) rho), with rho = 1 / (1 + strength)
    rho = (row["between"] - row["noise"]) / max(row["weight"] - row["groups"], 1e-9)
    return float(np.clip(1 / max(rho, 1e-9) - 1, *STRENGTH))


def site_rates(scored: DataFrame, host: str, path: str) -> tuple[DataFrame, float, float, float]:
    """``(host, path, n, s, host_n, host_s)`` of every group, the corpus rate, and the strengths of corpus over host and of host over path."""
    p = _sigmoid(F.col("logit"))
    paths = materialise(scored.groupBy(host, path).agg(F.count("*").alias("n"), F.sum(p).alias("s")))
    hosts = paths.groupBy(F.col(host).alias("h")).agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    whole = hosts.agg(F.sum("host_s").alias("s"), F.sum("host_n").alias("n")).first()
    rate = (whole["s"] + 0.5) / (whole["n"] + 1) if whole["n"] else 0.5
    over_host = _strength(hosts, F.lit(rate), "host_n", "host_s")
    both = paths.join(hosts, paths[host].eqNullSafe(hosts["h"])).drop("h")
    host_rate = (F.col("host_s") + over_host * rate) / (F.col("host_n") + over_host)
    over_path = _strength(both, host_rate, "n", "s")
    return materialise(both), rate, over_host, over_path


def with_posterior(scored: DataFrame, sites: tuple[DataFrame, float, float, float], host: str, path: str, prior: float) -> DataFrame:
    """``scored`` (which has ``logit``) with ``host_rate``, ``path_rate`` and ``posterior``, the probability that the document is good.

    Rates leave the document itself out.  A null host or path is a group of its own.
    """
    groups, rate, over_host, over_path = sites
    groups = groups.withColumnsRenamed({host: "_h", path: "_p"})
    if groups.count() <= BROADCAST_GROUPS:
        groups, same = F.broadcast(groups), F.lit(True)
    else:
        scored = scored.withColumn("_salt", F.pmod(F.xxhash64("logit"), F.lit(SALTS)).cast("int"))
        groups = groups.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = F.col("_salt") == F.col("_s")
    joined = scored.join(groups, scored[host].eqNullSafe(groups["_h"]) & scored[path].eqNullSafe(groups["_p"]) & same, "left").drop("_h", "_p", "_s", "_salt")
    own = _sigmoid(F.col("logit"))
    host_rate = (F.greatest(F.col("host_s") - own, F.lit(0.0)) + over_host * rate) / (F.col("host_n") - 1 + over_host)
    path_rate = (F.greatest(F.col("s") - own, F.lit(0.0)) + over_path * F.col("host_rate")) / (F.col("n") - 1 + over_path)
    bounded = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    return (
        joined.withColumn("host_rate", bounded(host_rate))
        .withColumn("path_rate", bounded(path_rate))
        .withColumn("posterior", _sigmoid(F.col("logit") - prior + _log_odds(F.col("path_rate"))))
        .drop("n", "s", "host_n", "host_s")
    )


def quality_posteriors(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5
) -> DataFrame:
    """``(id, logit, host_rate, path_rate, posterior, keep)``, one row per row of ``docs``.

    Null and empty texts are scored as texts without words, very long ones whole; a posterior at the threshold is kept.  Repeated rows each give a row and each count in their site's rate.
    Without usable labels every document gets the same evidence and is kept.  An empty table gives an empty result; other columns are ignored.
    """
    model = fit_classifier(docs, labels, id_col, text_col)
    source = clean_name(docs, id_col, host_col, path_col, text_col).toDF("id", "host", "path", "text")
    scored = materialise(classify(source, model).drop("text"))
    return with_posterior(scored, site_rates(scored, "host", "path"), "host", "path", model.prior).select(
        F.col("id").alias(id_col), "logit", "host_rate", "path_rate", "posterior", (F.col("posterior") >= threshold).alias("keep")
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5
) -> DataFrame:
    """The rows of ``docs``, all columns, whose posterior reaches ``threshold`` (see ``quality_posteriors``; a posterior at the threshold is kept).

    Null and empty texts are scored as texts without words, very long ones whole; repeated rows stay or go together; an empty table gives an empty result.  Texts are scored twice, once for the sites' rates and once for the rows, so that no copy of the texts is written.
    """
    model = fit_classifier(docs, labels, id_col, text_col)
    names = docs.columns
    work = docs.toDF(*[f"c{i}" for i in range(len(names))])
    host, path, text = (f"c{names.index(c)}" for c in (host_col, path_col, text_col))
    if path == host:
        work = work.withColumn("c_path", F.col(host))
        path = "c_path"
    slim = classify(work.select(host, path, text), model, text).drop(text)
    scored = with_posterior(classify(work, model, text), site_rates(slim, host, path), host, path, model.prior)
    return scored.where(F.col("posterior") >= threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
