import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import quality
from seqloom.llm.quality import FEATURES, LogisticModel, keep_good, quality_posteriors, site_rates, text_statistics

SF = "/root/testdata/sf0.01"


def test_statistics_of_any_text():
    for text in ("", " ", "\n", "a", "é" * 5000, "x " * 100_000, "!!!"):
        assert len(text_statistics(text.encode())) == FEATURES and np.isfinite(text_statistics(text.encode())).all()


def test_model_without_both_labels():
    assert LogisticModel.fit(np.zeros((0, FEATURES)), np.zeros(0)).logit(np.zeros((1, FEATURES)))[0] == 0
    m = LogisticModel.fit(np.ones((5, FEATURES)), np.ones(5))
    assert m.logit(np.zeros((2, FEATURES)))[1] > 0


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_posteriors(docs, labels.where("pmod(xxhash64(doc_id, 1), 2) = 0")).join(labels, "doc_id").where("pmod(xxhash64(doc_id, 1), 2) = 1")
    rows = got.select("keep", "quality").collect()
    assert len(rows) > 100
    assert sum(r.keep == bool(r.quality) for r in rows) / len(rows) > 0.97


def test_rates_against_plain_sums(spark):
    rows = [("a", "x", 2.0), ("a", "x", -1.0), ("a", "y", 0.5), ("b", None, 3.0), (None, None, -2.0), (None, None, -2.0)]
    scored = spark.createDataFrame(rows, "host string, path string, logit double")
    groups, rate, over_host, over_path = site_rates(scored, "host", "path")
    p = [1 / (1 + np.exp(-r[2])) for r in rows]
    assert rate == pytest.approx((sum(p) + 0.5) / 7)
    got = {(r.host, r.path): (r.n, r.s, r.host_n, r.host_s) for r in groups.collect()}
    assert got["a", "x"] == pytest.approx((2, p[0] + p[1], 3, p[0] + p[1] + p[2]))
    assert got[None, None] == pytest.approx((2, p[4] + p[5], 2, p[4] + p[5]))
    assert over_host >= 2 and over_path >= 2


def test_edges(spark):
    junk = "ZZ!! QQ!! " * 30
    fine = "The quick words here are different from one another, and so they end. "
    docs = spark.createDataFrame(
        [(i, fine + str(i) if i % 2 else junk, None if i < 4 else "en", None if i < 8 else "s", "n") for i in range(40)] + [(99, None, "en", "s", "n"), (98, "", "en", "s", "n"), (97, fine, "en", "s", "n"), (97, fine, "en", "s", "n")],
        "doc_id long, text string, lang string, source string, n string",
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (3, None), (3, 1)], "doc_id long, quality int")
    out = quality_posteriors(docs, labels)
    assert out.count() == docs.count()
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    want = sorted(r.doc_id for r in out.where("keep").collect())
    assert sorted(r.doc_id for r in kept.collect()) == want and {35, 37, 39, 97} <= set(want) and not {34, 36, 38} & set(want)
    assert quality_posteriors(docs.limit(0), labels).count() == 0
    assert keep_good(docs.limit(0), labels).count() == 0
    assert quality_posteriors(docs, labels.limit(0)).where("keep").count() == docs.count()


@pytest.mark.parametrize("most", [0, 100_000])
def test_rates_and_posteriors_against_plain_sums(spark, monkeypatch, most):
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", most)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, "hot").when(F.col("doc_id") % 7 > 0, F.col("source")).alias("source"), "lang")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = quality.quality_posteriors(docs, labels).join(docs.select("doc_id", "source", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    p = {r.doc_id: 1 / (1 + np.exp(-r.logit)) for r in got}
    paths, hosts = {}, {}
    for r in got:
        for groups, key in ((paths, (r.source, r.lang)), (hosts, r.source)):
            n, s = groups.get(key, (0, 0.0))
            groups[key] = (n + 1, s + p[r.doc_id])
    rate = (sum(p.values()) + 0.5) / (len(p) + 1)

    def strength(groups, parent):
        rows = [(n, s / n, parent(k)) for k, (n, s) in groups.items() if n > 1]
        between, noise = sum(n * (r - q) ** 2 for n, r, q in rows), sum(q * (1 - q) for _, _, q in rows)
        weight = sum(n * q * (1 - q) for n, _, q in rows)
        return float(np.clip(1 / max((between - noise) / max(weight - noise, 1e-9), 1e-9) - 1, *quality.STRENGTH))

    over_host = strength(hosts, lambda k: rate)
    over_path = strength(paths, lambda k: (hosts[k[0]][1] + over_host * rate) / (hosts[k[0]][0] + over_host))
    model = quality.fit_classifier(docs, labels)
    for r in got:
        own = p[r.doc_id]
        n, s = hosts[r.source]
        host = np.clip((max(s - own, 0) + over_host * rate) / (n - 1 + over_host), 1e-6, 1 - 1e-6)
        n, s = paths[r.source, r.lang]
        path = np.clip((max(s - own, 0) + over_path * host) / (n - 1 + over_path), 1e-6, 1 - 1e-6)
        posterior = 1 / (1 + np.exp(-(r.logit - model.prior + np.log(path / (1 - path)))))
        assert np.allclose((r.host_rate, r.path_rate, r.posterior), (host, path, posterior), atol=1e-9) and r.keep == (r.posterior >= 0.5)
    assert quality.keep_good(docs, labels).count() == sum(r.keep for r in got)
