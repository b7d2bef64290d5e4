import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm.tokens import SEPARATOR, count_tokens, document_spans, file_of, read_blocks, shard_of, tokenizer, write_token_files


def test_counts_against_tokenizer(spark):
    rng = random.Random(4)
    texts = [None, "", "a", "Ünï çødé \n\n 漢字", "word " * 4000, *["".join(rng.choice("ab cé\n1!") for _ in range(rng.randrange(200))) for _ in range(60)], "a"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, shard int").repartition(3)
    path_df = df.sparkSession.createDataFrame(df.collect(), df.schema)
    want = {i: len(tokenizer().encode_ordinary(t or "")) for i, t in enumerate(texts)}
    for block, file_bytes in ((7, 50), (1 << 20, 1 << 26), (1, 1000)):
        got = count_tokens(path_df, block=block, file_bytes=file_bytes).collect()
        assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(texts)
        assert (max(r.file for r in got) > 0) == (file_bytes < 1 << 26)
    assert count_tokens(path_df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 5, 64])
def test_spans_of_any_file(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    for k in range(4):
        ids = rng.integers(SEPARATOR - 2, SEPARATOR + 1, 40).astype(">u2")
        (tmp_path / f"part-{k:05d}-x").write_bytes(ids.tobytes())
    want = []
    for k in range(4):
        ids = np.frombuffer((tmp_path / f"part-{k:05d}-x").read_bytes(), ">u2").tolist()
        start = n = 0
        for i, t in enumerate(ids):
            if t == SEPARATOR:
                want.append((k, n, start, i - start, True))
                start, n = i + 1, n + 1
        if start < len(ids):
            want.append((k, n, start, len(ids) - start, False))
    got = document_spans(read_blocks(spark, str(tmp_path), block)).collect()
    assert sorted((int(r.path.split("part-")[1][:5]), r.ordinal, r.start, r.n_tokens, r.terminated) for r in got) == want


def test_files_are_flat(spark, tmp_path):
    docs = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string").coalesce(1)
    write_token_files(docs, str(tmp_path / "t"))
    (f,) = (tmp_path / "t").glob("kind=tokens/file=0/part-*")
    assert np.frombuffer(f.read_bytes(), ">u2").tolist() == [*tokenizer().encode_ordinary("hello world"), SEPARATOR, SEPARATOR]


def test_rows_whose_order_changes_from_read_to_read(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "repeat('word ', cast(id % 37 as int)) as text").withColumn("r", F.rand()).repartition(5, "r")
    want = {i: len(tokenizer().encode_ordinary("word " * (i % 37))) for i in range(500)}
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs).collect()} == want


def test_ids_of_any_text_and_repeated_rows(spark):
    docs = spark.createDataFrame([("Ā\n\"x", "a b c"), (None, "d e"), (None, "d e"), ("", None)], "doc_id string, text string")
    got = count_tokens(docs).collect()
    count = lambda t: len(tokenizer().encode_ordinary(t))
    assert sorted(((r.doc_id or "", r.doc_id is None, r.n_tokens) for r in got)) == sorted([("Ā\n\"x", False, count("a b c")), ("", True, count("d e")), ("", True, count("d e")), ("", False, 0)])


def test_a_task_number_is_not_taken_from_the_rest_of_a_name(spark):
    names = [f"file:/x/part-c7/kind=tokens/file={k}/part-{k:05d}-c1{k}3a0f2-c222-c3{k}4-part-00009-c9d8e7f60a1b{end}" for k in range(20) for end in (".c000.txt", "-c000.txt", "")]
    rows = spark.createDataFrame([(n,) for n in names], "path string").select("path", shard_of(F.col("path")).alias("s"), file_of(F.col("path")).alias("f")).collect()
    assert all(f"file={r.f}/part-{r.s:05d}-" in r.path for r in rows)
