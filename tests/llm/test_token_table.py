import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from seqloom.llm.token_table import END, Encoder, encoded_digests, read_documents, read_span, token_index, write_token_table

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, END]


def odd_texts():
    rng = random.Random(13)
    texts = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a\n b", "a \nb", "a   b", "it's we 'll 've", "x　 y", "<|endoftext|> a<|endoftext|> b", "a <|endof text|>", "Ünï çødé 漢字 🦆 🦆", "a\x1c b", "a\u00a0 b", "a \u3000b", "a\u0085 b", "a \u2028 b", "a\0b \0 c", "a᠎ b", "w" * 300 + " " + "w" * 300]
    texts += ["".join(rng.choice("ab  c'1.\n\té漢 ") for _ in range(rng.randrange(60))) for _ in range(300)]
    return texts


def test_cut_texts_encode_like_whole_ones():
    texts = odd_texts()
    e = Encoder()
    # a slice, as a part of a batch is
    for given in (pa.array(texts), pa.array(["x y", *texts])[1:]):
        got = e.encode(given)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain(t)[:-1] for t in texts]


def test_memory_of_words_is_bounded(monkeypatch):
    from seqloom.llm import token_table

    monkeypatch.setattr(token_table, "MEMORY_WORDS", 50)
    e, rng = Encoder(), random.Random(5)
    for _ in range(40):
        text = " ".join(f"w{rng.randrange(200)}" for _ in range(30)) + " " + "z" * 100
        assert np.frombuffer(e.encode(pa.array([text]))[0], "<u4").tolist() == plain(text)[:-1]
        assert len(e.recent) <= 80 and len(e.older) <= 80 and "z" * 100 not in e.recent


def test_digests_against_the_library(spark):
    texts = odd_texts() + ["word " * 60_000]
    rng = random.Random(2)
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    rows += [(None, "null id", "x", 1)] * 3 + [(7, "again", "x", 0), (7, "again", "x", 0)]
    rng.shuffle(rows)
    got = encoded_digests(spark.createDataFrame(rows, "doc_id long, text string, ids string, at long").repartition(5), row_group_bytes=4096, page_bytes=512, page_rows=8).orderBy("start").collect()
    assert len(got) == len(rows)
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    start, want = 0, {}
    for i, t, *_ in rows:
        ids = plain(t)
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    seen = {}
    for r in got:
        assert r.start == start
        start += r.n_tokens
        seen.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}


def test_string_ids_and_an_empty_table(spark):
    docs = spark.createDataFrame([("b", "two words"), ("a", "one")], "doc_id string, text string")
    got = encoded_digests(docs).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [("a", 0, len(plain("one"))), ("b", len(plain("one")), len(plain("two words")))]
    assert encoded_digests(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tokens") / "t")
    docs = spark.range(3000).selectExpr("id * 2 as doc_id", "concat_ws(' ', transform(sequence(0, cast(id % 90 as int)), i -> concat('w', (id * 31 + i * i) % 977))) as text")
    write_token_table(docs.repartition(6), path, row_group_bytes=1 << 15, page_bytes=1 << 11, page_rows=32)
    return path, {r.doc_id: plain(r.text) for r in docs.collect()}


def test_encodings_row_groups_and_page_index(stored):
    files = sorted(Path(stored[0]).glob("part-*.parquet"))
    found = [pq.ParquetFile(f) for f in files]
    assert max(f.metadata.num_row_groups for f in found) > 2
    for f in found:
        for g in range(f.metadata.num_row_groups):
            columns = {f.metadata.row_group(g).column(i).path_in_schema: f.metadata.row_group(g).column(i) for i in range(5)}
            assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
            for name in ("doc_id", "at", "n_tokens"):
                assert columns[name].encodings and "DELTA_BINARY_PACKED" in columns[name].encodings and "RLE_DICTIONARY" not in columns[name].encodings
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    # rows ascend through all files
    ids = np.concatenate([f.read(columns=["doc_id"]).column(0).to_numpy() for f in found])
    assert (np.diff(ids) > 0).all() and len(ids) == 3000


def rows_scanned(df):
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value()


def test_selective_reads(spark, stored):
    path, want = stored
    some = read_documents(spark, path, 1000, 1010)
    assert {r.doc_id: r.ids for r in some.collect()} == {i: want[i] for i in range(1000, 1011, 2)}
    # pages of at most 32 rows: few beside those asked for are opened
    assert rows_scanned(some) <= 6 + 2 * 32
    index = token_index(spark, path)
    plan = index._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema" in plan and "ids:" not in plan
    whole, starts = [], {}
    for i in sorted(want):
        starts[i] = len(whole)
        whole += want[i]
    assert {r.doc_id: (r.start, r.n_tokens) for r in index.collect()} == {i: (starts[i], len(want[i])) for i in want}


@pytest.mark.parametrize("begin, end", [(0, 1), (0, 10**9), (5000, 5001), (777, 60_000), (10**9, 10**9 + 5)])
def test_spans_of_ids(spark, stored, begin, end):
    path, want = stored
    whole = [t for i in sorted(want) for t in want[i]]
    got = sorted((r.start, r.ids) for r in read_span(spark, path, begin, end).collect())
    assert [t for _, ids in got for t in ids] == whole[begin:end]
    at = begin
    for start, ids in got:
        assert start == at and ids
        at += len(ids)


def test_marks_and_line_ends_part_words(monkeypatch):
    """Words are met again whatever marks or line ends stand behind them; texts that can't be cut so are as they were."""
    from seqloom.llm import token_table

    e, seen = Encoder(), []
    ids = e._ids
    monkeypatch.setattr(e, "_ids", lambda texts: (seen.extend(texts), ids(texts))[1])
    e.encode(pa.array(["one\none two, one alone"]))
    seen.clear()
    text = "one two. one two! alone; one, two?!\none two"
    assert np.frombuffer(e.encode(pa.array([text]))[0], "<u4").tolist() == plain(text)[:-1]
    assert not [t for t in seen if any(c.isalpha() for c in t)]
    rng = random.Random(21)
    ends = ["é,", "×,", "÷.", "ÿ;", "À!", "漢,", "ж.", "٣,", "x1,", "it's.", "'s,", "...", ",a.", "a.b", "<|endoftext|>a.", "<|endoftext|>.", "a\r", "\1", "a\1.", "ª,", "ß?!", "\n", "\r\n", "\x0b", "", " "]
    texts = ["\n", "a\n", "\na", "a\n\nb", "a \nb", "a\n b", "\n\n", "a.\nb", "a\r\nb", None, "a\n'll b", "\n's"] + ["".join(rng.choice(ends) + rng.choice([" ", "\n", ""]) for _ in range(rng.randrange(1, 8))) for _ in range(600)]
    assert [np.frombuffer(g, "<u4").tolist() for g in e.encode(pa.array(texts))] == [plain(t)[:-1] for t in texts]
    monkeypatch.setattr(token_table, "LONG", 5)
    assert [np.frombuffer(g, "<u4").tolist() for g in e.encode(pa.array(texts)[3:200])] == [plain(t)[:-1] for t in texts[3:200]]
    got, sizes = e.flat(pa.array([], pa.string()), b"\2\0\0\0")
    assert not len(got) and not len(sizes)


def test_known_words_cost_no_calls_of_their_own(monkeypatch):
    """What Python does for words that are known does not grow with their number, whatever marks stand behind them; control characters don't keep a text whole."""
    e, calls = Encoder(), []

    def count(n):
        text = pa.array([" ".join(f"w{chr(97 + i % 26)}{'abcdefghij'[i // 26 % 10]}{'klmnopqrst'[i // 260]}," for i in range(n))])
        first = e.encode(text)
        calls.clear()
        sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
        try:
            again = e.encode(text)
        finally:
            sys.setprofile(None)
        assert again == first and np.frombuffer(first[0], "<u4").tolist() == plain(text[0].as_py())[:-1]
        return len(calls)

    assert count(2600) < count(200) + 100
    seen, ids = [], e._ids
    monkeypatch.setattr(e, "_ids", lambda texts: (seen.extend(texts), ids(texts))[1])
    e.encode(pa.array(["one two\1 three\1\nfour"]))
    seen.clear()
    text = "one two\1 three\1\nfour two\1"
    # a batch's slice, with a null and empty texts beside
    got = e.encode(pa.array(["x  y", "", None, text, "", "one\n"])[1:5])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain(t)[:-1] for t in ["", None, text, ""]]
    assert text not in seen and not [t for t in seen if "one" in t]
