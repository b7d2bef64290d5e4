"""Records by name from indexed files, and what of these was read."""

import random
import struct
import zlib

import pytest

from seqloom.cli import parser, run
from seqloom.operators import records
from seqloom.sources import indexed
from seqloom.sources import text as io

BLOCK = 700


def packed(text):
    """A block-compressed file and its block index, but for the first block."""
    out, places, plain = b"", [], 0
    for at in [*range(0, len(text), BLOCK), len(text)]:
        part = text[at : at + BLOCK]
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        places.append((len(out), plain))
        plain += len(part)
        out += b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out, struct.pack("<Q", len(places) - 1) + b"".join(struct.pack("<QQ", *p) for p in places[1:])


@pytest.fixture
def files(tmp_path):
    rng = random.Random(8)
    text, index, seqs = "", "", {}
    for i in range(300):
        seq = "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 40, 500, 3000])))
        record = f">k{i} length\n" + "".join(seq[k : k + 60] + "\n" for k in range(0, len(seq), 60))
        index += f"k{i}\t{len(text)}\t{len(record)}\n"
        text += record
        seqs[f"k{i}"] = seq
    body, gzi = packed(text.encode())
    for name, content in (("x.fa", text.encode()), ("x.fa.gz", body), ("x.fa.gz.gzi", gzi), ("x.loc", index.encode())):
        (tmp_path / name).write_bytes(content)
    return tmp_path, seqs


@pytest.mark.parametrize(("file", "gzi"), [("x.fa", False), ("x.fa.gz", False), ("x.fa.gz", True)])
def test_only_blocks_of_what_is_asked_for(spark, files, file, gzi):
    path, seqs = files
    index = io.read_index(spark, str(path / "x.loc"))
    asked = ["k3", "k3", "k250", "k299", "gone"]
    got = indexed.read_indexed(spark, str(path / file), index, spark.createDataFrame([(n,) for n in asked], "name string"), str(path / "x.fa.gz.gzi") if gzi else None, 1 << 14).collect()
    assert {r.name: r.seq for r in got} == {n: seqs[n] for n in ("k3", "k250", "k299")} and len(got) == 3
    whole, wanted = (path / file).stat().st_size, sum(len(seqs[r.name]) for r in got)
    # three tasks at most, each with what it has read by its last record
    assert max(r.bytes_read for r in got) <= wanted * 1.1 + 3 * 2 * BLOCK + 100 and sum(r.bytes_read for r in got) < whole / 8
    everything = indexed.read_indexed(spark, str(path / file), index, index, None, 1 << 14)
    assert {r.name: r.seq for r in everything.collect()} == seqs


def test_block_indexes_agree_and_wrong_ones_fail(spark, files):
    path, _ = files
    assert (indexed.Blocks(str(path / "x.fa.gz"), None).index() == indexed.read_gzi(str(path / "x.fa.gz.gzi"))).all()
    with pytest.raises(ValueError, match="not a block"):
        indexed.Blocks(str(path / "x.fa"), None).index()
    wrong = spark.createDataFrame([("k3", 5, 50)], "name string, offset long, size long")
    with pytest.raises(Exception, match="another record"):
        indexed.read_indexed(spark, str(path / "x.fa"), wrong, wrong).collect()


def test_regions_of_all_forms(spark, files, capsys):
    path, seqs = files
    turned = seqs["k250"][:20][::-1].translate(str.maketrans("ACGT", "TGCA"))
    long = max(seqs, key=lambda n: len(seqs[n]))
    want = {long: seqs[long], f"{long}:11-20": seqs[long][10:20], f"{long}:7": seqs[long][6], "k250(-):1-20": turned, "k250(+):1-20": seqs["k250"][:20]}
    (path / "ask.rg").write_text("\n".join(want) + "\n")
    run(spark, parser().parse_args(["range", str(path / "x.fa.gz"), "--list", str(path / "ask.rg"), "--index", str(path / "x.loc"), "--gzi", str(path / "x.fa.gz.gzi")]))
    out = [x for x in capsys.readouterr().out.split("\n") if x]
    assert {a[1:]: b for a, b in zip(out[::2], out[1::2], strict=True)} == {k: v for k, v in want.items() if v}
    fa = io.read_fasta(spark, str(path / "x.fa"))
    assert {r.range: r.seq for r in records.extract_ranges(fa, spark.createDataFrame([(k,) for k in want], "range string"), loose=True).collect()} == want
