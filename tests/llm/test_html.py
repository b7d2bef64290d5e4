import re
import time

import pytest

from seqloom.llm.html_crf import blocks, default_model, extract_main_text, features, main_text, training_pages


def test_held_out_accuracy():
    model, right, total = default_model(), 0, 0
    for page, marks in training_pages(200, seed=99):
        found = blocks(page)
        assert len(found) == len(marks)
        got = model.decode(features(found))
        right += sum(a == b for a, b in zip(got, marks, strict=True))
        total += len(marks)
    assert right / total > 0.97, right / total


def test_blocks():
    page = "<p>a &amp; b<br>c <b>d</b>e<ul><li>x<li>y</ul><script>'</p>'</script><!-- <p>no --><p title='>'>z</p>tail"
    assert [b.text for b in blocks(page)] == ["a & b c de", "x", "y", "z", "tail"]
    assert blocks("") == [] and blocks("<<<") != [] and blocks("<p") != []
    assert len(blocks("<div>" * 3000 + "x")) == 1


def test_pages(spark):
    table = "/root/testdata/sf0.01/pages.parquet"
    model = default_model()
    import html

    rows = spark.read.parquet(table).collect()
    for r in rows:
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", body.replace("<br>", " "))]
        assert main_text(r.html, model) == "\n".join(x for x in want if x), r.page_id


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (2, "u", "", "t"), (3, "u", "<article><p>Some words here.</p></article>", "t"), (3, "u", "<article><p>Some words here.</p></article>", "t")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract_main_text(df).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, "Some words here.", 16), (3, "Some words here.", 16)]
    assert extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ['<a ', '<a "', "<!a", '<a "> "b', "<div>a", "<li><x1>", "<div><p>x"])
@pytest.mark.parametrize("tail", ["", "'", "</td>" * 20_000])
def test_very_long_pages_of_unclosed_tags(unit, tail):
    model = default_model()
    began = time.thread_time()
    main_text(unit * ((1 << 20) // len(unit)) + tail, model)
    assert time.thread_time() - began < 20


def test_empty_svg_and_formulas():
    page = '<p>one <svg class="i"/> two</p><p>three <math><mi>x</mi><mo>=</mo><mn>1</mn></math> four</p><svg><text>no</text></svg><p>five</p>'
    assert [b.text for b in blocks(page)] == ["one", "two", "three x=1 four", "five"]
