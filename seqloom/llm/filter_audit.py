"""Which filter removes what: an audit of five filters in every order, by inclusion and exclusion.

Each document becomes five flags.  For every set of filters the documents that fail all of them are counted, as sums of products of flags: 32 counts a part.
All else follows from these by signs.  Documents that fail none of a set are an alternating sum over its subsets; those that fail exactly one set are the Möbius
inverse; and the set function of what filters remove has the alternating counts as its Harsanyi dividends, so that a filter's Shapley value shares each
dividend evenly among the filters of its set.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm._store import clean_name

#: Bytes that part words (fixed values: space and the control characters 9 to 13).
BLANKS = "[\\x20\\x09-\\x0D]+"
NAMES = "ABCDE"


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The filters that see one text: few words, few distinct words, many capitals, odd symbols."""
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def subsets(s: int) -> list[int]:
    return [t for t in range(s + 1) if t & ~s == 0]


def bits(s: int) -> int:
    return s.bit_count()


def survivors(s: int) -> dict[int, int]:
    """Coefficients of the joint counts in the number of documents that fail nothing of ``s``."""
    return {t: (-1) ** bits(t) for t in subsets(s)}


def exactly(s: int, n: int) -> dict[int, int]:
    """Coefficients in the number of documents that fail all of ``s`` and nothing else: the Möbius inverse over supersets."""
    return {t: (-1) ** (bits(t) - bits(s)) for t in range(1 << n) if t & s == s}


def shapley(i: int, n: int) -> dict[int, int]:
    """Coefficients in n! times the Shapley value of filter ``i``: the dividend of a set, its joint count with a sign, in equal shares."""
    return {t: (-1) ** (bits(t) + 1) * math.factorial(n) // bits(t) for t in range(1 << n) if t >> i & 1}


def failing_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", label_id: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """``(part, mask, good, toxic, n)``: how many documents of a part fail exactly the filters of ``mask`` (bit 0 is A), by their labels.

    Only digests of texts leave the scan.  A text's copies are counted by part and label before they meet, each count beside the smallest id and the number of rows that
    have it, so a text that a third of all rows share is a few rows after its first aggregation.
    """
    source = clean_name(docs, id_col, text_col, part_col).toDF("id", "text", "part")
    text = F.coalesce("text", F.lit(""))
    split = source.select("id", F.coalesce("part", F.lit("")).alias("part"), text.alias("text"), F.array_remove(F.split(text, BLANKS), "").alias("words"))
    fails = text_failures(F.col("text"), F.col("words"))
    mask = sum((F.when(f, F.lit(1 << NAMES.index(k))).otherwise(F.lit(0)) for k, f in fails.items()), F.lit(0))
    rows = split.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    known = clean_name(labels, label_id, good, toxic).toDF("id", "good", "toxic").where("id is not null")
    known = known.groupBy("id").agg(F.coalesce(F.max(F.col("good") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # rows without an id have no label and come after nothing: they need not meet anything
    labelled = rows.where("id is not null").join(known, "id", "left").select("id", "part", "digest", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    lone = rows.where("id is null").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    kind = ["digest", "part", "mask", "good", "toxic"]
    copies = labelled.groupBy("id", *kind).agg(F.count("*").alias("n")).groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("id", F.col("n").alias("m"))).alias("first"))
    least = copies.groupBy("digest").agg(F.min("first.id").alias("least"))
    held = copies.join(least, "digest").select("part", "mask", "good", "toxic", "n", F.when(F.col("first.id") == F.col("least"), F.col("first.m")).otherwise(F.lit(0)).alias("kept"))
    apart = held.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("kept").alias("n")), F.struct(F.col("mask").bitwiseOR(16).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))).alias("r"))
    counted = apart.select("part", "r.mask", "good", "toxic", "r.n").unionByName(lone).where("n > 0")
    return counted.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def joint_failures(counts: DataFrame, n: int = len(NAMES)) -> DataFrame:
    """``(part, n, good, toxic)``: of each part, for every set of filters in turn, how many documents fail all of them (and maybe more), and how many of these are good or toxic.

    A document counts for a set by the product of its flags there, which is 1 if its mask covers the set.
    """
    weights = {"n": F.col("n"), "good": F.when(F.col("good"), F.col("n")).otherwise(F.lit(0)), "toxic": F.when(F.col("toxic"), F.col("n")).otherwise(F.lit(0))}
    # a part has some 128 rows at most before this, and one for each set after it
    each = counts.select("part", "mask", *[w.alias(k) for k, w in weights.items()], F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))).alias("s"))
    product = (F.col("mask").bitwiseAND(F.col("s")) == F.col("s")).cast("int")
    sums = each.groupBy("part", "s").agg(*[F.sum(product * F.col(k)).alias(k) for k in weights])
    held = sums.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("s", *weights))).alias("x"))
    return held.select("part", *[F.col(f"x.{k}").alias(k) for k in weights])


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``: five filters in all 120 orders, by part.

    A: under 200 words; B: under half of its words distinct; C: over 3 % of its characters A to Z; D: has one of ``#$%&*|``; E: its text is that of a smaller id.  Parts are
    the values of ``lang``, null as the empty string.  A null text is empty; a null id has no smaller one and no label, and is smaller than none; rows repeated with one id are
    no copies of each other; of several labels of one id each counts that any of them gives.  Texts of any length are read whole.  An empty table has no parts.  Other columns
    are ignored, whatever their names; ``columns`` goes to ``failing_documents``.
    """
    n = len(NAMES)
    joint = joint_failures(failing_documents(docs, labels, **columns), n)

    def linear(of: list[dict[int, int]], field: str = "n") -> Column:
        """Sums of a part's joint counts times coefficients, one for each row of these."""
        table = F.lit([[row.get(t, 0) for t in range(1 << n)] for row in of])
        return F.transform(table, lambda row: F.aggregate(F.zip_with(row, F.col(field), lambda c, x: c * x), F.lit(0).cast("long"), lambda a, x: a + x))

    # what each set leaves, and what each filter alone explains, once a part
    every = range(1 << n)
    once = joint.select(
        "part",
        *[linear([survivors(s) for s in every], field).alias(f"left_{field}") for field in ("n", "good", "toxic")],
        linear([{1 << i: 1} for i in range(n)]).alias("fails"),
        linear([exactly(1 << i, n) for i in range(n)]).alias("unique"),
        linear([shapley(i, n) for i in range(n)]).alias("worth"),
    )
    orders = ["".join(p) for p in permutations(NAMES)]
    rows = once.select("*", F.explode(F.lit(orders)).alias("filter_order")).withColumn("own", F.expr(f"transform(split(filter_order, ''), x -> shiftleft(1, instr('{NAMES}', x) - 1))"))
    rows = rows.select("*", F.posexplode("own").alias("at", "bit")).withColumn("before", F.expr("aggregate(slice(own, 1, at), 0, (a, b) -> a + b)"))
    rows = rows.withColumns({"step": F.col("at") + 1, "i": F.instr(F.lit(NAMES), F.substring(F.col("filter_order"), F.col("at") + 1, F.lit(1))) - 1})
    after = F.col("before") + F.col("bit")
    lost = lambda field: F.get(f"left_{field}", F.col("before")) - F.get(f"left_{field}", after)
    done = {
        "kept": F.get("left_n", after),
        "removed": lost("n"),
        "redundant": F.get("fails", F.col("i")) - lost("n"),
        "unique_fails": F.get("unique", F.col("i")),
        "good_lost": lost("good"),
        "toxic_lost": lost("toxic"),
        "shapley": F.get("worth", F.col("i")),
    }
    return rows.select("part", "filter_order", "step", *[c.cast("long").alias(k) for k, c in done.items()])


#: DuckDB SQL for ``audit``, which counts every order and step over the documents themselves.
ORACLE = """WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
  regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), FALSE)] AS fl FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, good, toxic, fl, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT p, unnest([1, 2, 3, 4, 5]) AS step FROM o),
m AS (SELECT part, p, step, good, toxic, n, fl[p[step]] AS own, len(list_filter(list_slice(p, 1, step - 1), lambda k: fl[k])) > 0 AS gone, len(list_filter(fl, lambda k: k)) AS fails FROM c, s),
r AS (SELECT part, p, step, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN own AND fails = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN own AND NOT gone THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone THEN n * toxic ELSE 0 END) AS toxic_lost FROM m GROUP BY part, p, step)
SELECT part, array_to_string(list_transform(p, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, p[step]))::BIGINT AS shapley FROM r"""
