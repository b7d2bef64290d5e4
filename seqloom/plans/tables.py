"""The driver's tables as the engine's inputs, and pieces of the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.shared import spread


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sequence records."""
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.col("doc_id").alias("name"), F.col("text").alias("seq"), F.col("source").alias("genome"))


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents spelt in four letters."""
    letters = F.regexp_replace(F.lower("seq"), "[^a-z]", "")
    return records(spark, sf_dir).withColumn("seq", F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"))


DNA_SQL = "SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents"
HASH_SQL = "('0x' || substr(md5({0}), 1, 15))::BIGINT"
RC_SQL = "reverse(translate({0}, 'ACGTURYMKBVDHacgturymkbvdh', 'TGCAAYRKMVBHDtgcaayrkmvbhd'))"

SHINGLE = 5


def _shingles(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``(name, hashes)``: the distinct runs of five words of each row, by a hash of the words' hashes."""
    words = F.transform(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != ""), lambda x: F.xxhash64(x))
    docs = spread(load(spark, sf_dir, "documents").select(F.col(name).alias("name"), "text")).select("name", words.alias("w")).where(F.size("w") >= SHINGLE)
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - SHINGLE), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(SHINGLE)]))
    return docs.select("name", F.array_distinct(grams).alias("hashes"))


def shingle_rows(spark: SparkSession, sf_dir: str, name: str = "doc_id") -> DataFrame:
    """``(name, hash)``: runs of five words of each document, or of each source; a name may have a hash several times."""
    # no array is empty; a plain explode would test that by computing each array once more
    return _shingles(spark, sf_dir, name).select("name", F.explode_outer("hashes").alias("hash"))


def shingle_sets(spark: SparkSession, sf_dir: str, name: str = "doc_id") -> DataFrame:
    """The same without copies."""
    return shingle_rows(spark, sf_dir, name).distinct()


def document_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(name, hashes)``: the same runs as one sorted array a document.  No set crosses the network unless documents share an id."""
    sets = _shingles(spark, sf_dir, "doc_id").select("name", F.array_sort("hashes").alias("hashes"))
    if load(spark, sf_dir, "documents").groupBy("doc_id").count().where("count > 1").isEmpty():
        return sets
    return sets.groupBy("name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hashes")))).alias("hashes"))


SHINGLES_SQL = f"""
w AS (SELECT doc_id, source, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, source, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM w WHERE len(w) >= {SHINGLE}),
sh AS (SELECT DISTINCT {{name}} AS name, {HASH_SQL.format(f"array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ')")} AS hash FROM g)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as annotation records."""
    e = load(spark, sf_dir, "events")
    start = F.col("event_id") * 10 + 1
    return e.select(
        F.lit("asm").alias("genome"), F.concat(F.lit("chr"), (F.col("user_id") % 20).cast("string"), F.lit(".v2")).alias("seqid"), F.col("event_type").alias("type"), start.alias("start"),
        (start + F.floor("value").cast("long")).alias("end"), F.when(F.col("event_id") % 3 == 0, "-").otherwise(".").alias("strand"),
        F.create_map(F.lit("ID"), F.concat(F.lit("ev-"), F.col("event_id").cast("string")), F.lit("k"), F.get_json_object("props", "$.k")).alias("attributes"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as features on ten molecules."""
    o = load(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("acc"), F.concat(F.lit("m"), (F.col("o_custkey") % 10).cast("string")).alias("mol"),
        (F.col("o_orderkey") * 100).alias("start"), (F.col("o_orderkey") * 100 + 50).alias("end"), F.col("o_orderkey").alias("line_no"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as matches between orders."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("acc1"), F.concat(F.lit("o"), F.col("l_partkey").cast("string")).alias("acc2"), (F.col("l_discount") * 10).alias("similarity"),
        (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("line_no"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("seq_id"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("end"))


def two_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as blocks of two ranges: place of the customer's nation, place of the supplier's."""
    li, o, c, s = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    block = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_partkey") % 100
    name = lambda p, k: F.concat(F.lit(p), (F.col(k) % 3).cast("string"), F.lit(".c"), F.col(k).cast("string"))
    first = F.struct(F.lit(1).cast("long").alias("ord"), name("A", "c_nationkey").alias("seq_name"), (F.col("l_orderkey") * 10).alias("start"), (F.col("l_orderkey") * 10 + F.col("l_quantity").cast("long")).alias("end"), F.lit("+").alias("strand"))
    second = F.struct(F.lit(2).cast("long").alias("ord"), name("B", "s_nationkey").alias("seq_name"), (F.col("l_partkey") * 10).alias("start"), (F.col("l_partkey") * 10 + F.col("l_quantity").cast("long")).alias("end"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"))
    rows = j.select(block.alias("block_id"), F.col("l_quantity").alias("score"), F.explode(F.array(first, second)).alias("r"))
    return rows.groupBy("block_id", F.col("r.ord").alias("ord")).agg(F.min(F.struct("r.seq_name", "r.start", "r.end", "r.strand", "score")).alias("x")).select("block_id", "ord", "x.*")


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as chromosomes of three genomes."""
    c = load(spark, sf_dir, "customer")
    g = F.concat(F.lit("A"), (F.col("c_nationkey") % 3).cast("string"))
    return c.select(g.alias("genome"), F.concat(g, F.lit(".c"), F.col("c_nationkey").cast("string")).alias("chrom"), F.floor(F.abs("c_acctbal")).cast("long").alias("l")).groupBy("genome", "chrom").agg(F.sum("l").alias("length"))
