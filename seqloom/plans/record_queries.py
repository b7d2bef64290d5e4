"""Queries on records, annotations, ranges and intervals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqloom.functions.ranges import format_range, parse_range
from seqloom.functions.shared import delete, shared_dir, stored
from seqloom.functions.sequence import bloom_size
from seqloom.operators import annotations, bloom, intervals, records
from seqloom.operators.merge import group_blocks
from seqloom.operators.prefix import number_rows
from seqloom.plans import tables as t
from seqloom.sources import text as io

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


@query("SELECT doc_id AS name, length(text)::INT AS size FROM documents")
def rec_size(spark, sf):
    return records.size(t.records(spark, sf))


_COUNT = ", ".join(f"length(regexp_replace(text, '[^{b}{b.lower()}]', '', 'g'))::BIGINT AS n_{b.lower()}" for b in "ACGTN")


@query(
    f"WITH c AS (SELECT doc_id::VARCHAR AS name, length(text)::BIGINT AS len, {_COUNT} FROM documents) SELECT * FROM c UNION ALL "
    "SELECT 'total', sum(len)::BIGINT, " + ", ".join(f"sum(n_{b})::BIGINT" for b in "acgtn") + " FROM c"
)
def rec_count_bases(spark, sf):
    return records.count_bases(t.records(spark, sf))


@query("""WITH p AS (SELECT doc_id, regexp_extract_all(text, '([a-zN]+|[^a-zN]+)') AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS part, unnest(range(len(l))) AS i FROM p),
s AS (SELECT doc_id, part, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM u)
SELECT doc_id AS name, (e - length(part) + 1)::BIGINT AS start, e::BIGINT AS "end" FROM s WHERE regexp_matches(part, '^[a-zN]')""")
def rec_masked_runs(spark, sf):
    return records.runs(t.records(spark, sf)).select("name", F.col("start").cast("long"), F.col("end").cast("long"))


@query("""WITH l AS (SELECT length(text)::BIGINT AS len, sum(length(text)) OVER (ORDER BY length(text) DESC) AS r, sum(length(text)) OVER () AS w FROM documents)
SELECT max(CASE WHEN r * 100 >= w * 50 THEN len END) AS n50, max(CASE WHEN r * 100 >= w * 90 THEN len END) AS n90, sum(len)::BIGINT AS sum, round(sum(len) / count(*), 4) AS avg, round(sum((len * len)::DOUBLE) / sum(len), 4) AS e_size, count(*) AS count FROM l""")
def rec_n50(spark, sf):
    return records.nx(t.records(spark, sf), percents=(50, 90))


@query("SELECT doc_id AS name, text AS seq FROM documents WHERE doc_id = 7")
def rec_one(spark, sf):
    return records.one(t.records(spark, sf), 7).select("name", "seq")


def _toxic(spark, sf):
    return t.load(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("name"))


@query("SELECT doc_id AS name, length(text)::INT AS size FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def rec_some(spark, sf):
    return records.size(records.some(t.records(spark, sf), _toxic(spark, sf)))


@query("SELECT doc_id AS name, length(text)::INT AS size FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def rec_some_invert(spark, sf):
    return records.size(records.some(t.records(spark, sf), _toxic(spark, sf), invert=True))


@query("SELECT item_id AS ordinal, doc_id AS name, length(text)::INT AS size FROM (SELECT item_id FROM benchmark) b JOIN documents ON doc_id = item_id * 3")
def rec_order(spark, sf):
    listed = t.load(spark, sf, "benchmark").select((F.col("item_id") * 3).alias("name"), F.col("item_id").alias("ordinal"))
    return records.in_order(t.records(spark, sf), listed).select("ordinal", "name", F.length("seq").alias("size"))


@query("SELECT doc_id AS name, ((sum(length(text)) OVER (ORDER BY doc_id) - length(text)) // 100000)::BIGINT AS chunk FROM documents")
def rec_split_about(spark, sf):
    return records.split_about(t.records(spark, sf), 100_000).select("name", "chunk")


@query("SELECT doc_id AS name, row_number() OVER (ORDER BY source, doc_id) AS seq_id, md5(text) AS digest FROM documents")
def rec_number(spark, sf):
    found = number_rows(t.records(spark, sf), ["genome", "name"], "seq_id")
    return found.select("name", "seq_id", F.md5("seq").alias("digest"))


@query(f"WITH d AS ({t.DNA_SQL}) SELECT 'd' || doc_id AS name, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS record_no, md5(seq) AS digest, md5(translate(seq, 'ACGT', '@+IJ')) AS quality FROM d")
def fastq_records(spark, sf):
    """Reads written as FASTQ in id order, their qualities full of what begins names, and read back."""
    reads = t.dna(spark, sf).select("name", io.fastq_lines(F.concat(F.lit("d"), F.col("name").cast("string")), F.col("seq"), F.translate("seq", "ACGT", "@+IJ")).alias("line"))
    path = f"{shared_dir(spark)}/fastq/{uuid.uuid4().hex}"
    reads.repartitionByRange("name").sortWithinPartitions("name").select("line").write.text(path, compression="gzip")
    found = io.read_fastq(spark, path).select("file_no", "record_no", "name", F.md5("seq").alias("digest"), F.md5("quality").alias("quality"))
    out = stored(number_rows(found, ["file_no", "record_no"], "n", 0).select("name", F.col("n").alias("record_no"), "digest", "quality"))
    delete(spark, path)
    return out


@query("SELECT coalesce('q' || l.quality || '_' || d.doc_id, d.doc_id::VARCHAR) AS name, length(text)::INT AS size FROM documents d LEFT JOIN labels l USING (doc_id)")
def rec_replace(spark, sf):
    mapping = t.load(spark, sf, "labels").select(F.col("doc_id").alias("name"), F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("_"), F.col("doc_id").cast("string")).alias("new_name"))
    return records.size(records.replace_names(t.records(spark, sf), mapping))


@query(f"WITH d AS ({t.DNA_SQL}) SELECT 'RC_' || doc_id AS name, md5({t.RC_SQL.format('seq')}) AS digest FROM d")
def rec_revcomp(spark, sf):
    return records.reverse_complements(t.dna(spark, sf)).select("name", F.md5("seq").alias("digest"))


@query("SELECT doc_id AS name, md5(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS digest FROM documents WHERE length(text) BETWEEN 300 AND 5000")
def rec_filter(spark, sf):
    return records.filter_records(t.records(spark, sf), least=300, most=5000, upper=True).select("name", F.md5("seq").alias("digest"))


@query(f"WITH d AS ({t.DNA_SQL}) SELECT min(doc_id) AS name, count(*) AS n_copies FROM d GROUP BY least(seq, {t.RC_SQL.format('seq')})")
def rec_dedup(spark, sf):
    return records.dedup(t.dna(spark, sf), both_strands=True)


@query("""SELECT doc_id AS name, md5(CASE WHEN length(text) < doc_id % 50 + 1 THEN text ELSE substr(text, 1, doc_id % 50) || repeat('N', least(20, length(text) - doc_id % 50)::INT) || substr(text, doc_id % 50 + 21) END) AS digest FROM documents""")
def rec_mask_hard(spark, sf):
    docs = t.records(spark, sf)
    regions = docs.select("name", (F.col("name") % 50 + 1).alias("start"), (F.col("name") % 50 + 20).alias("end"))
    return records.mask(docs, regions, hard=True).select("name", F.md5("seq").alias("digest"))


def _masked_sql(text: str, first: str, last: str) -> str:
    return f"substr({text}, 1, ({first}) - 1) || lower(substr({text}, {first}, ({last}) - ({first}) + 1)) || substr({text}, ({last}) + 1)"


@query(f"""WITH a AS (SELECT doc_id, {_masked_sql('text', '(doc_id % 50 + 1)::INT', '(doc_id % 50 + 20)::INT')} AS s FROM documents) SELECT doc_id AS name, md5({_masked_sql('s', '100', '109')}) AS digest FROM a""")
def rec_mask_runs(spark, sf):
    """Regions written as JSON run lists, one object a file line, read back and masked."""
    docs = t.records(spark, sf)
    path = f"{shared_dir(spark)}/runs/{uuid.uuid4().hex}"
    first = F.col("name") % 50 + 1
    runs = F.concat_ws(",", F.concat_ws("-", first.cast("string"), (first + 19).cast("string")), F.lit("100-104"), F.lit("105"), F.lit("106-109"))
    groups = docs.select((F.col("name") % 16).alias("g"), F.struct(F.col("name").cast("string").alias("k"), runs.alias("v")).alias("e")).groupBy("g").agg(F.map_from_entries(F.collect_list("e")).alias("m"))
    groups.repartition("g").select(F.to_json("m").alias("line")).write.option("maxRecordsPerFile", 1).text(path)
    regions = intervals.union(io.read_run_lists(spark, path), "name")
    masked = records.mask(docs.withColumn("name", F.col("name").cast("string")), regions)
    out = stored(masked.select(F.col("name").cast("long").alias("name"), F.md5("seq").alias("digest")))
    delete(spark, path)
    return out


@query(f"""WITH d AS ({t.DNA_SQL}), r AS (SELECT doc_id, CASE WHEN quality = 1 THEN '+' ELSE '-' END AS s, doc_id % 30 + 1 AS b FROM labels)
SELECT r.doc_id || '(' || s || '):' || b || '-' || (b + 39) AS range, CASE WHEN s = '-' THEN {t.RC_SQL.format('substr(seq, b, 40)')} ELSE substr(seq, b, 40) END AS seq FROM r JOIN d USING (doc_id)""")
def rec_range(spark, sf):
    start = F.col("doc_id") % 30 + 1
    asked = t.load(spark, sf, "labels").select(format_range(F.col("doc_id").cast("string"), F.when(F.col("quality") == 1, "+").otherwise("-"), start, start + 39).alias("range"))
    return records.extract_ranges(t.dna(spark, sf), asked)


_AA = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


_CODONS = ",".join(a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG")


def six_frames_sql(least: int) -> str:
    return f"""WITH d AS ({t.DNA_SQL}), s AS (SELECT doc_id, length(seq) AS n, '+' AS strand, seq AS q FROM d UNION ALL SELECT doc_id, length(seq), '-', {t.RC_SQL.format('seq')} FROM d),
f AS (SELECT doc_id, n, strand, frame, q FROM s, (VALUES (0), (1), (2)) v(frame)),
p AS (SELECT doc_id, n, strand, frame, array_to_string(list_transform(regexp_extract_all(substr(q, frame + 1), '...'), lambda c: substr('{_AA}', ((instr('{_CODONS}', c) + 3) // 4)::INT, 1)), '') AS prot FROM f),
l AS (SELECT *, string_split(prot, '*') AS parts FROM p), u AS (SELECT doc_id, n, strand, frame, unnest(parts) AS protein, unnest(range(len(parts))) AS i FROM l),
b AS (SELECT *, coalesce(sum(length(protein) + 1) OVER (PARTITION BY doc_id, strand, frame ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3 + frame + 1 AS b FROM u)
SELECT doc_id AS name, strand, frame::INT AS frame, (CASE WHEN strand = '+' THEN b ELSE n - (b + length(protein) * 3 - 1) + 1 END)::BIGINT AS start, (CASE WHEN strand = '+' THEN b + length(protein) * 3 - 1 ELSE n - b + 1 END)::BIGINT AS "end", protein FROM b WHERE length(protein) >= {least}"""


@query(six_frames_sql(30))
def rec_sixframe(spark, sf):
    return records.six_frames(t.dna(spark, sf), least=30)


@query("SELECT doc_id AS name, 1 AS mate, length(text)::INT AS size FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 2, length(text)::INT FROM documents WHERE lang = 'fr'")
def rec_interleave(spark, sf):
    docs = t.load(spark, sf, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("seq"), "lang")
    first, second = (docs.where(F.col("lang") == x).drop("lang") for x in ("en", "fr"))
    return records.interleave(first, second).select("name", "mate", F.length("seq").alias("size"))


_GFF = "'asm.' || {seq} || '(' || CASE WHEN event_id % 3 = 0 THEN '-' ELSE '+' END || '):' || (event_id * 10 + 1) || '-' || (event_id * 10 + 1 + floor(value)::BIGINT) AS range FROM events WHERE event_type = 'click'"


@query("SELECT 'ev-' || event_id AS key, " + _GFF.format(seq="'chr' || (user_id % 20) || '.v2'"))
def gff_rg(spark, sf):
    return annotations.feature_ranges(t.features(spark, sf), tag="Click")


@query("SELECT 'ev' AS key, " + _GFF.format(seq="'chr' || (user_id % 20)"))
def gff_rg_simplify(spark, sf):
    return annotations.feature_ranges(t.features(spark, sf), tag="click", simplify=True, simplify_seq=True)


@query("SELECT coalesce(props->>'$.k', 'NA') AS key, " + _GFF.format(seq="'chr' || (user_id % 20) || '.v2'"))
def gff_rg_key(spark, sf):
    return annotations.feature_ranges(t.features(spark, sf), tag="click", key="k")


@query("SELECT 'S' || l_suppkey || '.c' || l_linenumber || '(' || CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END || '):' || l_orderkey || '-' || (l_orderkey + l_partkey) AS range FROM lineitem")
def range_format(spark, sf):
    li = t.load(spark, sf, "lineitem")
    name = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit(".c"), F.col("l_linenumber").cast("string"))
    return li.select(format_range(name, F.when(F.col("l_returnflag") == "R", "-").otherwise("+"), F.col("l_orderkey"), F.col("l_orderkey") + F.col("l_partkey")).alias("range"))


@query("SELECT 'S' || l_suppkey || '.c' || l_linenumber AS name, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, l_orderkey AS start, l_orderkey + l_partkey AS \"end\" FROM lineitem")
def range_parse(spark, sf):
    return range_format(spark, sf).select(parse_range(F.col("range")).alias("r")).select("r.*")


@query("""WITH l AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_linestatus, lag(l_linestatus) OVER w AS p FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
g AS (SELECT l_suppkey, l_orderkey, sum(CASE WHEN p = l_linestatus THEN 0 ELSE 1 END) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS block_id FROM l)
SELECT l_suppkey AS file, block_id::BIGINT AS block_id, count(*) AS n_ranges, min(l_orderkey) AS first_start FROM g GROUP BY ALL""")
def block_group(spark, sf):
    li = t.load(spark, sf, "lineitem")
    found = group_blocks(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_linestatus")
    return found.groupBy(F.col("l_suppkey").alias("file"), "block_id").agg(F.count("*").alias("n_ranges"), F.min("l_orderkey").alias("first_start"))


_UNION = """i AS (SELECT l_suppkey AS seq_id, l_orderkey AS s, l_orderkey + l_quantity::BIGINT AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY seq_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i),
g AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
un AS (SELECT seq_id, min(s) AS start, max(e) AS "end" FROM g GROUP BY seq_id, k)"""


@query(f"WITH {_UNION} SELECT * FROM un")
def mask_union(spark, sf):
    return intervals.union(t.intervals(spark, sf))


_OTHERS = """oi AS (SELECT o_custkey % 100 AS seq_id, o_orderkey AS s, o_orderkey + o_custkey % 7 AS e FROM orders),
om AS (SELECT *, max(e) OVER (PARTITION BY seq_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM oi),
og AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM om),
ot AS (SELECT seq_id, min(s) AS s, max(e) AS e FROM og GROUP BY seq_id, k)"""


def _others(spark, sf):
    return t.load(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("seq_id"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey") % 7).alias("end"))


@query(f'WITH {_UNION}, {_OTHERS} SELECT un.seq_id, greatest(un.start, s) AS start, least(un."end", e) AS "end" FROM un JOIN ot ON un.seq_id = ot.seq_id AND s <= un."end" AND e >= un.start')
def interval_intersection(spark, sf):
    return intervals.intersection(t.intervals(spark, sf), _others(spark, sf))


@query(f"""WITH {_UNION}, {_OTHERS}, gp AS (SELECT seq_id, e + 1 AS a, coalesce(lead(s) OVER (PARTITION BY seq_id ORDER BY s), 1000000000) - 1 AS b FROM ot UNION ALL SELECT seq_id, -1000000000, min(s) - 1 FROM ot GROUP BY seq_id
  UNION ALL SELECT DISTINCT seq_id, -1000000000, 1000000000 FROM un WHERE seq_id NOT IN (SELECT seq_id FROM ot))
SELECT un.seq_id, greatest(un.start, a) AS start, least(un."end", b) AS "end" FROM un JOIN gp ON un.seq_id = gp.seq_id AND a <= un."end" AND b >= un.start""")
def interval_difference(spark, sf):
    return intervals.difference(t.intervals(spark, sf), _others(spark, sf))


_BITS, _HASHES = bloom_size(200, 0.1)
_PLACES = f"list_transform(range(0, {_HASHES}), lambda i: (({t.HASH_SQL.format('x')} % {_BITS}) + i * ({t.HASH_SQL.format(chr(39).join(['x || ', '#', '']))} % {_BITS})) % {_BITS})"


@query(f"""WITH f AS (SELECT DISTINCT unnest({_PLACES}) AS p FROM (SELECT c_name AS x FROM customer WHERE c_nationkey < 5)), l AS (SELECT list(p) AS ps FROM f)
SELECT x AS name, known FROM (SELECT c_name AS x, c_nationkey < 5 AS known FROM customer), l WHERE list_has_all(ps, {_PLACES})""")
def bloom_contains(spark, sf):
    """Customers that a filter of some nations' customers lets through: those, and a few others."""
    customers = t.load(spark, sf, "customer").select(F.col("c_name").alias("name"), (F.col("c_nationkey") < 5).alias("known"))
    return bloom.maybe_in(customers, "name", bloom.build(customers.where("known"), "name", 200, 0.1), 200, 0.1)


@query(f"WITH {_UNION} SELECT o_orderkey AS pos, o_custkey % 100 AS seq_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM un WHERE un.seq_id = o_custkey % 100 AND o_orderkey BETWEEN un.start AND un.\"end\")")
def mask_antijoin(spark, sf):
    points = t.load(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 100).alias("seq_id"))
    return intervals.outside(points, intervals.union(t.intervals(spark, sf)))
