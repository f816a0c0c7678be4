"""Queries of file sources and sinks: each writes what it reads, in a new folder, from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import patterns as pat
from tidewater.plans.catalog import query
from tidewater.schema import posts, table
from tidewater.sources import files, scratch, views

ORDER = "o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))


@query("S2_footers", "SELECT 'l_orderkey' AS \"column\", count(*) AS n, count(*) - count(l_orderkey) AS nulls, CAST(min(l_orderkey) AS VARCHAR) AS low, CAST(max(l_orderkey) AS VARCHAR) AS high, 'ZSTD' AS codec FROM lineitem UNION ALL SELECT 'l_shipmode', count(*), count(*), NULL, NULL, 'ZSTD' FROM lineitem")
def footer_rows(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.folder(spark)
    rows = table(spark, d, "lineitem").select("l_orderkey", F.lit(None).cast("string").alias("l_shipmode"))
    files.write_chunks(rows, path, "l_orderkey", 4, 20_000)
    found = files.footers(spark, files.files_of(spark, path))
    ends = F.when(F.col("column") == "l_orderkey", F.struct(F.col("low").cast("long").alias("a"), F.col("high").cast("long").alias("b")))
    out = found.withColumn("x", ends).groupBy("column").agg(F.sum("rows").alias("n"), F.sum("nulls").alias("nulls"), F.min("x.a").cast("string").alias("low"), F.max("x.b").cast("string").alias("high"), F.max("codec").alias("codec"))
    return out.select("column", "n", "nulls", "low", "high", "codec")


@query("S3_pruned_window", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-03-10'")
def pruned(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.folder(spark)
    files.write_chunks(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), path, "o_orderdate", 16)
    return files.windowed(spark, path, "o_orderdate", "1995-03-01", "1995-03-10").select("o_orderkey")


@query("S5_K3_csv", f"SELECT {ORDER} FROM orders")
def csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.folder(spark)
    files.write_csv(_orders(spark, d), path, ["o_custkey", "o_orderkey", "day"])
    return files.read_csv(spark, path, "o_custkey long, o_orderkey long, day date").select("o_orderkey", "o_custkey", "day")


@query("S6_second_source", "WITH s AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'Senate' WHEN 1 THEN ' Sen. ' WHEN 2 THEN 'U.S. House' WHEN 3 THEN 'Representative' WHEN 4 THEN 'h' END AS raw, c_custkey % 6 AS k, c_acctbal FROM customer) SELECT id, CASE WHEN k < 2 THEN 'Senate' WHEN k < 5 THEN 'House' END AS chamber FROM s WHERE c_acctbal > 0")
def second_source(spark: SparkSession, d: str) -> DataFrame:
    spelled = F.get(F.array(*[F.lit(x) for x in ("Senate", " Sen. ", "U.S. House", "Representative", "h", None)]), (F.col("c_custkey") % 6).cast("int"))
    dated = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return table(spark, d, "customer").where(dated.isNotNull()).select(F.col("c_custkey").alias("id"), pat.chamber(spelled).alias("chamber"))


@query("S7_K6_framed_events", "SELECT event_id, user_id, event_type FROM events")
def framed(spark: SparkSession, d: str) -> DataFrame:
    path, rows = scratch.folder(spark), table(spark, d, "events").select("event_id", "user_id", "event_type")
    files.write_framed(rows, path)
    return files.framed_events(spark, path, rows.schema, rows.count())


@query("S8_verified_package", "SELECT event_type AS kind, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def package(spark: SparkSession, d: str) -> DataFrame:
    path, rows = scratch.folder(spark), table(spark, d, "events")
    for name in ("view", "click"):
        rows.where(F.col("event_type") == name).select("event_id", F.struct("user_id", "props").alias("body")).write.parquet(f"{path}/{name}")
    told = scratch.put(files.manifest(spark, path))
    found = files.verified(spark, path, told, ["view", "click"], "event_id")
    both = found["view"].withColumn("kind", F.lit("view")).unionByName(found["click"].withColumn("kind", F.lit("click")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("body.user_id").alias("users"))


@query("S15_log_replay", "WITH l AS (SELECT user_id AS k, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id) SELECT k, event_id FROM l WHERE event_type <> 'error' AND event_id >= 100")
def log_replay(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.folder(spark)
    rows = table(spark, d, "events").select(F.col("user_id").alias("k"), "event_id", (F.col("event_type") == "error").alias("deleted"))
    rows.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.json(path)
    return files.last_wins(spark, path, "k", rows.schema, "event_id >= 100").select("k", "event_id")


@query("S17_S19_published_schema", "SELECT * FROM (VALUES ('buyers', 'id', 'bigint', 0), ('buyers', 'segment', 'string', 1), ('places', 'n_name', 'string', 0)) AS t(view, \"column\", type, position)")
def published(spark: SparkSession, d: str) -> DataFrame:
    names = views.publish(spark, {
        "buyers": views.View(f"{d}/customer.parquet", "one row a customer", lambda r: r.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))),
        "places": views.View(f"{d}/nation.parquet", "names only", lambda r: r.select("n_name")),
        "broken": views.View(f"{d}/nation.parquet", "its schema has changed", lambda r: r.select("no_such_column")),
        "absent": views.View(f"{d}/no_such_file.parquet", "not there"),
    })
    return views.schema(spark, names).select("view", "column", "type", F.col("position").cast("int").alias("position"))


@query("S18_driver_rows", "WITH k(status, name) AS (VALUES ('F', 'finished'), ('O', 'open')) SELECT name, count(*) AS n FROM orders JOIN k ON o_orderstatus = status GROUP BY name")
def driver_rows(spark: SparkSession, d: str) -> DataFrame:
    names = views.registered(spark, "td_states", [("F", "finished"), ("O", "open")], "status string, name string")
    return posts(spark, d).join(names, "status").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("S20_described", "SELECT count(*) AS n, min(ts) AS first, max(ts) AS last, count(DISTINCT CAST(ts AS DATE)) AS days, 'event_id,ts,user_id,event_type,value,props' AS columns, array_to_string(list_distinct(list_filter([CASE WHEN hour(min(ts)) >= 1 THEN CAST(CAST(min(ts) AS DATE) AS VARCHAR) END, CASE WHEN hour(max(ts)) < 23 THEN CAST(CAST(max(ts) AS DATE) AS VARCHAR) END], lambda x: x IS NOT NULL)), ',') AS partial_days, '[\"' || string_agg(DISTINCT event_type, '\",\"' ORDER BY event_type) || '\"]' AS values_event_type FROM events")
def described(spark: SparkSession, d: str) -> DataFrame:
    return views.describe(table(spark, d, "events"), "ts", ("event_type",))


@query("K1_K2_sorted_chunks", "SELECT count(*) AS n, CAST(ceil(count(*) / 2000.0) AS BIGINT) AS least_files, true AS bounded, true AS sorted FROM orders")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.folder(spark)
    files.write_chunks(table(spark, d, "orders").select("o_orderkey"), path, "o_orderkey", 3, 2000)
    meta = scratch.put(files.footers(spark, files.files_of(spark, path)).select("rows", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high")))
    size = meta.agg(F.sum("rows").alias("n"), F.max("rows").alias("most"))
    return size.select("n", F.ceil(F.col("n") / 2000).alias("least_files"), (F.col("most") <= 2000).alias("bounded"), (files.overlaps(meta).scalar() == 0).alias("sorted"))


@query("K4_report", "SELECT 'status' AS section, o_orderstatus AS k, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY ALL")
def report(spark: SparkSession, d: str) -> DataFrame:
    path, rows = scratch.folder(spark), posts(spark, d)
    files.report(spark, path, {n: rows.groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias("n")) for n, c in (("status", "status"), ("priority", "lang"))})
    doc = spark.read.text(path).select(F.explode(F.from_json("value", "map<string, array<struct<k:string, n:long>>>")).alias("section", "x"))
    return doc.select("section", F.explode("x").alias("x")).select("section", "x.k", "x.n")


@query("K5_json_lines", "SELECT c_custkey, c_mktsegment FROM customer")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    path, rows = scratch.folder(spark), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    files.write_json_lines(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("K7_matched_once", "WITH m AS (SELECT lang, source, n_chars FROM documents WHERE regexp_matches(text, '(?i)\\bthe\\b')) SELECT 'lang' AS by, lang AS k, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM m GROUP BY ALL")
def matched_once(spark: SparkSession, d: str) -> DataFrame:
    m = scratch.put(table(spark, d, "documents").where(F.col("text").rlike(pat.whole_word("the"))).select("lang", "source", "n_chars"))
    one = lambda c: m.groupBy(F.lit(c).alias("by"), F.col(c).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return one("lang").unionByName(one("source"))


@query("K8_chart_package", "SELECT 'days' AS chart, o_orderstatus AS x, count(*) AS y FROM orders GROUP BY ALL")
def charts(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.folder(spark)
    points = posts(spark, d).groupBy(F.col("status").alias("x")).agg(F.count(F.lit(1)).alias("y"))
    files.write_charts(spark, path, {"days": points, "old": points.limit(1)})
    files.write_charts(spark, path, {"days": points})
    rows = spark.read.schema("x string, y long").option("recursiveFileLookup", True).json(path)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/[^/]+$", 1).alias("chart"), "x", "y")


@query("K9_build_once", "SELECT n_nationkey AS k, n_name AS name FROM nation")
def build_once(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.folder(spark)
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    files.build_once(spark, path, lambda: rows)
    return files.build_once(spark, path, lambda: rows.limit(0))  # there already: not built again


@query("K11_merge_modes", "WITH o AS (SELECT l_orderkey AS k, min(l_linenumber) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1) SELECT k, low, high FROM o")
def merges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("low"), F.col("l_quantity").alias("high"))
    old, new = rows.where("low <= 3"), rows.where("low > 3")
    return files.upsert(old, new, "k", "low", {"low": "min", "high": "max"})


@query("U3_listed_files", "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def listed(spark: SparkSession, d: str) -> DataFrame:
    a, b = scratch.folder(spark), scratch.folder(spark)
    rows = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    rows.write.parquet(a)
    rows.withColumn("k", F.col("k") + 100).write.parquet(b)
    return spark.read.parquet(a, b)


@query("U6_selected_tags", "SELECT doc_id, unnest(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), ['the', 'and', 'of', 'licensed'])) AS topic FROM documents")
def selected_tags(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))
    return table(spark, d, "documents").select("doc_id", F.explode(F.array_intersect(found, F.array(*[F.lit(x) for x in ("the", "and", "of", "licensed")]))).alias("topic"))
