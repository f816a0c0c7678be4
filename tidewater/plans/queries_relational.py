"""Queries of scans, joins, windows, sets, samples and sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import sample, state
from tidewater.plans.catalog import query
from tidewater.schema import observations, posts, table

ORDER = "l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC"
OBS = "SELECT l_orderkey AS id, l_shipdate AS version, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_quantity AS BIGINT) AS likes, l_suppkey AS author_id, l_returnflag AS flag, l_linestatus AS status FROM lineitem"
ASC = "version, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
POSTS = "SELECT o_orderkey AS id, o_custkey AS author_id, o_orderdate AS created_at, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS lang, o_orderstatus AS status, CAST(floor(o_totalprice) AS BIGINT) AS likes FROM orders"


@query("S1_scan_projected", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-07-01'")
def scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz '1995-01-01' and l_shipdate < timestamp_ntz '1995-07-01'").select("l_orderkey", "l_quantity")


@query("S20_source_description", f"WITH p AS ({POSTS}) SELECT count(*) AS n, min(day) AS first_day, max(day) AS last_day, count(DISTINCT lang) AS langs, count(DISTINCT author_id) AS authors FROM p")
def describe(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_distinct("lang").alias("langs"), F.count_distinct("author_id").alias("authors"))


@query("S21_group_by_language", f"WITH p AS ({POSTS}) SELECT lang, count(*) AS n, count(*) FILTER (WHERE status = 'F') AS finished FROM p GROUP BY lang")
def by_language(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "F").alias("finished"))


@query("W1_latest_per_key", f"SELECT l_orderkey AS id, l_shipdate AS version, CAST(l_quantity AS BIGINT) AS likes, l_suppkey AS author_id FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) = 1")
def latest(spark: SparkSession, d: str) -> DataFrame:
    return state.latest(observations(spark, d), ["id"], [F.desc("version"), F.desc("added_at")]).select("id", "version", "likes", "author_id")


@query("W2_newest_complete_row", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC NULLS LAST) = 1")
def newest(spark: SparkSession, d: str) -> DataFrame:
    return state.newest_complete(table(spark, d, "orders"), "o_custkey", ["scored_at", "o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("W15_transitions", f"WITH o AS ({OBS}), s AS (SELECT *, lag(likes) OVER w AS prev, lag(version) OVER w AS pv FROM o WINDOW w AS (PARTITION BY id ORDER BY {ASC})) SELECT id, count(*) AS n, count(*) FILTER (WHERE likes > prev) AS rises, count(*) FILTER (WHERE likes < prev) AS falls, count(*) FILTER (WHERE pv = version) AS same_version FROM s GROUP BY id")
def transitions(spark: SparkSession, d: str) -> DataFrame:
    return state.transitions(observations(spark, d), ["version", "added_at"], "likes")


@query("G12_trajectories", f"WITH o AS ({OBS}), s AS (SELECT id, count(*) AS observations, min(version) AS first_version, max(version) AS last_version, arg_min(likes, ({ASC})) AS first_likes, arg_max(likes, ({ASC})) AS last_likes, CAST(epoch(max(version)) - epoch(min(version)) AS BIGINT) AS seconds FROM o GROUP BY id) SELECT *, last_likes - first_likes AS delta_likes, CASE WHEN seconds >= 3600 THEN round((last_likes - first_likes) * 3600.0::DOUBLE / seconds, 6) END AS hourly_likes FROM s")
def trajectories(spark: SparkSession, d: str) -> DataFrame:
    return state.trajectories(observations(spark, d), ["version", "added_at"], ["likes"])


@query("W3_lag_changes", f"WITH o AS ({OBS}), s AS (SELECT id, version, likes - lag(likes) OVER (PARTITION BY id ORDER BY {ASC}) AS change FROM o) SELECT id, version, change FROM s WHERE change IS NOT NULL")
def changes(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy("version", "added_at")
    return observations(spark, d).select("id", "version", (F.col("likes") - F.lag("likes").over(w)).alias("change")).where("change is not null")


@query("W4_distinct_pairs", "SELECT DISTINCT l_orderkey AS id, l_returnflag AS topic FROM lineitem")
def pairs(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).select("id", F.col("flag").alias("topic")).dropDuplicates(["id", "topic"])


HASH = "('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8))::BIGINT"


@query("W5_chained_caps", f"WITH p AS (SELECT *, {HASH} AS h FROM ({POSTS})), a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY lang, author_id ORDER BY h, id) = 1), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY lang, likes ORDER BY h, id) = 1) SELECT id, lang FROM b QUALIFY row_number() OVER (PARTITION BY lang, status ORDER BY h, id) <= CASE WHEN status = 'F' THEN 20 ELSE 30 END")
def caps(spark: SparkSession, d: str) -> DataFrame:
    rows = posts(spark, d).withColumn("h", sample.comparable_hash(F.col("id")))
    for key in (["lang", "author_id"], ["lang", "likes"]):
        rows = state.latest(rows, key, [F.asc("h"), F.asc("id")])
    return sample.capped(rows, ["lang", "status"], [F.asc("h"), F.asc("id")], F.when(F.col("status") == "F", 20).otherwise(30)).select("id", "lang")


@query("W6_top_n_per_group", f"WITH p AS ({POSTS}) SELECT lang, id, likes, row_number() OVER (PARTITION BY lang ORDER BY likes DESC, id) AS rank FROM p QUALIFY rank <= 8")
def top_n(spark: SparkSession, d: str) -> DataFrame:
    return state.top_n(posts(spark, d), ["lang"], [F.desc("likes"), F.asc("id")], 8).select("lang", "id", "likes", "rank")


@query("W8_total_over_all", f"WITH p AS ({POSTS}) SELECT id, (SELECT count(*) FROM p WHERE status = 'P') AS total FROM p WHERE status = 'P' ORDER BY likes DESC, id LIMIT 20")
def total(spark: SparkSession, d: str) -> DataFrame:
    rows = posts(spark, d).where("status = 'P'")
    return rows.select("id", "likes", rows.agg(F.count(F.lit(1))).scalar().alias("total")).orderBy(F.desc("likes"), "id").limit(20).select("id", "total")


@query("W9_round_robin", f"WITH p AS ({POSTS}), r AS (SELECT id, day, row_number() OVER (PARTITION BY day ORDER BY id) AS turn FROM p) SELECT id, day, turn FROM r ORDER BY turn, day LIMIT 100")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("day").orderBy("id")
    return posts(spark, d).select("id", "day", F.row_number().over(w).alias("turn")).orderBy("turn", "day").limit(100)


@query("J1_inner", "SELECT o_orderkey, l_linenumber, l_quantity, o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 100000")
def inner(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_totalprice > 100000")
    return o.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity", "o_custkey")


@query("J4_left_outer_coalesce", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("J6_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query("J7_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("J8_semi_by_aggregate", f"WITH p AS ({POSTS}), e AS (SELECT author_id FROM p GROUP BY author_id HAVING sum(likes) >= 1000000) SELECT id, author_id FROM p WHERE author_id IN (SELECT author_id FROM e)")
def eligible(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d)
    return p.join(p.groupBy("author_id").agg(F.sum("likes").alias("s")).where("s >= 1000000"), "author_id", "left_semi").select("id", "author_id")


@query("J9_theta", f"WITH p AS ({POSTS}), k AS (SELECT lang, max(day) AS peak, list_sort(list_distinct(list(day) FILTER (WHERE status = 'P')))[1:5] AS base FROM p GROUP BY lang) SELECT id, p.lang, day = peak AS at_peak FROM p JOIN k ON p.lang = k.lang AND (day = peak OR list_contains(base, day))")
def theta(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d)
    k = p.groupBy("lang").agg(F.max("day").alias("peak"), F.slice(F.array_sort(F.collect_set(F.when(F.col("status") == "P", F.col("day")))), 1, 5).alias("base"))
    return p.join(k, "lang").where((F.col("day") == F.col("peak")) | F.array_contains("base", F.col("day"))).select("id", "lang", (F.col("day") == F.col("peak")).alias("at_peak"))


@query("J11_multi_way", "SELECT n_name, r_name, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY n_name, r_name")
def multi(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("J12_first_per_version", f"WITH o AS ({OBS}), f AS (SELECT id, arg_min(flag, ({ASC})) AS first_flag FROM o GROUP BY id) SELECT o_orderkey, first_flag FROM orders JOIN f ON id = o_orderkey")
def first_mutation(spark: SparkSession, d: str) -> DataFrame:
    f = observations(spark, d).groupBy("id").agg(F.min_by("flag", F.struct("version", "added_at")).alias("first_flag"))
    return table(spark, d, "orders").join(f, F.col("id") == F.col("o_orderkey")).select("o_orderkey", "first_flag")


@query("J13_as_of", "WITH c AS (SELECT DISTINCT user_id, TIMESTAMP '2024-01-15' AS at FROM events) SELECT c.user_id, c.at, e.value FROM c ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2) e ON e.user_id = c.user_id AND e.ts <= c.at")
def as_of(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return state.as_of(events, "user_id", "ts", "value", events.select("user_id").distinct().withColumn("at", F.expr("timestamp_ntz '2024-01-15'")))


@query("J16_text_cache", "WITH t AS (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text) SELECT d.doc_id, first_id FROM documents d JOIN t USING (text)")
def text_cache(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("k"))
    return docs.join(docs.groupBy("k").agg(F.min("doc_id").alias("first_id")), "k").select("doc_id", "first_id")


@query("J17_full_outer", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def full(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full").select("k", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("J19_json_predicate", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k > 50")


@query("T1_top_liked", f"WITH p AS ({POSTS}) SELECT id, likes, day FROM p ORDER BY likes DESC NULLS LAST, id LIMIT 25")
def top_liked(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).orderBy(F.desc_nulls_last("likes"), "id").limit(25).select("id", "likes", "day")


@query("T4_rankings_with_reasons", f"WITH p AS ({POSTS}), r AS (SELECT 'likes' AS rank_name, id, row_number() OVER (ORDER BY likes DESC, id) AS k FROM p UNION ALL SELECT 'newest', id, row_number() OVER (ORDER BY created_at DESC, id) FROM p) SELECT id, string_agg(rank_name, ',' ORDER BY rank_name) AS reasons FROM r WHERE k <= 100 GROUP BY id")
def rankings(spark: SparkSession, d: str) -> DataFrame:
    rows = posts(spark, d)
    tops = [rows.orderBy(F.desc(c), "id").limit(100).select("id", F.lit(n).alias("rank_name")) for n, c in (("likes", "likes"), ("newest", "created_at"))]
    return tops[0].unionByName(tops[1]).groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("rank_name")), ",").alias("reasons"))


@query("T5_hash_sample", f"WITH p AS ({POSTS}) SELECT id FROM p WHERE {HASH} % 100 = 0")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample.bernoulli(posts(spark, d), F.col("id"), 100).select("id")


QUOTAS = f"""p AS ({POSTS}), n AS (SELECT day, count(*) AS n FROM p GROUP BY day),
r AS (SELECT *, row_number() OVER (ORDER BY n, day) AS i, CAST(sum(n) OVER (ORDER BY n, day ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS taken, count(*) OVER () AS d, CAST(sum(n) OVER () AS BIGINT) AS t FROM n),
w AS (SELECT *, bool_and(t <= 3000 OR n * (d - i + 1) <= 3000 - taken) OVER (ORDER BY i) AS whole FROM r),
z AS (SELECT *, CAST(3000 - sum(CASE WHEN whole THEN n ELSE 0 END) OVER () AS BIGINT) AS rest, count(*) FILTER (WHERE NOT whole) OVER () AS m, CAST(sum(CASE WHEN whole THEN 0 ELSE n END) OVER () AS BIGINT) AS weight, row_number() OVER (PARTITION BY whole ORDER BY n DESC, day) AS busy FROM w),
b AS (SELECT *, CASE WHEN whole THEN 0 ELSE (rest - m) * n // weight END AS base, CASE WHEN whole THEN 0 ELSE (rest - m) * n % weight END AS over FROM z),
e AS (SELECT *, row_number() OVER (PARTITION BY whole ORDER BY over DESC, n DESC, day) AS k, CAST(rest - m - sum(base) OVER () AS BIGINT) AS spare FROM b),
q AS (SELECT day, n, CAST(CASE WHEN whole THEN n WHEN rest < m THEN CAST(busy <= rest AS INT) ELSE least(n, 1 + base + CAST(k <= spare AS INT)) END AS BIGINT) AS quota FROM e)"""


@query("T6_allocation", f"WITH {QUOTAS} SELECT day, n, quota FROM q")
def allocation(spark: SparkSession, d: str) -> DataFrame:
    return sample.quotas(posts(spark, d), "day", 3000)


@query("T7_stratified_sample", f"WITH {QUOTAS} SELECT id, p.day FROM p JOIN q ON p.day = q.day QUALIFY row_number() OVER (PARTITION BY p.day ORDER BY {HASH}, id) <= max(quota) OVER (PARTITION BY p.day)")
def stratified(spark: SparkSession, d: str) -> DataFrame:
    return sample.stratified(posts(spark, d), "day", "id", 3000).select("id", "day")


@query("U1_union_of_metrics", "SELECT 'quantity' AS metric, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem UNION ALL SELECT 'line', count(*), CAST(sum(l_linenumber) AS BIGINT) FROM lineitem")
def metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("quantity"), F.col("l_linenumber").cast("long").alias("line"))
    return rows.unpivot([], ["quantity", "line"], "metric", "v").groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("U2_timeline_union", "SELECT event_id AS id, ts AS at, 'event' AS kind FROM events UNION ALL SELECT o_orderkey, o_orderdate, 'order' FROM orders")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.lit("event").alias("kind"))
    return e.unionByName(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.lit("order").alias("kind")), allowMissingColumns=True)


@query("U4_distinct", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_custkey", "o_orderstatus").distinct()


@query("U5_set_difference", "SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders")
def difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, d, "orders").select("o_custkey"))


@query("U7_calendar_spine", f"WITH p AS ({POSTS}), s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM p) SELECT day, count(id) AS n FROM s LEFT JOIN p USING (day) GROUP BY day")
def spine(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d)
    days = p.agg(F.explode(F.sequence(F.min("day"), F.max("day"), F.expr("interval 1 day"))).alias("day"))
    return days.join(p.groupBy("day").agg(F.count(F.lit(1)).alias("n")), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("F5_window_F6_language_F7_likes", f"WITH p AS ({POSTS}) SELECT id FROM p WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1996-04-01' AND lang IN ('1-URGENT', '2-HIGH') AND likes >= 1000")
def filtered(spark: SparkSession, d: str) -> DataFrame:
    from tidewater.plans.spec import Spec, compile_filter

    spec = Spec(start="1996-01-01", end="1996-04-01", languages=("1-URGENT", "2-HIGH"), min_likes=1000, originals_only=False)
    return posts(spark, d).where(compile_filter(spec, {"created_at": "created_at", "lang": "lang", "likes": "likes"}, ntz=True)).select("id")


@query("F22_post_type", "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'repost' WHEN o_orderstatus = 'F' THEN 'reply' WHEN o_orderpriority LIKE '1%' THEN 'quote' ELSE 'original' END AS kind, count(*) AS n FROM orders GROUP BY 1")
def post_type(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("id") % 7 == 0, "repost").when(F.col("status") == "F", "reply").when(F.col("lang").startswith("1"), "quote").otherwise("original")
    return posts(spark, d).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("M18_thread_heat", "SELECT a.conv_id, a.turn, count(b.turn) AS heat FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 GROUP BY ALL")
def heat(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn")
    n = c.groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.count(F.lit(1)).alias("heat"))
    rows = c.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("k")).join(n, ["conv_id", "turn"], "left")
    return rows.select("conv_id", "turn", (F.col("k") * F.coalesce("heat", F.lit(0))).alias("heat"))
