"""Queries of streams that run to their end, change data, labels, projects and live tracking."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import labeler
from tidewater.plans import project
from tidewater.plans.catalog import query
from tidewater.plans.queries_activity import EVENTS, grouped
from tidewater.plans.spec import Spec
from tidewater.schema import activity as events_of
from tidewater.schema import table
from tidewater.sources import scratch
from tidewater.streaming import ledger

ONE = "*"
H4 = 4 * 3_600_000


def _streamed(spark: SparkSession, rows: DataFrame, files: int = 3) -> DataFrame:
    """The rows as a stream of a few files, one a micro-batch, out of order."""
    path = scratch.folder(spark)
    rows.repartition(files, F.xxhash64("event_id") % files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("Z12_Z13_streamed_buckets", f"WITH {EVENTS}, b AS (SELECT *, t // {H4} * {H4} AS start FROM ev), {grouped('start', 'b')}")
def streamed_buckets(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.folder(spark)
    ledger.live_buckets(_streamed(spark, events_of(spark, d)), f"{path}/sums", f"{path}/checkpoint", H4).awaitTermination()
    return ledger.read_buckets(spark, f"{path}/sums")


@query("Z1_streamed_log", "SELECT event_id AS seq, sha256(props) AS hash FROM events")
def streamed_log(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.folder(spark)
    rows = table(spark, d, "events").select("event_id", F.col("event_id").alias("seq"), F.sha2("props", 256).alias("hash"))
    for k in range(2):  # the second run brings everything again
        ledger.start(spark, _streamed(spark, rows).drop("event_id"), f"{path}/log", f"{path}/checkpoint-{k}").awaitTermination()
    return spark.read.parquet(f"{path}/log").select("seq", "hash")


@query("Z8_Z9_streamed_screening", "SELECT event_type AS consumer, event_id FROM events WHERE event_type IN ('click', 'view') AND regexp_matches(props, '(?i)[13]')")
def streamed_screening(spark: SparkSession, d: str) -> DataFrame:
    path, rows = scratch.folder(spark), table(spark, d, "events").select("event_id", "event_type", "props")
    for name in ("click", "view"):
        wanted = (F.col("event_type") == name) & F.col("props").rlike("(?i)[13]")
        ledger.route(_streamed(spark, rows), name, wanted, f"{path}/{name}", f"{path}/checkpoint-{name}").awaitTermination()
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/{n}").select("consumer", "event_id") for n in ("click", "view")])


@query("Z2_post_versions", "SELECT user_id AS post, sha256(event_type) AS version, min(event_type) AS text, min(event_id) AS first_seq, max(event_id) AS last_seq FROM events WHERE event_type <> 'error' GROUP BY ALL")
def post_versions(spark: SparkSession, d: str) -> DataFrame:
    return ledger.versions(_changes(spark, d))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    return table(spark, d, "events").select(F.col("user_id").alias("post"), F.col("event_id").alias("seq"), op.alias("operation"), F.col("event_type").alias("text"))


@query("Z2_tombstones", "SELECT user_id AS post, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'error') AS text, max(event_id) AS last_seq, arg_max(event_type, event_id) = 'error' AS deleted FROM events GROUP BY 1")
def tombstones(spark: SparkSession, d: str) -> DataFrame:
    return ledger.current_posts(_changes(spark, d)).select("post", "text", "last_seq", "deleted")


@query("Z4_late_context", "WITH p AS (SELECT user_id, arg_min(props, event_id) AS context, min(event_id) AS post_seq FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT event_id AS seq, context, CASE WHEN post_seq IS NOT NULL THEN greatest(event_id, post_seq) END AS known_seq FROM events LEFT JOIN p USING (user_id) WHERE event_type = 'click'")
def late_context(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    likes = rows.where("event_type = 'click'").select(F.col("event_id").alias("seq"), F.col("user_id").alias("subject"))
    posts = rows.where("event_type = 'signup'").select(F.col("user_id").alias("post"), F.col("event_id").alias("seq"), F.col("props").alias("text"))
    return ledger.resolved(likes, posts).select("seq", "context", "known_seq")


@query("Z6_cursor_reset", "WITH n AS (SELECT event_id, user_id, event_id >= 500 AS late, CASE WHEN event_type <> 'error' THEN event_type END AS now FROM events), m AS (SELECT *, lag(now) OVER (PARTITION BY user_id, late ORDER BY event_id) AS was FROM n), x AS (SELECT was AS subject, -1 AS delta FROM m WHERE was IS DISTINCT FROM now UNION ALL SELECT now, 1 FROM m WHERE was IS DISTINCT FROM now) SELECT subject, count(*) AS moves, CAST(sum(delta) AS BIGINT) AS balance FROM x WHERE subject IS NOT NULL GROUP BY subject")
def cursor_reset(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("create")
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("like"), op.alias("operation"), F.col("event_type").alias("subject"))
    return ledger.reset_deltas(rows, [500]).groupBy("subject").agg(F.count(ONE).alias("moves"), F.sum("delta").alias("balance"))


@query("Z21_gaps_by_run", "WITH r AS (SELECT event_type AS run, event_id AS seq, lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS b FROM events) SELECT run, b + 1 AS \"from\", seq - 1 AS \"to\" FROM r WHERE seq > b + 1")
def gaps_by_run(spark: SparkSession, d: str) -> DataFrame:
    return ledger.gaps(table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("seq")))


@query("Z24_fair_turns", "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS round FROM events) SELECT event_type, event_id, CAST(round AS INT) AS round, CAST(row_number() OVER (PARTITION BY round ORDER BY event_type) AS INT) AS place FROM r")
def fair_turns(spark: SparkSession, d: str) -> DataFrame:
    return ledger.fair(table(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id")


def _shout(texts: list[str]) -> list[Mapping[str, object]]:
    """A stand-in for a model: the answer depends on the text alone."""
    return [{"relevant": (len(t) % 10) / 9, "score": float(len(t) % 5)} for t in texts]


ASKED = [labeler.Question("relevant", "noul"), labeler.Question("score", "score")]


@query("Q5_Q6_scored_texts", "SELECT doc_id, round((length(text) % 10) / 9.0::DOUBLE, 6) AS relevant, (length(text) % 5)::DOUBLE AS score FROM documents WHERE trim(text) <> ''")
def scored_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    cache = scratch.put(labeler.labelled(docs.where("doc_id % 2 = 0"), "text", _shout, ASKED, "m1"))
    labels = labeler.labelled(docs, "text", _shout, ASKED, "m1", cache)
    found = labeler.mapped_back(docs, "text", labels).where("answers is not null")
    return found.select("doc_id", *[F.round(F.get_json_object("answers", f"$.{q.name}").cast("double"), 6).alias(q.name) for q in ASKED])


@query("Z26_two_stages", "SELECT CASE WHEN trim(text) = '' OR text IS NULL THEN 'failed' WHEN (length(text) % 10) / 9.0::DOUBLE < 0.5 THEN 'others' ELSE 'done' END AS state, count(*) AS n, sum(CASE WHEN (length(text) % 10) / 9.0::DOUBLE >= 0.5 AND trim(text) <> '' THEN (length(text) % 5)::DOUBLE END) AS total FROM documents GROUP BY 1")
def two_stages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = labeler.two_stage(docs, "text", _shout, ASKED[0], 0.5, _shout, ASKED[1], "m1")
    return found.groupBy("state").agg(F.count(ONE).alias("n"), F.sum("score").alias("total"))


@query("Q7_trial", "WITH a AS (SELECT p_brand AS choice, p_size / 50.0::DOUBLE AS c FROM part), g AS (SELECT choice, count(*) AS n, count(*) FILTER (WHERE c < 0.5) AS u FROM a GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS groups, round(max(n) / sum(n)::DOUBLE, 6) AS largest, round(sum(u) / sum(n)::DOUBLE, 6) AS unsure, CASE WHEN sum(n) < 20 THEN 'thin' WHEN round(max(n) / sum(n)::DOUBLE, 6) >= 0.9 THEN 'dominant' WHEN round(sum(u) / sum(n)::DOUBLE, 6) >= 0.5 THEN 'unsure' WHEN count(*) < 3 THEN 'unused options' ELSE 'good' END AS verdict FROM g")
def trial(spark: SparkSession, d: str) -> DataFrame:
    return labeler.verdict(table(spark, d, "part").select(F.col("p_brand").alias("choice"), (F.col("p_size") / 50.0).alias("confidence")), 3)


DATED = "q AS (SELECT doc_id AS id, TIMESTAMP '2026-01-01' + to_days(CAST(doc_id % 28 AS INT)) AS created_at, text, lang, n_chars AS likes FROM documents), m AS (SELECT *, CAST(created_at AS DATE) AS day FROM q WHERE created_at < TIMESTAMP '2026-01-21' AND regexp_matches(text, '(?i)\\bthe\\b') AND NOT starts_with(text, 'RT @'))"
SPEC = Spec("2026-01-01", "2026-01-21", any_of=({"term": "the", "match": "word"},))


def _dated(spark: SparkSession, d: str) -> DataFrame:
    at = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).cast("timestamp_ntz")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), at.alias("created_at"), "text", "lang", F.col("n_chars").alias("likes"))


@query("V6_preview_days", f"WITH {DATED} SELECT day, count(*) AS n FROM m GROUP BY 1")
def preview_days(spark: SparkSession, d: str) -> DataFrame:
    return project.preview(_dated(spark, d), SPEC, ntz=True)["per_day"]


@query("V6_preview_languages", f"WITH {DATED}, g AS (SELECT coalesce(lang, '<NULL>') AS lang, count(*) AS n FROM m GROUP BY 1) SELECT lang, n, round(n / CAST((SELECT sum(n) FROM g) AS DOUBLE), 6) AS share FROM g ORDER BY n DESC, lang LIMIT 12")
def preview_languages(spark: SparkSession, d: str) -> DataFrame:
    return project.preview(_dated(spark, d), SPEC, ntz=True)["language_mix"]


@query("V6_preview_examples", f"WITH {DATED} SELECT id, left(text, 240) AS text FROM m ORDER BY likes DESC NULLS LAST, id LIMIT 6")
def preview_examples(spark: SparkSession, d: str) -> DataFrame:
    return project.preview(_dated(spark, d), SPEC, ntz=True)["examples"]


def _finished(spark: SparkSession, d: str) -> tuple[project.Projects, str]:
    def score(rows: DataFrame) -> DataFrame:
        s = (F.col("likes") % 201 - 100) / 100.0
        return rows.withColumn("score", s).withColumn("label", F.when(s < -0.2, "negative").when(s > 0.2, "positive").otherwise("neutral"))

    projects = project.Projects(spark, scratch.folder(spark))
    name = projects.submit(SPEC, _dated(spark, d), score, 1_000_000, ntz=True)
    assert projects.submit(SPEC, _dated(spark, d).limit(0), score, 1, ntz=True) == name  # it has run: not run again
    return projects, name


@query("V8_feeling_chart", f"WITH {DATED} SELECT 'mean' AS series, day AS x, round(sum((1 + likes) * ((likes % 201 - 100) / 100.0::DOUBLE)) / sum(1 + likes), 6) AS y, count(*) AS n FROM m GROUP BY day")
def feeling_chart(spark: SparkSession, d: str) -> DataFrame:
    projects, name = _finished(spark, d)
    return projects.chart(name, "feeling")["points"]


@query("V8_label_chart", f"WITH {DATED}, l AS (SELECT day, CASE WHEN (likes % 201 - 100) / 100.0::DOUBLE < -0.2 THEN 'negative' WHEN (likes % 201 - 100) / 100.0::DOUBLE > 0.2 THEN 'positive' ELSE 'neutral' END AS series FROM m), c AS (SELECT series, day AS x, count(*) AS n FROM l GROUP BY ALL) SELECT series, x, round(n / CAST(sum(n) OVER (PARTITION BY x) AS DOUBLE), 6) AS y, n FROM c")
def label_chart(spark: SparkSession, d: str) -> DataFrame:
    projects, name = _finished(spark, d)
    return projects.chart(name, "labels")["points"]


@query("V16_project_posts", f"WITH {DATED} SELECT id FROM m WHERE (likes % 201 - 100) / 100.0::DOUBLE > 0.2 ORDER BY likes DESC, id LIMIT 50")
def project_posts(spark: SparkSession, d: str) -> DataFrame:
    projects, name = _finished(spark, d)
    return projects.posts(name, "likes", ["positive"]).select("id")


@query("V16_project_status", f"WITH {DATED} SELECT count(*) AS sampled, count(*) AS scored, 'READY' AS status FROM m")
def project_status(spark: SparkSession, d: str) -> DataFrame:
    projects, _ = _finished(spark, d)
    return spark.createDataFrame([(s["sampled"], s["scored"], s["status"]) for s in map(projects.status, projects.names())], "sampled long, scored long, status string")


MATCH = "e AS (SELECT event_id, user_id AS post, CASE WHEN event_type = 'view' THEN 'post' ELSE 'like' END AS kind, user_id % 5 AS target, regexp_matches(props, '[13]') AS hit FROM events), h AS (SELECT DISTINCT post FROM e WHERE kind = 'post' AND hit), k AS (SELECT * FROM e WHERE hit OR post IN (SELECT post FROM h))"


@query("V9_scan", f"WITH {MATCH} SELECT count(*) FILTER (WHERE kind = 'post') AS posts, count(*) FILTER (WHERE kind <> 'post') AS likes, count(DISTINCT target) AS targets FROM k")
def scanned(spark: SparkSession, d: str) -> DataFrame:
    return project.scan(_searched(spark, d), F.col("props").rlike("[13]"))


def _searched(spark: SparkSession, d: str) -> DataFrame:
    return events_of(spark, d).join(table(spark, d, "events").select("event_id", "props"), "event_id")


@query("V9_found_posts", f"WITH {EVENTS}, {MATCH.replace('e AS (', 'x AS (', 1).replace('FROM e ', 'FROM x ')}, g AS (SELECT ev.post, min(ev.t) FILTER (WHERE ev.kind = 'post') AS published, CAST(sum(CASE WHEN ev.kind = 'like' THEN ev.delta ELSE 0 END) AS BIGINT) AS likes FROM ev JOIN k USING (event_id) GROUP BY 1) SELECT * FROM g WHERE published IS NOT NULL ORDER BY likes DESC, post LIMIT 20")
def found_posts(spark: SparkSession, d: str) -> DataFrame:
    return project.found_posts(_searched(spark, d), F.col("props").rlike("[13]"), 0, 1 << 60)


@query("V10_tracking", f"WITH {EVENTS}, n AS (SELECT max(t) + 1 AS now FROM ev), b AS (SELECT ev.*, CASE WHEN t >= now - 259200000 THEN 1 ELSE 0 END AS start FROM ev, n WHERE t >= now - 518400000 AND t < now), out AS (WITH {grouped('start', 'b')}), l AS (SELECT * FROM out WHERE start = 1), p AS (SELECT target, weight AS before FROM out WHERE start = 0) SELECT target, coalesce(volume, 0) AS volume, coalesce(weight, 0) AS weight, mean, round(coalesce(weight, 0) - coalesce(before, 0), 4) AS change FROM l FULL JOIN p USING (target)")
def tracking(spark: SparkSession, d: str) -> DataFrame:
    events = events_of(spark, d)
    now = events.agg((F.max("t") + 1).alias("now")).first().now
    return project.tracking(events, now, 3 * 86_400_000)


@query("V12_snapshot", "WITH p AS (SELECT user_id AS post, max(event_id) AS seq, arg_max(event_type, event_id) AS op FROM events WHERE event_id <= 800 GROUP BY 1), n AS (SELECT post, seq FROM p WHERE op <> 'error' ORDER BY seq DESC LIMIT 10), l AS (SELECT user_id AS post, count(*) AS likes FROM events WHERE event_id <= 800 AND event_type = 'click' GROUP BY 1) SELECT post, seq, coalesce(likes, 0) AS likes FROM n LEFT JOIN l USING (post)")
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    likes = table(spark, d, "events").where("event_type = 'click'").select(F.col("event_id").alias("seq"), F.col("user_id").alias("subject"), F.lit(1).alias("delta"))
    return project.snapshot(_changes(spark, d), likes, 800, 10)
