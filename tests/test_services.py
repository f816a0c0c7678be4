"""Sources, sinks, streams, labels, sandbox and projects: hand-computed cases, refusals and brute force."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewater.functions import patterns
from tidewater.operators import activity, labeler, reports, sample, statistics
from tidewater.plans import project, sandbox
from tidewater.plans.spec import Spec, compile_filter, hashtag_of, problems, warnings
from tidewater.sources import files, firehose, views
from tidewater.streaming import ledger


def test_every_attack_is_refused(spark, tmp_path):
    (tmp_path / "x").write_text("secret")
    spark.range(3).createOrReplaceTempView("v")
    assert sandbox.self_test(spark, str(tmp_path / "x")) == []
    for good in ("SELECT count(*) FILTER (WHERE id > 1) FROM v", "WITH a AS (SELECT id FROM v) SELECT a.id FROM a JOIN v USING (id) WHERE id IN (SELECT id FROM v) ORDER BY 1", "SELECT sum(id) OVER (ORDER BY id) FROM v", "SELECT e FROM v LATERAL VIEW explode(array(1, 2)) t AS e", "SELECT `id` FROM `v`"):
        sandbox.gate(spark, good, ["V"])
    with pytest.raises(sandbox.Refused):  # a CTE's name counts in its own statement only
        sandbox.gate(spark, "SELECT * FROM (WITH a AS (SELECT id FROM v) SELECT * FROM a) x JOIN a ON true", ["v"])


def test_sandbox_caps_and_log(spark, caplog):
    spark.createDataFrame([(1, float("nan"), "y" * 900, "z" * 900)] * 5, "a int, b double, c string, d string").createOrReplaceTempView("wide")
    with caplog.at_level("INFO", "tidewater.plans.sandbox"):
        got = sandbox.run_sql(spark, "SELECT * FROM wide", ["wide"], max_cell=100, max_chars=700)
        with pytest.raises(sandbox.Refused):
            sandbox.run_sql(spark, "SHOW TABLES", ["wide"])
    assert got["columns"] == ["a", "b", "c"] and got["columns_dropped"] == 1 and got["rows"][0] == [1, None, "y" * 100]
    assert [json.loads(r.message)["status"] for r in caplog.records] == ["ok", "refused"]


def test_sandbox_timeout(spark):
    spark.range(0, 2_000_000, 1, 8).createOrReplaceTempView("big")
    with pytest.raises(TimeoutError):
        sandbox.run_sql(spark, "SELECT count(*) FROM big a JOIN big b ON a.id % 7 = b.id % 7 AND sha2(concat(a.id, b.id), 256) < '0'", ["big"], timeout_s=1.5)


def test_hashtags_and_terms_are_groups_that_must_all_be_met(spark):
    rows = spark.createDataFrame([(1, "fusion now"), (2, "fusion #energy"), (3, "#energy!"), (4, "fusion #energyplus")], "id int, body string").withColumn("t", F.lit("2026-01-05").cast("timestamp"))
    spec = Spec("2026-01-01", "2026-02-01", any_of=("fusion",), hashtags=("energy",), originals_only=False)
    assert [r.id for r in rows.where(compile_filter(spec, {"created_at": "t", "text": "body"})).collect()] == [2]
    assert hashtag_of({"term": "#ai"}) == hashtag_of("#ai") != hashtag_of({"term": "#ai", "case_sensitive": True})
    for bad in ({"term": "#ai", "match": "word"}, {"term": "#"}, 7):
        with pytest.raises(ValueError):
            hashtag_of(bad)
    assert [c for c, _ in problems(Spec("2026-01-01", "2026-02-01", hashtags=("a b",), congress={"house": 1}))] == ["BAD_HASHTAG", "BAD_CONGRESS"]
    assert [c for c, _ in warnings(Spec("a", "b"), 10, 5, 3)] == ["NO_TERMS", "THIN", "SAMPLED"]


def test_second_source_conditions(spark):
    rows = spark.createDataFrame([(1, "Rep", "D", "tx", "AOC"), (2, "Sen.", "d", "TX", "x"), (3, "U.S. House", "D", "TX", "y")], "id int, chamber string, party string, state string, author_handle string").withColumn("t", F.lit("2026-01-05").cast("timestamp_ntz"))
    names = {"created_at": "t", "text": "party", **{c: c for c in ("chamber", "party", "state", "author_handle")}}
    spec = Spec("2026-01-01", "2026-02-01", originals_only=False, congress={"party": "d", "chamber": "House", "state": "tx", "handles": ["@aoc", "Y"]})
    assert sorted(r.id for r in rows.where(compile_filter(spec, names, ntz=True)).collect()) == [1, 3]
    with pytest.raises(ValueError):
        compile_filter(spec, {"created_at": "t", "text": "party"})


def test_allocation():
    real = {dt.date(2026, 9, d): n for d, n in zip(range(6, 14), (71, 91, 69, 51, 176, 80, 52, 58), strict=True)}
    assert sample.allocate(real, 3000) == real
    for cap in (1000, 647, 500, 100, 8):
        take = sample.allocate(real, cap)
        assert sum(take.values()) == min(cap, sum(real.values())) and all(1 <= take[d] <= real[d] for d in real)
        assert take[dt.date(2026, 9, 10)] == max(take.values())
    quiet, huge = {f"2026-09-{d:02d}": 100 for d in range(1, 21)}, {f"2026-08-{d:02d}": 200_000 for d in range(20, 25)}
    fits, over = sample.allocate(quiet | huge, 3000), sample.allocate({d: 200 for d in quiet} | huge, 3000)
    assert sum(fits.values()) == sum(over.values()) == 3000
    assert all(fits[d] == 100 for d in quiet) and all(fits[d] == 200 for d in huge)
    assert sum(sample.allocate({d: 9 for d in range(20)}, 5).values()) == 5 and sample.allocate({}, 5) == {} == sample.allocate({1: 2}, 0)


def test_log_replay_passes_over_a_torn_end_only(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, v int, deleted boolean").schema
    (tmp_path / "a.jsonl").write_text('{"id":"x","v":1}\n{"id":"y","v":1}\n{"id":"x","v":2}\n{"id":"y","deleted":true}\n{"id":"z","v":0}\n{"id":"x","v"')
    assert sorted(tuple(r) for r in files.last_wins(spark, f"{tmp_path}/a.jsonl", "id", schema).collect()) == [("x", 2, None), ("z", 0, None)]
    assert [r.id for r in files.last_wins(spark, f"{tmp_path}/a.jsonl", "id", schema, "v > 0").collect()] == ["x"]
    (tmp_path / "b.jsonl").write_text('{"id":"x","v":1}\n{"id":\n{"id":"x","v":2}\n')
    with pytest.raises(PySparkException):
        files.last_wins(spark, f"{tmp_path}/b.jsonl", "id", schema).collect()


def test_framed_files(spark, tmp_path):
    schema = spark.createDataFrame([], "id long").schema
    (tmp_path / "one").write_text('[{"id": 1}, {"id": 2}]')
    assert sorted(r.id for r in files.framed_events(spark, f"{tmp_path}/one", schema, 2).collect()) == [1, 2]
    with pytest.raises(ValueError):
        files.framed_events(spark, f"{tmp_path}/one", schema, 3)
    (tmp_path / "bad").write_text('[\n{"id": 1},\n{"id"\n]\n')
    with pytest.raises(PySparkException):
        files.framed_events(spark, f"{tmp_path}/bad", schema).collect()


def test_sinks_refuse_verify_and_clean_up(spark, tmp_path):
    rows = spark.range(100).withColumn("v", F.col("id") % 3)
    files.write_json_lines(rows, f"{tmp_path}/j")
    for again in (lambda: files.write_json_lines(rows, f"{tmp_path}/j"), lambda: files.write_chunks(rows, f"{tmp_path}/j", "id", 2)):
        with pytest.raises(PySparkException):
            again()
    rows.write.parquet(f"{tmp_path}/p/t")
    told = spark.createDataFrame(files.manifest(spark, f"{tmp_path}/p").collect())
    assert files.verified(spark, f"{tmp_path}/p", told, ["t"], "id")["t"].count() == 100
    with pytest.raises(ValueError):
        files.verified(spark, f"{tmp_path}/p", told, ["t"], "v")
    with pytest.raises(ValueError):
        files.verified(spark, f"{tmp_path}/p", told.withColumn("sha256", F.lit("0")), ["t"], "id")
    assert files.write_charts(spark, f"{tmp_path}/c", {"a": rows, "b": rows}) == [] and files.write_charts(spark, f"{tmp_path}/c", {"b": rows}) == ["a"]
    assert files.build_once(spark, f"{tmp_path}/o", lambda: rows).count() == 100 and files.build_once(spark, f"{tmp_path}/o", lambda: rows.limit(1), force=True).count() == 1
    with pytest.raises(ValueError):
        files.report(spark, f"{tmp_path}/r", {"x": rows}, most=10)
    old, new = (spark.createDataFrame(x, "k int, v int") for x in ([(1, 5), (2, 5)], [(1, 9), (3, 7), (3, 8)]))
    assert sorted(tuple(r) for r in files.upsert(old, new, "k", "v", "ignore").collect()) == [(1, 5), (2, 5), (3, 7)]
    assert sorted(tuple(r) for r in files.upsert(old, new, "k", "v", {"v": "sum"}).collect()) == [(1, 14), (2, 5), (3, 15)]


def test_pruned_window_reads_few_files(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.lit("2026-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id") / 10)).alias("at"))
    files.write_chunks(rows, f"{tmp_path}/t", "at", 10)
    got = files.windowed(spark, f"{tmp_path}/t", "at", "2026-02-10", "2026-02-12")
    assert sorted(r.id for r in got.collect()) == list(range(400, 420)) and len(got.inputFiles()) <= 2
    assert files.windowed(spark, f"{tmp_path}/t", "at", "2030-01-01", "2030-02-01").count() == 0


def test_published_views_survive_a_bad_one(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/a")
    got = views.publish(spark, {"good_view": views.View(f"{tmp_path}/a", "fine"), "bad_view": views.View(f"{tmp_path}/a", "x", lambda r: r.select("no")), "none_view": views.View(f"{tmp_path}/b", "x")})
    assert got == {"good_view": "fine"} and [tuple(r) for r in views.schema(spark, got).collect()] == [("good_view", "id", "bigint", 0, "fine")]


def frames(path, numbers):
    with open(path, "a") as f:
        for i in numbers:
            f.write(json.dumps({"kind": "commit", "seq": i, "collection": "post" if i % 2 else "like", "text": f"t{i}"}) + "\n")


def test_firehose_replays_ranges_and_follows_with_a_cursor(spark, tmp_path):
    frames(tmp_path / "a.jsonl", range(1, 61))
    with open(tmp_path / "a.jsonl", "a") as f:
        f.write('{"seq": 61, "error": "OutdatedCursor"}\n{"seq": 62, "error": "other"}\n{"seq": 63, "text": 5, "kind": [}\n')
    spark.dataSource.register(firehose.Firehose)
    options = {"path": str(tmp_path), "until": "62", "segments": "4"}
    got = firehose.decoded(spark.read.format("firehose").options(**options).load())
    assert {r.status: r.n for r in got.groupBy("status").agg(F.count("*").alias("n")).collect()} == {"event": 60, "gap": 1, "error": 1}
    assert {r.collection for r in got.where("status = 'event'").unionByName(got.limit(0)).collect()} == {"post", "like"}
    assert [r.status for r in firehose.decoded(spark.createDataFrame([(1, "{torn")], "seq long, frame string")).collect()] == ["corrupt"]
    sizes = []

    def follow():
        stream = spark.readStream.format("firehose").option("path", str(tmp_path)).option("collections", "post").option("limit", 10).load()
        query = stream.writeStream.foreachBatch(lambda b, n: sizes.append(sorted(r.seq for r in b.collect()))).option("checkpointLocation", f"{tmp_path}/ck").start()
        firehose.tail(query, 12)

    follow()
    frames(tmp_path / "b.jsonl", range(101, 105))
    follow()
    seen = [s for batch in sizes for s in batch]
    assert set(seen) == {*range(1, 61, 2), 61, 62, 101, 103} and max(map(len, sizes)) <= 10
    assert firehose.seek(lambda c: c * 2.0, 0, 1000, 301.0) == 151


def test_hydration_asks_once_and_remembers_what_is_gone(spark):
    known = spark.createDataFrame([("a", '{"n": 1}', False, 90.0), ("b", '{"n": 1}', False, 10.0)], "key string, value string, gone boolean, fetched double")
    rows = spark.createDataFrame([(k,) for k in ("a", "b", "c", "c", "d", None)], "id string")
    got = {r.key: r for r in firehose.hydrated(rows, "id", lambda keys: {k: {"n": 2} for k in keys if k != "d"} if len(keys) <= 25 else None, known, 100.0, 50.0).collect()}
    assert {k: (r.value, r.gone) for k, r in got.items()} == {"a": ('{"n": 1}', False), "b": ('{"n": 2}', False), "c": ('{"n": 2}', False), "d": (None, True)}


def test_late_events_reopen_their_bucket(spark, tmp_path):
    schema = "event_id long, t long, target long, post long, kind string, delta long, score double, opening boolean"
    batches = [[(1, 10, 1, 1, "post", 0, 5.0, False), (2, 20, 1, 1, "like", 3, 5.0, False)], [(3, 10_000_000, 1, 2, "post", 0, 1.0, False)], [(4, 15, 1, 1, "like", 4, 7.0, False), (5, 30, 1, 3, "post", 9, 2.0, False)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        ledger.live_buckets(stream, f"{tmp_path}/sums", f"{tmp_path}/ck", 1000).awaitTermination()
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    order = lambda rows: sorted(map(str, rows.collect()))
    assert order(ledger.read_buckets(spark, f"{tmp_path}/sums")) == order(activity.bucketed(every, 1000).select(*ledger.read_buckets(spark, f"{tmp_path}/sums").columns))


def test_log_looks_at_its_own_ranges(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (ledger.RANGE + 1, "b")], "seq long, hash string")
    ledger.put(rows, f"{tmp_path}/log")
    ledger.put(rows.unionByName(spark.createDataFrame([(2, "c"), (2, "c")], rows.schema)), f"{tmp_path}/log")
    assert sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [1, 2, ledger.RANGE + 1]
    with pytest.raises(ValueError):
        ledger.put(spark.createDataFrame([(1, "z")], rows.schema), f"{tmp_path}/log")


def test_reset_keeps_deltas_but_not_subjects(spark):
    rows = spark.createDataFrame([(1, "l", "create", "p1"), (5, "l", "delete", None), (6, "l", "create", "p2"), (7, "l", "delete", None)], "seq long, like string, operation string, subject string")
    got = lambda resets: sorted((r.seq, r.subject, r.delta) for r in ledger.reset_deltas(rows, resets).collect())
    assert got([]) == [(1, "p1", 1), (5, "p1", -1), (6, "p2", 1), (7, "p2", -1)]
    assert got([4]) == [(1, "p1", 1), (6, "p2", 1), (7, "p2", -1)] and got([4, 7]) == [(1, "p1", 1), (6, "p2", 1)]


def test_retries_keep_the_batch():
    calls, waits = [], []

    def act():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("down")

    assert ledger.retrying(act, first=1, most=3, sleep=waits.append) == 4 and waits == [1, 2, 3]
    with pytest.raises(ZeroDivisionError):
        ledger.retrying(lambda: 1 / 0, tries=2, sleep=waits.append)


QUESTIONS = [labeler.Question("p", "noul"), labeler.Question("c", "choice", ("a", "b"))]


def test_answers_are_validated():
    q, c, s = QUESTIONS[0], QUESTIONS[1], labeler.Question("s", "score", levels=3)
    assert q.problems(0.5) is None and all(q.problems(x) for x in (None, 1.5, True, "x", math.nan))
    assert c.problems({"a": 0.25, "b": 0.75}) is None and all(c.problems(x) for x in ({"a": 1.0}, {"a": 0.5, "b": 0.6}, {"a": 1.0, "b": 0.0, "c": 0.0}, 3))
    assert s.problems(2) is None and all(s.problems(x) for x in (-1, 2.1, None)) and labeler.Question("x", "y").problems(1)


def test_labels_are_asked_once_a_text_and_cached(spark, tmp_path):
    marks = tmp_path / "calls"

    def label(texts):
        with open(marks, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [{"p": 2.0 if t == "bad" else 0.5, "c": {"a": 1.0, "b": 0.0}} for t in texts]

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["x", "x", "y", "bad", None, " ", "x"])], "id int, t string")
    first = spark.createDataFrame(labeler.labelled(rows, "t", label, QUESTIONS, "m").collect())
    assert sorted(marks.read_text().split()) == ["bad", "x", "y"] and first.where("error is null").count() == 2
    back = {r.id: r.answers for r in labeler.mapped_back(rows, "t", first).collect()}
    assert back[0] == back[1] == back[6] and json.loads(back[0])["p"] == 0.5 and back[3] is back[4] is back[5] is None
    marks.unlink()
    again = labeler.labelled(rows, "t", label, QUESTIONS, "m", first).collect()
    assert marks.read_text().split() == ["bad"] and sum(r.cached for r in again) == 2
    assert len(labeler.labelled(rows, "t", label, QUESTIONS, "other model", first).where("not cached").collect()) == 3


def test_failed_calls_are_tried_again(spark, tmp_path):
    flag = tmp_path / "tried"

    def label(texts):
        if not flag.exists():
            flag.write_text("x")
            raise OSError("busy")
        return [{"p": 0.5, "c": {"a": 1.0, "b": 0.0}} for _ in texts]

    rows = spark.createDataFrame([("x",)], "t string").coalesce(1)
    assert labeler.labelled(rows, "t", label, QUESTIONS, "m", sleep=lambda s: None).first().error is None
    dead = labeler.labelled(rows, "t", lambda texts: 1 / 0, QUESTIONS, "m", tries=2, sleep=lambda s: None).first()
    assert dead.answers is None and "ZeroDivisionError" in dead.error


def test_verdicts(spark):
    def says(rows):
        return labeler.verdict(spark.createDataFrame(rows, "choice string, confidence double"), 2).first().verdict

    assert says([("a", 0.9)] * 5) == "thin" and says([("a", 0.9)] * 95 + [("b", 0.9)] * 5) == "dominant"
    assert says([("a", 0.4)] * 15 + [("b", 0.4)] * 15) == "unsure" and says([("a", 0.9)] * 15 + [("b", 0.9)] * 15) == "good"
    m = spark.createDataFrame([({"b": 0.4, "a": 0.4, "c": 0.2},)], "m map<string,double>").select(labeler.confidence(F.col("m")).alias("x")).first().x
    assert (m.choice, m.confidence) == ("a", 0.4)


def test_shift_p_values_and_strength(spark):
    r = random.Random(4)
    rows = [(t, lang, late, r.gauss(0.4 * late * (t == "up"), 0.2)) for t in ("up", "flat") for lang in "xy" for late in (False, True) for _ in range(60)]
    got = {x.t: x for x in reports.shifts(spark.createDataFrame(rows, "t string, l string, late boolean, v double"), "t", "l", "late", "v").collect()}
    for t in ("up", "flat"):
        part = {(lang, late): np.array([v for a, b, c, v in rows if (a, b, c) == (t, lang, late)]) for lang in "xy" for late in (False, True)}
        d = np.mean([part[x, True].mean() - part[x, False].mean() for x in "xy"])
        se = math.sqrt(sum(part[x, late].var(ddof=1) / 60 for x in "xy" for late in (False, True)) / 4)
        assert got[t].shift == pytest.approx(d) and got[t].error == pytest.approx(se) and got[t].p == pytest.approx(math.erfc(abs(d) / se / math.sqrt(2)))
    flags = spark.range(1).select(*[reports.strong(F.lit(m), F.lit(lo), F.lit(0.5), F.lit(q), F.lit(s), [F.lit(n)]).alias(k) for k, m, lo, q, s, n in (("yes", 0.3, 0.1, 0.01, 0.2, 80), ("few", 0.3, 0.1, 0.01, 0.2, 79), ("small", 0.1, 0.1, 0.01, 0.2, 80), ("unsure", 0.3, -0.1, 0.01, 0.2, 80), ("chance", 0.3, 0.1, 0.06, 0.2, 80), ("against", 0.3, 0.1, 0.01, -0.2, 80))]).first().asDict()
    assert flags == {"yes": True, "few": False, "small": False, "unsure": False, "chance": False, "against": False}


def test_bootstrap_against_plain_draws(spark):
    r = random.Random(5)
    rows = [("a", i % 40, bool(r.randrange(2)), r.gauss(0.0, 1.0)) for i in range(800)] + [("b", 1, True, 1.0)] * 3
    got = {x.t: x for x in statistics.cluster_bootstrap(spark.createDataFrame(rows, "t string, a int, late boolean, v double"), "t", "a", "late", "v").collect()}
    assert got["b"].lo is None or math.isnan(got["b"].lo)
    rng, diffs = np.random.default_rng(1), []
    by = {k: [(late, v) for t, a, late, v in rows if t == "a" and a == k] for k in range(40)}
    for _ in range(1000):
        drawn = [x for k in rng.integers(0, 40, 40) for x in by[k]]
        diffs.append(np.mean([v for late, v in drawn if late]) - np.mean([v for late, v in drawn if not late]))
    lo, hi = np.quantile(diffs, [0.025, 0.975])
    assert abs(got["a"].lo - lo) < 0.04 and abs(got["a"].hi - hi) < 0.04


def test_false_discovery_against_one_list(spark):
    r = random.Random(6)
    p = [round(r.random() ** 3, 2) for _ in range(500)]
    got = {x.k: x.q for x in statistics.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "k int, p double"), "k", "p").collect()}
    order = sorted(range(500), key=lambda k: (p[k], k))
    q, least = {}, 1.0
    for i in range(500, 0, -1):
        least = min(least, p[order[i - 1]] * 500 / i)
        q[order[i - 1]] = round(least, 6)
    assert got == pytest.approx(q)


def test_project_surface(spark, tmp_path):
    rows = spark.createDataFrame([(i, dt.datetime(2026, 1, 1 + i % 5), f"the text {i // 2}", "en" if i % 3 else None, i) for i in range(40)], "id long, created_at timestamp_ntz, text string, lang string, likes long")
    spec = Spec("2026-01-01", "2026-01-05", any_of=("text",))
    got = project.preview(rows, spec, ntz=True)
    assert got["ok"] and got["total"] == 32 and {r.n for r in got["per_day"].collect()} == {8} and got["examples"].first().id == 38
    assert got["duplicates"].first().share == pytest.approx(1 - len({i // 2 for i in range(40) if i % 5 < 4}) / 32) and [c for c, _ in got["warnings"]] == ["THIN"]
    assert not project.preview(rows, Spec("2026-01-05", "2026-01-01"))["ok"]
    projects = project.Projects(spark, str(tmp_path))
    half = lambda r: r.withColumn("score", F.when(F.col("id") % 2 == 0, 0.5)).withColumn("label", F.lit("x"))
    name = projects.submit(spec, rows, half, 16, ntz=True)
    assert projects.status(name)["status"] == "FAILED" and projects.names() == [name] and projects.status("nothing")["status"] == "UNKNOWN"
    with pytest.raises(ValueError):
        projects.posts(name)
    with pytest.raises(ValueError):
        projects.submit(Spec("b", "a"), rows, half, 16)
    done = projects.submit(Spec("2026-01-01", "2026-01-05", any_of=("the",)), rows, lambda r: r.withColumn("score", F.lit(0.5)).withColumn("label", F.lit("x")), 16, ntz=True)
    assert projects.status(done)["sampled"] == 16 and {r.n for r in projects.chart(done, "volume")["points"].collect()} == {4}
    assert projects.posts(done, "likes", ["x"], "2026-01-02", 2).count() == 2 and projects.posts(done, labels=["none"]).count() == 0


def test_cost_and_reservation():
    assert reports.cost(1000, 400, 2.0) == pytest.approx(1000 * 180 * 2 / 1e6 * 3)
    assert reports.reserve(1.0, 0.5, 0.25, 0.25) == 0.5 and reports.reserve(1.0, 0.5, 0.25, 0.26) is None


def test_chamber_spellings(spark):
    rows = spark.createDataFrame([(x,) for x in ("House", "rep.", "U.S. Rep", "SENATE", "Sen", "us senator", "S", "h", "other", None)], "c string")
    assert [r[0] for r in rows.select(patterns.chamber(F.col("c"))).collect()] == ["House"] * 3 + ["Senate"] * 4 + ["House", None, None]


def test_overlapping_files_by_brute_force(spark):
    r = random.Random(21)
    for n, wide in ((0, 1), (1, 5), (40, 1), (40, 2), (40, 3), (40, 200)):
        lows = sorted(r.sample(range(0, 400, 2), n))
        rows = [(a, a + r.randint(0, wide)) for a in lows] + [(None, None)]
        expect = any(a < d and c < b for i, (a, b) in enumerate(rows[:-1]) for c, d in rows[:i])
        got = files.overlaps(spark.createDataFrame(rows, "low long, high long")).first().n
        assert (got > 0) == expect
    assert files.overlaps(spark.createDataFrame([(1, 5), (5, 5), (5, 9)], "low long, high long")).first().n == 0


def test_sorted_chunks_are_not_compared_two_by_two(spark):
    """Pairs of files made a task for each two parts: 450 files, 200,000 tasks."""
    from tidewater.plans.catalog import QUERIES

    rows = QUERIES["K1_K2_sorted_chunks"](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert rows.first().asDict() == {"n": 1500, "least_files": 1, "bounded": True, "sorted": True}
