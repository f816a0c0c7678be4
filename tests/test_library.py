"""The library's own operators: hand-computed cases, refusals, and every query against its SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.functions import patterns
from tidewater.operators import activity, facts, feed, lift, state
from tidewater.plans import catalog
from tidewater.plans.sandbox import Refused, gate, run_sql
from tidewater.plans.spec import Spec, compile_filter, problems
from tidewater.sources import files
from tidewater.streaming import ledger

from .conftest import SF


def test_term_patterns(spark):
    assert patterns.whole_word("C") == "(?iu)(?<![A-Za-z0-9_])C(?![A-Za-z0-9_])"
    assert patterns.whole_word("C++") == r"(?iu)(?<![A-Za-z0-9_])C\+\+"
    assert patterns.whole_word("$AAPL") == r"(?iu)\$AAPL(?![A-Za-z0-9_])"
    for bad in ("é", "++"):
        with pytest.raises(ValueError):
            patterns.whole_word(bad)
    got = spark.createDataFrame([("MÜNCHEN",)], "t string").select(F.col("t").rlike(patterns.substring("münchen")))
    assert got.first()[0]


def test_spec_refuses_what_it_does_not_know():
    assert [c for c, _ in problems(Spec("2026-02-01", "2026-01-01", any_of=("",), min_likes=-1))] == ["EMPTY_WINDOW", "BAD_LIKES", "BAD_TERM"]
    with pytest.raises(ValueError):
        compile_filter(Spec("2026-01-01", "2026-02-01", languages=("en",)), {"created_at": "t"})
    assert Spec("a", "b").canonical_hash() == Spec("a", "b").canonical_hash() != Spec("a", "c").canonical_hash()


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, t long, target long, post long, kind string, delta long, score double, opening boolean")


def test_activity_window(spark):
    import math

    rows = [(1, 0, 1, 1, "like", 100, 0.0, False), (2, 1, 1, 2, "post", 0, 10.0, False), (3, 2, 1, 2, "like", 5, 10.0, False)]
    got = activity.aggregate(events(spark, rows), []).first()
    w = 1 + math.log(6)
    assert got["mean"] == round(10 * w / (math.log(101) + w), 4) and (got.volume, got.active, got.top_post) == (1, 2, 1)
    split = [(1, 0, 1, 1, "like", 10, 1.0, False), (2, 1, 1, 1, "like", 20, 1.0, False)]
    whole = [(1, 0, 1, 1, "like", 30, 1.0, False)]
    assert activity.aggregate(events(spark, split), []).first().weight == activity.aggregate(events(spark, whole), []).first().weight
    assert activity.aggregate(events(spark, [(1, 0, 1, 1, "like", -5, 1.0, False)]), []).first()["mean"] is None


def test_weighted_mean_of_a_loud_post(spark):
    rows = spark.createDataFrame([(1, 0.5, 0)] * 19 + [(1, -1.0, 999), (1, 0.3, None)], "g int, s double, likes int")
    got = facts.weighted_mean(rows, ["g"], F.col("s"), F.col("likes"), F.col("likes").isNotNull()).first()
    assert (got.weighted, got.plain, got.n, got.gated_out) == (round(-990.5 / 1019, 6), 0.425, 20, 1)


def test_latest_ignores_stale_copies(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (2, None, "c")], "id int, v int, x string")
    assert {(r.id, r.x) for r in state.latest(rows, ["id"], [F.desc_nulls_last("v")]).collect()} == {(1, "b"), (2, "c")}


def test_like_ledger(spark):
    rows = [(1, "l1", "create", "p1"), (2, "l1", "create", "p2"), (3, "l2", "create", "p1"), (4, "l2", "delete", None), (5, "l2", "delete", None), (6, "l9", "delete", None)]
    got = ledger.like_deltas(spark.createDataFrame(rows, "seq long, like string, operation string, subject string")).collect()
    assert sorted((r.seq, r.subject, r.delta) for r in got) == [(1, "p1", 1), (2, "p1", -1), (2, "p2", 1), (3, "p1", 1), (4, "p1", -1)]


def test_event_log_stream(spark, tmp_path):
    schema = "seq long, hash string"
    for k, rows in enumerate(([(1, "a"), (2, "b")], [(2, "b"), (3, "c")])):
        spark.createDataFrame(rows, schema).write.json(f"{tmp_path}/in/{k}")
    for _ in range(2):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
        ledger.start(spark, source, f"{tmp_path}/log", f"{tmp_path}/ck").awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        ledger.fresh(spark.createDataFrame([(3, "z")], schema), spark.read.parquet(f"{tmp_path}/log"))


def test_sandbox(spark):
    spark.range(300).createOrReplaceTempView("numbers")
    got = run_sql(spark, "WITH x AS (SELECT id FROM numbers) SELECT id FROM x ORDER BY id", ["numbers"])
    assert len(got["rows"]) == 200 and got["truncated"]
    for bad in ("DROP VIEW numbers", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc`", "SELECT * FROM secret", "SELECT * FROM range(5)", "SELECT java_method('java.lang.System', 'exit', 0)", "INSERT INTO numbers VALUES (1)", "SET a = 1", "SELECT (SELECT max(id) FROM secret) FROM numbers"):
        with pytest.raises(Refused):
            gate(spark, bad, ["numbers"])


def test_framed_file_and_upsert(spark, tmp_path):
    (tmp_path / "e.json").write_text('[\n{"id": 1},\n{"id": 2}\n]\n')
    schema = spark.createDataFrame([], "id long").schema
    assert sorted(r.id for r in files.framed_events(spark, f"{tmp_path}/e.json", schema).collect()) == [1, 2]
    a, b = (spark.createDataFrame(x, "k int, v int") for x in ([(1, 1), (2, 5)], [(1, 2), (2, 4)]))
    assert sorted(tuple(r) for r in files.upsert(a, b, "k", "v").collect()) == [(1, 2), (2, 5)]


def test_shortlist_folds_copies_and_spreads_authors(spark):
    rows = [(1, "a", 9, "Same  text"), (2, "b", 7, "same text!"), (3, "a", 8, "x"), (4, "a", 6, "y"), (5, "c", 5, None), (6, "c", 5, "z")]
    df = spark.createDataFrame(rows, "id long, author string, likes long, text string")
    got = feed.shortlist(df, "id", patterns.folded(F.col("text")), "author", "likes").collect()
    assert [(r.id, r.echoes) for r in got] == [(1, 1), (3, 0), (5, 0), (6, 0)]
    with pytest.raises(ValueError):
        feed.page(df, "best")


def test_replay_clock_frames_and_clipping(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (20.0,), (40.0,)], "s double")
    assert [r[0] for r in df.select(feed.delivery(F.col("s"), 10, [(1, 3), (5, 6)])).collect()] == [0.0, 1.0, 4.0, 7.0]
    texts = spark.createDataFrame([("a b. c d e. f",), ("",), (None,)], "t string")
    got = [r[0] for r in texts.select(feed.clipped(F.col("t"), 4)).collect()]
    assert (got[0].kept, got[0].n) == (1, 2) and got[1].kept == 1 and got[2] is None
    assert feed.tier(30_000_000) == "exact" and feed.tier(30_000_001) == "sample"
    assert feed.run_status(10, 5) == "FAILED" and feed.run_status(10, 6) == "READY"


def test_lift_follows_the_mix_alone(spark):
    totals = spark.createDataFrame([(1, "x", 100), (1, "y", 0), (2, "x", 0), (2, "y", 100)], "day int, lang string, n_all long")
    counts = spark.createDataFrame([("t", 1, "x", 10), ("t", 2, "y", 40)], "topic string, day int, lang string, n long")
    assert {r.day: (r.expected, r.lift) for r in lift.adjusted_lift(counts, totals, "topic", "day", "lang").collect()} == {1: (10.0, 1.0), 2: (40.0, 1.0)}


def test_slug_and_composed(spark):
    assert patterns.slug("A b!", set()) == "a-b" and patterns.slug("A b", {"a-b", "a-b-2"}) == "a-b-3"
    df = spark.createDataFrame([("e\u0301",), (None,)], "t string")
    assert [r[0] for r in df.select(patterns.composed(F.col("t"))).collect()] == ["\u00e9", None]


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name in catalog.SQL:
        rel = duck.execute(catalog.SQL[name])
        names = [x[0] for x in rel.description]
        at = [names.index(c) for c in sorted(df.columns)]
        assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
