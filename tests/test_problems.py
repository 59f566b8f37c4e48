"""Periods, snapshots and incremental runs against brute force and at their edges."""

import datetime as dt
import random

import pytest
from corvane.operators.incremental import IncrementalStore, files_taken, hash_value
from corvane.operators.intervals import OPEN_FROM, OPEN_TO, bound_micros, fact_periods, periods_and_gaps
from corvane.operators.snapshots import revision_file_changes
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

UTC = dt.timezone.utc


def merged(rows):
    """Periods and gaps by hand."""
    out, by = set(), {}
    for k, s, e in rows:
        by.setdefault(k, []).append((s, e))
    for k, own in by.items():
        own.sort()
        spans = []
        for s, e in own:
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
            else:
                spans.append([s, e])
        out |= {(k, "period", s, e) for s, e in spans}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(spans, spans[1:])}
    return out


@pytest.mark.parametrize("seed,bucket", [(1, 7), (2, 50), (3, 10_000)])
def test_periods_agree_with_brute_force(spark, seed, bucket):
    r = random.Random(seed)
    rows = [("hot" if r.random() < 0.4 else f"k{r.randrange(9)}", s := r.randrange(400), s + r.randrange(1, 12)) for _ in range(400)]
    rows += [("hot", OPEN_FROM, 3), ("k1", 390, OPEN_TO), *rows[:20]]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    got = {tuple(x) for x in periods_and_gaps(df, "k", "s", "e", bucket).collect()}
    assert got == merged(rows)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40), st.integers(1, 9)), max_size=25))
def test_periods_of_any_rows(spark, rows):
    rows = [(k, s, s + n) for k, s, n in rows]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    assert {tuple(x) for x in periods_and_gaps(df, "k", "s", "e", 5).collect()} == merged(rows)


def test_bounds_as_written(spark):
    texts = ["2024-01-02", " 2024-01-02 03:04:05 ", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05.500Z", "2024-01-02 03:04:05-0500", "tbd", "0000-00-00", "", None, "  "]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").orderBy("i").select(bound_micros(F.col("t"), -1)).collect()]
    at = lambda *x: int(dt.datetime(*x, tzinfo=UTC).timestamp() * 1_000_000)
    assert got == [at(2024, 1, 2), at(2024, 1, 2, 3, 4, 5), at(2024, 1, 2, 3, 4, 5), at(2024, 1, 2, 1, 4, 5), at(2024, 1, 2, 3, 4, 5, 500000), at(2024, 1, 2, 8, 4, 5), None, None, -1, -1, -1]


def test_facts_edges(spark):
    schema = "id bigint, subject string, valid_from string, valid_to string, k string, s string, e string, b int, prev int"
    rows = [
        (1, " a ", None, "2024-01-02", "x", "x", "x", 1, 1), (2, "a", "2024-01-02", "2024-01-03", *"xxx", 1, 1), (3, "a", "2024-01-05", None, *"xxx", 1, 1),
        (4, "  ", "2024-01-01", None, *"xxx", 1, 1), (5, None, "2024-01-01", None, *"xxx", 1, 1), (6, "b", "unknown", None, *"xxx", 1, 1),
        (7, "b", "2024-02-02", "2024-02-02", *"xxx", 1, 1), (3, "a", "2024-01-05", None, *"xxx", 1, 1),
    ]
    got = {tuple(r) for r in fact_periods(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("a", "period", "", "2024-01-03 00:00:00"), ("a", "gap", "2024-01-03 00:00:00", "2024-01-05 00:00:00"), ("a", "period", "2024-01-05 00:00:00", "")}
    assert fact_periods(spark.createDataFrame([], schema)).count() == 0
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert {tuple(r) for r in fact_periods(spark.createDataFrame(rows, schema)).collect()} == got
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


FILES = "index_revision bigint, document_id bigint, path string, project string, document_revision bigint, content_hash string, analysis_json string"


def test_snapshot_changes_against_brute_force(spark):
    r = random.Random(5)
    revs = [3, 5, 6, 9]
    rows = [(v, d, f"p{d}", "x", r.randrange(1, 3), r.choice("ab"), r.choice(['{"a": 1, "b": 2}', '{"b":2,"a":1}', '{"a": 2}', None])) for v in [*revs, 4, None] for d in [*range(12), None] if r.random() < 0.7]
    rows += r.sample(rows, 10)
    import json

    norm = lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True)
    at = {}
    for v, d, *x in rows:
        if v is not None and d is not None and (d not in at.setdefault(v, {}) or at[v][d][2] < x[2]):
            at[v][d] = x
    key = lambda x: (*x[:4], norm(x[4]))
    want = set()
    for a, b in zip(revs, revs[1:]):
        p, q = at.get(a, {}), at.get(b, {})
        want |= {(b, d, "added") for d in q.keys() - p.keys()} | {(b, d, "removed") for d in p.keys() - q.keys()}
        want |= {(b, d, "changed") for d in p.keys() & q.keys() if key(p[d]) != key(q[d])}
    published = spark.createDataFrame([(v,) for v in [*revs, 5, None]], "rev_id bigint")
    got = revision_file_changes(spark.createDataFrame(rows, FILES), published)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)


def test_snapshots_empty(spark):
    none = spark.createDataFrame([], FILES)
    assert revision_file_changes(none, spark.createDataFrame([(1,)], "rev_id bigint")).count() == 0
    assert revision_file_changes(none, spark.createDataFrame([], "rev_id bigint")).count() == 0


def ts(h):
    return dt.datetime(2026, 1, 1, tzinfo=UTC) + dt.timedelta(hours=h)


def test_hashes_by_value(spark):
    got = spark.createDataFrame([("B3: AbC1",), ("abc1",), (" ",), (None,)], "h string").select(hash_value(F.col("h"))).collect()
    assert [r[0] for r in got] == ["abc1", "abc1", None, None]


MAN = "canonical_path string, canonical_root string, content_hash string, last_synced timestamp"
SCAN = "scan_row_id bigint, canonical_path string, canonical_root string, content_hash string, observed_at timestamp, delivered_at timestamp"
RUNS = "run_id bigint, canonical_root string, finished_at timestamp, status string"


def history(spark):
    man = spark.createDataFrame([("f1", "r", "AA", ts(0)), ("f1", "r", "old", ts(-5)), ("f1", "r", "AA", ts(0)), ("f2", "r", None, ts(0))], MAN)
    scan = spark.createDataFrame([
        (1, "f1", "r", "b3:aa", ts(1), ts(1)), (2, "f1", "r", "bb", ts(2), ts(2)), (3, "f2", "r", "cc", ts(2), ts(2)), (3, "f2", "r", "cc", ts(2), ts(2)),
        (4, "f1", "r", "dd", ts(3), ts(9)), (5, "f1", "r", "aa", ts(5), ts(5)), (6, "f3", "r", None, ts(5), ts(5)), (7, "f4", "r", "x", ts(20), ts(20)),
    ], SCAN)
    runs = spark.createDataFrame([(10, "r", ts(1), "succeeded"), (11, "r", ts(2), "failed"), (12, "r", ts(3), "succeeded"), (13, "r", ts(6), "succeeded"), (14, "r", ts(10), "succeeded"), (15, "r", None, "failed")], RUNS)
    return man, scan, runs


def test_runs_take_what_changed(spark):
    got = sorted(tuple(r) for r in files_taken(*history(spark)).collect())
    # the failed run's changes come with the next one; the late row of f1 is older than its state
    assert got == [(12, "f1"), (12, "f2"), (13, "f1")]


def test_store_runs_agree_with_the_replay_and_survive_a_crash(spark, tmp_path):
    from corvane.operators.incremental import DeliveryLog, observations

    man, scan, runs = history(spark)
    obs = observations(man, scan).drop("root")
    log, store = DeliveryLog(spark, str(tmp_path / "log")), IncrementalStore(spark, str(tmp_path / "s"), compact=2)
    number = F.when(F.col("delivered").isNull(), 0)
    for i, h in enumerate((1, 3, 6, 10)):
        number = number.when(F.col("delivered") <= F.lit(ts(h)), i + 1)
    log.load(obs.withColumn("seq", number).filter("seq is not null").drop("delivered"))
    taken = {10: store.run(log, 1)}

    def crash():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.run(log, 2, before_commit=crash)
    assert store.sequence() == 1 and store.watermark() == 1
    for run, upper in ((12, 2), (13, 3), (14, 4)):
        taken[run] = store.run(log, upper)
    got = sorted((run, r.path) for run, df in taken.items() for r in df.collect())
    assert got == sorted(tuple(r) for r in files_taken(man, scan, runs).collect())
    assert len(store.commit(store.sequence())["state"]) <= 2


OBS = "path string, hash string, observed timestamp, tie bigint"


def test_batches_out_of_order_and_lower_limits(spark, tmp_path):
    from corvane.operators.incremental import DeliveryLog, Stale

    log, store = DeliveryLog(spark, str(tmp_path / "log")), IncrementalStore(spark, str(tmp_path / "s"))
    land = lambda *rows: log.append(spark.createDataFrame([(p, h, ts(t), 1) for p, h, t in rows], OBS))
    took = lambda df: sorted(r.path for r in df.collect())
    land(("a", "1", 5))
    assert took(store.run(log)) == ["a"] and store.watermark() == 1
    land(("b", "1", 3), ("a", "0", 3))  # older than what is known: b is new, a's state stays
    assert took(store.run(log)) == ["b"] and store.watermark() == 2
    land(("c", "1", 6), ("a", "2", 6))
    land(("d", "1", 1))
    assert took(store.run(log, 3)) == ["a", "c"]
    assert took(store.run(log, 3)) == [] and store.sequence() == 3
    with pytest.raises(Stale):
        store.run(log, 2)
    other = IncrementalStore(spark, str(tmp_path / "s"))

    def race():
        other.run(log, 4)

    with pytest.raises(Stale):
        store.run(log, 4, before_commit=race)
    assert store.sequence() == 4 and store.watermark() == 4
    assert sorted((r.path, r.hash) for r in store.state().collect()) == [("a", "2"), ("b", "1"), ("c", "1"), ("d", "1")]
    assert [tuple(r) for r in store.output().filter("sequence = 4").collect()] == [(4, "d", "1")]


def test_stream_into_store(spark, tmp_path):
    from corvane.operators.incremental import DeliveryLog
    from corvane.streaming.changes import change_log, sync_into

    log, store = DeliveryLog(spark, str(tmp_path / "log")), IncrementalStore(spark, str(tmp_path / "s"))
    for i, rows in enumerate(([("a", "1", ts(5), 1)], [("b", "1", ts(3), 1), ("a", "0", ts(3), 1)])):
        spark.createDataFrame(rows, OBS).write.mode("append").parquet(str(tmp_path / "in"))
        sync_into(change_log(spark, str(tmp_path / "in"), OBS), log, store, str(tmp_path / "c")).awaitTermination()
        assert store.watermark() == i + 1
    assert sorted((r.sequence, r.path) for r in store.output().collect()) == [(1, "a"), (2, "b")]


def test_no_runs(spark):
    man, scan, _ = history(spark)
    assert files_taken(man, scan, spark.createDataFrame([], RUNS)).count() == 0
    man, scan, runs = history(spark)
    assert files_taken(man.limit(0), scan.limit(0), runs).count() == 0
    # what is only delivered, never known before
    assert sorted(tuple(r) for r in files_taken(man.limit(0), scan, runs).collect()) == [(10, "f1"), (12, "f1"), (12, "f2"), (13, "f1")]
