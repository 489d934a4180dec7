from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltline.operators.history import SnapshotStore, instant_column, instant_from_text, record_attributes, version_history

SCHEMA = "k string, t bigint, a string, b bigint, o bigint"


def versions(rows):
    """Brute force: per key in order of time, a version per change."""
    by = defaultdict(list)
    for k, t, a, b, o in rows:
        if t is not None:
            by[k].append((t, o, a, b))
    out = []
    for k, own in by.items():
        own.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or 0))
        starts = [(t, a, b) for i, (t, _, a, b) in enumerate(own) if i == 0 or own[i - 1][2:] != (a, b)]
        out += [(k, a, b, t, starts[i + 1][0] if i + 1 < len(starts) else None) for i, (t, a, b) in enumerate(starts)]
    return sorted(out, key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in version_history(df, ["k"], "t", ["a", "b"], ["o"], row_group=4, **options).collect()), key=repr)


ROWS = [(None, 5, "x", 1, 0), (None, 6, "x", 1, 1), ("k", 1, None, None, 2), ("k", 2, None, None, 3), ("k", 3, "", None, 4), ("k", 3, "", None, 5), ("k", 9, None, None, 6), ("k", None, "z", 1, 7), ("l", 4, "a" * 100_000, 2, 8), ("l", 5, "a" * 100_000, 2, 9), ("k", 0, "late", 7, 10)]


@pytest.mark.parametrize("range_rows", [1_000_000, 1, 5])
def test_defined_cases(spark, range_rows):
    df = spark.createDataFrame(ROWS * 2, SCHEMA).withColumns({"valid_from": F.lit("clash"), "r": F.lit(1), "k0": F.lit(2)})
    assert found(df, range_rows=range_rows) == versions(ROWS * 2)
    assert found(df.limit(0), range_rows=range_rows) == []


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["p", "q", None]), st.one_of(st.none(), st.integers(0, 40)), st.sampled_from(["a", "b", None]), st.sampled_from([1, None]), st.integers(0, 3)), max_size=60), st.sampled_from([1, 7, 1_000_000]))
def test_like_brute_force(spark, rows, range_rows):
    day = [(k, None if t is None else t * 3_600_000_000, a, b, o) for k, t, a, b, o in rows]
    assert found(spark.createDataFrame(day, SCHEMA), range_rows=range_rows) == versions(day)


def test_timestamps_and_hot_key(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("t"), F.floor(F.col("id") / 5_000).cast("string").alias("a"), F.lit(1).cast("bigint").alias("b"), F.col("id").alias("o"))
    rows = [(r.k, r.t, r.a, r.b, r.o) for r in df.collect()]
    assert found(df, range_rows=1_500) == versions(rows)


def test_snapshots_are_added_one_by_one(spark, tmp_path):
    parts = [ROWS[i::3] for i in range(3)]
    frames = [spark.createDataFrame(p, SCHEMA) for p in parts]
    assert sorted((tuple(r) for r in version_history(frames, ["k"], "t", ["a", "b"], ["o"], row_group=2).collect()), key=repr) == versions(ROWS)
    store = SnapshotStore(spark, str(tmp_path), ["k"], "t", ["a", "b"], ["o"], buckets=3)
    seen = []
    for p, frame in zip(parts, frames):
        kept = {f: f.stat().st_mtime_ns for f in (tmp_path / "runs").glob("*")}
        store.add(frame)
        seen += p
        assert sorted((tuple(r) for r in store.versions().collect()), key=repr) == versions(seen)
        assert all(f.stat().st_mtime_ns == t for f, t in kept.items())


def test_one_scan(spark, data):
    from siltline.operators.queries import QUERIES

    plan = QUERIES["p2_acquisition_periods"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


@pytest.mark.parametrize("text", ["2025-01-02T03:04:05", "2025-01-02 03:04:05+02:00", "2025-01-02T03:04:05Z", "2025-01-02T03:04:05.678901-05:30", "2025-01-02", "0000-00-00", "yesterday", "", None, "2025-13-01T00:00:00", "2025-01-02T03:04"])
def test_instants_agree(spark, text):
    got = spark.createDataFrame([(text,)], "s string").select(instant_column("s").alias("v")).head()[0]
    assert got == instant_from_text(text)


def test_attributes(spark):
    rows = [(1, "2025-01-01", '{"d": 1.0, "t": "x"}'), (2, "2025-01-01T00:00:00Z", '{"d": 1, "t": "x", "z": 1}'), (3, "soon", "{}"), (4, "2025-01-01", "[1]"), (5, "2025-01-01", '{"d":'), (6, "2025-01-01", '{"d": NaN}'), (7, None, "{}"), (8, "2025-01-01", None), (9, "2025-01-01", '{"d": true, "t": {"a": "\\ud800"}}')]
    got = record_attributes(spark.createDataFrame(rows, "id bigint, fetched_at string, raw_json string"), ["d", "t"], ["id"]).collect()
    assert [r.id for r in got] == [1, 2, 9] and got[0].d == got[1].d and got[0].t == got[1].t and got[0].at == got[1].at
