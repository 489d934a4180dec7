import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltline.operators.snapshot_diff import LookupTable, changed_hashes, snapshot_changes

SCHEMA = "s int, a string, b string, v bigint"


def changes(rows, numbers=None):
    numbers = sorted({r[0] for r in rows if r[0] is not None}) if numbers is None else numbers
    sides = {n: {} for n in numbers}
    for s, a, b, v in rows:
        if s in sides:
            sides[s][a, b] = v
    out = []
    for old, new in zip(numbers, numbers[1:]):
        x, y = sides[old], sides[new]
        out += [(new, *k, "added") for k in y if k not in x] + [(new, *k, "removed") for k in x if k not in y] + [(new, *k, "changed") for k in y if k in x and x[k] != y[k]]
    return sorted(out, key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in snapshot_changes(df, "s", ["a", "b"], ["v"], **options).collect()), key=repr)


@pytest.mark.parametrize("cells", [0.001, 0.4])
@pytest.mark.parametrize("n", [0, 1, 50, 5_000])
def test_peeling(cells, n):
    rng = np.random.default_rng(n)
    k = rng.integers(0, 1 << 64, 2 * n + 2, dtype=np.uint64)
    old, new = k[: n + 1], k[n // 2 : n // 2 + n + 1]
    p, q = np.zeros(len(old), np.uint64), np.zeros(len(new), np.uint64)
    came, went = changed_hashes((old, p), (new, q), cells, 2)
    assert set(came.tolist()) == set(new.tolist()) - set(old.tolist()) and set(went.tolist()) == set(old.tolist()) - set(new.tolist())


def test_table_that_is_too_full():
    k = np.arange(1, 500, dtype=np.uint64)
    t = LookupTable(24)
    t.add(k, k)
    assert t.peel() is None


ROWS = [(1, None, "x", 1), (2, None, "x", 1), (3, "", "x", 1), (1, "a", "b", None), (2, "a", "b", None), (3, "a", "b", 5), (1, "q" * 50_000, "", 1), (3, "q" * 50_000, "", 1), (None, "n", "n", 1), (2, "A", "a", 1), (2, "a", "A", 1)]


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 2}, {"bucket_rows": 1}, {"first_cells": 0.0}])
def test_defined_cases(spark, options):
    df = spark.createDataFrame(ROWS * 3, SCHEMA).withColumns({"h": F.lit(1), "change_kind": F.lit("clash"), "k0": F.lit(0)})
    assert found(df, **options) == changes(ROWS)
    assert found(df.limit(0), **options) == [] and found(df.filter("s = 1"), **options) == []
    assert found(df, snapshots=[1, 3], **options) == changes(ROWS, [1, 3])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.tuples(st.integers(1, 4), st.sampled_from("abcdef"), st.sampled_from(["x", None])), st.one_of(st.none(), st.integers(0, 2)), max_size=40), st.sampled_from([1, 5, 20_000]))
def test_like_brute_force(spark, cells, bucket_rows):
    rows = [(s, a, b, v) for (s, a, b), v in cells.items()]
    assert found(spark.createDataFrame(rows, SCHEMA), bucket_rows=bucket_rows) == changes(rows)


def test_hot_key_and_many_buckets(spark):
    df = spark.range(30_000).select((F.col("id") % 3 + 1).cast("int").alias("s"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.floor(F.col("id") / 7))).alias("a"), F.lit("b").alias("b"), F.lit(1).cast("bigint").alias("v"))
    assert found(df, bucket_rows=500) == changes([tuple(r) for r in df.collect()])
