import heapq
import operator
import pickle

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltline.llm.topn import Cursor, LoserTree, merge_runs, top_n
from siltline.operators.runs import Run, RunFile

SCHEMA = "g string, s bigint, i string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9)), max_size=7))
def test_loser_tree(runs):
    sorted_ = [[(x,) for x in sorted(r)] for r in runs]
    assert list(LoserTree(sorted_)) == list(heapq.merge(*sorted_))


def expected(rows, n):
    best = {}
    for g, s, i in rows:
        if s is not None and i is not None:
            best[g, i] = max(s, best.get((g, i), s))
    out = []
    for g in {g for g, _ in best}:
        own = sorted(((-s, i) for (h, i), s in best.items() if h == g))[:n]
        out += [(g, -s, i, place) for place, (s, i) in enumerate(own, 1)]
    return sorted(out, key=repr)


def found(df, n):
    return sorted((tuple(r) for r in top_n(df, ["g"], "s", "i", n, row_group=3).collect()), key=repr)


ROWS = [(None, 1, "a"), (None, 2, "b"), ("x", None, "n"), ("x", 1, None), ("x", 5, ""), ("x", 5, "z" * 50_000), ("x", 5, "Z"), ("x", 5, "é"), ("x", 4, "late"), ("x", 9, "late"), ("y", -3, "only"), ("z", None, "none")]


@pytest.mark.parametrize("n", [1, 2, 10])
def test_defined_cases(spark, n):
    df = spark.createDataFrame(ROWS * 3, SCHEMA).withColumns({"score": F.lit(1), "item": F.lit(2), "run": F.lit(3), "place": F.lit(4)})
    assert found(df, n) == expected(ROWS, n) and found(df.limit(0), n) == []
    assert found(df.repartition(7), n) == expected(ROWS, n)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["p", "q", None]), st.one_of(st.none(), st.integers(0, 5)), st.sampled_from([*"abcdefgh", None])), max_size=60), st.integers(1, 4), st.integers(1, 9))
def test_like_brute_force(spark, rows, n, parts):
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(parts), n) == expected(rows, n)


def test_a_hot_group_and_numbers_that_are_none(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 2_000)).alias("g"), (F.col("id") * 7919 % 1_000).alias("s"), F.col("id").cast("string").alias("i"))
    assert found(df, 10) == expected([tuple(r) for r in df.collect()], 10)
    floats = spark.createDataFrame([("a", float("nan"), "x"), ("a", 1.5, "y")], "g string, s double, i string")
    assert [tuple(r) for r in top_n(floats, ["g"], "s", "i", 3).collect()] == [("a", 1.5, "y", 1)]


def test_seeking_leaves_row_groups_unread(tmp_path):
    file = RunFile(str(tmp_path), 0, 0, ["g0"], 10)
    rows = [("a", -s, f"i{s}") for s in range(500)] + [("b", 1, "x"), (None, 2, "y")]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or "", -r[1]))
    file.add(pa.table({"g0": [r[0] for r in rows], "score": [r[1] for r in rows], "item": [r[2] for r in rows]}))
    stored = file.close()
    run, read = Run(stored["path"], pickle.loads(stored["marks"]), ["g0"]), []
    group = run.group
    run.group = lambda i: read.append(i) or group(i)
    got = list(merge_runs([Cursor(run, ["g0"], operator.neg)], 3))
    assert [(names[0], score) for names, score, _, _ in got] == [(None, 2), ("a", 0), ("a", -1), ("a", -2), ("b", 1)] and len(run.marks) == 51 and len(read) == 2
