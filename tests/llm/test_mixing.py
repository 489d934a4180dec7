import random

import pytest
from pyspark.sql import functions as F

from siltline.llm.mixing import feasible_total, mixture, route


def test_flow():
    patterns = {("a",): 100, ("a", "b"): 50, ("b",): 10}
    repeats = {"a": 1, "b": 3}
    flows = route(patterns, {"a": 120, "b": 60}, repeats)
    assert sum(n for (_, s), n in flows.items() if s == "a") == 120 and sum(n for (_, s), n in flows.items() if s == "b") == 60
    # the documents of both sources are first used once: 20 for a, 30 for b, then b repeats
    assert flows[("a",), "a"] == 100 and flows[("a", "b"), "a"] == 20
    assert feasible_total({("a",): 100, ("b",): 10}, {"a": 1, "b": 1}, {"a": 1, "b": 3}) == 61


def test_the_largest_total_leaves_no_source_short():
    rng = random.Random(2)
    for _ in range(100):
        names = "abcd"[: rng.randint(1, 4)]
        patterns = {tuple(s for s in names if rng.random() < 0.5) or (names[0],): rng.randint(1, 200) for _ in range(5)}
        weights, repeats = {s: float(rng.randint(1, 9)) for s in names}, {s: rng.randint(1, 3) for s in names}
        have = {s: w for s, w in weights.items() if any(s in p for p in patterns)}
        short = lambda total: any(n > sum(x for (_, t), x in route(patterns, {s: int(total * w / sum(have.values())) for s, w in have.items()}, repeats).items() if t == s) for s, n in {s: int(total * w / sum(have.values())) for s, w in have.items()}.items())
        total = feasible_total(patterns, have, repeats)
        assert not short(total) and short(total + max(1, -int(-sum(have.values()) // min(have.values())) + 1))


def documents(spark, n=3_000):
    source = F.when(F.col("id") % 3 == 0, F.array(F.lit("a"))).when(F.col("id") % 10 == 1, F.array(F.lit("b"))).when(F.col("id") % 10 == 2, F.array(F.lit("b"), F.lit("a"), F.lit("b"), F.lit("zz"))).otherwise(F.array(F.lit("c"), F.lit(None)))
    return spark.range(n).select(F.col("id").alias("i"), source.alias("sources"), (F.pmod(F.xxhash64("id"), F.lit(40)) + 1).alias("size"))


def test_shares(spark):
    df = documents(spark).withColumns({"pattern": F.lit("x"), "h": F.lit(1), "uses": F.lit(2)})
    targets = [("a", 50.0, 1), ("b", 30.0, 4), ("c", 20.0, 2), ("none", 5.0, 3)]
    chosen, shares = mixture(df, "i", "sources", "size", targets, bucket_documents=100)
    rows = {r.source: r for r in shares.collect()}
    picked = chosen.collect()
    assert rows["none"].reached_tokens == 0 and abs(sum(r.reached_share for r in rows.values()) - 1) < 1e-9
    for s, w, most in targets[:3]:
        assert abs(rows[s].reached_share - w / 100) < 0.005 and rows[s].most_uses <= most
        assert abs(rows[s].reached_tokens - rows[s].target_tokens) <= 80
    assert all(r.uses <= dict((s, m) for s, _, m in targets)[r.source] for r in picked) and len({(r.i, r.source) for r in picked}) == len(picked)
    again, _ = mixture(df.repartition(9), "i", "sources", "size", targets, bucket_documents=100)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, picked))
    other, _ = mixture(df, "i", "sources", "size", targets, seed=1)
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, picked))


def test_a_total_that_cannot_be_reached(spark):
    chosen, shares = mixture(documents(spark, 300), "i", "sources", "size", [("a", 1.0, 2), ("b", 1.0, 1)], total=1_000_000)
    rows = {r.source: r for r in shares.collect()}
    assert rows["a"].reached_tokens == 2 * rows["a"].available_tokens and rows["b"].reached_tokens == rows["b"].available_tokens
    assert {r.uses for r in chosen.filter("source = 'a'").collect()} == {2}


def test_defined_cases(spark):
    rows = [(1, ["a"], 5), (2, None, 5), (3, ["a"], None), (4, ["a"], 0), (5, [], 7), (6, ["q"], 7), (7, ["a"], 10_000_000), (7, ["a"], 10_000_000), (None, ["a"], 3)]
    df = spark.createDataFrame(rows, "i bigint, sources array<string>, size bigint")
    chosen, shares = mixture(df, "i", "sources", "size", [("a", 1.0, 1), ("b", 0.0, 1), ("c", 1.0, 0)])
    assert sorted((r.i, r.uses) for r in chosen.filter("i is not null").collect()) == [(1, 1), (7, 1), (7, 1)] and chosen.count() == 4
    empty, shares = mixture(df.limit(0), "i", "sources", "size", [("a", 1.0, 1)])
    assert empty.count() == 0 and [(r.reached_tokens, r.reached_share) for r in shares.collect()] == [(0, None)]
    for bad in ([("a", -1.0, 1)], [("a", 1.0, 1), ("a", 2.0, 1)]):
        with pytest.raises(ValueError):
            mixture(df, "i", "sources", "size", bad)
