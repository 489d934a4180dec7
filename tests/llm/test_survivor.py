import random
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltline.llm import survivor
from siltline.llm.survivor import align, closest, consensus, consensus_survivors, distance, fit, most_trusted, tokens

BY = [("p", "desc"), ("t", "desc"), ("i", "asc")]
SCHEMA = "k string, v string, p int, t timestamp, i bigint, w double"
words = st.lists(st.sampled_from("abcd"), max_size=7)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_alignment(a, b):
    pairs = align(a, b)
    assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))
    assert distance(a, b) == levenshtein(a, b)


@settings(max_examples=100, deadline=None)
@given(st.lists(words, min_size=1, max_size=6))
def test_the_most_trusted_outvotes_all(values):
    votes = [1 << (len(values) - i) for i in range(len(values))]
    assert consensus(values, votes) == values[0]
    assert closest([" ".join(v) for v in values], None) == 0


def test_consensus_of_many():
    values = ["the old garden film", "the old garden", "the green garden film", "an old garden film"]
    assert consensus([tokens(v) for v in values], [1, 1, 1, 1]) == ["the", "old", "garden", "film"]
    assert closest(values, [1, 1, 1, 1]) == 0 and closest(["x y", "a b c", "a b d", "a b c"], [1, 1, 1, 1]) == 1
    assert closest([None, "a", "a b"], [5, 1, 1]) == 0 and closest(["", "a"], [1, 3]) == 1


def cheapest(columns, value):
    table = [list(range(len(value) + 1))]
    for c in columns:
        row = [table[-1][0] + (None not in c)]
        for j, y in enumerate(value, 1):
            row.append(min(table[-1][j - 1] + (y not in c), table[-1][j] + (None not in c), row[-1] + 1))
        table.append(row)
    return table[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.sampled_from(["a", "b", "c", "d", None]), min_size=1), max_size=7), words, st.sampled_from([1_000_000, 4, 0]))
def test_fit_to_columns(columns, value, cells):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(survivor, "ALIGN_CELLS", cells)
        pairs = fit(columns, value)
    assert [i for i, _ in pairs if i is not None] == list(range(len(columns))) and [j for _, j in pairs if j is not None] == list(range(len(value)))
    assert sum(1 if i is None else None not in columns[i] if j is None else value[j] not in columns[i] for i, j in pairs) == cheapest(columns, value)


def test_votes_for_an_inserted_token_add_up():
    values = ["The Film", "The Old Film", "The Old Film !"]
    assert consensus([tokens(v) for v in values], [5, 4, 4]) == ["The", "Old", "Film"] and closest(values, [5, 4, 4]) == 1
    assert consensus([tokens(v) for v in ["a z", "a b z", "a c b z", "a b z !", "z"]], [4, 3, 1, 3, 1]) == ["a", "b", "z"]
    assert consensus([tokens(v) for v in values], [9, 4, 4]) == ["The", "Film"] and consensus([tokens(v) for v in values], None) == ["The", "Film"]


def test_long_values():
    a = [f"w{i}" for i in range(5_000)]
    b = a[:2_000] + ["new"] + a[2_010:]
    assert distance(a, b) == 10 and consensus([a, b], [2, 1]) == a
    assert distance(["x"] * 3_000, ["y"] * 2_000) == 3_000


def test_long_values_are_aligned_exactly():
    a = [f"w{i}" for i in range(5_000)]
    assert distance(["X", *a], [*a, "X"]) == 2 and distance(["X", *a, "y"] * 2, [*a, "X"] * 2) == 3
    values = [" ".join(["X", *a]), " ".join(["z"] * 100 + a[100:]), " ".join([*a, "X"])]
    assert closest(values, [1, 1, 3]) == 2


def expected(rows):
    best = {}
    for k, v, p, t, i, _ in rows:
        rank = (p is None, -(p or 0), t is None, -(t or datetime(2000, 1, 1)).timestamp(), i)
        if k not in best or rank < best[k][0]:
            best[k] = (rank, (k, i))
    return sorted((x for _, x in best.values()), key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in consensus_survivors(df, ["k"], "v", BY, **options).select("k", "i").collect()), key=repr)


T = datetime(2024, 1, 1)
ROWS = [(None, "a b", 1, T, 1, 1.0), (None, None, 2, None, 2, None), ("g", "", 5, T, 3, 1.0), ("g", "x", 5, T, 4, 2.0), ("g", "x " * 30_000, None, T, 5, 1.0), ("h", None, None, None, 6, None), ("h", "one", 3, None, 7, 0.0), ("h", "one", 3, T, 8, 0.0), ("h", "two", 3, T, 9, 9.0), ("solo", None, None, None, 10, None)]


@pytest.mark.parametrize("group_values", [256, 1])
def test_defined_cases(spark, group_values):
    df = spark.createDataFrame(ROWS * 2, SCHEMA).withColumns({"best": F.lit(1), "value": F.lit(2), "k0": F.lit(3)})
    assert found(df, group_values=group_values) == expected(ROWS)
    assert found(df.limit(0), group_values=group_values) == []
    weighted = dict(found(df, group_values=group_values, weight="w"))
    assert set(weighted) == {None, "g", "h", "solo"} and weighted["h"] == 9 and weighted["g"] == 4


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["p", "q"]), st.sampled_from(["a b", "a c d", None, "", "b"]), st.sampled_from([1, 2, None]), st.sampled_from([T, None])), min_size=1, max_size=25), st.sampled_from([1, 256]))
def test_like_brute_force(spark, rows, group_values):
    rows = [(*r, i, 1.0) for i, r in enumerate(rows)]
    assert found(spark.createDataFrame(rows, SCHEMA), group_values=group_values) == expected(rows)


def test_a_group_with_a_third_of_all_rows(spark):
    df = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("k"), F.concat(F.lit("common words "), F.col("id") % 1_500).alias("v"), (F.col("id") % 7).cast("int").alias("p"), F.lit(T).alias("t"), F.col("id").alias("i"), F.lit(1.0).alias("w"))
    assert found(df) == expected([(r.k, r.v, r.p, r.t, r.i, r.w) for r in df.collect()])
    weighted = consensus_survivors(df.filter("k = 'hot'"), ["k"], "v", BY, weight="w").collect()
    assert len(weighted) == 1 and weighted[0].v.startswith("common words ")


def test_one_rule_at_every_size(spark):
    rows, i = [], 0
    for copies in (1, 150):  # copies are rows, not values
        for k, v, p, w in [("tie", "Blue Sky", 2, 1.0), ("tie", "Blue Sun", 1, 1.0), ("old", "The Film", 3, 5.0), ("old", "The Old Film", 2, 4.0), ("old", "The Old Film !", 1, 4.0)]:
            for _ in range(copies):
                rows.append((f"{k}{copies}", v, p, T, i := i + 1, w / copies if k == "old" else w))
    rng = random.Random(3)
    rows += [(None if n % 40 == 0 else f"r{n % 40}", " ".join(rng.choices("abcdef", k=rng.randrange(6))), rng.randrange(3), T, 10_000 + n, float(rng.randrange(4))) for n in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = [sorted((tuple(r) for r in consensus_survivors(df, ["k"], "v", BY, weight="w", group_values=n).select("k", "i", "v").collect()), key=repr) for n in (256, 1, 4, 10**9)]
    assert kept[0] == kept[1] == kept[2] == kept[3] and len(kept[0]) == 44
    survivors = {k: v for k, _, v in kept[0]}
    assert survivors["tie1"] == survivors["tie150"] == "Blue Sky" and survivors["old1"] == survivors["old150"] == "The Old Film"


def plain_survivor(values, weights):
    """The method once more, by one whole table per value: the place of the survivor.

    Of equally cheap alignments the rule takes one that pairs the common beginning, then the common end.
    """
    columns, voted = [], 0.0
    for count, (whole, weight) in enumerate(zip(values, weights)):
        fits = lambda c, t: t in c and None not in c
        before, after = 0, 0
        while before < min(len(columns), len(whole)) and fits(columns[before], whole[before]):
            before += 1
        while after < min(len(columns), len(whole)) - before and fits(columns[-1 - after], whole[-1 - after]):
            after += 1
        first = list(zip(columns[:before], whole[:before]))
        last = list(zip(columns[len(columns) - after :], whole[len(whole) - after :]))
        columns, value = columns[before : len(columns) - after], whole[before : len(whole) - after]
        n, m = len(columns), len(value)
        cost = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n + 1):
            for j in range(m + 1):
                if i or j:
                    ways = []
                    if i and j:
                        ways.append(cost[i - 1][j - 1] + (value[j - 1] not in columns[i - 1]))
                    if i:
                        ways.append(cost[i - 1][j] + (None not in columns[i - 1]))
                    if j:
                        ways.append(cost[i][j - 1] + 1)
                    cost[i][j] = min(ways)
        i, j, merged = n, m, []
        while i or j:
            if i and j and cost[i][j] == cost[i - 1][j - 1] + (value[j - 1] not in columns[i - 1]):
                i, j = i - 1, j - 1
                merged.append((columns[i], value[j]))
            elif i and cost[i][j] == cost[i - 1][j] + (None not in columns[i - 1]):
                i -= 1
                merged.append((columns[i], None))
            else:
                j -= 1
                merged.append(({None: voted} if count else {}, value[j]))
        columns = [{**c, t: c.get(t, 0) + weight} for c, t in [*first, *reversed(merged), *last]]
        voted += weight
    agreed = [t for t in (max(c, key=c.get) for c in columns) if t is not None]
    return min(range(len(values)), key=lambda i: levenshtein(values[i], agreed))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(words, st.integers(0, 4)), min_size=1, max_size=7, unique_by=lambda x: tuple(x[0])))
def test_like_the_plain_method(values):
    texts, weights = [" ".join(v) for v, _ in values], [float(w) for _, w in values]
    assert closest(texts, weights) == plain_survivor([v for v, _ in values], weights)


def test_the_whole_table_like_the_plain_method(spark, data):
    """p1_consensus over a table, against a second computation."""
    from siltline.llm.queries import QUERIES, eligible_observations

    groups = {}
    for r in eligible_observations(spark, data).collect():
        rank = (-r.effective_priority, r.provider_registration_order, r.observed_at is None, -(r.observed_at.timestamp() if r.observed_at else 0), r.observation_id)
        own = groups.setdefault((r.video_id, r.field_name), {}).setdefault(r.observed_value, [rank, 0.0])
        own[0], own[1] = min(own[0], rank), own[1] + r.effective_priority
    wanted = {}
    for key, values in groups.items():
        order = sorted(values.items(), key=lambda x: (x[1][0], x[0] is not None, x[0] or ""))
        at = plain_survivor([tokens(v) for v, _ in order], [w for _, (_, w) in order])
        wanted[key] = (order[at][1][0][-1], order[at][0])
    got = {(r.video_id, r.field_name): (r.observation_id, r.observed_value) for r in QUERIES["p1_consensus"](spark, data).collect()}
    assert got == wanted and len(got) > 100


def test_one_scan(spark, data):
    from siltline.llm.queries import QUERIES

    for name in ("p1_found", "p3_found"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 2  # one of each table


def test_each_stage_decides(spark, data):
    """p1_found is settled by trust alone and aligns nothing; where values are aligned, other rows survive."""
    from siltline.llm.queries import QUERIES

    found, agreed = QUERIES["p1_found"](spark, data), QUERIES["p1_consensus"](spark, data)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (found, agreed)]
    assert "MapInArrow" not in plans[0] and "observed_value" not in plans[0] and "MapInArrow" in plans[1]
    trusted, other = ({(r.video_id, r.field_name): r.observation_id for r in df.collect()} for df in (found, agreed))
    assert set(trusted) == set(other) and trusted != other


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["p", "q", None]), st.sampled_from(["a b", "a c d", None, ""]), st.sampled_from([1, 2, None]), st.sampled_from([T, None])), max_size=25))
def test_most_trusted(spark, rows):
    rows = [(*r, i, 1.0) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows * 2, SCHEMA)
    assert sorted((tuple(r) for r in most_trusted(df, ["k"], BY).select("k", "i").collect()), key=repr) == expected(rows)
    places = {}
    for r in rows:
        rank = (r[2] is None, -(r[2] or 0), r[3] is None, r[4])
        places.setdefault(r[0], []).append((rank, r[1]))
    ordered = {k: [v for _, v in sorted(x, key=lambda y: y[0])] for k, x in places.items()}
    assert {r.k: r.v for r in most_trusted(df, ["k"], BY, "v").collect()} == {k: v[closest(v, None)] for k, v in ordered.items()}
