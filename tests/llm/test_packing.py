import random
from collections import defaultdict
from itertools import combinations, permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltline.llm.packing import _completions, best_fit, lower_bound, pack, pack_items, room_gaps

sizes_ = st.lists(st.integers(1, 20), max_size=7)


def least(sizes, capacity):
    """Brute force: first fit over all orders."""
    best = len(sizes)
    for order in set(permutations(sizes)):
        rooms = []
        for s in order:
            for i, r in enumerate(rooms):
                if r >= s:
                    rooms[i] -= s
                    break
            else:
                rooms.append(capacity - s)
        best = min(best, len(rooms))
    return best


@settings(max_examples=80, deadline=None)
@given(sizes_)
def test_small_ones_are_packed_as_well_as_possible(sizes):
    found = pack(sizes, 20)
    assert sorted(s for f in found for s in f) == sorted(sizes) and all(sum(f) <= 20 for f in found)
    assert lower_bound(sizes, 20) <= least(sizes, 20) <= len(found) <= len(best_fit(sizes, 20))
    assert len(found) == least(sizes, 20)


def test_better_than_best_fit():
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6, 20, 40, 40, 20]
    assert len(pack(sizes, 60)) <= len(best_fit(sizes, 60))
    rng = random.Random(5)
    gains = sum(len(best_fit(s, 100)) - len(pack(s, 100)) for s in ([rng.randint(20, 60) for _ in range(60)] for _ in range(40)))
    assert gains > 0


def test_other_fillings_stay_as_later_branches():
    sizes = [10, 8, 8, 8, 6, 6, 5, 5, 4]
    found = pack(sizes, 20)
    assert len(found) == 3 and sorted(s for f in found for s in f) == sorted(sizes) and all(sum(f) <= 20 for f in found)


def holds(a, b):
    """Whether the items of b have places inside the items of a."""
    if not b:
        return True
    return any(x >= b[0] and holds([*a[:i], x - b[0], *a[i + 1 :]], b[1:]) for i, x in enumerate(a))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=7), st.integers(0, 14), st.sampled_from([0, 1, 6]))
def test_every_filling_is_listed_or_dominated(items, room, branches):
    stock = {s: items.count(s) for s in sorted(set(items), reverse=True) if s <= room}
    listed = list(_completions(stock, room, branches, room, [10_000]))
    every = {tuple(sorted(c, reverse=True)) for n in range(len(items) + 1) for c in combinations(items, n) if sum(c) <= room}
    assert len({tuple(f) for f in listed}) == len(listed) and {tuple(f) for f in listed} <= every
    assert all(any(holds(f, list(e)) for f in listed) for e in every)
    assert all(sum(f) >= room - 2 for f in listed if f in list(_completions(stock, room, branches, 2, [10_000])))


def optimum(sizes, capacity):
    """Brute force over all sets of items: the least containers, and the least filled last one."""
    best = [(len(sizes) + 1, 0)] * (1 << len(sizes))
    best[0] = (1, 0)
    for chosen in range(len(best)):
        made, filled = best[chosen]
        for i, s in enumerate(sizes):
            if not chosen >> i & 1:
                after = chosen | 1 << i
                way = (made, filled + s) if filled + s <= capacity else (made + 1, s)
                if way < best[after]:
                    best[after] = way
    return best[-1][0] if sizes else 0


def test_a_thousand_rooms_like_brute_force():
    rng = random.Random(11)
    known = [(50, [5, 5, 6, 9, 10, 15, 17, 18, 19, 21, 25]), (20, [2, 3, 4, 5, 6, 9, 9, 9, 12]), (20, [10, 8, 8, 8, 6, 6, 5, 5, 4])]
    for capacity, sizes in known + [(c := rng.choice([15, 20, 37, 50, 100]), [rng.randint(1, max(2, c * 6 // 10)) for _ in range(rng.choice([6, 7, 8, 8, 9, 9, 10, 12]))]) for _ in range(1_000)]:
        found = pack(sizes, capacity)
        assert sorted(s for f in found for s in f) == sorted(sizes) and all(sum(f) <= capacity for f in found)
        assert len(found) == optimum(sizes, capacity), (capacity, sizes)


def test_gaps_of_rooms(spark):
    df = spark.range(3_000).select(F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).alias("size"))
    packed = pack_items(df, "i", "size", [(1, 128)], room_containers=40)
    rooms = room_gaps(packed, [(1, 128)]).collect()
    assert len(rooms) > 1 and sum(r.containers for r in rooms) == packed.select("container_id").distinct().count()
    assert all(r.least <= r.containers and r.proven == (r.least == r.containers) for r in rooms)


def check(df, items, specs, **options):
    rows = pack_items(df, "i", "size", specs, **options).collect()
    capacity = dict(specs)
    filled, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        filled[r.spec_id, r.container_id] += r.piece_size
        pieces[r.spec_id, r.i].append((r.piece_no, r.start, r.piece_size))
    assert all(n <= capacity[s] for (s, _), n in filled.items())
    for s, c in specs:
        for i, size in items:
            own = sorted(pieces.pop((s, i)))
            assert sum(p for _, _, p in own) == (size or 0) and len(own) == max(1, -(-(size or 0) // c))
            assert [(n, n * c) for n, _, _ in own] == [(n, start) for n, start, _ in own] and all(p == c for _, _, p in own[:-1])
    assert not pieces
    return filled


def test_defined_cases(spark):
    items = [(1, 5), (2, None), (3, 0), (4, 10), (5, 11), (6, 1_000_003), (7, 10), (None, 3)]
    df = spark.createDataFrame(items, "i bigint, size bigint").withColumns({"id": F.lit(1), "room": F.lit(2), "spec_id": F.lit(3)})
    check(df, items, [(1, 10), (2, 1_000)])
    check(df, items, [(1, 10)], room_containers=1)
    assert pack_items(df.limit(0), "i", "size", [(1, 10)]).collect() == [] and pack_items(df, "i", "size", []).collect() == []
    with pytest.raises(ValueError):
        pack_items(df, "i", "size", [(1, 0)])
    twice = df.filter("i = 6").union(df.filter("i = 6"))
    filled = defaultdict(int)
    for r in pack_items(twice, "i", "size", [(1, 10)]).collect():
        filled[r.container_id] += r.piece_size
    assert sum(filled.values()) == 2_000_006 and max(filled.values()) == 10


def test_little_is_left_empty(spark):
    df = spark.range(20_000).select(F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(300)) + 1).alias("size"))
    items = [tuple(r) for r in df.collect()]
    filled = check(df, items, [(1, 256), (2, 4096)])
    for s, c in ((1, 256), (2, 4096)):
        own = [n for (x, _), n in filled.items() if x == s]
        assert sum(own) / (len(own) * c) > 0.985
