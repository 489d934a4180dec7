"""Filling fixed-capacity containers with items, by bin completion."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.operators.skew import key_hash

#: Full containers that the items of a room would make; a room is packed by one task.
ROOM_CONTAINERS = 256
#: Greedy fillings tried first around a largest item, and nodes of the search in a room before the incumbent is taken.
BRANCHES, NODES = 6, 4_000
#: Steps of listing fillings for each of these nodes.
STEPS = 50


def lower_bound(sizes: Sequence[int], capacity: int) -> int:
    """Containers that any packing needs: by total size, and by the waste that items above half leave."""
    best = -(-sum(sizes) // capacity)
    asc = sorted(sizes)
    total = [0]
    for s in asc:
        total.append(total[-1] + s)
    half = bisect_right(asc, capacity // 2)
    for k in {0, *asc[:half]}:
        large = bisect_right(asc, capacity - k)  # items that no item of size k or more can join
        low = bisect_left(asc, k)
        alone, big, middle = len(asc) - large, large - half, total[half] - total[low] if half > low else 0
        room = capacity * big - (total[large] - total[half])
        best = max(best, alone + big + max(0, -(-(middle - room) // capacity)))
    return best


class _Stock:
    """The items not yet placed, as sizes with counts."""

    def __init__(self, sizes: Sequence[int]) -> None:
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.sizes = sorted(self.count)

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            del self.count[s]
            self.sizes.pop(bisect_left(self.sizes, s))

    def put(self, s: int) -> None:
        if s not in self.count:
            self.count[s] = 0
            insort(self.sizes, s)
        self.count[s] += 1

    def largest(self, most: int) -> int | None:
        i = bisect_right(self.sizes, most)
        return self.sizes[i - 1] if i else None


def _completions(stock: Mapping[int, int], room: int, branches: int, spare: int, steps: list[int]) -> Iterator[list[int]]:
    """Undominated fillings of the room beside a largest item that leave at most ``spare`` empty, one by one.

    ``stock`` has the counts of the sizes that fit, largest first. First come up to ``branches`` greedy fillings,
    which each start with another size and go on with the largest that fits: those without waste as they are found,
    then the rest by rising waste. Then all others follow, unless ``steps`` are used up. A filling is left out
    only if another one dominates it.
    """
    sizes, counts = list(stock), list(stock.values())
    if not sizes or sizes[0] == room:  # one item that fills the room has a place for what any other filling holds
        if not sizes and room > spare:
            return
        yield sizes[:1]
        return
    fits = lambda left: bisect_left(sizes, -left, key=lambda s: -s)
    tried: set[tuple[int, ...]] = set()
    wasteful: list[tuple[int, tuple[int, ...]]] = []
    for start, size in enumerate(sizes[:branches]):
        left, filling = room - size, [size]
        i = fits(left)
        while i < len(sizes):
            n = min(counts[i] - (i == start), left // sizes[i])
            filling += [sizes[i]] * n
            left -= sizes[i] * n
            i = max(i + 1, fits(left))
        found = tuple(sorted(filling, reverse=True))
        if found in tried:
            continue
        tried.add(found)
        if not left:
            yield list(found)
        elif left <= spare:
            wasteful.append((left, found))
    present = sum(1 << s for s in sizes)
    for left, found in sorted(wasteful, key=lambda f: f[0]):
        if not _dominated(found, left, stock, present):
            yield list(found)
    behind = [0]  # total size from a place on
    for s, c in zip(sizes[::-1], counts[::-1]):
        behind.append(behind[-1] + s * c)
    behind.reverse()
    chosen: list[int] = []
    free = list(counts)
    left, i = room, 0
    while steps[0] > 0:
        if left - behind[i] <= spare:
            while (i := max(i, fits(left))) < len(sizes):
                if free[i]:
                    chosen.append(i)
                    free[i] -= 1
                    left -= sizes[i]
                    steps[0] -= 1
                else:
                    i += 1
            found = tuple(sizes[j] for j in chosen)
            if left <= spare and found not in tried and not _dominated(found, left, stock, present):
                yield list(found)
        if not chosen:
            return
        i = chosen.pop()
        free[i] += 1
        left += sizes[i]
        steps[0] -= 1
        i += 1


def _dominated(filling: Sequence[int], left: int, stock: Mapping[int, int], present: int) -> bool:
    """Whether some items of a filling, or none, can give way to a larger item of the stock, or several to one as large.

    Such an exchange leaves smaller items for the other containers (Martello and Toth). Sizes in stock
    (``present``) and sums of items are sets as bits of whole numbers.
    """
    for s, n in Counter(filling).items():
        if n == stock[s]:
            present &= ~(1 << s)
    none_or_one, several = 1, 0
    for s in filling:
        several |= several << s | (none_or_one & ~1) << s
        none_or_one |= 1 << s
    if several & present:
        return True
    reached, width = (none_or_one | several) << 1, 1  # sums and 1 to ``width`` more
    if not left:
        return False
    while width < left:
        more = min(width, left - width)
        reached |= reached << more
        width += more
    return bool(reached & present)


def best_fit(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item, from large to small, into the fullest container that has room."""
    rooms: list[tuple[int, int]] = []
    out: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        i = bisect_left(rooms, (s, -1))
        if i < len(rooms):
            left, n = rooms.pop(i)
        else:
            left, n = capacity, len(out)
            out.append([])
        out[n].append(s)
        insort(rooms, (left - s, n))
    return out


def pack(sizes: Sequence[int], capacity: int, branches: int = BRANCHES, nodes: int = NODES) -> list[list[int]]:
    """Containers of sizes, none above ``capacity``; each size must be from 1 to ``capacity``.

    Bin completion: the best-fit solution is the first incumbent. A depth-first search fills one container
    after the other around the largest item left, tries its undominated fillings, drops a branch whose
    waste cannot make it better than the incumbent, and ends at the lower bound or after ``nodes`` nodes.
    Listing the fillings of all nodes takes at most ``STEPS`` times ``nodes`` steps.
    """
    best = best_fit(sizes, capacity)
    least = lower_bound(sizes, capacity)
    total = sum(sizes)
    stock, path, visited, steps = _Stock(sizes), [], 0, [STEPS * nodes]
    if not sizes or len(best) <= least:
        return best

    def options() -> Iterator[list[int]]:
        size = stock.sizes[-1]
        stock.take(size)
        beside = {s: stock.count[s] for s in reversed(stock.sizes[: bisect_right(stock.sizes, capacity - size)])}
        stock.put(size)
        # The incumbent less one container has this much room to spare.
        spare = (len(best) - 1) * capacity - total - waste
        return ([size, *f] for f in _completions(beside, capacity - size, branches, spare, steps))

    waste = 0
    frames = [options()]
    while frames and len(best) > least and visited < nodes + 2 * len(best):
        filling = next(frames[-1], None)
        if filling is None:
            frames.pop()
            if path:
                last = path.pop()
                waste -= capacity - sum(last)
                for s in last:
                    stock.put(s)
            continue
        visited += 1
        lost = waste + capacity - sum(filling)
        if lost > (len(best) - 1) * capacity - total:
            continue
        for s in filling:
            stock.take(s)
        path.append(filling)
        waste = lost
        if not stock.sizes:
            if len(path) < len(best):
                best = [list(f) for f in path]
            frames.append(iter(()))
        else:
            frames.append(options())
    return best


def room_gaps(packed: DataFrame, specs: Sequence[tuple[int, int]]) -> DataFrame:
    """What the packing of each room leaves open: containers, the least that any packing of the room needs, and whether they are equal.

    ``packed`` is what ``pack_items`` returns. Columns: spec_id, room, containers, least, proven.
    """
    capacity = {int(s): int(c) for s, c in specs}
    rooms = packed.select("spec_id", F.split("container_id", "-")[1].cast("long").alias("room"), "container_id", "piece_size")

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        spec, made = int(pdf["spec_id"].iloc[0]), pdf["container_id"].nunique()
        sizes = [s for s in pdf["piece_size"].tolist() if s]
        least = max(1, lower_bound(sizes, capacity[spec]))
        return pd.DataFrame({"spec_id": [spec], "room": [int(pdf["room"].iloc[0])], "containers": [made], "least": [least], "proven": [made == least]})

    return rooms.groupBy("spec_id", "room").applyInPandas(bound, "spec_id int, room bigint, containers bigint, least bigint, proven boolean")


def pack_items(
    items: DataFrame,
    id: str,
    size: str,
    specs: Sequence[tuple[int, int]],
    room_containers: int = ROOM_CONTAINERS,
    nodes: int = NODES,
) -> DataFrame:
    """Every item assigned to containers of each capacity (``specs``: pairs of spec id and capacity).

    An item larger than a capacity is cut into pieces that each fill a container, and a rest; no other item
    is cut. Items and rests are spread over rooms by a hash of the id, so many that each room makes about
    ``room_containers`` containers, and every room is packed by itself (``pack``). A room's last container is
    the price: about half a container in ``room_containers``. Which items share a room depends on nothing but ids
    and total size, so a run can be repeated.

    Returns spec_id, container_id, the id, piece_no (from 0), start (offset in the item) and piece_size.

    Defined cases: items of size 0 or null are placed, with size 0, into the first container of their room;
    equal sizes are taken by id; a repeated id is packed once per row; a null id is an id; other columns do
    not matter; no items or no specs give no containers. Capacities must be positive.
    """
    if any(c <= 0 for _, c in specs):
        raise ValueError("a capacity must be positive")
    base = items.select(F.col(id).alias("id"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    total, count = base.agg(F.sum("size"), F.count(F.lit(1))).head()
    kind = base.schema["id"].dataType.simpleString()
    schema = f"spec_id int, container_id string, id {kind}, piece_no bigint, start bigint, piece_size bigint"
    if not count or not specs:
        return base.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id)
    rooms = {s: max(1, round((total or 0) / (c * room_containers)), -(-count // 100_000)) for s, c in specs}
    spec = F.explode(F.array(*(F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("long").alias("capacity"), F.lit(rooms[s]).cast("long").alias("rooms")) for s, c in specs))).alias("spec")
    each = base.select("id", "size", spec).select("id", "size", "spec.*").withColumn("whole", F.floor((F.greatest("size", F.lit(1)) - 1) / F.col("capacity"))).withColumn("room", F.pmod(key_hash(["id"]), F.col("rooms")))
    rest = each.select("spec_id", "room", "capacity", F.col("id").cast("string").alias("id"), "whole", (F.col("size") - F.col("whole") * F.col("capacity")).alias("size"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "whole"], ascending=False, kind="stable", na_position="first")
        spec_id, room, capacity = int(pdf["spec_id"].iloc[0]), int(pdf["room"].iloc[0]), int(pdf["capacity"].iloc[0])
        sizes = pdf["size"].tolist()
        waiting: dict[int, list[int]] = {}
        for at, s in enumerate(sizes):
            waiting.setdefault(s, []).append(at)
        container = [0] * len(sizes)
        made = 0
        for n, filling in enumerate(pack([s for s in sizes if s], capacity, nodes=nodes)):
            made = n + 1
            for s in filling:
                container[waiting[s].pop()] = n
        out = pd.DataFrame({"spec_id": spec_id, "container_id": [f"{spec_id}-{room}-{n}" for n in container], "id": pdf["id"].to_numpy(), "piece_no": pdf["whole"].to_numpy(), "start": pdf["whole"].to_numpy() * capacity, "piece_size": sizes})
        full = [(x, i) for x, whole in zip(pdf["id"], pdf["whole"]) for i in range(whole)]
        if full:
            more = pd.DataFrame({"spec_id": spec_id, "container_id": [f"{spec_id}-{room}-{made + n}" for n in range(len(full))], "id": [x for x, _ in full], "piece_no": [i for _, i in full], "start": [i * capacity for _, i in full], "piece_size": capacity})
            out = pd.concat([out, more], ignore_index=True)
        return out

    packed = rest.groupBy("spec_id", "room").applyInPandas(fill, schema.replace(f"id {kind}, piece", "id string, piece"))
    return packed.select("spec_id", "container_id", F.col("id").cast(base.schema["id"].dataType).alias(id), "piece_no", "start", "piece_size")
