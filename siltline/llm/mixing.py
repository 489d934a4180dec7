"""Mixing sources to target weights, by min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltline.operators.skew import broadcast_if_small

#: Documents that share a bucket of the seeded order; bounds what a running sum sees at once.
BUCKET_DOCUMENTS = 10_000
#: Distinct membership patterns that the plan may have; they are planned on the driver.
PATTERNS = 10_000
_SEPARATOR = "\x1f"


class Network:
    """A small flow network with costs."""

    def __init__(self, nodes: int) -> None:
        self.edges: list[list[int]] = []  # to, capacity left, cost; the reverse edge is next to it
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, capacity: int, cost: int) -> int:
        self.out[a].append(len(self.edges))
        self.out[b].append(len(self.edges) + 1)
        self.edges += [[b, capacity, cost], [a, 0, -cost]]
        return len(self.edges) - 2

    def run(self, source: int, sink: int) -> int:
        """The greatest flow, of these the cheapest; the amount that flows."""
        total = 0
        while True:
            cost, via, waiting, queued = {source: 0}, {}, deque([source]), {source}
            while waiting:
                a = waiting.popleft()
                queued.discard(a)
                for e in self.out[a]:
                    b, left, price = self.edges[e]
                    if left and cost[a] + price < cost.get(b, 1 << 62):
                        cost[b], via[b] = cost[a] + price, e
                        if b not in queued:
                            queued.add(b)
                            waiting.append(b)
            if sink not in via:
                return total
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.edges[via[at] ^ 1][0]
            amount = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= amount
                self.edges[e ^ 1][1] += amount
            total += amount


def route(patterns: Mapping[Sequence[str], int], quotas: Mapping[str, int], repeats: Mapping[str, int]) -> dict[tuple[Sequence[str], str], int]:
    """Tokens that each pattern of sources gives to each source's quota.

    A pattern's tokens may be used again and again: the first use costs nothing, each further one more than
    the one before. For a source it is used at most as often as the source allows.
    """
    names, sources = list(patterns), list(quotas)
    net = Network(2 + len(names) + len(sources))
    at = {s: 2 + len(names) + j for j, s in enumerate(sources)}
    flows = {}
    for i, p in enumerate(names):
        inside = [s for s in p if s in at]
        for use in range(sum(repeats[s] for s in inside)):
            net.edge(0, 2 + i, patterns[p], use * use)
        for s in inside:
            flows[p, s] = net.edge(2 + i, at[s], patterns[p] * repeats[s], 0)
    for s in sources:
        net.edge(at[s], 1, quotas[s], 0)
    net.run(0, 1)
    return {key: net.edges[e ^ 1][1] for key, e in flows.items() if net.edges[e ^ 1][1]}


def feasible_total(patterns: Mapping[Sequence[str], int], weights: Mapping[str, float], repeats: Mapping[str, int]) -> int:
    """The largest total at which every source that has anything reaches its quota.

    A pattern may be used for each of its sources as often as that source allows, whatever the others take; so a
    source can reach its own tokens times its repeats, and the scarcest source decides.
    """
    reach = {s: repeats[s] * sum(n for p, n in patterns.items() if s in p) for s in weights}
    whole = sum(weights[s] for s in weights if reach[s])

    def fits(total: int) -> bool:
        return all(int(total * weights[s] / whole) <= reach[s] for s in weights if reach[s])

    lo, hi = 0, sum(reach.values())
    while lo < hi:
        middle = (lo + hi + 1) // 2
        lo, hi = (middle, hi) if fits(middle) else (lo, middle - 1)
    return lo


def mixture(
    documents: DataFrame,
    id: str,
    sources: str,
    size: str,
    targets: Sequence[tuple[str, float, int]],
    total: int | None = None,
    seed: int = 0,
    bucket_documents: int = BUCKET_DOCUMENTS,
) -> tuple[DataFrame, DataFrame]:
    """Documents mixed so that each source has its weight, and the shares really reached.

    ``sources`` is a column with an array of the sources that a document belongs to; ``targets`` are
    (source, weight, greatest number of uses of a document for it). Documents are added up by membership
    pattern, a min-cost flow routes their tokens to the quotas with convex costs of repetition, and each
    pattern's documents are chosen in a seeded order: they lie end to end on a circle, and every source takes
    the next arc, so that repetition is even. The middle of a document decides, so a quota is met to within
    one document per pattern.

    ``total`` defaults to the largest at which every source that has any documents reaches its weight. Of a
    larger total, sources that run out give all they may, and the rest is left short.

    Returns the chosen documents (id, source, uses, tokens of one use) and per source target_share,
    target_tokens, available_tokens, within_tokens (how far the tokens reached may be from the target: the
    largest document of each pattern used), reached_tokens, reached_share, chosen and most_uses.

    Defined cases: documents without size, with null or unlisted sources, or of weight 0 take no part; a
    source named twice counts once; a listed source without documents reaches 0 and its weight is shared by
    the others; a repeated id is a document of its own; other columns do not matter; without documents all
    shares reached are 0 (null as a share). Weights and repeats must not be negative; a source is listed once.
    """
    if any(w < 0 or r < 0 for _, w, r in targets) or len({s for s, _, _ in targets}) < len(targets):
        raise ValueError("targets need distinct sources, weights and repeats of 0 or more")
    spark = documents.sparkSession
    weights, repeats = {s: float(w) for s, w, _ in targets}, {s: int(r) for s, _, r in targets}
    open_ = [s for s in weights if weights[s] > 0 and repeats[s] > 0]
    listed = F.array(*(F.lit(s) for s in open_)).cast("array<string>")
    base = documents.select(
        F.col(id).alias("id"), F.col(size).cast("long").alias("tokens"),
        F.array_join(F.array_sort(F.array_intersect(listed, F.col(sources))), _SEPARATOR).alias("pattern"),
        F.xxhash64(F.col(id), F.lit(seed)).alias("h"),
    ).filter((F.col("tokens") > 0) & (F.col("pattern") != ""))
    found = base.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"), F.count(F.lit(1)).alias("n")).limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} membership patterns")
    patterns = {tuple(r["pattern"].split(_SEPARATOR)): r["tokens"] for r in found}
    largest = {tuple(r["pattern"].split(_SEPARATOR)): r["largest"] for r in found}
    have = [s for s in open_ if any(s in p for p in patterns)]
    whole, all_ = sum(weights[s] for s in have), sum(weights.values())
    amount = feasible_total(patterns, {s: weights[s] for s in have}, repeats) if total is None else total
    quotas = {s: int(amount * weights[s] / whole) for s in have}
    flows = route(patterns, quotas, repeats)

    arcs, start = [], {p: 0 for p in patterns}
    for (p, s), n in sorted(flows.items()):
        arcs.append((_SEPARATOR.join(p), s, start[p], n, patterns[p]))
        start[p] = (start[p] + n) % patterns[p]
    arcs_df = spark.createDataFrame(arcs, "pattern string, source string, start bigint, arc bigint, whole bigint")

    buckets = max(1, -(-sum(r["n"] for r in found) // bucket_documents))
    spread = base.withColumn("bucket", F.floor((F.shiftrightunsigned("h", 33)) * F.lit(buckets) / F.lit(1 << 31)))
    sums = spread.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("filled"))
    offsets = sums.withColumn("before", F.coalesce(F.sum("filled").over(W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("filled")
    inside = W.partitionBy("pattern", "bucket").orderBy("h", "id", "tokens")
    running = spread.withColumn("upto", F.sum("tokens").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    placed = running.join(broadcast_if_small(offsets), ["pattern", "bucket"]).select("id", "pattern", "tokens", (F.col("before") + F.col("upto") - F.col("tokens") / 2.0).alias("middle"))
    uses = F.ceil((F.col("start") + F.col("arc") - F.col("middle")) / F.col("whole")) - F.ceil((F.col("start") - F.col("middle")) / F.col("whole"))
    chosen = placed.join(broadcast_if_small(arcs_df), "pattern").select(F.col("id").alias(id), "source", uses.cast("int").alias("uses"), "tokens").filter(F.col("uses") > 0)

    available = {s: sum(n for p, n in patterns.items() if s in p) for s in weights}
    plan = spark.createDataFrame([(s, weights[s] / all_ if all_ else None, quotas.get(s, 0), available[s], sum(largest[p] for p, t in flows if t == s)) for s in weights], "source string, target_share double, target_tokens bigint, available_tokens bigint, within_tokens bigint")
    reached = chosen.groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("reached_tokens"), F.count(F.lit(1)).alias("chosen"), F.max("uses").alias("most_uses"))
    shares = plan.join(reached, "source", "left").na.fill(0, ["reached_tokens", "chosen", "most_uses"])
    return chosen, shares.withColumn("reached_share", F.try_divide(F.col("reached_tokens").cast("double"), F.sum("reached_tokens").over(W.partitionBy())))
