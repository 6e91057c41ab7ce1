"""Mixing sources to target weights as a min-cost flow.

Documents are summed by membership pattern (the set of sources they belong to). A flow routes the
patterns' tokens to the sources' quotas; the first pass over a pattern is free, every repetition
costs more than the one before (convex), so the flow repeats text only where a quota can't be met
otherwise. The driver solves the flow over patterns and sources (a documented bound; documents
never leave the executors). Then each pattern's documents are chosen by a seeded hash until its
flow is taken: whole hash buckets below the cut, then documents in order, the last few of them so
that the words taken come as near to the flow as whole documents can.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a document
in no source is never taken; documents of size 0 are taken 0 times; rows that repeat an id are
documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, WHITE_CLASS, stored

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
SHARE = (3, 2)  # 150 % of all sizes, as a fraction
MAX_EPOCHS = 2
SEED = 20260101
BUCKETS = 4096
AROUND = 64  # documents on either side of the cut that are chosen for the closest sum
MOST_WORDS = 4_000_000  # of those documents; with longer ones, fewer take part
MAX_PATTERNS = 100_000  # rows that the driver solves; more is an error


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WHITE_CLASS + "+"))).cast("long")


def quotas(sizes: list[int], total: int, weights=WEIGHTS, share=SHARE, cap: int = MAX_EPOCHS) -> list[float]:
    """Targets: the share of ``total`` split by weight; what exceeds ``cap`` times a source's size is shared
    again among the others by weight, until none is above. (Sources fill up in the order of size
    over weight; the rest have one common level per weight.)"""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    left, rest = total * share[0] / share[1], sum(w)
    for i in sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / w[i], i)):
        out[i] = float(min(cap * sizes[i], w[i] * left / rest))
        left, rest = left - out[i], rest - w[i]
    return out


def min_cost_flow(supply: list[int], members: list[tuple[int, ...]], demand: list[int],
                  epochs: int = MAX_EPOCHS) -> list[dict[int, int]]:
    """Tokens that each pattern gives to each of its sources.

    Network: origin -> pattern (``supply`` per epoch, each epoch dearer than the one before) ->
    its sources -> end (``demand``). Costs lie on the first arcs only, so successive shortest paths means:
    open one epoch after the other and augment until no path is left."""
    n, m = len(supply), len(demand)
    flow: list[dict[int, int]] = [dict.fromkeys(x, 0) for x in members]
    givers: list[set[int]] = [set() for _ in range(m)]
    used, got = [0] * n, [0] * m
    for epoch in range(1, epochs + 1):
        for p in range(n):
            while used[p] < epoch * supply[p]:
                # breadth first from the pattern; backwards along flow that another pattern can take back
                came: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None}
                queue, goal = deque([("p", p)]), None
                while queue and goal is None:
                    kind, x = queue.popleft()
                    if kind == "p":
                        for s in members[x]:
                            if ("s", s) not in came:
                                came["s", s] = (kind, x)
                                queue.append(("s", s))
                                if got[s] < demand[s]:
                                    goal = ("s", s)
                                    break
                    else:
                        for o in givers[x]:
                            if ("p", o) not in came:
                                came["p", o] = (kind, x)
                                queue.append(("p", o))
                if goal is None:
                    break
                path, at = [], goal
                while at is not None:
                    path.append(at)
                    at = came[at]
                path.reverse()  # p0 s0 p1 s1 ... goal: give along (p_i, s_i), take back along (s_i, p_i+1)
                steps = list(zip(path, path[1:], strict=False))
                amount = min([epoch * supply[p] - used[p], demand[goal[1]] - got[goal[1]],
                              *(flow[b[1]][a[1]] for a, b in steps if a[0] == "s")])
                for a, b in steps:
                    q, s, d = (a[1], b[1], amount) if a[0] == "p" else (b[1], a[1], -amount)
                    flow[q][s] += d
                    (givers[s].add if flow[q][s] else givers[s].discard)(q)
                used[p] += amount
                got[goal[1]] += amount
    return flow


def best_subset(sizes: list[int], want: int) -> list[bool]:
    """Which of the sizes add up to the most that is not above ``want`` (sums as bits of one integer)."""
    reach, steps, limit = 1, [], (1 << (want + 1)) - 1
    for size in sizes:
        steps.append(reach)
        reach |= (reach << size) & limit
    left, out = reach.bit_length() - 1, []
    for size, before in zip(reversed(sizes), reversed(steps), strict=True):
        out.append(not before >> left & 1)
        left -= size if out[-1] else 0
    return out[::-1]


def _choose(pdf):
    """One pattern's documents around its cut, in hash order: as many as fit; the last of them and the first beyond are
    then chosen anew so that their words come nearest to what is wanted."""
    pdf = pdf.sort_values(["h", "doc_id", "size", "key"], na_position="first", kind="stable").reset_index(drop=True)
    sizes, want = pdf["size"].tolist(), int(pdf["rest"].iloc[0])
    at = total = 0
    while at < len(sizes) and total + sizes[at] <= want:
        total += sizes[at]
        at += 1
    low, high = max(0, at - AROUND), min(len(sizes), at + AROUND)
    while sum(sizes[low:high]) > MOST_WORDS and high - low > 1:
        low, high = (low + 1, high) if at - low >= high - at else (low, high - 1)
    pick = [i < low for i in range(len(sizes))]
    pick[low:high] = best_subset(sizes[low:high], want - sum(sizes[:low]))
    return pdf[["key"]].assign(pick=pick)


def take(narrow: DataFrame, flows: dict[str, tuple[int, int]]) -> DataFrame:
    """``narrow`` (key, doc_id, size, pattern, h) with ``taken`` words, for flows ``pattern -> (supply, flow)``:
    everything ``flow // supply`` times, and once more the documents that are picked for the rest."""
    spark = narrow.sparkSession
    small = lambda rows, ddl: F.broadcast(spark.createDataFrame(rows, ddl))  # noqa: E731  at most MAX_PATTERNS rows
    wants = [(p, f // s if s else 0, f % s if s else 0) for p, (s, f) in flows.items()]
    bucket = F.pmod("h", F.lit(BUCKETS))
    up_to = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = narrow.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("c"))
    sums = sums.join(small(wants, "pattern string, whole long, want long"), "pattern")
    sums = stored(sums.withColumns({"end": F.sum("n").over(up_to), "docs": F.sum("c").over(up_to)}), "buckets")
    # the bucket in which the wanted words end, and the buckets with AROUND documents on either side
    cut = sums.filter("end - n <= want and want < end").groupBy("pattern").agg(F.min(F.struct("bucket", "docs", "c")).alias("cut"))
    near = sums.join(F.broadcast(cut), "pattern").filter(
        (F.col("docs") > F.col("cut.docs") - F.col("cut.c") - AROUND) & (F.col("docs") - F.col("c") < F.col("cut.docs") + AROUND))
    zones = near.groupBy("pattern").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"),
                                        F.max(F.col("want") - F.col("end") + F.col("n")).alias("rest"))
    zones = {r["pattern"]: (r["low"], r["high"], r["rest"]) for r in zones.collect()}
    zones = small([(p, whole, *zones.get(p, (-1, -1, 0))) for p, whole, _ in wants], "pattern string, whole long, low long, high long, rest long")
    doc = narrow.join(zones, "pattern").withColumn("bucket", bucket)
    inside = F.col("bucket").between(F.col("low"), F.col("high"))
    # a zone is a 4096th of its pattern, or some hundred documents
    chosen = doc.filter(inside).select("pattern", "key", "doc_id", "size", "h", "rest").groupBy("pattern").applyInPandas(_choose, "key long, pick boolean")
    doc = doc.join(chosen, "key", "left")
    times = F.col("whole") + F.when(F.coalesce("pick", F.col("bucket") < F.col("low")), 1).otherwise(0)
    return doc.select("doc_id", "pattern", "size", (F.col("size") * times).alias("taken"))


def pattern_of(sources: Column) -> Column:
    """The distinct sources of a document as one text key; null or empty lists have none."""
    return F.when(F.size(sources) > 0, F.to_json(F.sort_array(F.array_distinct(sources))))


def mix(docs: DataFrame, sources: Column, weights=WEIGHTS, share=SHARE, epochs: int = MAX_EPOCHS, seed: int = SEED):
    """Documents (doc_id, pattern, size, taken) and the quotas ``source -> (size, target)``."""
    import json

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text").cast("string")).alias("size"),
                         pattern_of(sources).alias("pattern"))
    narrow = narrow.withColumns({"h": F.xxhash64(F.lit(seed), "doc_id"), "key": F.monotonically_increasing_id()})
    narrow = stored(narrow, "sizes")
    rows = narrow.groupBy("pattern").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: group sources first")
    supply = {r["pattern"]: int(r["n"]) for r in rows if r["pattern"] is not None}
    members = {p: json.loads(p) for p in supply}
    names = sorted({s for m in members.values() for s in m}, key=lambda s: (s is None, s or ""))
    index = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for p, m in members.items():
        for s in m:
            sizes[index[s]] += supply[p]
    targets = quotas(sizes, sum(supply.values()), weights, share, epochs)
    flow = min_cost_flow(list(supply.values()), [tuple(index[s] for s in members[p]) for p in supply],
                         [int(t + 0.5) for t in targets], epochs)
    flows = {p: (supply[p], sum(f.values())) for p, f in zip(supply, flow, strict=True)}
    outside = narrow.filter("pattern is null").select("doc_id", "pattern", "size", F.lit(0).cast("long").alias("taken"))
    taken = take(narrow.filter("pattern is not null"), flows).unionByName(outside)
    return taken, {s: (sizes[i], targets[i]) for s, i in index.items()}


def query(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    taken, shares = mix(docs, F.array(F.col("source").cast("string")))
    # one source per document: its pattern is its source
    rows = [(n, t, s) for s, (n, t) in shares.items()]
    per = spark.createDataFrame(rows, "source_size long, target double, source string")
    per = per.withColumn("pattern", pattern_of(F.array("source")))
    return taken.join(F.broadcast(per), "pattern").select("doc_id", "source", "size", "source_size", "target", "taken")
