"""MinHash near-duplicates with an LSH forest.

Every document's shingle set gets ``TREES`` short signatures, and each tree is a sorted order of them. Documents
that share at least ``BASE`` values of a signature are a region of the order. A region of up to ``REGION`` documents is paired
completely; in a larger one each document is paired with the next one in order, its neighbour with the longest common
prefix, so the depth adapts to the region and candidates stay linear in the documents. Candidates whose sketches cannot
reach the threshold are dropped, the rest is confirmed on the full shingle sets, a spanning forest
first (each document with its most similar candidate), then every candidate whose ends are still in different
components. Finally come the regions that were too large to be paired completely and whose members
are still in different components. There, sets are compared by what they differ in from what most of their cluster holds: documents
close to it are linked with the closest one, and two others can only be linked if they share one of their
rarest differences (as many as the threshold, both sizes and both numbers of differences leave room for), so
exact candidates come from a join on those, between components only. So the limit on regions loses no link.

Documents with equal sets are one class from the start, so groups of copies never meet in a join.

Defined cases: null, empty and blank texts have no shingles and link with nothing; a text of fewer words
than a shingle is one shingle; null ids are their own component (null); rows that repeat an id are
judged by their own text; texts are taken whole, however long; of equally similar candidates the smallest
node is tried first, which changes no result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import range_partitioned
from .common import arrow_schema, stored, trimmed
from .components import components, smallest_ids

TREES, BASE, DEEPEST = 32, 4, 6  # a pair at similarity 0.8 shares no prefix of BASE values in any tree with p = 5e-8
REGION = 16
SLICE = 1 << 20  # texts are hashed in slices of about this many bytes
SLACK = 0.18  # sketches of 192 values: five standard deviations at 0.8 are 0.145

M64 = (1 << 64) - 1
_X = 0x9E3779B97F4A7C15  # odd
_XI = pow(_X, -1, 1 << 64)
_RNG = np.random.default_rng(20260101)
_A = _RNG.integers(1, M64, TREES * DEEPEST, dtype=np.uint64, endpoint=True) | np.uint64(1)
_B = _RNG.integers(0, M64, TREES * DEEPEST, dtype=np.uint64, endpoint=True)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS: dict[int, tuple] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """x^i and x^-i modulo 2^64 for i <= n."""
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _POWERS:
        steps = np.full((2, size), [[_X], [_XI]], np.uint64)
        steps[:, 0] = 1
        _POWERS[size] = tuple(np.cumprod(steps, axis=1, dtype=np.uint64))
    return _POWERS[size]


def _slice_words(raw: np.ndarray) -> np.ndarray:
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(raw))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[:len(raw)], dtype=np.uint64)))
    return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per word, in order (A-Z lower-cased)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out, at = [], 0
    while len(raw) - at > 2 * SLICE:
        cut = at + SLICE
        while cut < len(raw) and not (gaps := np.flatnonzero(_SPACE[raw[cut:cut + SLICE]])).size:
            cut += SLICE
        cut = min(len(raw), cut + (int(gaps[0]) if gaps.size else 0))
        out.append(_slice_words(raw[at:cut]))
        at = cut
    out.append(_slice_words(raw[at:]))
    return np.concatenate(out)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    w = word_hashes(text) if text else np.array([], np.uint64)
    if len(w) == 0:
        return w
    n = min(width, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mix(h * np.uint64(_X) + w[k:len(w) - n + 1 + k])
    return np.unique(h)


def _set_key(raw: bytes) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    d = hashlib.blake2b(raw, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def minhash(s: np.ndarray) -> np.ndarray:
    out = np.full(len(_A), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(s), 1024):
        out = np.minimum(out, ((s[i:i + 1024, None] * _A + _B) >> np.uint64(32)).min(axis=0))
    return out


_SKETCH = "doc_id long, text_hash long, n long, k1 long, k2 long, sketch binary, keys array<long>, next1 array<int>, next2 array<int>"


def _sketches(width: int):
    def run(batches):
        import pyarrow as pa

        schema = arrow_schema(_SKETCH)
        tree = _mix(np.arange(1, TREES + 1, dtype=np.uint64))
        for batch in batches:
            rows = []
            for doc_id, text_hash, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text"),
                                               strict=True):
                s = shingle_set(text.as_py(), width)
                row = {"doc_id": doc_id, "text_hash": text_hash, "n": len(s)}
                if len(s) and doc_id is not None:
                    k1, k2 = _set_key(s.tobytes())
                    m = minhash(s)
                    t, key = m.reshape(TREES, DEEPEST), tree
                    for k in range(BASE):
                        key = _mix(key * np.uint64(_X) + t[:, k])
                    row |= {"k1": k1, "k2": k2, "sketch": m.astype(np.uint8).tobytes(), "keys": key.astype(np.int64),
                            "next1": t[:, BASE].astype(np.uint32).view(np.int32), "next2": t[:, BASE + 1].astype(np.uint32).view(np.int32)}
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

    return run


def _sets(width: int):
    """Shingle sets of rows ``id, text``; of rows that repeat a node in one task, the first one's."""
    def run(batches):
        import pyarrow as pa

        seen = set()
        for batch in batches:
            ids, sets = [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                if i not in seen:
                    seen.add(i)
                    ids.append(i)
                    sets.append(shingle_set(text.as_py(), width).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], schema=arrow_schema("doc_id long, shingles binary"))

    return run


def _similar(least: float):
    """Pairs whose sketches agree in at least the given share of their values."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            est = (x == y).mean(axis=1) if batch.num_rows else np.array([])
            keep = pa.array(est >= least)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(est, pa.float64())], schema=arrow_schema("a long, b long, est double"))
            yield out.filter(keep)

    return run


def _linked(share: int):
    """Pairs with 100 * |intersection| >= share * |union| of their full sets."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for s, t in zip(batch.column("xa"), batch.column("xb"), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (s, t))
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * common >= share * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


_NEAR = "kind int, key long, a long, b long, task int"
PAIR, MEMBER, EDGE, FIRST, LAST = range(5)


def _neighbours(region: int):
    """One stretch of all trees' sorted signatures (key, next values, id) -> rows of five kinds: candidate pairs; members of
    regions of more than ``region`` documents; members of a smaller region at either end of the stretch, which may go on in the
    next one; the first and the last document of the stretch. Holds one region's first ``region`` documents at a time."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema, task = arrow_schema(_NEAR), TaskContext.get().partitionId()
        out: list[tuple] = []

        def pair(x, y):
            out.append((PAIR, None, min(x, y), max(x, y), None))

        def close(key, ids, large, edge):
            """The region ends: pair it completely, or, where it is large, each document with the next one in order."""
            if large or len(ids) > region:
                for x, y in zip(ids, ids[1:], strict=False):
                    pair(x, y)
                out.extend((MEMBER, key, x, None, None) for x in (ids[1:] if large else ids))
                return
            for n, x in enumerate(ids):
                for y in ids[n + 1:]:
                    pair(x, y)
            if edge:
                out.extend((EDGE, key, x, None, task) for x in ids)

        def flush():
            cols = list(zip(*out, strict=True)) or [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        key, ids, large, first = None, [], False, True
        for batch in batches:
            k, i = batch.column("key").to_numpy(), batch.column("id").to_numpy()
            if not len(k):
                continue
            if key is None:
                out.append((FIRST, int(k[0]), int(i[0]), None, task))
            cuts = np.flatnonzero(np.diff(k)) + 1
            lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(k)]])
            # whole single regions inside the batch make no pair
            for n in np.flatnonzero((hi - lo > 1) | (np.arange(len(lo)) == 0) | (np.arange(len(lo)) == len(lo) - 1)):
                now, part = int(k[lo[n]]), i[lo[n]:hi[n]].tolist()
                if key is not None and now != key:
                    close(key, ids, large, first)
                    ids, large, first = [], False, False
                key, ids = now, ids + part
                if len(ids) > region:  # large: all but the last document are done with
                    close(key, ids, large, False)
                    ids, large = ids[-1:], True
            yield flush()
        if key is not None:
            if large:
                close(key, ids, True, False)
            else:
                close(key, ids, False, True)
            out.append((LAST, key, ids[-1], None, task))
            yield flush()

    return run


def _candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of all trees, and the members (key, id) of regions too large to be paired completely.

    All trees' signatures are put into one sorted order, dealt over tasks by range, so no region is a group that one task
    must hold. A document's neighbours in the order are those with the longest common prefix: the depth
    follows the region. Candidates are linear in the documents, however large a region is."""
    rows = reps.select("id", F.explode(F.arrays_zip("keys", "next1", "next2")).alias("t"))
    order = ["key", "next1", "next2", "id"]
    rows = range_partitioned(rows.select(F.col("t.keys").alias("key"), "t.next1", "t.next2", "id"), order).select("key", "id")
    near = stored(rows.mapInArrow(_neighbours(REGION), _NEAR), "neighbours")
    # a region that goes on in the next stretch: the two documents at the seam are a pair, and its members are closed like
    # those of a large region. Two rows per task and two small regions per task.
    ends = near.filter(F.col("kind") >= FIRST)
    at = Window.orderBy("task", "kind")
    seams = ends.select("key", "a", F.lead("key").over(at).alias("next_key"), F.lead("a").over(at).alias("b"), "kind").filter(
        (F.col("kind") == LAST) & (F.col("key") == F.col("next_key")))
    seams = stored(seams.select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "seams")
    edges = near.filter(F.col("kind") == EDGE).join(F.broadcast(seams.select("key").distinct()), "key", "left_semi")  # one key per task
    pairs = near.filter(F.col("kind") == PAIR).select("a", "b").unionByName(seams.select("a", "b"))
    large = near.filter(F.col("kind") == MEMBER).unionByName(edges).select("key", F.col("a").alias("id")).distinct()
    return pairs.filter("a < b").distinct(), large


def _with_sketches(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    s = reps.select("id", "sketch")
    both = pairs.join(s.withColumnsRenamed({"id": "a", "sketch": "sa"}), "a").join(s.withColumnsRenamed({"id": "b", "sketch": "sb"}), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(trimmed(_similar(least)), "a long, b long, est double")


def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    c = comp.withColumnsRenamed({"id": "x", "component_id": "c"})
    for end in ("a", "b"):
        pairs = pairs.join(c.withColumnsRenamed({"x": end, "c": f"c{end}"}), end, "left")
    return pairs.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _mixed(members: DataFrame) -> DataFrame:
    """Members (key, id, size, c) of regions that hold more than one component."""
    keys = members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
    return members.join(keys, "key")


def _differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(cluster, id, n, diff) of members (id, cluster): a set's size and in what it differs from its cluster's pivot.

    The pivot is what more than half of the cluster's documents hold, so it is at most twice as large as their mean set. Two sets
    differ from each other exactly where their differences from the pivot do: what most documents share takes no part."""
    def tokens(batches):
        import pyarrow as pa

        schema = arrow_schema("cluster long, token long")
        for batch in batches:
            for cluster, s in zip(batch.column("cluster"), batch.column("shingles"), strict=True):
                s = np.frombuffer(s.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), cluster.as_py()), pa.int64()), pa.array(s)], schema=schema)

    def differ(batches):
        import pyarrow as pa

        schema = arrow_schema("cluster long, id long, n long, diff array<long>")
        for batch in batches:
            n, diff = [], []
            for s, pivot in zip(batch.column("shingles"), batch.column("pivot"), strict=True):
                s = np.frombuffer(s.as_buffer(), np.int64)
                n.append(len(s))
                diff.append(np.setxor1d(s, pivot.values.to_numpy()) if pivot.is_valid else s)
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("id"), pa.array(n, pa.int64()),
                                              pa.array(diff, pa.list_(pa.int64()))], schema=schema)

    rows = stored(members.select("id", "cluster").join(sets.withColumnRenamed("doc_id", "id"), "id").select("cluster", "id", "shingles"), "open-sets")
    held = rows.mapInArrow(trimmed(tokens), "cluster long, token long").groupBy("cluster", "token").agg(F.count("*").alias("held"))
    pivots = held.join(rows.groupBy("cluster").agg(F.count("*").alias("docs")), "cluster").filter("2 * held > docs")
    pivots = pivots.groupBy("cluster").agg(F.collect_list("token").alias("pivot"))
    out = rows.join(pivots, "cluster", "left").select("cluster", "id", "shingles", "pivot").mapInArrow(
        trimmed(differ), "cluster long, id long, n long, diff array<long>")
    return stored(out, "differences")


def _with_slack(docs: DataFrame, members: DataFrame, share: int) -> DataFrame:
    """``docs`` of ``_differences`` with c, d = |diff| and the slack s = (100 - share) * n - (100 + share) * d.

    Two sets are linked if (100 + share) * |their difference| <= (100 - share) * (the sum of their sizes). With k
    elements of their diffs in common this is s + s' + 2 * (100 + share) * k >= 0."""
    d = F.size("diff").cast("long")
    return docs.join(members.select("id", "c"), "id").withColumns({"d": d, "s": (100 - share) * F.col("n") - (100 + share) * d})


def _hub_pairs(docs: DataFrame) -> DataFrame:
    """Each cluster's document nearest to the pivot with those of other components that are linked with it whatever their
    diffs hold. Of two documents whose slacks add up to 0 or more, both are."""
    hubs = docs.groupBy("cluster").agg(F.max(F.struct("s", (-F.col("id")).alias("m"), "c")).alias("x"))
    both = docs.join(hubs, "cluster").filter("s + x.s >= 0 and c <> x.c").select("id", (-F.col("x.m")).alias("hub"))
    return both.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))


def _shared_shingles(docs: DataFrame, share: int) -> DataFrame:
    """(cluster, token, id, c, s, rest): elements of a document's diff, the rarest in the cluster first, that can be the first one it
    shares with a document it is linked with; ``rest`` counts the elements from there on, and is at least what the two have in common."""
    rows = docs.select("cluster", "id", F.explode("diff").alias("token"), "c")
    held = rows.groupBy("cluster", "token").agg(F.count("*").alias("held"), (F.min("c") != F.max("c")).alias("mixed"))
    # an element that only one component of the cluster holds takes its place in the order, but makes no pair
    order = rows.join(held, ["cluster", "token"]).groupBy("cluster", "id").agg(F.sort_array(F.collect_list(F.struct("held", "token", "mixed"))).alias("t"))
    best = docs.groupBy("cluster").agg(F.max("s").alias("best"))
    docs = docs.select("cluster", "id", "c", "n", "d", "s").join(order, ["cluster", "id"]).join(best, "cluster")
    t = F.transform("t", lambda x, i: F.struct((F.col("d") - i).alias("rest"), x["token"].alias("token"), x["mixed"].alias("mixed")))
    # no partner has more slack than the cluster's best one; nor, holding k elements and at most 100 / share times the size, more than that leaves
    double, most = 2 * (100 + share), (100 - share) * 100
    able = lambda x: x["mixed"] & (double * x["rest"] + F.col("s") + F.col("best") >= 0) & (
        share * ((100 + share) * x["rest"] + F.col("s")) + most * F.col("n") >= 0)
    return docs.select("cluster", "id", "c", "s", F.explode(F.filter(t, able)).alias("x")).select(
        "cluster", F.col("x.token").alias("token"), "id", "c", "s", F.col("x.rest").alias("rest"))


def _open_pairs(members: DataFrame, sets: DataFrame | None, share: int, docs: DataFrame | None = None) -> DataFrame:
    """Pairs across components (of members: id, c, cluster) that may be linked; all links are among them. ``docs``: their
    differences, if they are there already."""
    docs = _with_slack(_differences(members, sets) if docs is None else docs, members, share)
    # linked whatever they share: none is left in other components once the hubs' pairs are links
    best = docs.groupBy("cluster").agg(F.max("s").alias("best"))
    near = docs.join(best, "cluster").filter("s + best >= 0").select("cluster", "id", "c", "s")
    near = near.join(near.groupBy("cluster").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("cluster"), "cluster")
    sure = near.select("cluster", F.col("id").alias("a"), F.col("c").alias("ca"), F.col("s").alias("sa")).join(
        near.withColumnRenamed("id", "b"), "cluster").filter("a < b and c <> ca and s + sa >= 0").select("a", "b")
    key = ["cluster", "token"]
    rare = _shared_shingles(docs, share)
    # an element that only one component holds makes no pair; of the others, the largest component is one side only
    per = rare.groupBy(*key).agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.mode("c").alias("main")).filter("lo <> hi")
    rare = stored(rare.join(per.select(*key, "main"), key), "shared-shingles")
    few = rare.filter("c <> main").select(*key, F.col("id").alias("a"), F.col("c").alias("ca"), F.col("s").alias("sa"), F.col("rest").alias("ra"))
    both = few.join(rare.withColumnRenamed("id", "b"), key).filter(
        f"c <> ca and (c = main or a < b) and s + sa + {2 * (100 + share)} * least(ra, rest) >= 0")
    both = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return both.unionByName(sure).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, share: int = 80, text_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; links are pairs with 100 * |intersection| >= share * |union|. ``text_hash`` adds
    the row's xxhash64 of the text, by which rows that repeat an id are told apart."""
    if share < 80:
        raise ValueError("trees and depth are laid out for a similarity of 0.8 and more")
    least = share / 100 - SLACK
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.withColumn("text_hash", F.xxhash64("text"))  # tells rows apart that repeat an id
    sketch = stored(src.mapInArrow(trimmed(_sketches(width)), _SKETCH), "sketches")
    # a class of equal sets is a node with a number of its own: rows may repeat an id with other texts
    classes = sketch.filter("k1 is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    classes = stored(classes.select("k1", "k2", F.col("first.doc_id").alias("least"), F.col("first.text_hash").alias("text_hash"),
                                    F.monotonically_increasing_id().alias("id")), "classes")
    # one row stands for its class
    reps = sketch.join(classes.withColumnRenamed("least", "doc_id"), ["doc_id", "text_hash", "k1", "k2"]).select("id", "sketch", "keys", "next1", "next2")
    reps = stored(reps.dropDuplicates(["id"]), "reps")
    raw, large = _candidates(reps)
    raw, large = stored(raw, "candidates"), stored(large, "large-regions")
    pairs = stored(_with_sketches(raw, reps, least), "pairs")
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    wanted = wanted.unionByName(large.select("id")).distinct()

    def sets_of(ids):
        """(doc_id: the node, shingles) of the classes wanted."""
        some = classes.join(ids, "id", "left_semi").select(F.col("least").alias("doc_id"), "text_hash", "id")
        rows = src.join(some, ["doc_id", "text_hash"]).select("id", "text")
        return stored(rows.mapInArrow(trimmed(_sets(width)), "doc_id long, shingles binary"), "sets")

    def confirm(some, sets):
        both = some.join(sets.withColumnsRenamed({"doc_id": "a", "shingles": "xa"}), "a").join(
            sets.withColumnsRenamed({"doc_id": "b", "shingles": "xb"}), "b")
        return both.select("a", "b", "xa", "xb").mapInArrow(trimmed(_linked(share)), "a long, b long")

    sets = sets_of(wanted)
    forest = pairs.groupBy("b").agg(F.max(F.struct("est", (-F.col("a")).alias("m"))).alias("x")).select((-F.col("x.m")).alias("a"), "b")
    links = stored(confirm(forest, sets), "links")
    comp = components(links)

    def with_more(links, comp, more):
        """Links and components after the confirmed ones of ``more`` (the same, if there are none)."""
        more = stored(confirm(more, sets), "links")
        if more.isEmpty():
            return links, comp
        links = links.unionByName(more)
        return links, components(links)

    # a link that was tried and failed is tried again here only if its ends are still apart
    links, comp = with_more(links, comp, _across(pairs.select("a", "b"), comp))
    members = large.join(comp, "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("c"))
    members = stored(_mixed(members), "open-regions")
    if not members.isEmpty():
        clusters = components(raw).withColumnRenamed("component_id", "cluster")
        members = members.select("id", "c").distinct().join(clusters, "id")
        docs = _differences(members, sets)
        links, comp = with_more(links, comp, _hub_pairs(_with_slack(docs, members, share)))
        members = stored(members.drop("c").join(comp, "id", "left").select("id", F.coalesce("component_id", "id").alias("c"), "cluster"), "open-regions")
        late = _open_pairs(members, None, share, docs).join(pairs, ["a", "b"], "left_anti")
        links, comp = with_more(links, comp, _with_sketches(late, reps, least).select("a", "b"))
    own = smallest_ids(classes, comp).select("k1", "k2", "c")
    out = sketch.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "k1", "k2").join(own, ["k1", "k2"], "left")
    c = F.coalesce("c", "doc_id")
    return out.select("doc_id", "n_shingles", c.alias("component_id"), F.coalesce(F.col("doc_id") == c, F.lit(True)).alias("kept"),
                      *(["text_hash"] if text_hash else []))


def query(spark, sf_dir):
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), width=2)
