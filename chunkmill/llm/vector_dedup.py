"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c are at most 2 - 2c apart in squared distance. After a rotation the
dimensions are cut into blocks of eight; in at least one block a linked pair keeps to the block's
proportional share of that budget. Each block is a range join of its own: a vector lies in one
grid cell over the block's first coordinates and asks every cell that its budget reaches. Inside a
cell, block distances are computed for blocks of vectors at a time; a pair counts in the first
block in which it keeps the budget, so the union of the blocks needs no distinct. Pairs are then
confirmed by their exact cosine in double precision.

Equal vectors are one class from the start (counted, not expanded). Cells with many vectors are
split into tiles of bounded size, both sides replicated over the other's tiles. A tile returns link
counts and a spanning forest of its links, never all pairs; it folds them in strip by strip, so it holds its
vectors and the pairs of one strip.

Defined cases: null, empty and zero vectors and those with null or non-finite components link with
nothing; vectors of different length never link; rows that repeat an id are vectors of their own
with the same id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, stored
from .components import components, smallest_ids

BLOCK = 8
TILE = 16384  # vectors of either side in one tile
SLACK = 1e-6  # widens ranges against rounding
NEAR = 1e-5  # widens the single-precision test that finds candidates; exact tests follow
SEED = 20260101


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix (made once on the driver, shipped with the job)."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int) -> list[slice]:
    return [slice(i, min(i + BLOCK, dim)) for i in range(0, dim, BLOCK)]


def grid_dims(n: int) -> int:
    """Coordinates of a block that the grid divides: more for more vectors, to keep cells small."""
    return int(min(BLOCK, max(1, round(math.log2(max(n, 1) / 4000) / 2))))


def units(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotated(unit: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row in a fixed order of sums, so that a vector's coordinates are the same in every tile."""
    out = np.empty_like(unit)
    for j in range(q.shape[1]):
        out[:, j] = (unit * q[:, j]).sum(axis=1)
    return out


def _cells(budget: float, g: int, with_vector: bool, rotations: dict[int, np.ndarray], kind: str):
    """Rows (dim, block, cell, side, id, weight, vec): the cell of each vector (side 0) and all cells in reach (side 1)."""
    def run(batches):
        import pyarrow as pa

        schema = arrow_schema("dim int, block int, cell string, side int, id long, weight long, vec binary")
        for batch in batches:
            ids, weights = batch.column("id").to_numpy(), batch.column("weight").to_numpy()
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(batch.column("embedding").value_lengths().to_numpy())
            sizes = np.diff(np.concatenate(([0], ends)))
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                raw = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
                y = units(raw) @ rotations[int(dim)]
                for b, s in enumerate(blocks(int(dim))):
                    r = math.sqrt(budget * (s.stop - s.start) / dim) + SLACK
                    lead = y[:, s][:, :g]
                    low, high = np.floor((lead - r) / (2 * r)).astype(int), np.floor((lead + r) / (2 * r)).astype(int)
                    keys = [(np.arange(len(rows)), np.zeros(len(rows), int), np.floor(lead / (2 * r)).astype(int))]
                    for corner in np.ndindex(*([2] * lead.shape[1])):  # an interval of width 2r meets at most 2 cells
                        at = low + np.array(corner)
                        ok = np.flatnonzero((at <= high).all(axis=1))
                        keys.append((ok, np.ones(len(ok), int), at[ok]))
                    i, side = np.concatenate([k[0] for k in keys]), np.concatenate([k[1] for k in keys])
                    cell = [",".join(map(str, c)) for c in np.concatenate([k[2] for k in keys]).tolist()]
                    n = len(i)
                    vec = [raw[k].tobytes() for k in i] if with_vector else [None] * n
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, dim), pa.int32()), pa.array(np.full(n, b), pa.int32()), pa.array(cell, pa.string()),
                        pa.array(side, pa.int32()), pa.array(ids[rows][i], pa.int64()), pa.array(weights[rows][i], pa.int64()),
                        pa.array(vec, pa.binary())], schema=schema)

    return run


class Forest:
    """A spanning forest of links that arrive in strips: its memory is the nodes, never the links."""

    def __init__(self, n: int):
        self.parent, self.edges = np.arange(n), []

    def roots(self, at: np.ndarray) -> np.ndarray:
        top = self.parent[at]
        while (up := self.parent[top]).tobytes() != top.tobytes():
            top = up
        self.parent[at] = top
        return top

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a[k] - b[k]: of those between two trees, each upper root takes one to its lower root, until none is left."""
        while len(a):
            p, q = self.roots(a), self.roots(b)
            apart = np.flatnonzero(p != q)
            a, b, p, q = a[apart], b[apart], p[apart], q[apart]
            high, low = np.maximum(p, q), np.minimum(p, q)
            tops, at = np.unique(high, return_index=True)
            self.parent[tops] = low[at]
            self.edges.append((a[at], b[at]))


def _strips(xb: np.ndarray, yb: np.ndarray, radius: float):
    """Strips of up to 256 rows of ``yb``, each with the rows of ``xb`` that can be within ``radius`` of one of them. Rows are halved
    along one coordinate after the other, the last ones first: the grid has divided the others already."""
    todo = [(np.arange(len(yb)), np.arange(len(xb)), 0)]
    while todo:
        own, reach, depth = todo.pop()
        if not len(reach):
            continue
        if len(own) <= 256:
            yield own, reach
            continue
        k = -1 - depth % yb.shape[1]
        own = own[np.argsort(yb[own, k], kind="stable")]
        half, at = len(own) // 2, xb[reach, k]
        todo.append((own[:half], reach[at <= yb[own[half - 1], k] + radius], depth + 1))
        todo.append((own[half:], reach[at >= yb[own[half], k] - radius], depth + 1))


def _tile(cosine: float, budget: float, rotations: dict[int, np.ndarray], kind: str):
    def run(key, pdf):
        import pandas as pd

        dim, b = int(key[0]), int(key[1])
        q, parts = rotations[dim], blocks(dim)
        limits = np.array([budget * (s.stop - s.start) / dim for s in parts])
        sides = []
        for side in (0, 1):
            own = pdf[pdf["side"] == side].sort_values("id")
            raw = np.frombuffer(b"".join(own["vec"]), kind).reshape(len(own), dim)
            sides.append((own["id"].to_numpy(), own["weight"].to_numpy(), units(raw) if len(own) else raw.astype(float)))
        (ids_d, w_d, x), (ids_q, w_q, y) = sides
        # counts and forest grow strip by strip: a node is an id of either side
        nodes = np.unique(np.concatenate((ids_d, ids_q)))
        node_d, node_q = np.searchsorted(nodes, ids_d), np.searchsorted(nodes, ids_q)
        forest, counts, linked = Forest(len(nodes)), np.zeros(len(nodes), np.int64), np.zeros(len(nodes), bool)
        if len(x) and len(y):
            at = parts[b]
            xb, yb = x @ q[:, at], y @ q[:, at]
            # |x - y|^2 as one product: (x, |x|^2, 1) times (-2y, 1, |y|^2)
            one = lambda n: np.ones((n, 1))
            xe = np.hstack((xb, (xb * xb).sum(axis=1, keepdims=True), one(len(x)))).astype(np.float32).T.copy()
            ye = np.hstack((-2 * yb, one(len(y)), (yb * yb).sum(axis=1, keepdims=True))).astype(np.float32)

            def count(ii, jj):
                """Counts the linked pairs that keep to this block's budget, and to none of an earlier block."""
                ui, pi = np.unique(ii, return_inverse=True)
                uj, pj = np.unique(jj, return_inverse=True)
                upto = q[:, :at.stop]  # later blocks don't matter
                gap = (rotated(x[ui], upto)[pi] - rotated(y[uj], upto)[pj]) ** 2
                keeps = np.stack([gap[:, s].sum(axis=1) for s in parts[:b + 1]], axis=1) <= limits[:b + 1] + 1e-9
                ok = keeps[:, b] & (keeps.argmax(axis=1) == b)
                a, b_ = node_d[ii[ok]], node_q[jj[ok]]
                np.add.at(counts, a, w_q[jj[ok]])
                np.add.at(counts, b_, w_d[ii[ok]])
                linked[a] = linked[b_] = True
                forest.add(a, b_)

            held, n_held = [], 0
            for own, reach in _strips(xb, yb, np.sqrt(limits[b] + 2 * NEAR)):
                j, i = np.divmod(np.flatnonzero(ye[own] @ xe[:, reach] <= limits[b] + NEAR), len(reach))
                i, j = reach[i], own[j]
                once = ids_q[j] > ids_d[i]
                i, j = i[once], j[once]
                for k in range(0, len(i), 100_000):
                    ii, jj = i[k:k + 100_000], j[k:k + 100_000]
                    # the exact cosine first: few candidates have it, and only those need all blocks
                    ok = (x[ii] * y[jj]).sum(axis=1) >= cosine
                    held.append((ii[ok], jj[ok]))
                    n_held += len(held[-1][0])
                    if n_held >= 10_000:
                        count(*map(np.concatenate, zip(*held, strict=True)))
                        held, n_held = [], 0
            if n_held:
                count(*map(np.concatenate, zip(*held, strict=True)))
        rows = [(k, n, None, None) for k, n in zip(nodes[linked].tolist(), counts[linked].tolist(), strict=True)]
        rows += [(None, 0, x_, y_) for a, b_ in forest.edges for x_, y_ in zip(nodes[a].tolist(), nodes[b_].tolist(), strict=True)]
        return pd.DataFrame(rows, columns=["id", "n", "a", "b"]).astype({"id": "Int64", "n": "int64", "a": "Int64", "b": "Int64"})

    return run


def _linkable(e: Column) -> Column:
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))


def link(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    budget = 2 - 2 * cosine
    kind = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))
    if kind == "<f8":
        src = src.withColumn("embedding", F.col("embedding").cast("array<double>"))
    # two 64-bit hashes stand for a vector's value; -0.0 and 0.0 hash alike
    src = src.withColumns({"ok": _linkable(F.col("embedding")), "k1": F.xxhash64("embedding"),
                           "k2": F.xxhash64(F.lit(1), "embedding")})
    # a class is a node with a number of its own: rows may repeat an id with other vectors
    classes = src.filter("ok and vec_id is not null").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "vectors")
    # one row per vector length
    shape = {r["d"]: r["n"] for r in classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    rotations, g = {d: rotation(d) for d in shape}, grid_dims(max(shape.values(), default=0))
    cols = "dim int, block int, cell string, side int, id long, weight long, vec binary"
    narrow = classes.mapInArrow(_cells(budget, g, False, rotations, kind), cols)
    tiles = narrow.groupBy("dim", "block", "cell").agg(
        F.ceil(F.sum(1 - F.col("side")) / TILE).alias("nd"), F.ceil(F.sum("side") / TILE).alias("nq")).filter("nd > 0")
    wide = classes.mapInArrow(_cells(budget, g, True, rotations, kind), cols).join(tiles, ["dim", "block", "cell"])
    own = lambda n: F.array(F.pmod(F.xxhash64("id"), n).cast("int"))
    all_ = lambda n: F.sequence(F.lit(0), n.cast("int") - 1)
    side0 = F.col("side") == 0
    wide = wide.withColumn("td", F.explode(F.when(side0, own(F.col("nd"))).otherwise(all_(F.col("nd")))))
    wide = wide.withColumn("tq", F.explode(F.when(side0, all_(F.col("nq"))).otherwise(own(F.col("nq")))))
    found = wide.select("dim", "block", "cell", "td", "tq", "side", "id", "weight", "vec").groupBy(
        "dim", "block", "cell", "td", "tq").applyInPandas(_tile(cosine, budget, rotations, kind), "id long, n long, a long, b long")
    found = stored(found, "vector-links")
    comp = components(found.filter("a is not null").select("a", "b"))
    counts = found.filter("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
    cls = smallest_ids(classes.select("k1", "k2", "id", "least", "weight"), comp).join(counts, "id", "left").select(
        "k1", "k2", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n"), "c")
    members = src.select("vec_id", "k1", "k2", (F.col("ok") & F.col("vec_id").isNotNull()).alias("ok"))
    out = members.join(cls.withColumn("ok", F.lit(True)), ["k1", "k2", "ok"], "left")
    comp_id = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"),
                      F.coalesce(F.col("vec_id") == comp_id, F.lit(True)).alias("kept"))


def query(spark, sf_dir):
    from .common import table

    return link(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
