"""Connected components of a link table, as Spark joins (alternating large and small stars)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, stored, trimmed

LOCAL = 1 << 18  # links that one task reduces at once


def _stars(batches):
    """A task's links (u, v) -> each of its nodes with the smallest one that these links reach."""
    import pyarrow as pa

    ends = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not ends:
        return
    u, v = (np.concatenate(x) for x in zip(*ends, strict=True))
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    top = np.arange(len(nodes))
    # every root next to a smaller one goes below it: at least half of those that are no component's last go each time
    while len(apart := np.flatnonzero(top[a] != top[b])):
        a, b = a[apart], b[apart]
        p, q = top[a], top[b]
        np.minimum.at(top, np.maximum(p, q), np.minimum(p, q))
        while (up := top[top]).tobytes() != top.tobytes():
            top = up
    below = np.flatnonzero(top != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[below], pa.int64()), pa.array(nodes[top[below]], pa.int64())], schema=arrow_schema("u long, v long"))


def _min_neighbour(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id): the smallest reachable id for every id of ``links``; ids without a link
    to another id are not listed.

    First each task reduces its own ``LOCAL`` links or so to stars, which ends it where one task has them all. Then each round hangs every node's larger neighbours, then its smaller ones, below the smallest node
    it knows, until nothing changes; rounds grow with the logarithm of the longest chain. A node
    with very many links is a hot join key on one side only, which AQE splits. Every round is
    written to the shared folder, so lineage stays short."""
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    e = stored(e, "links")
    parts = max(1, -(-e.count() // LOCAL))
    e = stored(e.repartition(parts).mapInArrow(trimmed(_stars), "u long, v long"), "links")
    state = None
    while True:
        new = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() if parts > 1 else state
        if new == state:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
                e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
        state = new
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _min_neighbour(both).select("u", F.least("u", "m").alias("m"))
        e = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _min_neighbour(e)
        e = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        e = stored(e, "links")


def smallest_ids(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """``nodes`` (id, least, ...) with ``c``: the smallest ``least`` of the node's component in ``comp`` (id, component_id); nodes
    without links are their own. Nodes have numbers of their own, so rows of different content may share an outer id."""
    linked = nodes.select("id", "least").join(comp, "id")
    smallest = linked.groupBy("component_id").agg(F.min("least").alias("c"))
    return nodes.join(comp.join(smallest, "component_id").select("id", "c"), "id", "left").withColumn("c", F.coalesce("c", "least"))
