import math

import numpy as np
from pyspark.sql import types as T

from chunkmill.llm import vector_dedup as V

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])


def brute(rows, cosine):
    """vec_id, n_links, component_id of every row by comparing all pairs."""
    def good(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)

    units = [np.float64(np.array(v, np.float32)) / np.linalg.norm(np.float64(np.array(v, np.float32))) if good(v) else None for _, v in rows]
    links = [[j for j, y in enumerate(units) if j != i and x is not None and y is not None and len(x) == len(y) and float(x @ y) >= cosine]
             for i, x in enumerate(units)]
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((d, len(links[i]), min(rows[j][0] for j in seen)))
    return sorted(out)


def got(spark, rows, cosine=0.95):
    df = spark.createDataFrame([(d, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for d, v in rows], SCHEMA)
    out = [tuple(r) for r in V.link(df.repartition(3), cosine).collect()]
    assert all(k == (d == c) for d, _, c, k in out)
    return sorted(r[:3] for r in out)


def test_like_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 20))
    vectors = [c + s * rng.standard_normal(20) for c in centres for s in (0, 0.1, 0.2, 0.25, 0.3, 0.35)] + list(rng.standard_normal((60, 20)))
    vectors += [vectors[0]] * 30 + [vectors[0] * 3]  # a group of copies, and one of another length
    ids = rng.permutation(len(vectors)) * 7
    rows = [(int(i), v) for i, v in zip(ids, vectors, strict=True)]
    assert got(spark, rows) == brute(rows, 0.95)
    assert got(spark, rows, 0.8) == brute(rows, 0.8)


def test_split_cells(spark, monkeypatch):
    monkeypatch.setattr(V, "TILE", 16)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16) * 0.3 + np.ones(16)) for i in range(150)]
    assert got(spark, rows) == brute(rows, 0.95)


def test_tile_holds_one_strip_of_pairs():
    """3,000 jittered copies (4.5 million links) in one tile: counts and a spanning tree, with memory far below the pairs'."""
    import tracemalloc

    import pandas as pd

    n, dim = 3000, 8
    vectors = (np.ones(dim) + 0.01 * np.random.default_rng(3).standard_normal((n, dim))).astype("<f4")
    pdf = pd.DataFrame([(side, i * 5, i % 3 + 1, v.tobytes()) for side in (0, 1) for i, v in enumerate(vectors)], columns=["side", "id", "weight", "vec"])
    run = V._tile(0.95, 0.1, {dim: V.rotation(dim)}, "<f4")
    tracemalloc.start()
    out = run((dim, 0), pdf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts, edges = out[out["id"].notna()], out[out["a"].notna()]
    weights = np.arange(n) % 3 + 1
    assert dict(zip(counts["id"].tolist(), counts["n"].tolist())) == {i * 5: int(weights.sum() - weights[i]) for i in range(n)}
    assert len(edges) == n - 1
    seen, todo, near = {0}, [0], {}
    for x, y in zip(edges["a"].tolist(), edges["b"].tolist()):
        near.setdefault(x, []).append(y)
        near.setdefault(y, []).append(x)
    while todo:
        for y in near.get(todo.pop(), ()):
            if y not in seen:
                seen.add(y)
                todo.append(y)
    assert len(seen) == n
    assert peak < 150 << 20  # a pair's two places alone, for all pairs, are 72 MB, and 250 MB more as Python numbers


def test_strips_leave_out_no_near_pair_and_most_others():
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((3000, 8)) / 8, rng.standard_normal((2500, 8)) / 8
    strips = list(V._strips(x, y, 0.12))
    assert sorted(np.concatenate([own for own, _ in strips]).tolist()) == list(range(2500)) and max(len(own) for own, _ in strips) <= 256
    got = np.zeros((2500, 3000), bool)
    for own, reach in strips:
        got[np.ix_(own, reach)] = True
    assert got[((y[:, None] - x[None]) ** 2).sum(axis=2) <= 0.12 ** 2].all() and got.mean() < 0.7
    assert [len(own) for own, _ in V._strips(np.ones((3, 8)), np.ones((600, 8)), 0.1)] == [150] * 4 and not list(V._strips(x[:0], y, 1))


def test_edges(spark):
    rows = [(1, None), (2, []), (3, [0, 0]), (4, [1, None]), (5, [1, float("nan")]), (6, [float("inf"), 1]), (7, [1, 0]), (8, [1, 0, 0]),
            (9, [2, 0]), (9, [2, 0]), (10, [0, 1]), (11, [1e-30, 0]), (12, [0, 0])]
    out = got(spark, rows)
    assert out == brute(rows, 0.95)
    assert got(spark, []) == []


def test_components_of_a_chain(spark):
    from chunkmill.llm.components import components

    links = [(i, i + 1) for i in range(100, 160)] + [(5, 7), (7, 5), (3, 3)] + [(200, 200 + i) for i in range(1, 40)]
    out = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 100 for i in range(100, 161)}, 5: 5, 7: 5, **{i: 200 for i in range(200, 240)}}


def test_rows_that_repeat_an_id_with_other_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [1.0, 0.02]), (1, [1.0, 0.0])]
    assert got(spark, rows) == brute(rows, 0.95)
    df = spark.createDataFrame([(None, [1.0, 0.0], "x", 1), (7, [1.0, 0.0], "x", 1)], SCHEMA)
    out = sorted((tuple(r) for r in V.link(df).collect()), key=str)
    assert out == sorted([(None, 0, None, True), (7, 0, 7, True)], key=str)
