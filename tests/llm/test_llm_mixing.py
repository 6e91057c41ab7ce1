import itertools

from conftest import SF001
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import documents, empty
from pyspark.sql import functions as F

from chunkmill.llm import mixing as M


def reshared(sizes, total, weights):
    """Targets by the rule's own words: share by weight, cap, share the excess among the others."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    left, open_ = total, set(range(len(sizes)))
    while left > 1e-9 and open_:
        for i in open_:
            out[i] += left * w[i] / sum(w[j] for j in open_)
        left = 0.0
        for i in list(open_):
            if out[i] >= 2 * sizes[i]:
                left += out[i] - 2 * sizes[i]
                out[i] = 2.0 * sizes[i]
                open_.discard(i)
    return out


@given(st.lists(st.integers(0, 500), min_size=1, max_size=9))
@settings(max_examples=100, deadline=None)
def test_quotas(sizes):
    got = M.quotas(sizes, sum(sizes))
    want = reshared(sizes, 1.5 * sum(sizes), M.WEIGHTS)
    assert all(abs(a - b) < 1e-6 * (1 + b) for a, b in zip(got, want, strict=True))


def brute(supply, members, demand):
    """(most tokens, least repeated tokens) over all flows of a tiny network."""
    arcs = [(p, s) for p, m in enumerate(members) for s in m]
    best = (0, 0)
    for f in itertools.product(*(range(min(2 * supply[p], demand[s]) + 1) for p, s in arcs)):
        used = [sum(x for x, a in zip(f, arcs, strict=True) if a[0] == p) for p in range(len(supply))]
        got = [sum(x for x, a in zip(f, arcs, strict=True) if a[1] == s) for s in range(len(demand))]
        if all(u <= 2 * c for u, c in zip(used, supply, strict=True)) and all(g <= d for g, d in zip(got, demand, strict=True)):
            best = max(best, (sum(f), -sum(max(0, u - c) for u, c in zip(used, supply, strict=True))))
    return best


@given(st.lists(st.integers(0, 3), min_size=3, max_size=3), st.lists(st.integers(0, 4), min_size=2, max_size=2))
@settings(max_examples=60, deadline=None)
def test_flow_is_cheapest(supply, demand):
    members = [(0,), (0, 1), (1,)]
    flow = M.min_cost_flow(supply, members, demand)
    used = [sum(f.values()) for f in flow]
    got = [sum(f.get(s, 0) for f in flow) for s in range(2)]
    assert all(u <= 2 * c for u, c in zip(used, supply, strict=True)) and all(g <= d for g, d in zip(got, demand, strict=True))
    assert (sum(used), -sum(max(0, u - c) for u, c in zip(used, supply, strict=True))) == brute(supply, members, demand)


def test_takes_come_near_targets_and_repeat(spark):
    first = {tuple(r) for r in M.query(spark, SF001).collect()}
    assert first == {tuple(r) for r in M.query(spark, SF001).collect()}
    per = {}
    for doc_id, source, size, source_size, target, taken in first:
        assert 0 <= taken <= 2 * size and (size == 0 or taken % size == 0)
        per.setdefault((source, target), []).append((size, taken))
    for (_, target), rows in per.items():
        assert abs(sum(t for _, t in rows) - target) <= max(0.02 * target, min(s for s, _ in rows if s))
    assert abs(sum(t for _, t in per) - 1.5 * sum(r[2] for r in first)) < 1


def test_overlapping_sources(spark):
    rows = [(i, "w " * (10 + i % 7), ["a", "b"] if i % 3 else ["a"]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    taken, quotas = M.mix(docs, F.col("sources"))
    assert set(quotas) == {"a", "b"}
    got = taken.agg(F.sum("taken")).first()[0]
    assert abs(got - sum(t for _, t in quotas.values())) < 0.01 * got


def test_edges(spark):
    taken, quotas = M.mix(documents(spark), F.array("source"))
    by = {(r.doc_id, r.pattern): r for r in taken.collect()}
    assert taken.count() == 10 and list(quotas)[-1] is None or None in quotas
    assert all(by[k].taken == 0 for k in by if by[k].size == 0)
    assert M.mix(empty(spark), F.array("source"))[0].count() == 0
    outside = M.mix(spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, s array<string>"), F.col("s"))[0]
    assert [r.taken for r in outside.collect()] == [0]
