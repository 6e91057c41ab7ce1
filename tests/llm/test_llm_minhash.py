import random
import re

import numpy as np
import pytest
from conftest import SF001
from llm_cases import documents, empty
from pyspark.sql import functions as F

from chunkmill.llm import minhash_forest as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width=2, share=80):
    sets = [shingles(t, width) for _, t in rows]
    inv = {}
    for i, s in enumerate(sets):
        for g in s:
            inv.setdefault(g, []).append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for g in s for j in inv[g] if j > i}:
            common = len(s & sets[j])
            if 100 * common >= share * (len(s) + len(sets[j]) - common) and rows[i][0] is not None and rows[j][0] is not None:
                a, b = root(i), root(j)
                parent[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df, width=2):
    out = [tuple(r) for r in M.near_duplicates(df, width).collect()]
    assert all(k == (d == c) or d is None for d, _, c, k in out)
    return sorted((r[:3] for r in out), key=str)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:3] for r in M.query(spark, SF001).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("width", [2, 5])
def test_groups_larger_than_a_region(spark, width):
    rnd = random.Random(width)
    words = [f"W{i}" for i in range(3000)]
    rows = []
    for size, change in ((150, 4), (60, 9), (10, 14), (2, 8)):
        base = [rnd.choice(words) for _ in range(120)]
        for _ in range(size):
            text = list(base)
            for _ in range(rnd.randrange(change)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append((rnd.randrange(10 ** 9), " ".join(text)))
    rows += [(rnd.randrange(10 ** 9), " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 50)))) for _ in range(150)]
    rows += [(i, t) for i, (_, t) in enumerate(rows[:100])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df, width) == brute(rows, width)


@pytest.mark.parametrize("seed", range(3))
def test_open_pairs_hold_every_link(spark, seed):
    rnd = random.Random(seed)
    base = rnd.sample(range(10 ** 6), 200)
    sets = []
    for _ in range(60):
        s = set(base[:rnd.randrange(150, 201)])
        for x in rnd.sample(sorted(s), rnd.randrange(1, 40)):
            s.remove(x)
            s.add(rnd.randrange(10 ** 6, 10 ** 6 + 300))
        sets.append(sorted(s))
    df = spark.createDataFrame([(i, np.array(s, np.uint64).tobytes()) for i, s in enumerate(sets)], "doc_id long, shingles binary")
    members = spark.createDataFrame([(i, i % 20, 1) for i in range(60)], "id long, c long, cluster long")
    found = {tuple(r) for r in M._open_pairs(members, df, 80).collect()}
    links = set()
    for i in range(60):
        for j in range(i + 1, 60):
            common = len(set(sets[i]) & set(sets[j]))
            if i % 20 != j % 20 and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                links.add((i, j))
    assert links <= found and all(i % 20 != j % 20 for i, j in found) and links


def group_near_the_threshold(changes=7, most=18):
    """300 near copies (one component) and 60 documents that are too far from them for a link; sizes differ. Ten of these have a copy."""
    rnd, base, sets = random.Random(1), list(range(1, 146)), []
    for i in range(360):
        own = changes if i < 300 else most
        sets.append(set(base) - set(rnd.sample(base, own)) | {10 ** 6 + 1000 * i + k for k in range(own + i % 10 - (5 if i < 300 else 0))})
    sets += [sets[300 + i] - {min(sets[300 + i])} | {10 ** 9 + i} for i in range(10)]
    return sets, [0] * 300 + list(range(300, 370))


def test_open_pairs_are_few_near_the_threshold(spark):
    sets, comps = group_near_the_threshold()
    df = spark.createDataFrame([(i, np.array(sorted(s), np.uint64).tobytes()) for i, s in enumerate(sets)], "doc_id long, shingles binary")
    members = spark.createDataFrame([(i, c, 1) for i, c in enumerate(comps)], "id long, c long, cluster long")
    found = {tuple(r) for r in M._open_pairs(members, df, 80).collect()}
    links = {(i, j) for i, s in enumerate(sets) for j in range(i + 1, len(sets)) if comps[i] != comps[j] and 100 * len(s & sets[j]) >= 80 * len(s | sets[j])}
    assert len(links) == 10 and links <= found and len(found) < len(sets)


def test_hubs_join_what_is_near_the_pivot(spark):
    """Documents whose slacks add up to 0 or more are linked, and with the hub, too; sizes differ."""
    rnd, base = random.Random(5), list(range(1, 151))
    sets = [set(base[:rnd.randrange(135, 151)]) - set(rnd.sample(base, rnd.randrange(12))) | set(rnd.sample(range(1000, 1400), rnd.randrange(12)))
            for _ in range(120)]
    df = spark.createDataFrame([(i, np.array(sorted(s), np.uint64).tobytes()) for i, s in enumerate(sets)], "doc_id long, shingles binary")
    members = spark.createDataFrame([(i, i, 1) for i in range(120)], "id long, c long, cluster long")
    docs = M._with_slack(M._differences(members, df), members, 80)
    slack = {r.id: r.s for r in docs.collect()}
    hubs = {tuple(r) for r in M._hub_pairs(docs).collect()}
    linked = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    assert hubs and all(linked(i, j) for i, j in hubs)
    hub = max(slack, key=lambda i: (slack[i], -i))
    sure = [(i, j) for i in range(120) for j in range(i + 1, 120) if slack[i] + slack[j] >= 0]
    reached = {x for p in hubs for x in p} | {hub}
    assert len(sure) > 1000 and all(linked(i, j) and {i, j} <= reached for i, j in sure)


def test_edges(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    out = got(documents(spark))
    want = brute(rows)
    assert [r[:2] for r in out] == [r[:2] for r in want]
    by = {r[0]: r for r in out}
    assert by[8][2] == 1 and by[2] == (2, 0, 2) and by[None][2] is None and by[7][1] == 1
    assert got(empty(spark)) == []


def test_slices_do_not_change_hashes(monkeypatch):
    text = "alpha Beta\tgamma " * 400 + "x" * 5000 + " delta"
    whole = M.word_hashes(text)
    monkeypatch.setattr(M, "SLICE", 64)
    assert M.word_hashes(text).tolist() == whole.tolist() and len(whole) == 1202
    assert M.word_hashes("ALPHA").tolist() == M.word_hashes("alpha").tolist()


def test_rows_that_repeat_an_id_with_other_texts(spark):
    rnd = random.Random(7)
    a, b = ([f"{p}{rnd.randrange(10 ** 6)}" for _ in range(100)] for p in "ab")
    change = lambda t: " ".join([*t[:-1], "other"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (2, change(a)), (3, change(b)), (5, " ".join(a)), (None, " ".join(a))]
    out = got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out == brute(rows)
    assert {(d, c) for d, _, c in out} == {(5, 2), (5, 3), (2, 2), (3, 3), (None, None)}


def test_recall_just_above_the_threshold(spark):
    """Pairs at a similarity of 0.80 to 0.82, each with its own words."""
    rnd, rows, want = random.Random(3), [], 0
    for i in range(600):
        base = [f"p{i}w{j}" for j in range(120)]
        other = list(base)
        for j in rnd.sample(range(2, 118), 6):  # 6 words changed: about 107 of 131 shingles of two words
            other[j] = f"p{i}x{j}"
        s, t = shingles(" ".join(base), 2), shingles(" ".join(other), 2)
        if 0.80 <= len(s & t) / len(s | t) <= 0.83:
            rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
            want += 1
    assert want > 300
    out = got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(d % 2 and c == d - 1 for d, _, c in out) >= 0.99 * want


def test_candidates_are_linear_in_a_large_group(spark):
    """Regions over several tasks: neighbours only, the seams too; no document of a region is lost for the closing step."""
    n = 4000
    rows = [(i, [int(k) for k in range(M.TREES)], [i % 7] * M.TREES, [i % 3] * M.TREES) for i in range(n)]
    reps = spark.createDataFrame(rows, "id long, keys array<long>, next1 array<int>, next2 array<int>").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs, large = M._candidates(reps)
        assert pairs.count() <= n * M.TREES
        assert large.count() == n * M.TREES
        near = pairs.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in near:
        parent[root(r.a)] = root(r.b)
    assert len({root(i) for i in range(n)}) == 1


def test_small_regions_at_the_ends_of_a_task(spark):
    batches = [[(1, 10), (1, 11)], [(1, 12), (2, 5), (3, 6), (3, 7)]]
    import pyarrow as pa

    class Task:
        partitionId = staticmethod(lambda: 4)

    import pyspark

    old = pyspark.TaskContext.get
    pyspark.TaskContext.get = staticmethod(lambda: Task)
    try:
        frames = [pa.RecordBatch.from_pylist([{"key": k, "id": i} for k, i in b]) for b in batches]
        out = [tuple(r.values()) for f in M._neighbours(3)(iter(frames)) for r in f.to_pylist()]
    finally:
        pyspark.TaskContext.get = old
    assert {r[2:4] for r in out if r[0] == M.PAIR} == {(10, 11), (10, 12), (11, 12), (6, 7)}
    assert [r[:3] for r in out if r[0] == M.EDGE] == [(M.EDGE, 1, 10), (M.EDGE, 1, 11), (M.EDGE, 1, 12), (M.EDGE, 3, 6), (M.EDGE, 3, 7)]
    assert [r[:3] for r in out if r[0] in (M.FIRST, M.LAST)] == [(M.FIRST, 1, 10), (M.LAST, 3, 7)]
