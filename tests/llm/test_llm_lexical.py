import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import documents, empty

from chunkmill.llm import lexical_search as ls


def brute(docs, items, k=10):
    """Every document scored for every item."""
    def terms(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)

    bags = [(doc_id, Counter(t), len(t)) for doc_id, t in ((d, terms(x)) for d, x in docs)]
    n_docs, total = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, bag, n in bags:
            score = 0
            for t in set(terms(text)):
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * (100 - 90 + (90 * n * n_docs) // total)))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("seed", range(30))
def test_walk_equals_sums(seed):
    rng = np.random.default_rng(seed)
    n_docs, k = int(rng.integers(1, 400)), int(rng.integers(1, 12))
    lists, sums = [], np.zeros(n_docs, np.int64)
    for _ in range(int(rng.integers(1, 9))):
        docs = np.sort(rng.choice(n_docs, int(rng.integers(1, n_docs + 1)), replace=False))
        gain = rng.integers(0, int(rng.choice([2, 4, 1000])), len(docs)).astype(np.int64)
        lists.append(ls.Postings(docs, gain, k))
        sums[docs] += gain
    want = sorted((-s, d) for d, s in enumerate(sums.tolist()) if s > 0)[:k]
    for window in (1, 7, 1024):
        for share in (0, 2, 32, 10**9):  # all lists long, some short, all short
            docs, score = ls.top_documents(lists, n_docs, k, window, share)
            assert [(-s, d) for d, s in zip(docs.tolist(), score.tolist(), strict=True)] == want


def corpus(rng, n):
    words = [f"w{i}" for i in range(60)] + ["the", "The", "é", "straße", "İx"]
    weights = [1 / (i + 1) for i in range(len(words))]
    out = []
    for i in range(n):
        text = " ".join(rng.choices(words, weights, k=rng.randrange(0, 40))) + rng.choice(["", ".", "\n", "_a-b~c"])
        out.append((rng.choice([i, i // 3, None]) if i % 7 == 0 else i, rng.choice([text] * 9 + [None])))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = corpus(rng, 400)
    items = [(i // 2, t) for i, (_, t) in enumerate(corpus(rng, 25))] + [(99, "nowhere"), (None, "the w3")]
    index = ls.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), segment_bytes=2000, segment_rows=30)
    assert index.select("segment").distinct().count() > 10
    assert got(ls.search(index, spark.createDataFrame(items, "item_id long, text string"), block_items=7)) == brute(docs, items)


def test_a_term_in_every_document_and_copies(spark):
    docs = [(i % 50, "same words here") for i in range(300)] + [(1000, "same words here twice same"), (1001, "other")]
    items = [(1, "same"), (2, "other same"), (3, "twice")]
    index = ls.build_index(spark.createDataFrame(docs, "doc_id long, text string"), segment_rows=64)
    assert got(ls.search(index, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_defined_cases(spark):
    docs = documents(spark, [(20, "Wort wort " * 3, "de", "a")])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(1, "the CAT"), (2, None), (3, ""), (4, "wort Hund"), (4, "wort Hund"), (5, "\x00 . ,")]
    table = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, term string, rank int")
    assert got(ls.search(ls.build_index(docs), table)) == brute(rows, items)
    assert got(ls.search(ls.build_index(empty(spark)), table)) == []
    assert got(ls.search(ls.build_index(docs), table.limit(0))) == []
    names = spark.createDataFrame([("a", "cat")], "item_id string, text string")
    assert [r["item_id"] for r in ls.search(ls.build_index(docs), names).collect()] == ["a"] * 2
