import hashlib
import random

import pytest
from llm_cases import documents, empty

from chunkmill.llm import suffix_dedup as S


def brute(rows):
    """doc -> (n_bytes, n_removed, n_spans, sha256) by the rule's own words; rows are (doc_id, text)."""
    first = {}
    order = lambda d: S.NO_ID if d is None else d
    raw = [(order(d), (t or "").encode()) for d, t in rows]
    for d, t in raw:
        for i in range(len(t) - 49):
            w = t[i:i + 50]
            first[w] = min(d, first.get(w, d))
    out = []
    for (d, _), (o, t) in zip(rows, raw, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i:i + 50]] < o:
                gone[i:i + 50] = b"\x01" * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in S.remove_repeats(df).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_like_brute_force(spark, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rnd.randrange(8, 40)) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [text(rnd.randrange(0, 25)) for _ in range(3)]
        if rnd.random() < 0.6:
            s = rnd.choice(shared)
            a = rnd.randrange(len(s) // 2)
            parts.insert(1, s[a:a + rnd.randrange(40, 200)])
        if rnd.random() < 0.1:
            parts.append("ab" * rnd.randrange(20, 60))
        rows.append((rnd.randrange(10 ** 12) if i else None, " ".join(parts)))
    rows += [(rows[5][0], rows[5][1]), (10 ** 13, rows[7][1]), (10 ** 13 + 1, rows[7][1][:49]), (10 ** 13 + 2, rows[8][1][3:53])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df) == brute(rows)


def test_hot_passage_and_long_text(spark):
    rnd = random.Random(9)
    passage = " ".join(str(rnd.random()) for _ in range(12))
    long = " ".join(str(rnd.random()) for _ in range(150_000))  # about 3 MB: several slices
    rows = [(i, f"{rnd.random()} {passage} {rnd.random()}") for i in range(400)] + [(1000, long), (1001, long[1_048_000:1_049_500]), (1002, "x" + long[2_000_000:2_000_060])]
    out = {r[0]: r for r in got(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))}
    want = {r[0]: r for r in brute([r for r in rows if r[0] != 1000])}
    assert all(out[i] == want[i] for i in range(400))
    assert out[1000][2] == 0 and out[1001][2] == 1500 and out[1001][3] == 1 and out[1002][2] == 60


def test_edges(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect() if r.doc_id != 7]
    assert got(documents(spark).filter("doc_id is null or doc_id <> 7")) == brute(rows)
    assert got(documents(spark).filter("doc_id = 7"))[0][2] == 0
    assert got(empty(spark)) == []


def test_cut_documents_keep_columns(spark):
    passage = "ein Absatz über mehr als fünfzig Bytes, den zwei Texte teilen, äöü"
    df = documents(spark, [(20, f"vorn {passage} hinten", "de", "a"), (21, f"anders {passage} Ende", "de", "a"), (22, passage, "de", "a")])
    out = S.cut_documents(df)
    assert out.dtypes == df.dtypes
    by = {r.doc_id: r for r in out.collect()}
    assert by[20].text == f"vorn {passage} hinten" and by[21].text == "andersEnde" and by[21].pattern == "y" and 22 not in by
    assert out.filter("doc_id = 5").count() == 2 and by[2].text in (None, "")


def test_maximal_repeats_like_brute_force():
    rnd = random.Random(3)
    for _ in range(30):
        texts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(30))).encode() for _ in range(3)]
        least, want = 4, set()
        subs = {}
        for i, t in enumerate(texts):
            for a in range(len(t)):
                for n in range(least, min(2 * least, len(t) - a) + 1):
                    subs.setdefault(t[a:a + n], []).append((i, a))
        for s, at in subs.items():
            if len(at) < 2:
                continue
            left = {texts[i][a - 1] if a else ("start", i) for i, a in at}
            right = {texts[i][a + len(s)] if a + len(s) < len(texts[i]) else ("end", i, a) for i, a in at}
            if len(left) > 1 and (len(right) > 1 or len(s) == 2 * least):
                want.add((len(s), tuple(at)))
        assert {(n, tuple(at)) for n, at in S.maximal_repeats(texts, least)} == want


def short_phrase_rows(rnd, n):
    """A 30-byte phrase in a third of the rows, with different neighbours each time; a few of the places are real repeats."""
    phrase = "Published Monday, 3 May 2021. "
    rows = [(i, f"{rnd.random()} {rnd.random()} {phrase if i % 3 == 0 else ''}{rnd.random()} {rnd.random()}") for i in range(n)]
    return rows + [(n + i, f"{rnd.random()}{rows[3 * i][1][8:8 + 60 + i]}{rnd.random()}") for i in range(20)]


def test_short_phrase_with_different_neighbours(spark, monkeypatch):
    monkeypatch.setattr(S, "SPLIT", 20)
    rows = short_phrase_rows(random.Random(4), 600)
    want = brute(rows)
    assert sum(r[2] > 0 for r in want) == 20
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want


def test_no_bucket_gets_all_contexts_of_an_anchor():
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    rows, n_buckets, split = short_phrase_rows(random.Random(6), 1500), 5, 40
    z = lambda t: len(t).to_bytes(8, "little") + pa.Codec("zstd").compress(t, asbytes=True)
    batches = {b: pd.DataFrame([(d, z(t.encode())) for d, t in rows if d % 4 == b], columns=["id", "z"]) for b in range(4)}
    asks = pd.concat([S._ask(n_buckets)((b,), docs) for b, docs in batches.items()])
    answers = pd.concat([S._answer(split)((b,), part) for b, part in asks.groupby("bucket")])
    sent = pd.concat([S._send(n_buckets)((b,), docs, answers[answers["batch"] == b]) for b, docs in batches.items()])
    for _, part in sent.groupby("bucket"):
        seen = []
        for n, offset, _, _, _, raw in (S._unpack(m, np.uint8, np.uint8, np.int32, np.int32, np.int64, np.uint8) for m in part["contexts"]):
            start = np.cumsum(n.astype(int) + S.WINDOW - 1) - (n.astype(int) + S.WINDOW - 1)
            whole = offset < S.ALONE
            assert (n[~whole] == 1).all()
            seen += [raw[i:i + S.K].tobytes() for i in (start + offset)[whole]]
        assert max(map(seen.count, set(seen)), default=0) <= split
    assert any((S._unpack(m, np.uint8, np.uint8)[1] >= S.ALONE).any() for m in sent["contexts"])


def test_null_ids_are_no_hot_batch(spark):
    """A third of the rows without an id: dealt by text too, and still without effect on each other."""
    from chunkmill.llm import suffix_dedup as S

    rows = [(None if i % 3 == 0 else i, f"row {i} " + "shared passage of more than fifty bytes in every third row " * (i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = S.remove_repeats(df)
    assert out.count() == 300 and out.filter("doc_id is null").agg({"n_removed": "sum"}).first()[0] == 0
    kept = S.cut_documents(df)
    assert kept.count() == 300


def test_anchors_like_brute_force():
    import numpy as np

    from chunkmill.llm import suffix_dedup as S

    rnd = np.random.default_rng(4)
    raw = np.concatenate([rnd.integers(97, 100, 400), np.full(120, 97), rnd.integers(0, 256, 300)]).astype(np.uint8)
    at, k = S._anchors(raw)
    high = [int(x) >> S.PLACE for x in k]
    assert at.tolist() == [min(range(i, i + S.W), key=lambda j: (high[j], j)) for i in range(len(raw) - S.WINDOW + 1)]
    # runs cover every window of every piece once, in order
    texts = [bytes(raw[:333]), b"short", bytes(raw[333:]), b"", bytes(raw[:50])]
    seen = []
    for _, d, p, h, first, n, shift in S._runs(texts):
        for i in range(len(d)):
            seen += [(int(d[i]), int(first[i] + shift[i]) + j) for j in range(n[i])]
            assert first[i] + shift[i] <= p[i] <= first[i] + shift[i] + S.W - 1
    assert seen == [(d, j) for d, t in enumerate(texts) for j in range(len(t) - S.WINDOW + 1)]
