import random
import re
from collections import Counter, defaultdict

import pytest
from llm_cases import documents, empty

from chunkmill.llm import phrases


def brute_counts(rows, longest=4):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    return f, n


def brute(rows, top, least):
    out = []
    all_f, n = brute_counts(rows)
    for lang, f in all_f.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            inside = any(100 * b >= 80 * a for q, b in cand.items() if len(q) > len(p)
                         and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not inside:
                score, _, l, r = min((2000000 * a // (f[p[:i]] + f[p[i:]]), i, f[p[:i]], f[p[i:]]) for i in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "é", "straße", "x" * 5, " ", "\x00y", "w1", "w2", "w3", "w4"]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 12)):
            parts.append(rng.choice(["new york city hall", "New  York", "of the", " ".join(rng.choices(words, k=rng.randrange(1, 6)))]))
            parts.append(rng.choice([" ", "\t", ". ", "\n", ",", "\u0085", "\x0b"]))
        out.append((i if i % 9 else None, rng.choice(["en", "de", None]), "".join(parts) if i % 11 else None))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


# a small sample, an overfull bitmap and small chunks: border failures, false hits, sums over tasks
@pytest.mark.parametrize("seed,how", [(0, {}), (1, {"sample_share": 40}), (2, {"sample_share": 300, "chunk_bytes": 500}), (3, {"most_bits": 64}),
                                      (4, {"sample_share": 1, "slack": 1.0})])
def test_equals_brute_force(spark, seed, how):
    rows = corpus(seed)
    want = brute([r[1:] for r in rows], 40, 5)
    assert got(phrases.top_collocations(table(spark, rows).repartition(3), top=40, least=5, **how)) == want
    counts, totals, missed = phrases.mine(table(spark, rows), least=5, **how)
    f, n = brute_counts([r[1:] for r in rows])
    assert sorted(tuple(r) for r in counts.select("lang", "phrase", "n").collect()) == sorted(
        (lang, " ".join(p), a) for lang, c in f.items() for p, a in c.items() if a >= 5)
    assert {r["lang"]: r["n"] for r in totals.collect()} == n
    assert missed[-1] == 0 and len(missed) <= 4
    if how.get("sample_share", 1) >= 40:
        assert len(missed) > 1


def test_failures_at_every_length(spark):
    """A sample without documents proposes nothing: words, pairs and triples each fail in turn."""
    rows = [(1, "en", "a b c d. " * 20), (1, "en", "b c d e")]
    counts, _, missed = phrases.mine(table(spark, rows), least=10, sample_share=10**9)
    assert len(missed) == 4 and missed[-1] == 0 and all(missed[:-1])
    assert counts.filter("phrase = 'a b c d'").first()["n"] == 20
    assert counts.filter("phrase = 'b c d'").first()["n"] == 21


def test_large_products(spark):
    big = 3 * 10**13
    counts = spark.createDataFrame([("en", 1, "x", big), ("en", 1, "y", big + 1), ("en", 2, "x y", big)], "lang string, k int, phrase string, n long")
    row = phrases.collocations(counts).first()
    assert row["score"] == 2000000 * big // (2 * big + 1) and row["a"] == big


def test_defined_cases(spark):
    docs = documents(spark)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert got(phrases.top_collocations(docs, top=10, least=2)) == brute(rows, 10, 2)
    assert got(phrases.top_collocations(empty(spark))) == []
