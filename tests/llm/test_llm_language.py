from collections import Counter

from conftest import SF01
from llm_cases import documents, empty
from pyspark.sql import functions as F

from chunkmill.llm import language as L


def grams(text):
    out = Counter()
    text = "".join(c if c.isalpha() else " " for c in text.lower())
    for w in text.split():
        out.update(w)
    line = " " + " ".join(text.split()) + " "
    for k in range(len(line) - 1):
        out[line[k:k + 2]] += 1
    for k in range(len(line) - 2):
        if line[k + 1] != " ":
            out[line[k:k + 3]] += 1
    return out


def code(g):
    x = 0
    for c in g:
        x = x << 21 | (L.GAP if c == " " else ord(c))
    return x


def top(counts, size):
    return sorted(((code(g), n) for g, n in counts.items()), key=lambda t: (-t[1], t[0]))[:size]


def test_profiles_and_distance_like_brute_force(spark):
    docs = [("en", "The cat sat. The dog ran!"), ("de", "Der Hund läuft, die Katze schläft"), ("en", "a dog and a cat")]
    model = L.fit(spark.createDataFrame(docs, "lang string, text string"), size=40)
    want = {x: [c for c, _ in top(sum((grams(t + "\n") for y, t in docs if y == x), Counter()), 40)] for x in ("de", "en")}
    for i, x in enumerate(model.langs):
        have = sorted((r, c) for c, r in zip(model.codes.tolist(), model.ranks[i].tolist(), strict=True) if r >= 0)
        assert [c for _, c in have] == want[x]
    text = "Die Katze und the dog"
    mine = [c for c, _ in top(grams(text), 40)]
    apart = {x: sum(abs(r - want[x].index(c)) if c in want[x] else 40 for r, c in enumerate(mine)) for x in want}
    lang, score = model.predict(text)
    assert lang == min(apart, key=apart.get) and abs(score - (1 - apart[lang] / (40 * len(mine)))) < 1e-12


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    out = L.query(spark, SF01).filter("held_out").join(truth, "doc_id")
    right, n = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right >= 0.99 * n


def test_blocks_do_not_change_counts(monkeypatch):
    text = "eine kleine Nachtmusik und " * 50
    whole = L.ngrams(text)
    monkeypatch.setattr(L, "BLOCK_CHARS", 100)
    parts = L.ngrams(text)
    assert whole[0].tolist() == parts[0].tolist() and abs(int(whole[1].sum()) - int(parts[1].sum())) <= 40


def test_edges(spark):
    out = {r.doc_id: r for r in L.identify(documents(spark)).collect()}
    assert (out[2].lang_pred, out[2].score) == ("und", 0.0) == (out[4].lang_pred, out[4].score) == (out[3].lang_pred, out[3].score)
    assert L.identify(documents(spark)).count() == 10
    assert L.identify(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.identify(nothing).collect()] == ["und"]
