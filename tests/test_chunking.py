import hashlib

import numpy as np
import regex
from pyspark.sql import functions as F

from brute import recursive_split, semantic_split, window_split
from chunkmill.operators.chunking import (MEASURES, chunk_with, explode_chunks, hashed_embedding, measured_chunks,
                                          measured_windows, paragraph_chunks, recursive_chunks, semantic_chunks, sparse_unit,
                                          split_sentences, token_buckets, window_chunks)

SF001 = "/root/testdata/sf0.001"
LITERALS = ["", "   ", "abc", "a\n\nb\n\nc", "This is a test document. " * 100, "x" * 1300,
            ("word " * 300) + "\n\n" + ("y" * 700), "p1 line\nline two. sentence three\n\n" * 40, "a. " * 400,
            "\n\n\n\nhello\n\n\n", "héllo wörld 😀 " * 80, " lead and trail　", "One. Two? Three! Four."]


def _texts(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    lits = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(LITERALS)], "doc_id long, text string")
    return docs.unionByName(lits)


def test_recursive_matches_brute_force(spark):
    df = _texts(spark)
    for size, ov in [(512, 50), (1000, 100), (100, 20), (64, 0)]:
        rows = df.select("text", recursive_chunks("text", size, ov).alias("c")).collect()
        for r in rows:
            assert list(r.c) == recursive_split(r.text, size, ov), (size, ov, r.text[:60])


def test_recursive_invariants(spark):
    rows = _texts(spark).select("text", recursive_chunks("text", 300, 30).alias("c")).collect()
    for r in rows:
        assert all(0 < len(c) <= 300 for c in r.c)
        # no non-blank character is lost: chunks appear in order in the text
        pos = 0
        for c in r.c:
            found = r.text.find(c[: min(len(c), 20)], max(0, pos - 300))
            assert found >= 0
            pos = found


def test_window_matches_brute_force(spark):
    rows = _texts(spark).select("text", window_chunks("text", 200, 50).alias("w")).collect()
    for r in rows:
        assert list(r.w) == window_split(r.text, 200, 50)


def _py_embed(text, dim=64):
    toks = [w for w in regex.split(r"[^\p{L}\p{N}_]+", text.lower()) if w]
    v = np.zeros(dim)
    for w in toks:
        v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def test_hashed_embedding_matches_python(spark):
    rows = _texts(spark).select("text", hashed_embedding("text").alias("v")).collect()
    for r in rows[:60]:
        assert np.allclose(np.asarray(r.v), _py_embed(r.text))


def test_semantic_matches_python(spark):
    rows = _texts(spark).select("text", semantic_chunks(F.col("text")).alias("c")).collect()
    for r in rows:
        assert list(r.c) == semantic_split(r.text, _py_embed), r.text[:80]


def test_sentences_and_paragraphs(spark):
    df = spark.createDataFrame([("A b. C d?  E!\nF", "p1\n\n\np2 \n  \n p3")], "t string, p string")
    r = df.select(split_sentences("t").alias("s"), paragraph_chunks(F.col("p")).alias("p"),
                  paragraph_chunks(F.col("t"), tokens=2).alias("k")).first()
    assert list(r.s) == ["A b.", "C d?", "E!", "F"]
    assert list(r.p) == ["p1", "p2", "p3"]
    assert list(r.k) == ["A b.", "C d?", "E! F"]


def test_explode_metadata(spark):
    df = spark.createDataFrame([("a.md", "x " * 700)], "filename string, text string")
    rows = explode_chunks(df.withColumn("chunks", window_chunks("text", 512, 50)), processed_at="t").collect()
    assert [r.chunk_index for r in rows] == [0, 1, 2]
    assert all(r.total_chunks == 3 and r.metadata.file_type == ".md" and r.metadata.source == "a.md" for r in rows)


class _FakeModel:
    def encode(self, texts):
        return [_py_embed(t) for t in texts]


def _load_fake():
    return _FakeModel()


def test_semantic_with_model_embedder(spark):
    from chunkmill.operators.chunking import pandas_embedder

    rows = _texts(spark).select("text", semantic_chunks(F.col("text"), embedder=pandas_embedder(_load_fake)).alias("c")).collect()
    for r in rows:
        assert list(r.c) == semantic_split(r.text, _py_embed), r.text[:80]


def test_recursive_custom_separators(spark):
    # no empty separator: a piece that is still too long after the last separator is kept as it is
    df = _texts(spark)
    for seps in (["\n", " "], ["\n\n", ". "], [" "]):
        rows = df.select("text", recursive_chunks("text", 120, 30, separators=seps).alias("c")).collect()
        for r in rows:
            assert list(r.c) == recursive_split(r.text, 120, 30, seps=tuple(seps)), (seps, r.text[:60])


MEASURED = {"words": lambda t: len(t.split()), "bytes": lambda t: len(t.encode()), "chars": len}


def test_measured_chunks_match_brute_force(spark):
    df = _texts(spark).unionByName(spark.createDataFrame(
        [(-100, "tab\tseparated\twords\twithout\tany\tother\tseparator " * 3), (-101, "\u3000\u3000 a\u3000b " * 30)], "doc_id long, text string"))
    for name, fn in MEASURED.items():
        for size, ov in [(40, 8), (7, 0)]:
            rows = df.select("text", measured_chunks("text", size, ov, name).alias("c")).collect()
            for r in rows:
                assert list(r.c) == recursive_split(r.text, size, ov, length=fn), (name, size, r.text[:60])


def test_measured_chunks_custom_separators(spark):
    for r in _texts(spark).select("text", measured_chunks("text", 12, 3, "words", ["\n", ". "]).alias("c")).collect():
        assert list(r.c) == recursive_split(r.text, 12, 3, seps=("\n", ". "), length=MEASURED["words"])


def test_measured_by_chars_equals_recursive(spark):
    rows = _texts(spark).select(recursive_chunks("text", 100, 20).alias("a"), measured_chunks("text", 100, 20, F.length).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_measured_windows(spark):
    rows = _texts(spark).select("text", measured_windows("text", 10, 3).alias("w")).collect()
    for r in rows:
        words, got = r.text.split(), [w.split() for w in r.w]
        want = [words[k:k + 10] for k in range(0, max(len(words) - 3, 1), 7)] if words else []
        assert got == want, r.text[:60]
        assert all(w in r.text for w in r.w)
    # the fold gives the same as the arithmetic
    rows = _texts(spark).select(measured_windows("text", 10, 3).alias("a"), measured_windows("text", 10, 3, MEASURES["words"]).alias("b")).collect()
    assert all(r.a == r.b for r in rows)
    # bytes: no window above the size, units of the size or more alone
    rows = _texts(spark).select("text", measured_windows("text", 64, 0, "bytes").alias("w")).collect()
    for r in rows:
        assert "".join("".join(r.w).split()) == "".join(r.text.split())
        assert all(len(w.encode()) <= 64 or len(w.split()) == 1 for w in r.w)


def test_measured_nulls_and_choice(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n ",), ("one two three",)], "text string")
    got = [r.c for r in chunk_with(df, "text", "recursive", "c", size=2, overlap=0, length="words").select("c").collect()]
    assert got[0] is None and got[1:] == [[], [], ["one two", "three"]]
    got = [r.c for r in chunk_with(df, "text", "window", "c", size=2, overlap=0, length="words").select("c").collect()]
    assert got[0] is None and got[1:] == [[], [], ["one two", "three"]]


def test_sparse_unit_equals_dense(spark):
    rows = _texts(spark).select(hashed_embedding("text").alias("d"), sparse_unit(token_buckets("text")).alias("s")).collect()
    for r in rows:
        dense = np.zeros(64)
        for c in r.s:
            dense[c.bucket] = c.weight
        assert [c.bucket for c in r.s] == sorted({c.bucket for c in r.s}) and np.allclose(dense, r.d)
