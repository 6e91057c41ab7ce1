import functools
import hashlib
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import documents, empty

from chunkmill.llm import bpe_codec


@functools.cache
def load_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bpe_codec.TOKENIZER))


@pytest.fixture(scope="module")
def library():
    return load_library()


def ids(text):
    return np.frombuffer(bpe_codec.built(bpe_codec.Encoder).encode(text), "<u4").tolist()


def back(got):
    return bpe_codec.built(bpe_codec.Decoder).decode(np.array(got, "i8"))


def same(library, text):
    got = ids(text)
    assert got == library.encode(text, add_special_tokens=False).ids
    assert back(got) == library.decode(got, skip_special_tokens=False)


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(), st.text("ab \n'"), st.text("thenigrso .,<|endoftext|>"), st.text("aeioué中\U0001f600́   \x85")))
def test_generated_texts(text):
    same(load_library(), text)


def test_every_code_point(library):
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 5000):
        part = points[a:a + 5000]
        for text in ("".join(part), " ".join(part), "x".join(part), "1 " .join(part)):
            same(library, text)


def test_every_token_and_words(library):
    texts = [library.decode([t]) for t in range(library.get_vocab_size())]
    for text in texts:
        assert ids(text) == library.encode(text, add_special_tokens=False).ids
    same(library, "".join(texts))


def test_special_tokens_long_runs_and_spaces(library):
    for text in ("<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", " <|endoftext|", "a" * 100_000, "ab" * 50_000, " " * 5000 + "x",
                 "x \n y", "x\n\n  y ", "\t \t", "don't we'll I'D  it's", "é" * 20_000, "the" * 30_000, "0123456789" * 3000,
                 " “the” heron’s neck – über 中文 中文 x\n\u2003y\n", "中 a 中", "a \U0001f600b", "’s it’s 's", "heron\n’ \u00a0 the"):
        same(library, text)


def test_pieces_longer_than_a_scan(library):
    reach = bpe_codec.SCANNED_TOKENS * bpe_codec.built(bpe_codec.Encoder).longest
    for n in range(reach - 3, reach + 4):
        for word in ("a", "the", "tion", "oré", "=", "-=", "heron"):
            same(library, word * (n // len(word)) + "x" * (n % len(word)))


def test_a_scan_starts_where_it_is_needed(library):
    class Counted:
        looked = 0

        def __init__(self, own):
            self.own = own

        def __getattr__(self, name):
            def scan(piece):
                for match in getattr(self.own, name)(piece):
                    self.looked += 1
                    yield match
            return scan

    own = bpe_codec.built(bpe_codec.Encoder)
    automaton, own.automaton = own.automaton, Counted(own.automaton)
    try:
        tokens = 0
        for word in (" thenthan", " anedoron", " heersh", " eleentionanle", " whbleononshtheningor"):
            got = own._piece(word)
            assert got == library.encode(word, add_special_tokens=False).ids
            tokens += len(got)
        looked = own.automaton.looked
    finally:
        own.automaton = automaton
    assert looked <= 2 * tokens  # not every token at every byte


def test_frequent_keys_stay_cached():
    made = []
    cache = bpe_codec.Cache(lambda key: made.append(key) or key, 20)
    for word in (f"rare{i}" for i in range(1000)):
        assert cache["often"] == "often" and cache[word] == word
        assert len(cache) + len(cache.before) <= 20
    assert made.count("often") == 1 and len(made) == 1001


def test_unknown_ids_and_bytes():
    assert back([10**6, -1]) == ""
    own = bpe_codec.built(bpe_codec.Decoder)
    lead = next(t for t in range(256) if own.blob[own.offsets[t]] == 0xC3)
    assert back([lead]) == "\N{REPLACEMENT CHARACTER}"


def digests(library, rows):
    out = []
    for doc_id, text in rows:
        got = library.encode(text or "", add_special_tokens=False).ids
        text = library.decode(got, skip_special_tokens=False)
        out.append((doc_id, len(got), hashlib.sha256(",".join(map(str, got)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_defined_cases(spark, library):
    docs = documents(spark, [(11, "a<|endoftext|>b  c", "en", "a"), (12, "über\x00 \U0001f600", "de", None)])
    docs = docs.withColumn("ids", docs["n"])
    got = bpe_codec.decode(bpe_codec.encode(docs))
    assert got.columns == ["doc_id", "ids", "text"]
    want = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got.collect():
        assert r["text"] == want[r["doc_id"]]
        assert r["ids"] == library.encode(want[r["doc_id"]], add_special_tokens=False).ids
    assert got.count() == docs.count()
    assert bpe_codec.decode(bpe_codec.encode(empty(spark))).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [tuple(r) for r in bpe_codec.decode(nothing).orderBy("doc_id").collect()] == [(1, None, None), (2, [], "")]


def test_batches_leave_in_parts(spark, library):
    n = 2 * bpe_codec.ROWS + 1  # in one Arrow batch
    docs = spark.range(n).selectExpr("id doc_id", "if(id % 7 = 0, null, concat('the ', id, ' heron')) text").coalesce(1)
    encoded = bpe_codec.encode(docs)
    got = bpe_codec.decode(encoded).collect()
    assert [r["doc_id"] for r in got] == list(range(n))
    for r in got:
        text = f"the {r['doc_id']} heron" if r["doc_id"] % 7 else ""
        assert r["text"] == text and r["ids"] == library.encode(text, add_special_tokens=False).ids
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"a": list(range(n))})
    assert [b.num_rows for b in bpe_codec.parts([batch])] == [bpe_codec.ROWS, bpe_codec.ROWS, 1]


def test_query_equals_the_library(spark, library):
    from conftest import SF001

    got = sorted((tuple(r) for r in bpe_codec.query(spark, SF001).collect()), key=str)
    assert got == digests(library, [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()])


def test_refuses_other_vocabularies():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe_codec.Encoder(public_tokenizers.path("word_bpe_49k.json"))
