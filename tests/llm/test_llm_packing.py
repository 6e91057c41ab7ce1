import zlib

import numpy as np
import public_tokenizers
from conftest import SF001
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import documents, empty
from tokenizers import Tokenizer

from chunkmill.llm import packing as P

REFERENCE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return np.array([*REFERENCE.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def verify(rows, texts):
    """Each document's ids lie in exactly one piece each; sequences are gapless; returns the share of padding."""
    todo = {d: [] for d in texts}
    for r in rows:
        todo[r.doc_id].append(r)
    for d, text in texts.items():
        want, at = ids_of(text), 0
        for r in sorted(todo[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(want[at:at + r.length].tobytes())
            at += r.length
        assert at == len(want)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    padded = sum(n if n & (n - 1) == 0 else 1024 for n in ends.values())
    assert all(n <= 1024 for n in ends.values())
    return 1 - sum(ends.values()) / padded if padded else 0


def test_given_table(spark):
    texts = dict(tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect())
    assert verify(P.query(spark, SF001).collect(), texts) < 0.01


def test_edges(spark):
    rows = P.pack_documents(documents(spark).filter("doc_id is not null and doc_id <> 5")).collect()
    verify(rows, {r.doc_id: r.text for r in documents(spark).collect() if r.doc_id not in (None, 5)})
    assert P.pack_documents(documents(spark).filter("doc_id = 5")).count() == 2 * len(P.cut(len(ids_of("der Hund und die Katze"))))
    assert P.pack_documents(empty(spark)).count() == 0


TEXT = st.text(st.sampled_from(list("ab'stZé,.1 \n\t\u00a0\u3000ß漢😀")), max_size=40)


@given(st.lists(st.one_of(TEXT, st.just("<|endoftext|>"), st.just("  two  blanks "), st.just("it's we'll")), max_size=4))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_reference_tokenizer(parts):
    text = " ".join(parts)
    assert np.frombuffer(P.encoder(P.TOKENIZER)(text), "<u4").tolist() == REFERENCE.encode(text, add_special_tokens=False).ids


@given(st.integers(1, 5000))
def test_cut(n):
    out = P.cut(n)
    assert sum(out) == n and all(x == 1024 or 1024 % x == 0 and x >= 64 for x in out[:-1]) and len(out) <= n // 1024 + 5


def test_first_fit():
    placed = P.first_fit([500, 600, 24, 400, 424], 1024)
    used = {}
    for n, (b, o) in sorted(zip([500, 600, 24, 400, 424], placed, strict=True), key=lambda x: x[1]):
        assert o == used.get(b, 0)
        used[b] = o + n
    assert sorted(used.values()) == [924, 1024]


def test_sequences(spark):
    docs = spark.createDataFrame([(1, "a b c " * 700), (2, "x")], "doc_id long, text string")
    packed = P.pack_documents(docs, with_ids=True)
    out = P.sequences(packed).collect()
    assert sum(r.n_ids for r in out) == sum(len(ids_of(t)) for t in ("a b c " * 700, "x"))
    assert all(len(r.ids) == 1024 or len(r.ids) & (len(r.ids) - 1) == 0 for r in out)
