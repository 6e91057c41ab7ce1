"""Harmonic packing of tokenised documents into fixed-length sequences.

A document's ids (and one end id) are cut into full sequences and the binary places of the rest,
down to 64 ids, plus one tail below 64. A piece of length ``n`` belongs to the reciprocal-capacity
class ``k = capacity // n``: bins of class ``k`` take exactly ``k`` pieces of one length. Tasks number
their pieces per class on their own; one prefix sum over (task, class) counts turns the local
numbers into global ones, and bin and offset follow by arithmetic, without moving a token. Only
what is left over when a class's last bin stays open (fewer than ``k`` pieces per class, some
5,000 in all, whatever the input) is packed first-fit in one task.

Sequences are padded to the capacity unless their length is a power of two.

Defined cases: null text is an empty document (the end id alone); repeated rows are packed each
for itself; an empty table gives no pieces; other columns are ignored. A text is tokenised whole, in
one worker; memory follows the longest text of a batch.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, stored, trimmed

CAPACITY = 1024
SMALLEST = 64  # binary places below this stay together as one tail
END_ID = 0
TOKENIZER = "byte_bpe_50k"
CACHED_WORDS = 250_000  # a worker's cache of word ids is emptied beyond this

_AFTER_SPACE = re.compile(r"\s ")


class WordIds(dict):
    """Ids (little-endian unsigned 32-bit) of words that follow a blank, computed once per word.

    In this vocabulary's word pattern no token goes across "non-space, blank", so a text whose
    blanks all follow a non-space is tokenised word by word with the same ids as whole."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = ids = self.encode(" " + word)
        return ids


_ENCODERS: dict = {}


def encoder(name: str):
    """``text -> ids as little-endian unsigned 32-bit bytes``, built once per Python worker."""
    if name in _ENCODERS:
        return _ENCODERS[name]
    import base64
    from array import array

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    specials = [t.content for t in reference.get_added_tokens_decoder().values()]
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # the same vocabulary and merges in a faster library; texts that hold a special token's name go
    # to the first library, which maps it to its id
    plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = WordIds(lambda w: array("I", plain.encode_ordinary(w)).tobytes())

    def encode(text: str) -> bytes:
        if any(s in text for s in specials):
            return array("I", reference.encode(text, add_special_tokens=False).ids).tobytes()
        if _AFTER_SPACE.search(text):
            return array("I", plain.encode_ordinary(text)).tobytes()
        first, *rest = text.split(" ")
        head = array("I", plain.encode_ordinary(first)).tobytes()
        return head + b"".join([words[w] for w in rest])

    encode.words = words
    _ENCODERS[name] = encode
    return encode


def cut(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Piece lengths of a document of ``n`` ids, in order."""
    out, rest, place = [capacity] * (n // capacity), n % capacity, capacity >> 1
    while place >= smallest:
        if rest & place:
            out.append(place)
        place >>= 1
    return [*out, rest % smallest] if rest % smallest else out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, local_rank long, ids binary"


def _tokenise(name: str, capacity: int, with_ids: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode, task, ranks = encoder(name), TaskContext.get().partitionId(), {}
        end = END_ID.to_bytes(4, "little")
        schema = arrow_schema(_PIECES)
        for batch in batches:
            cols: list[list] = [[] for _ in schema.names]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = (encode(text.as_py()) if text.is_valid else b"") + end
                total, start = len(ids) // 4, 0
                for n in cut(total, capacity):
                    piece = ids[4 * start:4 * (start + n)]
                    rank = ranks[n] = ranks.get(n, -1) + 1
                    for c, v in zip(cols, (doc_id, start, n, zlib.crc32(piece), total, task, rank,
                                           piece if with_ids else None), strict=True):
                        c.append(v)
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
        encode.words.clear()  # an idle worker holds no cache

    return run


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Cut every document; written once, so that the counting and the numbering pass see the same
    tasks and ranks. ``with_ids`` keeps each piece's ids (little-endian unsigned 32-bit)."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(src.mapInArrow(trimmed(_tokenise(tokenizer, capacity, with_ids)), _PIECES), "pieces")


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, longest first into the first bin with room."""
    bins: list[int] = []
    out: list = [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, used in enumerate(bins) if used + lengths[i] <= capacity), len(bins))
        if b == len(bins):
            bins.append(0)
        out[i] = (b, bins[b])
        bins[b] += lengths[i]
    return out


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset of every piece."""
    counts = cut_pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = F.expr(f"{capacity} div length")
    offsets = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # one row per piece length: at most 68
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n_length")).withColumn("bins", F.floor(F.col("n_length") / per_bin))
    first_bin = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    lengths = lengths.withColumn("first_bin", F.coalesce(F.sum("bins").over(first_bin), F.lit(0)))
    lengths = lengths.withColumn("all_bins", F.sum("bins").over(Window.partitionBy()))
    at = offsets.join(lengths.drop("n_length"), "length")
    numbered = cut_pieces.join(at, ["length", "task"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    bin_ = F.expr("rank div per_bin")
    numbered = numbered.withColumn("per_bin", per_bin).withColumn("bin", bin_)
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    full = numbered.filter(F.col("bin") < F.col("bins")).select(
        *keep, (F.col("first_bin") + F.col("bin")).cast("long").alias("sequence_id"),
        ((F.col("rank") % F.col("per_bin")) * F.col("length")).cast("long").alias("offset"))
    # fewer than capacity / length pieces per length: bounded whatever the input
    open_ = numbered.filter(F.col("bin") >= F.col("bins")).select(*keep, "rank", "all_bins")

    def fill(pdf):
        pdf = pdf.sort_values(["length", "rank"], kind="stable").reset_index(drop=True)
        placed = first_fit(pdf["length"].tolist(), capacity)
        pdf["sequence_id"] = [p[0] for p in placed] + pdf["all_bins"]
        pdf["offset"] = [p[1] for p in placed]
        return pdf.drop(columns=["rank", "all_bins"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long"
    rest = open_.groupBy("all_bins").applyInPandas(fill, schema)
    return full.unionByName(rest.select(full.columns))


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = END_ID) -> DataFrame:
    """The training sequences of pieces that kept their ids: ids in offset order, padded to the
    capacity unless the length is a power of two."""
    import numpy as np

    def build(pdf):
        import pandas as pd

        pdf = pdf.sort_values("offset")
        ids = np.frombuffer(b"".join(pdf["ids"]), "<u4").astype("int32")
        n = len(ids) if len(ids) & (len(ids) - 1) == 0 else capacity
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "n_ids": [len(ids)],
                             "ids": [np.pad(ids, (0, n - len(ids)), constant_values=pad_id)]})

    return packed.groupBy("sequence_id").applyInPandas(build, "sequence_id long, n_ids long, ids array<int>")


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    out = pack(pieces(docs, tokenizer, capacity, with_ids), capacity)
    return out if with_ids else out.drop("ids")


def query(spark, sf_dir):
    from .common import table

    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
