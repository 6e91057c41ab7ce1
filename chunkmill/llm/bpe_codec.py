"""Exact byte-level BPE encoding by backtracking, and decoding by an offset table.

Encoding: a text is cut at special tokens and by the tokenizer's own pre-tokeniser. In each piece an
Aho-Corasick automaton over the vocabulary finds the longest token at a place, and then at the place where
that token ends. Tokens are chosen from left to right, the longest first; a token may follow another
only if merging by rank would really leave the two side by side (the pair-compatibility table,
filled on demand by undoing merges at the seam). Where a shorter token is taken, the automaton starts anew
behind it. Where no token fits, the last one is taken back and the
place is marked as a dead end, so every place is left at most once and time is linear in the text.

Decoding: all tokens' bytes lie in one blob; an offset table gives each id's place, and the bytes of
many ids are gathered in one vector step.

Nothing is shuffled: both directions are one pass over rows. A worker builds its tables once; its caches of
ids hold at most ``CACHED_PIECES`` pre-tokens and ``CACHED_WORDS`` words, those used last, none longer than ``LONGEST_CACHED``.

Defined cases: null text is an empty text (no ids); blank and very long texts are encoded whole, in one worker;
there are no ties, as the encoding of a text is unique; repeated rows are encoded each for itself; a null
``doc_id`` stays null; an empty table gives no rows; columns other than ``doc_id`` and ``text`` (``ids`` when
decoding) are ignored. Null ids decode to null, ids that the vocabulary doesn't hold to nothing, and bytes that
are not UTF-8 to U+FFFD, as in the tokenizer's library.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
CACHED_PIECES = 450_000  # pre-tokens whose ids a worker holds
CACHED_WORDS = 150_000  # words with other characters than _SIMPLE
CACHED_PAIRS = 300_000
LONGEST_CACHED = 64
ROWS = 1000  # rows whose ids or texts a worker holds at once
GATHERED_IDS = 1 << 18  # ids decoded in one vector step
SCANNED_TOKENS = 4  # a scan of a piece looks so many times the longest token ahead

_AFTER_SPACE = re.compile(r"\s ")
# ASCII and the Latin letters up to U+024F: character classes that no version of Unicode changes. Texts of
# these characters are pre-tokenised by a pattern (fixed by the vocabulary's kind), all others by the library.
_SIMPLE = re.compile("[\x00-\x7fÀ-ÖØ-öø-ɏ]*")
# words with other characters, and the blank before them
_OTHER_WORDS = re.compile("((?:^| )[\x00-\x1f!-\x7fÀ-ÖØ-öø-ɏ]*+[^\x00-\x7fÀ-ÖØ-öø-ɏ][^ ]*)")
_SIMPLE_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^ \t-\r0-9A-Za-zÀ-ÖØ-öø-ɏ]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")


def byte_chars() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others follow from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Cache(dict):
    """Values of ``make(key)``, at most ``most`` of them: whenever half as many keys were used since the last time,
    the others are dropped, so frequent keys stay. Long keys are never held."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most
        self.before: dict = {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_CACHED:
            if len(self) >= self.most // 2:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Automaton and merge tables of one vocabulary file (byte-level BPE without a normaliser)."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        special = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"]]
        if not plain or spec["normalizer"] or odd or model.get("ignore_merges") or special:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        at = byte_chars()
        raw = {t: bytes(at[c] for c in t).decode("latin-1") for t in model["vocab"]}  # a token's bytes, as Latin-1
        vocab = {raw[t]: i for t, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.size = size = max([*vocab.values(), *self.added.values()]) + 1
        # rank at which a token is made (-1: a byte) and the two tokens that it is made of
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.merged: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a_id, b_id, t = vocab[raw[a]], vocab[raw[b]], vocab[raw[a + b]]
            self.merged.setdefault((a_id, b_id), r)
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, a_id, b_id
        self.fits: dict[int, int] = {}
        # tokens that merging really reaches from their own bytes, in the order in which they are made
        self.known: dict[str, int] = {}
        known = self.known
        self.length, self.shorter = [0] * size, [-1] * size
        reached = [False] * size
        for token, t in sorted(vocab.items(), key=lambda kv: self.rank[kv[1]]):
            r = self.rank[t]
            if r < 0 and len(token) > 1:
                continue
            reached[t] = r < 0 or (reached[self.left[t]] and reached[self.right[t]] and self._seam(self.left[t], self.right[t], r))
            if reached[t]:
                known[token] = t
                self.length[t] = len(token)
        self.automaton = ahocorasick.Automaton()
        for token, t in known.items():
            self.shorter[t] = next((known[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in known), -1)
            self.automaton.add_word(token, t)
        self.automaton.make_automaton()
        self.longest = max(self.length)
        self.lacking = {chr(b) for b in range(256)}.difference(known)
        self.pieces = Cache(lambda piece: self._ids(self._piece(piece.encode().decode("latin-1"))), CACHED_PIECES)
        self.words = Cache(self._pieces, CACHED_WORDS)

    def _seam(self, a: int, b: int, limit: float) -> bool:
        """No merge of a rank below ``limit`` joins ``a`` and ``b``, nor any two of the parts that met at their
        seam before they were whole. The token that was made later is undone first; of two equal
        tokens that is the right one, as merging goes from left to right."""
        merged, rank = self.merged, self.rank
        while True:
            m = merged.get((a, b))
            if m is not None and m < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]
            else:
                return True

    def _fitting(self, a: int, t: int) -> int:
        """The longest token that may follow ``a`` and is ``t`` or begins it (-1: none)."""
        key = a * self.size + t
        while t >= 0 and not self._seam(a, t, float("inf")):
            t = self.shorter[t]
        if len(self.fits) >= CACHED_PAIRS:
            self.fits.clear()
        self.fits[key] = t
        return t

    def _piece(self, piece: str) -> list[int]:
        """Ids of one pre-token (its bytes, as Latin-1)."""
        if piece in self.known:  # merging reaches the token from its own bytes
            return [self.known[piece]]
        if not self.lacking.isdisjoint(piece):
            raise ValueError("the vocabulary lacks a byte")
        length, shorter, fits, size = self.length, self.shorter, self.fits, self.size
        scan, ahead = self.automaton.iter_long, SCANNED_TOKENS * self.longest
        n = len(piece)
        out: list[int] = []
        dead, at, t = bytearray(n + 1), 0, -1
        tokens, scanned = None, 0  # the longest tokens, one behind the other; up to where they are known to be the longest
        while at < n:
            if tokens is None or at > scanned:
                tokens = scan(piece[at:at + ahead])
                scanned = n if at + ahead >= n else at + ahead - self.longest
            t = next(tokens)[1]
            while True:
                if out and t >= 0:
                    fit = fits.get(out[-1] * size + t)
                    if fit is None:
                        fit = self._fitting(out[-1], t)
                    if fit != t:
                        t, tokens = fit, None
                if t < 0:
                    dead[at] = 1
                    t = out.pop()
                    at -= length[t]
                elif not dead[at + length[t]]:
                    break
                t, tokens = shorter[t], None
            out.append(t)
            at += length[t]
        return out

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _simple(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _SIMPLE_PIECES.findall(text)))

    def _pieces(self, text: str) -> bytes:
        """Ids of a stretch of text, pre-token by pre-token."""
        if _SIMPLE.fullmatch(text):
            return self._simple(text)
        return b"".join([self.pieces[text[a:b]] for _, (a, b) in self.cut(text)])

    def _plain(self, text: str) -> bytes:
        if _SIMPLE.fullmatch(text):
            return self._simple(text)
        if _AFTER_SPACE.search(text):  # pre-tokens look across runs of white space
            return self._pieces(text)
        # no token goes across "non-space, blank": words with other characters are encoded apart
        parts = _OTHER_WORDS.split(text)
        return b"".join([self.words[p] if k % 2 else self._simple(p) for k, p in enumerate(parts)])

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit numbers."""
        for name in self.added:
            if name in text:
                break
        else:
            return self._plain(text)
        out = []
        for part in re.split("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")", text):
            out.append(self._ids([self.added[part]]) if part in self.added else self._plain(part))
        return b"".join(out)


class Decoder:
    """The offset table of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        at = byte_chars()
        entries = [*spec["model"]["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]
        table = [b""] * (max(t for _, t in entries) + 1)
        for token, t in entries:
            table[t] = bytes(at[c] for c in token) if all(c in at for c in token) else token.encode()
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in table])])

    def decode(self, ids: np.ndarray) -> str:
        out = []
        for k in range(0, len(ids), GATHERED_IDS):
            part = ids[k:k + GATHERED_IDS].astype(np.int64)
            part = part[(part >= 0) & (part < len(self.offsets) - 1)]
            start = self.offsets[part]
            n = self.offsets[part + 1] - start
            before = np.cumsum(n) - n
            out.append(self.blob[np.repeat(start - before, n) + np.arange(int(n.sum()))].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_BUILT: dict = {}


def built(kind: type, tokenizer: str = TOKENIZER):
    """The encoder or decoder of a vocabulary file (a path, or the name of an installed public vocabulary), once per worker."""
    if (kind, tokenizer) not in _BUILT:
        path = tokenizer
        if "/" not in tokenizer:
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        _BUILT[kind, tokenizer] = kind(path)
    return _BUILT[kind, tokenizer]


def parts(batches):
    """Arrow batches of at most ``ROWS`` rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def encode(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids array<int>`` of every row of ``docs`` (``doc_id, text``)."""

    def run(batches):
        import pyarrow as pa

        own = built(Encoder, tokenizer)
        for batch in parts(batches):
            ids = [own.encode(t.as_py()) if t.is_valid else b"" for t in batch.column("text")]
            offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids], dtype=np.int64)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), values)],
                                             names=["doc_id", "ids"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids, text`` of every row of ``encoded`` (``doc_id, ids``)."""

    def run(batches):
        import pyarrow as pa

        own = built(Decoder, tokenizer)
        for batch in parts(batches):
            ids = batch.column("ids")
            texts = []
            for row in ids:
                texts.append(own.decode(row.values.to_numpy(zero_copy_only=False)) if row.is_valid else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(texts, pa.string())],
                                             names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def query(spark, sf_dir):
    from .common import table

    out = decode(encode(table(spark, sf_dir, "documents", "doc_id", "text")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
