"""Language identification by rank-order profiles of character n-grams.

A profile is the ``PROFILE_SIZE`` most frequent n-grams (one to three characters, a blank at word
ends) of a language, in rank order, counted over all training texts by Spark. A document's own
most frequent n-grams are compared with each profile: every n-gram adds the distance between its
two ranks, or the profile size if the profile lacks it; the smallest sum wins.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text when
there is nothing to learn from; ties go to the first language by code point; equally frequent
n-grams rank by code; repeated rows are predicted each for itself; other columns are ignored.
Texts are counted in blocks, so memory does not follow their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, release, trimmed

PROFILE_SIZE = 300
UNDETERMINED = "und"
BLOCK_CHARS = 1 << 20  # texts are counted in blocks of at most this many characters
FOLDS, HELD_OUT = 5, 0
GAP = 1  # stands for everything between words; no letter has this code point

_LETTERS: list = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _blocks(text: str) -> Iterator[str]:
    """Pieces of at most ``BLOCK_CHARS`` characters, cut behind a blank where there is one."""
    at = 0
    while len(text) - at > BLOCK_CHARS:
        cut = text.rfind(" ", at, at + BLOCK_CHARS) + 1
        cut = cut if cut > at else at + BLOCK_CHARS
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _block_codes(text: str) -> np.ndarray:
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    a = np.concatenate(([GAP], np.where(_letters()[chars], chars, GAP), [GAP])).astype(np.int64)
    a = a[np.concatenate(([True], (a[1:] != GAP) | (a[:-1] != GAP)))]  # one gap between words
    pairs = a[:-1] << 21 | a[1:]
    triples = pairs[:-1] << 21 | a[2:]
    return np.concatenate((a[a != GAP], pairs, triples[a[1:-1] != GAP]))


def _tally(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order and their counts (or summed weights)."""
    if weights is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.array([], int)
    counts = np.diff(np.append(first, len(codes))) if weights is None else np.add.reduceat(weights, first) if len(first) else weights
    return codes[first], counts


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's n-grams; empty if it has no letter."""
    parts = [_tally(c) for c in map(_block_codes, _blocks(text)) if len(c) > 1]
    if not parts:
        return np.array([], np.int64), np.array([], np.int64)
    if len(parts) == 1:
        return parts[0]
    return _tally(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))


def _count_by_language(batches):
    """Partial n-gram counts of each language: one merge per batch, rows at the end of the task."""
    import pyarrow as pa

    schema = arrow_schema("lang string, code long, n long")
    totals: dict[str, tuple] = {}

    def rows():
        for lang, (codes, counts) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()),
                                              pa.array(counts, pa.int64())], schema=schema)
        totals.clear()

    for batch in batches:
        texts: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, group in texts.items():
            new = ngrams("\n ".join(group))
            old = totals.get(lang)
            totals[lang] = new if old is None else _tally(np.concatenate((old[0], new[0])), np.concatenate((old[1], new[1])))
        if sum(len(c) for c, _ in totals.values()) > 2_000_000:
            yield from rows()
    yield from rows()


@dataclass
class Profiles:
    """Ranks of every profile: ``ranks[l, i]`` of n-gram ``codes[i]``; -1 where profile ``l`` lacks it."""

    langs: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngrams(text) if text else ((), ())
        if not len(codes) or not self.langs:
            return UNDETERMINED, 0.0
        top = codes[np.argsort(-counts, kind="stable")[:self.size]]
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        ranks = np.where(self.codes[at] == top, self.ranks[:, at], -1)
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        best = int(np.argmin(apart))
        return self.langs[best], 1.0 - float(apart[best]) / (self.size * len(top))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def fit(docs: DataFrame, size: int = PROFILE_SIZE) -> Profiles:
    """Profiles from all of ``text, lang`` (rows with a null are left out). The driver gets ``size``
    n-grams per language."""
    src = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).dropna()
    counts = src.mapInArrow(trimmed(_count_by_language), "lang string, code long, n long")
    counts = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    # the limit stands on the row number itself, so every task keeps ``size`` rows a language before the exchange
    top = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= size).select("lang", "code", (F.col("r") - 1).alias("r"))
    rows = top.toPandas()
    langs = sorted(rows["lang"].unique())
    codes = np.unique(rows["code"].to_numpy(np.int64))
    ranks = np.full((len(langs), len(codes)), -1, np.int64)
    ranks[[langs.index(x) for x in rows["lang"]], np.searchsorted(codes, rows["code"].to_numpy(np.int64))] = rows["r"]
    return Profiles(langs, codes, ranks, size)


def predict(text: Column, profiles: Profiles) -> Column:
    """Struct (lang_pred, score) of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([profiles.predict(t) for t in s], columns=["lang_pred", "score"])
        release()

    return run(text)


def identify(docs: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; profiles are learned from the
    documents that are not held out."""
    docs = docs.select("doc_id", "text", "lang")
    profiles = fit(docs.filter(~held_out()), size)
    out = docs.select("doc_id", held_out().alias("held_out"), predict(F.col("text"), profiles).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def query(spark, sf_dir):
    from .common import table

    return identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
