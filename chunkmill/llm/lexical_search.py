"""Ranked lexical search over a segmented inverted index: short lists term by term, long lists document by document.

Index: every task cuts its documents into segments of bounded bytes and writes, per segment, one row per term
(ordinals of the documents that hold it, occurrences) and one row with the documents' ids and lengths.
Segments are built alone, so nothing is shuffled, and a segment is never larger than its bytes (one longer
document makes a segment of its own). The index lies in the shared checkpoint folder, sorted by term.

Search: items are taken in blocks of bounded size. Only the index rows of a block's terms are read (a semi join with
the block's own terms, whose number the block bounds); their document frequencies and the corpus totals are exact
sums over all segments. Then every segment is searched alone for all items of the block:

* TAAT: the item's short lists are summed into accumulators, which become one more iterator, bounded by
  its largest sum;
* DAAT: that iterator and the long lists are walked together in document order, a window of documents at a
  time. Lists whose bounds together can't reach the tenth best score so far propose no documents; they are only
  probed, by binary search, at documents that the others propose and that can still get in.

A segment gives at most ``k`` rows an item. They are merged in two steps (salted by segment, then whole), so
no task sees more than ``k`` rows from each of its inputs. Scores are exact; nothing is approximate.

Defined cases: a null text has no terms, as an item or as a document; an item without terms, or whose terms are
in no document, has no rows; texts are taken whole, however long; equal scores are ordered by ``doc_id``, nulls last;
repeated rows of documents are documents of their own (each takes a rank); rows that repeat an ``item_id`` are
ranked each for itself; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, stored

SEGMENT_BYTES = 8 << 20
SEGMENT_ROWS = 1 << 16
BLOCK_ITEMS = 1000
BLOCK_BYTES = 1 << 20
WINDOW = 1024  # documents that are walked together
SHORT_SHARE = 32  # lists that hold less than 1/32 of a segment's documents are short
SALTS = 64

# A text's bytes: letters and digits (A-Z lower-cased) and all bytes of other code points; 0 separates terms.
_TERM_BYTES = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _TERM_BYTES[_b] = _b
for _b in range(0x41, 0x5B):
    _TERM_BYTES[_b] = _b + 32


def terms_of(text: str | None) -> list[str]:
    """The terms of a text, in order, with repeats."""
    raw = _TERM_BYTES[np.frombuffer((text or "").encode(), np.uint8)].tobytes()
    return [t.decode() for t in raw.split(b"\0") if t]


_INDEX = "segment long, term string, rows array<int>, counts array<int>, ids array<long>"


def _segment(number: int, ids: list, texts: list):
    """One segment's rows as an Arrow batch: its documents (term null), then its terms in byte order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    raw = [texts[i] for i in order]
    low = _TERM_BYTES[np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)]
    held = low != 0
    edge = np.flatnonzero(np.diff(held, prepend=False))  # the last byte is a separator: edges come in pairs
    start, length = edge[::2], edge[1::2] - edge[::2]
    n_docs = len(raw)
    doc_end = np.cumsum([len(t) + 1 for t in raw])
    doc = np.searchsorted(doc_end, start, side="right")
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(low[held]))
    coded = words.dictionary_encode()
    by_bytes = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(by_bytes), np.int64)
    place[by_bytes] = np.arange(len(by_bytes))
    codes = coded.indices.to_numpy()
    key, tf = np.unique(place[codes] * n_docs + doc, return_counts=True)
    term, row = np.divmod(key, n_docs)
    first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(by_bytes)))]).astype(np.int32)
    n_terms = len(by_bytes)
    per_doc = np.bincount(doc, minlength=n_docs).astype(np.int32)

    def lists(of_docs, of_terms):
        values = pa.array(np.concatenate([of_docs, of_terms]).astype(np.int32))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], first + len(of_docs)]).astype(np.int32)), values)

    no_rows = np.zeros(0, np.int32)
    terms = pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary.take(pa.array(by_bytes)).cast(pa.string())])
    own_ids = pa.array([[ids[i] for i in order], *[None] * n_terms], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n_terms + 1, number)), terms, lists(no_rows, row), lists(per_doc, tf), own_ids],
        names=["segment", "term", "rows", "counts", "ids"])


def _index(segment_bytes: int, segment_rows: int):
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if ids and (size + len(raw) > segment_bytes or len(ids) >= segment_rows):
                    yield _segment(number, ids, texts)
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(doc_id)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield _segment(number, ids, texts)

    return run


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The written index of ``doc_id, text``: ``segment, term, rows, counts, ids``; the row of a null term holds the
    segment's document ids and, as counts, their numbers of terms."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(src.mapInArrow(_index(segment_bytes, segment_rows), _INDEX), "lexical-index")


def corpus_totals(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""
    own = index.filter("term IS NULL").select(
        F.size(F.filter("counts", lambda n: n > 0)).alias("n"),
        F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n).alias("l"))
    n, total = own.agg(F.sum("n"), F.sum("l")).first()
    return n or 0, total or 0


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Postings:
    """A term's postings in one segment: documents in order, their contributions, the largest one and the ``k``-th largest."""

    __slots__ = ("docs", "gain", "bound", "kth")

    def __init__(self, docs: np.ndarray, gain: np.ndarray, k: int):
        self.docs, self.gain, self.bound = docs, gain, int(gain.max()) if len(gain) else 0
        self.kth = int(np.partition(gain, len(gain) - k)[len(gain) - k]) if len(gain) >= k else 0


def accumulate(lists: list[Postings], scratch: np.ndarray, k: int) -> Postings:
    """Term-at-a-time: the sums of several lists as one list."""
    seen = np.unique(np.concatenate([p.docs for p in lists]))
    for p in lists:
        scratch[p.docs] += p.gain
    out = Postings(seen, scratch[seen], k)
    scratch[seen] = 0
    return out


def top_documents(lists: list[Postings], n_docs: int, k: int, window: int = WINDOW, short_share: int = SHORT_SHARE,
                  scratch: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents (ordinals) and scores of the ``k`` best sums above 0; of equal sums the smaller ordinals win."""
    scratch = np.zeros(n_docs, np.int64) if scratch is None else scratch
    lists = [p for p in lists if p.bound > 0]
    short = [p for p in lists if len(p.docs) * short_share < n_docs]
    walk = [p for p in lists if len(p.docs) * short_share >= n_docs]
    if short:
        walk.append(accumulate(short, scratch, k))
    walk.sort(key=lambda p: p.bound)
    reach = np.cumsum([p.bound for p in walk])  # of each list and all weaker ones
    # the k-th largest value of any list is a lower bound of the k-th best sum
    need = max([1, *(p.kth for p in walk)])
    best_docs, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo = 0
    while lo < n_docs:
        weak = int(np.searchsorted(reach, need, side="left"))  # these together stay below what is needed
        if weak == len(walk):
            break
        strong = walk[weak:]
        # skip to the next document that a strong list holds
        at = [int(np.searchsorted(p.docs, lo)) for p in strong]
        heads = [int(p.docs[i]) for p, i in zip(strong, at, strict=True) if i < len(p.docs)]
        if not heads:
            break
        lo, hi = min(heads), min(heads) + window
        parts = []
        for p, i in zip(strong, at, strict=True):
            j = int(np.searchsorted(p.docs, hi))
            if j > i:
                parts.append(p.docs[i:j])
                scratch[parts[-1]] += p.gain[i:j]
        found = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        score = scratch[found]
        scratch[found] = 0
        for w in range(weak - 1, -1, -1):
            fit = score + reach[w] >= need
            found, score = found[fit], score[fit]
            if not len(found):
                break
            p = walk[w]
            place = np.minimum(np.searchsorted(p.docs, found), len(p.docs) - 1)
            score = score + np.where(p.docs[place] == found, p.gain[place], 0)
        fit = score >= need
        if fit.any():
            docs, sums = np.concatenate([best_docs, found[fit]]), np.concatenate([best, score[fit]])
            order = np.lexsort((docs, -sums))[:k]
            best_docs, best = docs[order], sums[order]
            if len(best) == k:
                need = max(need, int(best[-1]) + 1)  # later documents must beat the last one
        lo = hi
    return best_docs, best


def _search_segment(table, items: list[tuple[int, list[str]]], weights: dict[str, int], n_docs: int, total: int, k: int):
    """All items against one segment: item number, doc_id, score."""
    import pyarrow as pa

    term = table.column("term").to_pylist()
    rows, counts = table.column("rows").combine_chunks(), table.column("counts").combine_chunks()
    own = term.index(None)
    ids = table.column("ids")[own].as_py()
    # 100 - 90 + (90 n N) div L, in whole numbers of any size
    m = np.array([10 + 90 * n * n_docs // total for n in counts[own].as_py()], np.int64)
    held: dict[str, Postings] = {}
    for i, t in enumerate(term):
        if t is not None:
            docs, tf = rows[i].values.to_numpy().astype(np.int64), counts[i].values.to_numpy().astype(np.int64)
            held[t] = Postings(docs, weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs])), k)
    scratch = np.zeros(len(ids), np.int64)
    out: list[tuple] = []
    for number, terms in items:
        docs, score = top_documents([held[t] for t in terms if t in held], len(ids), k, scratch=scratch)
        out += [(number, ids[d], s) for d, s in zip(docs.tolist(), score.tolist(), strict=True)]
    cols = list(zip(*out, strict=True)) or [[], [], []]
    return pa.table({"item": pa.array(cols[0], pa.int64()), "doc_id": pa.array(cols[1], pa.int64()),
                     "score": pa.array(cols[2], pa.int64())})


def _searcher(*args):
    return lambda table: _search_segment(table, *args)


def _blocks(items: DataFrame, block_items: int, block_bytes: int):
    """Items in blocks of bounded size: (item_id, terms) lists."""
    block, size = [], 0
    for item_id, text in items.select(F.col("item_id"), F.col("text").cast("string")).toLocalIterator():
        if block and (len(block) >= block_items or size + len(text or "") > block_bytes):
            yield block
            block, size = [], 0
        block.append((item_id, list(dict.fromkeys(terms_of(text)))))
        size += len(text or "")
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, k: int = 10, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents of every item (``item_id, text``)."""
    spark = index.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    n_docs, total = corpus_totals(index)
    path = scratch_path(spark, "lexical-hits")
    n_blocks = 0
    for n, block in enumerate(_blocks(items, block_items, block_bytes) if total else ()):
        terms = sorted({t for _, own in block for t in own})
        if not terms:
            continue
        # bounded by the block
        wanted = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))
        lists = index.filter("term IS NOT NULL").join(wanted, "term", "left_semi")
        df = {t: d for t, d in lists.groupBy("term").agg(F.sum(F.size("rows")).alias("df")).collect()}
        weights = {t: weight(n_docs, d) for t, d in df.items()}
        asked = [(i, [t for t in own if weights.get(t, 0) > 0]) for i, (_, own) in enumerate(block)]
        hits = lists.unionByName(index.filter("term IS NULL")).groupBy("segment").applyInArrow(
            _searcher(asked, weights, n_docs, total, k), "item long, doc_id long, score long")
        best = [F.desc("score"), F.asc_nulls_last("doc_id")]
        salt = (F.spark_partition_id() % SALTS).alias("salt")
        some = hits.select("*", salt).withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*best)))
        some = some.filter(F.col("rank") <= k).drop("rank", "salt")
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).filter(F.col("rank") <= k)
        names = F.broadcast(spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item long, item_id {kind}"))
        ranked.join(names, "item").select("item_id", "rank", "doc_id", "score").write.parquet(f"{path}/{n}")
        n_blocks += 1
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    return spark.read.schema(schema).parquet(f"{path}/*") if n_blocks else spark.createDataFrame([], schema)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
tot AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w)) AS total FROM d),
qt AS (SELECT DISTINCT item, item_id, unnest(w) AS term FROM q),
tf AS (SELECT rn, term, count(*) AS tf FROM (SELECT rn, unnest(w) AS term FROM d)
       WHERE term IN (SELECT term FROM qt) GROUP BY rn, term),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
       FROM tf, tot GROUP BY term, n_docs),
s AS (SELECT item, item_id, doc_id, rn, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf
               + 8 * (10 + (90 * len(w) * n_docs) // total)))) AS BIGINT) AS score
      FROM qt JOIN wt USING (term) JOIN tf USING (term) JOIN d USING (rn), tot GROUP BY item, item_id, doc_id, rn),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""


def query(spark, sf_dir):
    from .common import table

    index = build_index(table(spark, sf_dir, "documents", "doc_id", "text"))
    return search(index, table(spark, sf_dir, "benchmark", "item_id", "text"))
