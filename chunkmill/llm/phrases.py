"""Phrase mining after Toivonen: a sample proposes, full passes decide.

1. A seeded sample of the documents is counted at a lowered threshold. Its frequent words and phrases are the
   proposal.
2. A full pass counts, exactly, the proposal and its negative border: every word, and every phrase whose two
   parts without the last and without the first word are both proposed. The border isn't listed; a phrase is
   tested where it occurs, so only border phrases that occur cost anything.
3. Frequent phrases that were not proposed are border failures. They join the proposal, which admits longer
   phrases, and a further pass counts exactly those that no earlier pass has counted. This goes on until there
   is no failure: then every part of a frequent phrase is known, and with it every frequent phrase. Each
   pass can only fail with phrases one word longer than the last, so there are at most as many passes as words
   in the longest phrase.

Membership is tested with bitmaps of 64-bit phrase hashes, ``BITS_PER_PHRASE`` bits a phrase and at most ``MOST_BITS``
bits a layer, whatever the input: that is all that is gathered on the driver and sent to the tasks. A false
hit only has one more phrase counted, so results stay exact also where a bitmap is overfull; counts
themselves are grouped by the phrases' texts, never by hashes. Tasks count chunks of bounded bytes with vector
operations and deal the distinct phrases of a chunk out to buckets by hash; Spark shuffles the parts, and each
bucket adds its parts up. A phrase in a third of all documents is one row per chunk; a bucket holds an even
share of the distinct phrases, so buckets stay bounded if the number of shuffle partitions follows the data.

Scoring joins every frequent phrase with the counts of its parts. A part shared by many phrases is a hot key of
one join side, which adaptive execution splits; the other side holds a part once.

Defined cases: a null text has no words; a null language is ``und``; texts are taken whole, however long (memory
follows the longest text of a task); equal scores of a cut go to the shortest first part, equal scores of phrases to
the larger count, then to the phrase that is smaller in bytes; repeated rows count each for itself; an empty
table gives no phrases; columns other than ``doc_id`` (it only seeds the sample), ``text`` and ``lang`` are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, stored

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words of a phrase
COVERED = 80  # percent of a phrase's occurrences that lie in one longer candidate
SAMPLE_SHARE = 8  # one document in so many is sampled
SLACK = 0.6  # the sample's threshold, as a share of what it should hold of a phrase at the limit
SEED = 11
CHUNK_BYTES = 4 << 20
BITS_PER_PHRASE = 32
MOST_BITS = 1 << 26
BUCKETS_PER_PARTITION = 4  # buckets of phrase hashes, by the session's number of shuffle partitions
UNKNOWN = "und"

# Bytes between words, bytes between pieces (fixed values), and A-Z lower-cased.
_BLANKS, _BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANKS)] = 1
_KIND[list(_BREAKS)] = 2
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(lang: str, words: list[str]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh64_intdigest(lang) & 0x7FFFFFFF
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def _longer(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer."""
    return _mix(head * np.uint64(0x9E3779B97F4A7C15) + word)


class Layer:
    """Bitmaps of phrase hashes by phrase length (bytes of bits; a power of two of them)."""

    def __init__(self, maps: dict[int, np.ndarray]):
        self.maps = maps

    def holds(self, k: int, hashes: np.ndarray) -> np.ndarray:
        bits = self.maps[k]
        slot = hashes & np.uint64(len(bits) * 8 - 1)
        return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _held(layers: list[Layer], k: int, hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes), bool)
    for layer in layers:
        out |= layer.holds(k, hashes)
    return out


def _tokens(texts: list[bytes]):
    """Distinct words (Arrow), their number at every place, and the number of the place's piece."""
    import pyarrow as pa

    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _KIND[raw]
    held = kind == 0
    edge = np.flatnonzero(np.diff(held, prepend=False))  # the last byte is a break: edges come in pairs
    start, length = edge[::2], edge[1::2] - edge[::2]
    piece = np.searchsorted(np.flatnonzero(kind == 2), start)
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(_LOW[raw[held]])).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), piece


def _distinct(words, hashes: np.ndarray, code: np.ndarray, at: np.ndarray, k: int):
    """The distinct phrases of ``k`` words at the places ``at``: texts, hashes, counts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size, key, prefixes = len(words), code[at], []
    for j in range(1, k):
        key = key * size + code[at + j]
        if j < k - 1:  # number the prefixes densely, so that keys stay below 64 bits
            distinct, key = np.unique(key, return_inverse=True)
            prefixes.append(distinct)
    key, n = np.unique(key, return_counts=True)
    cols, head = [key % size], key // size
    for distinct in reversed(prefixes):
        cols.append(distinct[head] % size)
        head = distinct[head] // size
    cols = [head, *reversed(cols)]
    full = hashes[cols[0]]
    for c in cols[1:]:
        full = _longer(full, hashes[c])
    texts = pc.binary_join_element_wise(*[words.take(pa.array(c)) for c in cols], pa.scalar(" ", words.type))
    return texts, full, n


def count_phrases(lang: str, texts: list[bytes], known: list[Layer] | None, before: list[Layer] | None, longest: int = LONGEST):
    """(length, phrases, their hashes, counts) of the phrases that the layers ``known`` admit and ``before`` don't
    (None admits nothing). Without ``known`` every phrase is counted."""
    import pyarrow as pa

    words, code, piece = _tokens(texts)
    hashes = _word_hashes(lang, words.to_pylist())
    if before is None:
        yield 0, pa.array([""], words.type), np.zeros(1, np.uint64), np.array([len(code)])
        yield 1, words, hashes, np.bincount(code, minlength=len(words))
    # per place: hash of the phrase that starts there, whether it is known, and whether it was before
    here = hashes[code]
    now = _held(known, 1, hashes)[code] if known is not None else np.ones(len(code), bool)
    then = _held(before, 1, hashes)[code] if before is not None else np.zeros(len(code), bool)
    for k in range(2, longest + 1):
        # both parts are known, and all words lie in one piece
        admitted = now[:-1] & now[1:] & (piece[:max(0, len(piece) - k + 1)] == piece[k - 1:])
        old = admitted & then[:-1] & then[1:]
        at = np.flatnonzero(admitted & ~old)
        if len(at):
            yield k, *_distinct(words, hashes, code, at, k)
        at = np.flatnonzero(admitted)
        if k == longest or not len(at):
            return
        part = _longer(here[at], hashes[code[at + k - 1]])
        here, now, then = np.zeros(len(admitted), np.uint64), np.zeros(len(admitted), bool), np.zeros(len(admitted), bool)
        here[at], now[at] = part, _held(known, k, part) if known is not None else True
        if before is not None:
            at = np.flatnonzero(old)
            then[at] = _held(before, k, here[at])


_COUNTS = "lang string, k int, phrase string, n long"


def _counter(known, before, longest, chunk_bytes, buckets):
    """Texts -> ``bucket, part``: per chunk and bucket of phrase hashes, a table of exact counts as Arrow bytes."""

    def run(batches):
        import pyarrow as pa

        schema, packed = arrow_schema(_COUNTS), pa.ipc.IpcWriteOptions(compression="zstd")

        def flush(chunk):
            tables, bucket = [], []
            for lang, texts in chunk.items():
                for k, phrases, hashes, n in count_phrases(lang, texts, known, before, longest):
                    langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int32)), pa.array([lang])).cast(pa.string())
                    tables.append(pa.Table.from_arrays([langs, pa.array(np.full(len(n), k, np.int32)), phrases.cast(pa.string()),
                                                        pa.array(n.astype(np.int64))], schema=schema))
                    bucket.append(((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64))
            if not tables:
                return
            bucket = np.concatenate(bucket)
            order = np.argsort(bucket, kind="stable")
            table = pa.concat_tables(tables).take(pa.array(order)).combine_chunks()
            held, first = np.unique(bucket[order], return_index=True)
            for a in range(0, len(held), 64):  # some parts at a time
                parts = []
                for b, lo, hi in zip(held[a:a + 64], first[a:a + 64], [*first[1:], len(bucket)][a:a + 64], strict=False):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, schema, options=packed) as w:
                        w.write_table(table.slice(lo, hi - lo))
                    parts.append(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(held[a:a + 64]), pa.array(parts, pa.binary())], names=["bucket", "part"])

        chunk, size = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes()
                if size and size + len(raw) > chunk_bytes:
                    yield from flush(chunk)
                    chunk, size = {}, 0
                chunk.setdefault(lang, []).append(raw)
                size += len(raw) + 1
        yield from flush(chunk)

    return run


def _adder(least: int):
    """All parts of one bucket -> phrases with at least ``least`` occurrences, and the numbers of words (length 0)."""

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        out, waiting, rows = None, [], 0
        parts = table.column("part")
        for i, part in enumerate(parts):
            waiting.append(pa.ipc.open_stream(part.as_buffer()).read_all())
            rows += waiting[-1].num_rows
            # fold again when as many rows wait as are folded
            if i == len(parts) - 1 or rows > max(1 << 18, 2 * (out.num_rows if out else 0)):
                whole = pa.concat_tables(([out] if out else []) + waiting).combine_chunks()
                out = whole.group_by(["lang", "k", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "k", "phrase", "n"])
                waiting, rows = [], out.num_rows
        keep = pc.or_(pc.greater_equal(out.column("n"), least), pc.equal(out.column("k"), 0))
        return out.filter(keep).select(["lang", "k", "phrase", "n"])

    return run


def _pass(texts: DataFrame, least: int, known, before, longest: int, chunk_bytes: int, name: str) -> DataFrame:
    """Exact counts of one pass, written: phrases with at least ``least`` occurrences, and (length 0) the number of words."""
    buckets = BUCKETS_PER_PARTITION * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = texts.mapInArrow(_counter(known, before, longest, chunk_bytes, buckets), "bucket long, part binary")
    return stored(counted.groupBy("bucket").applyInArrow(_adder(least), _COUNTS), name)


def _hash_rows(known: list[Layer]):
    """Rows of phrases -> hashes of those that ``known`` doesn't hold (with all their parts)."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                mine = batch.filter(pc.equal(batch.column("lang"), lang))
                phrases = [p.split(" ") for p in mine.column("phrase").to_pylist()]
                k = np.array([len(p) for p in phrases])
                words = {w: i for i, w in enumerate({w for p in phrases for w in p})}
                word_hash = _word_hashes(lang, list(words))
                for size in np.unique(k):
                    codes = np.array([[words[w] for w in p] for p in phrases if len(p) == size])
                    hashes = word_hash[codes]
                    held, full = _known_rows(hashes, known)
                    out = full[~held]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), size, np.int32)), pa.array(out.view(np.int64))],
                                                     names=["k", "hash"])

    return run


def _known_rows(hashes: np.ndarray, known: list[Layer]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each phrase (rows of word hashes) is held with all its parts, and its own hash."""
    size = hashes.shape[1]
    held, level = np.ones(len(hashes), bool), [hashes[:, i] for i in range(size)]
    for k in range(1, size + 1):
        for h in level:
            held &= _held(known, k, h)
        if k < size:
            level = [_longer(level[i], hashes[:, i + k]) for i in range(size - k)]
    return held, level[0]


def failures(frequent: DataFrame, known: list[Layer], longest: int = LONGEST) -> DataFrame:
    """``k, hash`` of the frequent phrases, below the longest, that ``known`` doesn't hold; written."""
    rows = frequent.filter(F.col("k").between(1, longest - 1)).select("lang", "phrase")
    return stored(rows.mapInArrow(_hash_rows(known), "k int, hash long"), "phrase-failures")


def layer(hashes: DataFrame, longest: int = LONGEST, most_bits: int = MOST_BITS) -> Layer | None:
    """Bitmaps of ``k, hash`` rows; None if there are none. The driver gets at most ``most_bits`` bits a length."""
    sizes = dict(hashes.groupBy("k").count().collect())
    if not sizes:
        return None
    maps = {}
    for k in range(1, longest):
        bits = 64
        while bits < min(most_bits, sizes.get(k, 0) * BITS_PER_PHRASE):
            bits *= 2
        slot = F.col("hash").bitwiseAND(F.lit(bits - 1))
        words = (hashes.filter(F.col("k") == k).groupBy(F.shiftright(slot, 6).alias("word"))
                 .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(hash & {63}L as int))")).alias("bits"))).toArrow()
        out = np.zeros(bits // 64, np.int64)
        out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        maps[k] = out.astype("<i8").view(np.uint8)
    return Layer(maps)


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sample_share: int = SAMPLE_SHARE, slack: float = SLACK,
         seed: int = SEED, chunk_bytes: int = CHUNK_BYTES, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame, list[int]]:
    """Exact counts ``lang, k, phrase, n`` of all phrases of 1 to ``longest`` words that occur at least ``least`` times in a
    language, the words ``lang, n`` of every language, and the number of border failures of every pass."""
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)), F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(lang.alias("lang"), text.alias("text"))
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(sample_share)) == 0
    sample = docs.filter(drawn).select(lang.alias("lang"), text.alias("text"))
    lowered = max(1, int(least / sample_share * slack))
    proposed = _pass(sample, lowered, None, None, longest - 1, chunk_bytes, "phrase-sample")
    first = layer(failures(proposed, [], longest), longest, most_bits)
    known, before, found, missed = [first or layer_of_nothing(longest)], None, [], []
    while True:
        counts = _pass(texts, least, known, before, longest, chunk_bytes, "phrase-counts")
        found.append(counts)
        more = layer(failures(counts, known, longest), longest, most_bits)
        missed.append(more)
        if more is None:
            break
        known, before = [*known, more], known
    all_counts = found[0]
    for c in found[1:]:
        all_counts = all_counts.unionByName(c)
    totals = found[0].filter("k = 0").select("lang", "n")
    return all_counts.filter("k > 0"), totals, [0 if m is None else sum(int(np.unpackbits(b).sum()) for b in m.maps.values()) for m in missed]


def layer_of_nothing(longest: int = LONGEST) -> Layer:
    return Layer({k: np.zeros(8, np.uint8) for k in range(1, longest)})


def _part(first: str, size: str) -> str:
    return f"array_join(slice(words, {first}, {size}), ' ')"


def collocations(counts: DataFrame, least: int = LEAST, covered: int = COVERED) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the candidates of 2 and more words that no longer candidate covers."""
    words = counts.withColumn("words", F.split("phrase", " "))
    phrases = words.filter((F.col("k") >= 2) & (F.col("n") >= least)).select("lang", "phrase", "k", "words", F.col("n").alias("a"))
    cuts = phrases.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).select(
        "lang", "phrase", "a", "cut", F.expr(_part("1", "cut")).alias("first"), F.expr(_part("cut + 1", "k - cut")).alias("rest"))
    part = counts.select("lang", F.col("phrase").alias("part"), "n")
    scored = cuts.join(part.withColumnsRenamed({"part": "first", "n": "l"}), ["lang", "first"])
    scored = scored.join(part.withColumnsRenamed({"part": "rest", "n": "r"}), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(19, 0)) * 2000000) div (cast(l as decimal(19, 0)) + r)")
    worst = scored.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "cut", "a", "l", "r")).alias("w")).select("lang", "phrase", "w.a", "w.l", "w.r", "w.score")
    # every shorter candidate inside a phrase, with the phrase's count
    inner = phrases.filter("k > 2").select("lang", "a", F.explode(F.expr(
        "flatten(transform(sequence(2, k - 1), s -> transform(sequence(1, k - s + 1), i -> array_join(slice(words, i, s), ' '))))"
    )).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    out = worst.join(around, ["lang", "phrase"], "left")
    free = F.col("around").isNull() | (100 * F.col("around") < covered * F.col("a"))
    return out.filter(free).drop("around")


def top_collocations(docs: DataFrame, top: int = 2000, least: int = LEAST, **how) -> DataFrame:
    """The ``top`` phrases of every language: ``lang, rank, phrase, a, l, r, n, score``."""
    counts, totals, _ = mine(docs, least, **how)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = collocations(counts, least).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
tot AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cut AS (SELECT lang, phrase, a, i, array_to_string(w[1:i], ' ') AS p1, array_to_string(w[i + 1:k], ' ') AS p2
        FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
s AS (SELECT cut.lang, cut.phrase, a, i, x.n AS l, y.n AS r, (CAST(2000000 AS HUGEINT) * a) // (x.n + y.n) AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = p1 JOIN f y ON y.lang = cut.lang AND y.phrase = p2),
worst AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
sub AS (SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
        FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)),
cov AS (SELECT lang, phrase, max(a) AS around FROM sub GROUP BY lang, phrase),
r AS (SELECT worst.*, tot.n AS n, row_number() OVER (PARTITION BY worst.lang ORDER BY score DESC, a DESC, worst.phrase) AS rank
      FROM worst JOIN tot USING (lang) LEFT JOIN cov ON cov.lang = worst.lang AND cov.phrase = worst.phrase
      WHERE around IS NULL OR 100 * around < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 2000
"""


def query(spark, sf_dir):
    from .common import table

    return top_collocations(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
