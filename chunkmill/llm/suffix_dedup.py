"""Removal of repeated passages by the common-prefix intervals of an enhanced suffix array.

A byte goes if a ``WINDOW``-byte string over it also starts in a document with a smaller id. Suffixes that
share ``WINDOW`` bytes are one interval of the suffix array; its smallest document decides for all of its
members at once (all occurrences, not just neighbours).

The suffix array is dealt out by anchors: the smallest ``K``-byte hash in a window is the same in every copy
of the window, so equal windows meet in the bucket of their anchor.

1. Texts are dealt out by a hash of their id to batches of some megabytes, compressed; this is the only time
   that they move. Every batch lists its distinct anchors, one entry per batch and anchor, in the buckets.
   A bucket answers each batch which of them other batches hold as well; those that two documents of one batch
   share, it knows itself.
2. Per batch, every run of windows with one repeated anchor (a context of at most 2 * WINDOW bytes) goes to
   the anchor's bucket, equal contexts once with their smallest document. The bucket sorts the suffixes of
   its contexts, takes the longest common prefixes of neighbours and scans the intervals of at
   least ``WINDOW`` bytes; a context that is alone with its anchor needs no sorting.
   An anchor with more than ``SPLIT`` contexts (a frequent passage shorter than a window, with other neighbours each
   time) is split: its windows are dealt out one by one by a hash of the whole window, equal windows of a batch once,
   so no bucket holds all contexts of an anchor.
3. The smallest document of every window goes back to the batch, whose texts are cut.

A passage that a third of all documents hold is one entry per batch in either step, or one per batch and different
window if its anchor is split, and never a list of its occurrences. The three passes over the batches read one shuffle.

Defined cases: null text is empty; a null id is larger than every other; rows that repeat an id don't
remove each other's text; long texts are scanned in overlapping slices; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_schema, trimmed

WINDOW = 50
K = 20  # anchor length; WINDOW - K + 1 anchors start in a window
W = WINDOW - K + 1
SLICE = 1 << 17  # bytes hashed at a time: their arrays stay in a core's cache
BUCKET_BYTES = 4 << 20  # text per bucket
PLACE = 21  # bits of a position in a slice
BATCH_BYTES = 16 << 20  # text per batch
SPLIT = 4096  # contexts of one anchor that a bucket may get
FEW = 8  # so many occurrences of an anchor in a batch are counted as contexts without a comparison
ALONE = 128  # added to the offset (and to a reply's first window) of a window of a split anchor
NO_ID = (1 << 63) - 1
_X = 0x9E3779B97F4A7C15
_XI = pow(_X, -1, 1 << 64)
_BYTE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _sums(raw: np.ndarray) -> np.ndarray:
    """Sums of the bytes before each position, weighed by powers: a difference of two is the hash of what is between them."""
    x = _BYTE[raw]
    x *= _context_powers(len(raw))[0][:len(raw)]
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def _anchors(raw: np.ndarray, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``raw`` (a slice): the position of its smallest K-byte hash (by all but the last PLACE bits, the leftmost of
    equal ones); and all K-byte hashes. Hash and position are one number, so a minimum moves both."""
    if len(raw) >> PLACE:
        raise ValueError("longer than a slice")
    k = _string_hashes(_sums(raw) if sums is None else sums, np.s_[:-K], np.s_[K:])
    value, width = k & np.uint64((1 << 64) - (1 << PLACE)), 1
    value |= np.arange(len(k), dtype=np.uint64)
    while width < W:
        step = min(width, W - width)
        value = np.minimum(value[:-step], value[step:])
        width += step
    return (value & np.uint64((1 << PLACE) - 1)).astype(np.int32), k


def _string_hashes(sums: np.ndarray, first, end) -> np.ndarray:
    """64-bit hashes of the bytes from ``first`` to ``end`` (indices or slices)."""
    x = sums[end] - sums[first]
    x *= _context_powers(len(sums) - 1)[1][:len(sums)][first]
    return _mix(x)


def _slices(texts: list[bytes]):
    """(raw, pieces) with pieces (document number, first byte in the document, first byte in raw, length): documents
    one behind the other up to about SLICE bytes; long ones in slices that overlap by WINDOW - 1 bytes."""
    pieces, parts, size = [], [], 0
    for d, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), SLICE):
            part = t[at:at + SLICE + WINDOW - 1]
            if len(part) >= WINDOW:
                if size and size + len(part) > SLICE + WINDOW:
                    yield np.frombuffer(b"".join(parts), np.uint8), pieces
                    pieces, parts, size = [], [], 0
                pieces.append((d, at, size, len(part)))
                parts.append(part)
                size += len(part)
    if size:
        yield np.frombuffer(b"".join(parts), np.uint8), pieces


def _runs(texts: list[bytes]):
    """Per slice: its sums, and for each run of windows with one anchor: document, anchor position in the document,
    anchor hash, first window in the slice, number of windows, the document position of the slice's byte 0 by its piece."""
    for raw, pieces in _slices(texts):
        sums = _sums(raw)
        at, k = _anchors(raw, sums)
        doc, offset, start, size = np.array(pieces, np.int64).T
        beyond = start + size - WINDOW + 1  # the first window that leaves its piece
        change = np.empty(len(at) + 1, bool)
        np.not_equal(at[1:], at[:-1], out=change[1:-1])
        change[start] = change[beyond] = True
        edge = np.flatnonzero(change)
        first, n = edge[:-1], np.diff(edge)
        o = np.searchsorted(start, first, "right") - 1  # piece
        stays = np.flatnonzero(first < beyond[o])
        first, n, o = first[stays], n[stays], o[stays]
        shift = (offset - start)[o]  # position in the slice -> document position
        yield sums, doc[o], at[first] + shift, k[at[first]], first, n, shift


def _groups(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of every run of equal values."""
    if not len(sorted_values):
        return []
    cuts = [0, *(np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1).tolist(), len(sorted_values)]
    return list(zip(cuts, cuts[1:], strict=False))


def _ids(column) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in column.to_pylist()], np.int64)


def _texts(column) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message."""
    import pyarrow as pa

    raw = b"".join(len(a.tobytes()).to_bytes(8, "little") + a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpack(message: bytes, *types) -> list[np.ndarray]:
    import pyarrow as pa

    size = int.from_bytes(message[:8], "little")
    raw = pa.Codec("zstd").decompress(message[8:], decompressed_size=size, asbytes=True) if size else b""
    out, at = [], 0
    for t in types:
        n = int.from_bytes(raw[at:at + 8], "little")
        out.append(np.frombuffer(raw, t, n // np.dtype(t).itemsize, at + 8))
        at += 8 + n
    return out


def _zip(batches):
    """Texts compressed one by one, for the shuffle."""
    import pyarrow as pa

    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        raw = _texts(batch.column("text"))
        z = [len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in raw]
        yield pa.RecordBatch.from_arrays([pa.array(_ids(batch.column("doc_id")), pa.int64()), batch.column("hash"), batch.column("batch"),
                                          pa.array(z, pa.binary())], schema=arrow_schema(_TEXT))


_TEXT = "id long, hash long, batch int, z binary"


def _unzip(z) -> bytes:
    import pyarrow as pa

    size = int.from_bytes(z[:8], "little")
    return pa.Codec("zstd").decompress(z[8:], decompressed_size=size, asbytes=True) if size else b""


def _lead(*columns: np.ndarray) -> np.ndarray:
    """First positions of runs of equal rows in sorted columns."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _batch_anchors(ids: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a batch in ascending order, whether two of its documents hold them, and the number of
    their contexts (of their occurrences if below FEW)."""
    found = [(d, h, _context_keys(sums, first, first + n + WINDOW - 1, p - shift - first)) for sums, d, p, h, first, n, shift in _runs(texts)]
    if not found:
        return np.array([], np.uint64), np.array([], bool), np.array([], np.uint16)
    d, h, code = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(h)
    h, who, code = h[order], ids[d[order]], code[order]
    first = _lead(h)
    times = np.diff(np.append(first, len(h)))
    often = np.flatnonzero(np.repeat(times >= FEW, times))
    if len(often):
        group, code = np.repeat(np.arange(len(first)), times)[often], code[often]
        by = np.lexsort((code, group))
        group = group[by][_lead(group[by], code[by])]
        times = np.where(times >= FEW, np.bincount(group, minlength=len(first)), times)
    return h[first], np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first), np.minimum(times, 65535).astype(np.uint16)


_ASK = "bucket int, batch int, entries binary"


def _ask(n_buckets: int):
    """Step 1, in a batch: its anchors, dealt out to the buckets. An anchor is sent as the low 32 bits of its hash over
    the number of buckets: two different ones that agree there only cost a comparison later."""
    def run(key, pdf):
        h, shared, times = _batch_anchors(pdf["id"].to_numpy(), [_unzip(z) for z in pdf["z"]])
        bucket = (h % np.uint64(n_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        h, shared, times, bucket = (h[order] // np.uint64(n_buckets)).astype(np.uint32), shared[order], times[order], bucket[order]
        rows = [(int(bucket[s]), int(key[0]), _pack(h[s:e], np.packbits(shared[s:e]), times[s:e])) for s, e in _groups(bucket)]
        return pd.DataFrame(rows, columns=["bucket", "batch", "entries"])

    return run


_ANSWER = "batch int, bucket int, entries binary"


def _answer(split: int):
    """Step 1, in a bucket: to each batch, those of its anchors that another batch holds, or that two of its documents share,
    and which of them have more than ``split`` contexts in all batches."""
    def run(key, pdf):
        lists, shared, contexts = zip(*(_unpack(e, np.uint32, np.uint8, np.uint16) for e in pdf["entries"]), strict=True)
        sizes = [len(x) for x in lists]
        h = np.concatenate(lists)
        flags = np.concatenate([np.unpackbits(f)[:n] for f, n in zip(shared, sizes, strict=True)])
        owner = np.repeat(np.arange(len(lists)), sizes)
        order = np.argsort(h, kind="stable")
        first = _lead(h[order])
        times = np.diff(np.append(first, len(h)))
        repeated = np.repeat((times > 1) | (np.maximum.reduceat(flags[order], first) > 0), times)
        hot = np.empty(len(h), bool)
        hot[order] = np.repeat(np.add.reduceat(np.concatenate(contexts).astype(np.int64)[order], first) > split, times)
        keep = np.sort(order[repeated])
        rows = [(int(pdf["batch"].iloc[owner[keep[s]]]), int(key[0]), _pack(h[keep[s:e]], np.packbits(hot[keep[s:e]])))
                for s, e in _groups(owner[keep])]
        return pd.DataFrame(rows, columns=["batch", "bucket", "entries"])

    return run


def _inner(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of runs of ``n`` windows: the run, and the window's number in it."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _contexts(texts: list[bytes], wanted: np.ndarray | None, n_buckets: int, hot: np.ndarray | None = None):
    """Runs of windows with one anchor: arrays (document, bucket, context hash, windows, anchor offset, first window in the
    document). ``wanted`` holds the repeated anchors as bucket << 32 | entry, in ascending order (None: all); the windows of
    those that are ``hot`` are contexts of their own, in the bucket of their hash, with ALONE added to the offset."""
    cols = []
    for sums, d, p, h, first, n, shift in _runs(texts):
        bucket = h % np.uint64(n_buckets)
        alone = np.zeros(len(d), bool)
        if wanted is not None:
            code = bucket << np.uint64(32) | (h // np.uint64(n_buckets)) & np.uint64(0xFFFFFFFF)
            i = np.minimum(np.searchsorted(wanted, code), max(len(wanted) - 1, 0))
            hit = np.flatnonzero(wanted[i] == code) if len(wanted) else np.array([], int)
            d, p, h, bucket, first, n, shift = (x[hit] for x in (d, p, h, bucket, first, n, shift))
            alone = hot[i[hit]] if len(hit) else alone[:0]
        if not len(d):
            continue
        offset = p - shift - first  # of the anchor in the context
        one = np.flatnonzero(~alone)
        if len(one):
            key = _context_keys(sums, first[one], first[one] + n[one] + WINDOW - 1, offset[one])
            cols.append((d[one], bucket[one].astype(np.int32), key, n[one], offset[one], (first + shift)[one]))
        if len(one) < len(d):
            many = np.flatnonzero(alone)
            run, inner = _inner(n[many])
            run = many[run]
            at, place = first[run] + inner, offset[run] - inner
            key = _context_keys(sums, at, at + WINDOW, place)
            cols.append((d[run], (key % np.uint64(n_buckets)).astype(np.int32), key, np.ones_like(at), place + ALONE, at + shift[run]))
    empty = np.array([], np.int64)
    return tuple(np.concatenate(c) for c in zip(*cols, strict=True)) if cols else (empty, empty, empty.astype(np.uint64), empty, empty, empty)


def _context_keys(sums: np.ndarray, first: np.ndarray, end: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from first to end, with the anchor's place in them."""
    down = _context_powers(len(sums) - 1)[1]
    return _mix(((sums[end] - sums[first]) * down[first]) ^ ((end - first) * 64 + offset).astype(np.uint64) * np.uint64(_XI))


def _context_powers(n: int) -> np.ndarray:
    if not _POWERS or _POWERS[0].shape[1] <= n:
        steps = np.full((2, max(SLICE + (1 << 12), n + 1)), [[_X], [_XI]], np.uint64)
        steps[:, 0] = 1
        _POWERS[:] = [np.cumprod(steps, axis=1, dtype=np.uint64)]
    return _POWERS[0]


_SEND = "bucket int, batch int, contexts binary"


def _send(n_buckets: int):
    """Step 2, in a batch: each distinct context of a repeated anchor once, with its smallest and largest document."""
    def run(key, docs, answers):
        ids = docs["id"].to_numpy()
        texts, wanted, hot = [_unzip(z) for z in docs["z"]], np.array([], np.uint64), np.array([], bool)
        if len(answers):
            known, bits = zip(*(_unpack(e, np.uint32, np.uint8) for e in answers["entries"]), strict=True)
            hot = np.concatenate([np.unpackbits(f)[:len(x)] for x, f in zip(known, bits, strict=True)]) > 0
            wanted = np.concatenate([np.uint64(b) << np.uint64(32) | x.astype(np.uint64) for b, x in zip(answers["bucket"], known, strict=True)])
            order = np.argsort(wanted)
            wanted, hot = wanted[order], hot[order]
        d, bucket, code, n, offset, at = _contexts(texts, wanted, n_buckets, hot)
        order = np.lexsort((code, bucket))
        d, code, bucket, n, offset, at = (x[order] for x in (d, code, bucket, n, offset, at))
        who = ids[d]
        rows = []
        if len(code):
            first = _lead(code, bucket)
            names, index = np.unique(ids, return_inverse=True)
            least = np.searchsorted(names, np.minimum.reduceat(who, first)).astype(np.int32)
            most = np.searchsorted(names, np.maximum.reduceat(who, first)).astype(np.int32)
            for s, e in _groups(bucket[first]):
                f = first[s:e]
                used, nr = np.unique(np.concatenate((least[s:e], most[s:e])), return_inverse=True)
                a, b = nr[:e - s].astype(np.int32), nr[e - s:].astype(np.int32)
                whole = b"".join([texts[i][x:x + m + WINDOW - 1] for i, x, m in zip(d[f].tolist(), at[f].tolist(), n[f].tolist(), strict=True)])
                rows.append((int(bucket[f[0]]), int(key[0]), _pack(
                    n[f].astype(np.uint8), offset[f].astype(np.uint8), a, b - a, names[used], np.frombuffer(whole, np.uint8))))
        return pd.DataFrame(rows, columns=["bucket", "batch", "contexts"])

    return run


def suffix_array(raw: np.ndarray, starts: np.ndarray, depth: int = WINDOW + 6) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``raw`` at ``starts`` in lexicographic order of their first ``depth`` bytes, and the longest common
    prefix (up to ``depth``) of each with the one before it. ``raw`` must reach ``depth`` bytes beyond every start."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8))).astype(np.uint64)
    word = np.zeros(len(raw) + 1, np.uint64)  # eight bytes, big-endian, at every position
    for k in range(8):
        word = word << np.uint64(8) | padded[k:len(raw) + 1 + k]
    words = [word[np.minimum(starts + k, len(raw))] for k in range(0, depth, 8)]
    order = np.lexsort(words[::-1])
    lcp = np.zeros(len(starts), np.int64)
    same = np.ones(max(len(starts) - 1, 0), bool)
    for w in words:
        x = w[order[1:]] ^ w[order[:-1]]
        equal = np.full(len(x), 8)
        for b in range(8):  # leading equal bytes of the word
            equal = np.where((x >> np.uint64(8 * b)) != 0, 7 - b, equal)
        lcp[1:] += np.where(same, equal, 0)
        same &= x == 0
    return order, lcp


def intervals(lcp: list[int], least: int):
    """The common-prefix interval tree by a stack scan: (first, last, length) of every interval of neighbouring suffixes
    whose longest common prefix is at least ``least``, inner ones first."""
    stack: list[tuple[int, int]] = []  # (first suffix, length)
    for i, n in enumerate([*lcp[1:], 0], 1):
        first = i - 1
        while stack and stack[-1][1] > n:
            first, length = stack.pop()
            yield first, i - 1, length
        if n >= least and (not stack or stack[-1][1] < n):
            stack.append((first, n))


def maximal_repeats(texts: list[bytes], least: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, start), ...]) of every maximal repeat of at least ``least`` bytes (up to twice that length): an interval whose
    suffixes have different bytes before them (or a beginning), so that it can't be extended to the left. All
    occurrences are listed, also those inside longer repeats."""
    gap = np.zeros(2 * least, np.uint8)
    starts, owner, parts, at = [], [], [], 0
    for i, t in enumerate(texts):
        raw = np.frombuffer(t, np.uint8)
        starts.append(np.arange(max(0, len(t) - least + 1)) + at)
        owner.append(np.full(len(starts[-1]), i))
        parts += [raw, gap]
        at += len(t) + len(gap)
    if not texts or not sum(map(len, starts)):
        return []
    raw, starts, owner = np.concatenate(parts), np.concatenate(starts), np.concatenate(owner)
    base = np.cumsum([0, *(len(t) + len(gap) for t in texts)])
    order, lcp = suffix_array(raw, starts, 2 * least)
    room = (base[owner] + np.array([len(t) for t in texts])[owner] - starts)[order]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(room[1:], room[:-1]))
    left = np.where(starts > base[owner], raw[starts - 1].astype(int), -1 - np.arange(len(starts)))[order]
    out = []
    for first, last, length in intervals(lcp.tolist(), least):
        if len(set(left[first:last + 1].tolist())) > 1:
            members = order[first:last + 1]
            out.append((length, sorted((int(owner[i]), int(starts[i] - base[owner[i]])) for i in members)))
    return sorted(out)


_REPLY = "batch int, replies binary"


def _scan(key, pdf):
    """Step 2, in a bucket: the smallest document of every window of every context."""
    parts = [_unpack(m, np.uint8, np.uint8, np.int32, np.int32, np.int64, np.uint8) for m in pdf["contexts"]]
    batch = np.repeat(pdf["batch"].to_numpy(), [len(p[0]) for p in parts])
    n, offset, raw = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 5))
    n, split, offset = n.astype(np.int64), offset >= ALONE, (offset % ALONE).astype(np.int64)
    least, most = np.concatenate([p[4][p[2]] for p in parts]), np.concatenate([p[4][p[2] + p[3]] for p in parts])
    size = n + WINDOW - 1
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    keys, anchors = np.empty(len(n), np.uint64), np.empty(len(n), np.uint64)
    for i, j in _groups(start // SLICE):  # about a SLICE of bytes at a time
        sums, first = _sums(raw[start[i]:start[j - 1] + size[j - 1]]), start[i:j] - start[i]
        keys[i:j] = _context_keys(sums, first, first + size[i:j], offset[i:j])
        anchors[i:j] = _string_hashes(sums, first + offset[i:j], first + offset[i:j] + K)
    h = np.where(split, keys, anchors)  # a split anchor's window only meets its equals
    # equal contexts of several batches become one (their bytes are compared, not only their hash)
    order = np.lexsort((keys, h))
    same = np.concatenate(([False], (keys[order][1:] == keys[order][:-1]) & (h[order][1:] == h[order][:-1]) & (n[order][1:] == n[order][:-1])))
    for m in np.unique(size[order][same]):
        i = np.flatnonzero(same & (size[order] == m))
        for j in np.array_split(i, len(i) // 10_000 + 1):
            span = np.arange(m)
            same[j] = (raw[start[order[j]][:, None] + span] == raw[start[order[j - 1]][:, None] + span]).all(axis=1)
    variant = np.empty(len(h), np.int64)
    variant[order] = np.cumsum(~same) - 1
    lead = order[~same]  # one context of each variant, in order of anchor and key
    low = np.minimum.reduceat(least[order], np.flatnonzero(~same))
    anchor = h[lead]
    alone = np.ones(len(lead), bool)
    alone[1:] &= anchor[1:] != anchor[:-1]
    alone[:-1] &= anchor[1:] != anchor[:-1]
    # (variant, first window, last window, smallest document); a variant alone with its anchor has one for all windows
    parts = [(np.flatnonzero(alone), np.zeros(alone.sum(), np.int64), n[lead][alone] - 1, low[alone])]
    mixed = np.flatnonzero(~alone)
    for lo in _chunks(anchor[mixed], n[lead][mixed]):
        v = mixed[lo]
        m = n[lead][v]
        owner = np.repeat(v, m)
        inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        # the chunk's contexts alone, one behind the other
        long = size[lead][v]
        place = np.cumsum(long) - long
        own = raw[np.arange(long.sum()) + np.repeat(start[lead][v] - place, long)]
        at = np.repeat(place, m) + inner
        sa, lcp = suffix_array(own, at, WINDOW + 6)
        first = np.flatnonzero(lcp < WINDOW)  # the outermost intervals of at least WINDOW bytes
        smallest = np.empty(len(at), np.int64)
        smallest[sa] = np.repeat(np.minimum.reduceat(low[owner][sa], first), np.diff(np.append(first, len(sa))))
        cut = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (smallest[1:] != smallest[:-1]))))
        last = np.append(cut[1:], len(owner)) - 1
        parts.append((owner[cut], inner[cut], inner[last], smallest[cut]))
    v, a, b, s = (np.concatenate(c) for c in zip(*parts, strict=True))
    by = np.argsort(v, kind="stable")
    v, a, b, s = v[by], a[by], b[by], s[by]
    # back to every batch that holds the variant in a document larger than the smallest one
    f, e = np.searchsorted(v, variant), np.searchsorted(v, variant, "right")
    times = e - f
    entry = np.repeat(np.arange(len(h)), times)
    piece = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(f, times)
    keep = s[piece] < most[entry]
    entry, piece = entry[keep], piece[keep]
    entry_batch = batch[entry]
    by = np.argsort(entry_batch, kind="stable")
    entry, piece, entry_batch = entry[by], piece[by], entry_batch[by]
    rows = []
    for x, y in _groups(entry_batch):
        q, own = piece[x:y], entry[x:y]
        rows.append((int(entry_batch[x]), _pack(keys[own], (a[q] + ALONE * split[own]).astype(np.uint8), b[q].astype(np.uint8), s[q],
                                                np.unique(anchors[own[split[own]]]))))
    return pd.DataFrame(rows, columns=["batch", "replies"])


def _chunks(anchors: np.ndarray, windows: np.ndarray, most: int = 1 << 18):
    """Index ranges of whole anchor groups with about ``most`` windows: equal windows have equal anchors."""
    if not len(anchors):
        return
    edge = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    chunk = (np.cumsum(windows) - windows)[edge] // most
    cuts = edge[np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))]
    for s, e in zip(cuts, [*cuts[1:], len(anchors)], strict=True):
        yield np.arange(s, e)


def _single(runs, ids: np.ndarray, anchors: np.ndarray, keys: np.ndarray, earliest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first byte, end) of a slice's windows with one of the split ``anchors`` whose hash is one of ``keys`` with an earlier document."""
    sums, d, p, h, first, n, shift = runs
    many = np.flatnonzero(anchors[np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)] == h)
    run, inner = _inner(n[many])
    run = many[run]
    at = first[run] + inner
    code = _context_keys(sums, at, at + WINDOW, (p - shift - first)[run] - inner)
    i = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
    hit = np.flatnonzero((keys[i] == code) & (earliest[i] < ids[d[run]]))
    low = at[hit] + shift[run[hit]]
    return d[run[hit]], low, low + WINDOW


_CUT = "id long, hash long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(n_buckets: int, with_text: bool):
    """Step 3: remove the covered bytes of a batch's documents. ``with_text`` returns the rest, compressed (without what the
    cuts leave of a character), once for rows that are alike."""
    def run(key, docs, replies):
        if with_text:
            docs = docs.drop_duplicates(["id", "hash"])
        ids, texts = docs["id"].to_numpy(), [_unzip(z) for z in docs["z"]]
        owner = low = high = np.array([], np.int64)
        if len(replies):
            k, a, b, s, anchors = (np.concatenate(c) for c in zip(*(_unpack(m, np.uint64, np.uint8, np.uint8, np.int64, np.uint64) for m in replies["replies"]), strict=True))
            order = np.argsort(k, kind="stable")
            k, a, b, s = k[order], a[order].astype(np.int64), b[order].astype(np.int64), s[order]
            split = a >= ALONE
            single, earliest = k[split], s[split]
            k, a, b, s = (x[~split] for x in (k, a, b, s))
            d, _, code, _, _, at = _contexts(texts, None, n_buckets)
            f = np.searchsorted(k, code)
            hit = np.flatnonzero(k[np.minimum(f, len(k) - 1)] == code) if len(k) else np.array([], int)
            f = f[hit]
            times = np.searchsorted(k, code[hit], "right") - f
            run_ = np.repeat(hit, times)
            piece = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(f, times)
            keep = s[piece] < ids[d[run_]]
            run_, piece = run_[keep], piece[keep]
            owner, low, high = d[run_], at[run_] + a[piece], at[run_] + b[piece] + WINDOW
            if len(single):
                anchors = np.unique(anchors)
                more = [x for r in _runs(texts) if len((x := _single(r, ids, anchors, single, earliest))[0])]
                owner, low, high = (np.concatenate(x) for x in zip((owner, low, high), *more, strict=True))
        rows, hashes = [], docs["hash"].tolist()
        by = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[by], np.arange(len(texts) + 1))
        for i, t in enumerate(texts):
            mine = by[edges[i]:edges[i + 1]]
            kept, spans = t, 0
            if len(mine):
                change = np.zeros(len(t) + 1, np.int64)
                np.add.at(change, low[mine], 1)
                np.add.at(change, high[mine], -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1))
            whole = _pack(np.frombuffer(kept.decode("utf-8", "ignore").encode(), np.uint8)) if with_text else None
            rows.append((int(ids[i]), hashes[i], len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest(), whole))
        return pd.DataFrame(rows, columns=["id", "hash", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _steps(docs: DataFrame, with_text: bool) -> DataFrame:
    """All steps for ``docs`` (doc_id, text): the rows of ``_CUT``."""
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a batch that returns texts holds them twice more
    batch_bytes = BATCH_BYTES // 4 if with_text else BATCH_BYTES
    n_buckets, n_batches = max(least, math.ceil(total / BUCKET_BYTES)), max(least, math.ceil(total / batch_bytes))
    # dealt by id and text: null ids, or an id that many rows repeat, are no hot batch
    src = src.select("doc_id", F.xxhash64("text").alias("hash"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_batches)).cast("int").alias("batch"),
                     F.col("text").cast("binary").alias("text"))
    # one exchange, which all three passes over the batches read
    texts = src.mapInArrow(trimmed(_zip), _TEXT).repartition(n_batches, "batch")
    asks = texts.groupBy("batch").applyInPandas(trimmed(_ask(n_buckets)), _ASK)
    answers = asks.groupBy("bucket").applyInPandas(trimmed(_answer(SPLIT)), _ANSWER)
    contexts = texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(trimmed(_send(n_buckets)), _SEND)
    replies = contexts.groupBy("bucket").applyInPandas(trimmed(_scan), _REPLY)
    return texts.groupBy("batch").cogroup(replies.groupBy("batch")).applyInPandas(trimmed(_cut(n_buckets, with_text)), _CUT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    out = _steps(docs, False)
    return out.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _unpack_texts(kept):
    @F.pandas_udf("binary")
    def texts(s: pd.Series) -> pd.Series:
        return s.map(lambda m: _unpack(m, np.uint8)[0].tobytes())

    return texts(kept)


def cut_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with their columns, repeated passages cut out of ``text``; documents of which nothing is left are dropped."""
    cut = _steps(docs, True).select("id", "hash", F.struct("n_removed", "kept").alias("cut"))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    narrow = docs.select(F.struct(*others).alias("rest"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                         F.xxhash64(F.col("text").cast("string")).alias("hash"))
    out = narrow.join(cut, ["id", "hash"]).withColumn("text", _unpack_texts(F.col("cut.kept")).cast("string"))
    out = out.filter((F.col("cut.n_removed") == 0) | (F.length("text") > 0))
    return out.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def query(spark, sf_dir):
    from .common import table

    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
