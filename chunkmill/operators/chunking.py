"""Splitting documents into chunks.

Every splitter is a Column expression over one document row that returns ``ARRAY<STRING>``;
``explode_chunks`` turns the array into chunk rows. A document is one row, so chunking needs no
shuffle at all: chunk order, ``chunk_index`` and ``total_chunks`` come from the array itself.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import DEFAULT_OVERLAP, DEFAULT_SEPARATORS, DEFAULT_SIZE
from ..functions.text import NON_WS_CLASS, STRIP_PATTERN, WS_CLASS, col_, let, ustrip

# Fixed value: sentence boundary of the semantic splitter (after . ? or !, then white space).
SENTENCE_SPLIT = "(?<=[.?!])" + WS_CLASS + "+"

_CHUNK_ITEM = "array<struct<txt:string,nxt:int>>"


def _sql_str(s: str) -> str:
    out = s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return "'" + out + "'"


def _regex_quote(s: str) -> str:
    return "".join("\\" + ch if ch in ".^$|?*+()[]{}\\" else ch for ch in s)


def _check(size: int, overlap: int) -> None:
    if size < 2 or overlap < 0 or overlap >= size:
        raise ValueError(f"need size >= 2 and 0 <= overlap < size, got size={size}, overlap={overlap}")


# ---------------------------------------------------------------------------------------------
# Fixed windows
# ---------------------------------------------------------------------------------------------

def _blocks_sql(t: str, size: int) -> str:
    """The text as consecutive blocks of ``size`` code points, in one pass. A stretch of at most ``size`` is
    then cut from two blocks, whatever its place, instead of walking from the start of the text."""
    return f"regexp_extract_all({t}, '(?s).{{1,{size}}}', 0)"


def _cut_sql(start: str, length: str, size: int) -> str:
    """``length`` code points from offset ``start`` of the text whose blocks are ``B``."""
    j = f"CAST(({start}) div {size} AS INT)"
    return f"substring(concat(get(B, {j}), coalesce(get(B, {j} + 1), '')), CAST(({start}) % {size} AS INT) + 1, {length})"


def _window_items_sql(t: str, size: int, overlap: int, strip_sql) -> str:
    step = size - overlap
    n = f"greatest(1, CAST(ceil((length({t}) - {overlap}) / {step}) AS INT))"
    return (
        f"transform(sequence(0, {n} - 1), k -> named_struct('txt', {strip_sql(_cut_sql(f'k * {step}', str(size), size))},"
        f" 'nxt', -1))"
    )


def window_chunks(text, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> Column:
    """Windows of ``size`` code points every ``size - overlap``; each window stripped, blank ones
    dropped. Equals the recursive splitter on a text without any separator."""
    _check(size, overlap)
    step = size - overlap
    t = col_(text)
    n = F.greatest(F.lit(1), F.ceil((F.length(t) - overlap) / step).cast("int"))

    def windows(b):
        def cut(k):
            j = F.floor(k * step / size).cast("int")
            two = F.concat(F.get(b, j), F.coalesce(F.get(b, j + 1), F.lit("")))
            return ustrip(F.substring(two, k * step - j * size + 1, size))

        return F.transform(F.sequence(F.lit(0), n - 1), cut)

    wins = let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), windows)
    return F.filter(wins, lambda w: w != "")


# ---------------------------------------------------------------------------------------------
# Recursive splitting with greedy packing and overlap
# ---------------------------------------------------------------------------------------------

def _level_sql(t: str, frm: str, size: int, overlap: int, seps: list[str]) -> str:
    """One recursion level for segment ``t`` searching separators from index ``frm``.

    Returns ``array<struct<txt, nxt>>`` in text order: ``nxt = -1`` marks a finished chunk,
    ``nxt >= 0`` a piece that is too long and must be split again from separator ``nxt``.
    """
    m = len(seps)
    strip = lambda e: f"regexp_replace({e}, {_sql_str(STRIP_PATTERN)}, '')"
    # separator choice: first separator (from ``frm`` on) that occurs, or the empty one
    whens = []
    for i, s in enumerate(seps):
        cond = f"{frm} <= {i}" if s == "" else f"{frm} <= {i} AND instr({t}, {_sql_str(s)}) > 0"
        whens.append(f"WHEN {cond} THEN {i}")
    choice = f"CASE {' '.join(whens)} ELSE {m - 1} END"
    seps_arr = "array(" + ", ".join(_sql_str(s) for s in seps) + ")"
    regex_arr = "array(" + ", ".join(_sql_str(_regex_quote(s)) for s in seps) + ")"
    sep = f"element_at({seps_arr}, c + 1)"
    # pieces keep their separator in front; empty pieces are dropped
    pieces = (
        f"filter(transform(split({t}, element_at({regex_arr}, c + 1), -1), (x, i) -> IF(i = 0, x, concat({sep}, x))),"
        f" x -> x != '')"
    )
    nxt = f"IF(c + 1 < {m}, c + 1, -1)"
    emit = f"array(named_struct('txt', {strip(_cut_sql('acc.apos', 'acc.tot', size))}, 'nxt', -1))"
    lj = "element_at(L, i)"
    # drop pieces from the front of the window until it holds at most ``overlap`` and the next
    # piece fits (integers only: start piece, its offset, window length)
    pop = (
        f"aggregate(sequence(acc.a, i - 1),"
        f" named_struct('a', acc.a, 'apos', acc.apos, 'tot', acc.tot, 'pos', acc.pos, 'out', concat(acc.out, {emit})),"
        f" (st, x) -> IF(st.tot > {overlap} OR (st.tot + {lj} > {size} AND st.tot > 0),"
        f"   named_struct('a', st.a + 1, 'apos', st.apos + element_at(L, st.a), 'tot', st.tot - element_at(L, st.a),"
        f"                'pos', st.pos, 'out', st.out), st),"
        f" st -> named_struct('a', st.a, 'apos', st.apos, 'tot', st.tot + {lj}, 'pos', st.pos + {lj}, 'out', st.out))"
    )
    step = (
        f"IF({lj} >= {size},"
        # too long: close the current window, hand the piece to the next level
        f" named_struct('a', i + 1, 'apos', acc.pos + {lj}, 'tot', 0, 'pos', acc.pos + {lj},"
        f"   'out', concat(acc.out, IF(acc.tot > 0, {emit}, CAST(array() AS {_CHUNK_ITEM})),"
        f"                 array(named_struct('txt', element_at(P, i), 'nxt', {nxt})))),"
        f" IF(acc.tot + {lj} > {size} AND acc.tot > 0, {pop},"
        f"   named_struct('a', acc.a, 'apos', acc.apos, 'tot', acc.tot + {lj}, 'pos', acc.pos + {lj}, 'out', acc.out)))"
    )
    init = f"named_struct('a', 1, 'apos', 0, 'tot', 0, 'pos', 0, 'out', CAST(array() AS {_CHUNK_ITEM}))"
    finish = f"acc -> IF(acc.tot > 0, concat(acc.out, {emit}), acc.out)"
    merge = (
        f"IF(size(P) = 0, CAST(array() AS {_CHUNK_ITEM}),"
        f" aggregate(sequence(1, size(P)), {init}, (acc, i) -> {step}, {finish}))"
    )
    packed = f"transform(array({pieces}), P -> transform(array(transform(P, x -> length(x))), L -> {merge})[0])[0]"
    window = _window_items_sql(t, size, overlap, strip)
    return f"transform(array({_blocks_sql(t, size)}), B -> transform(array({choice}), c -> IF({sep} = '', {window}, {packed}))[0])[0]"


def recursive_chunks(text: str, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP,
                     separators: list[str] | None = None) -> Column:
    """C1 on the column named ``text``: split by the first separator present, keep the separator
    at the start of the next piece, recurse into pieces of ``size`` or more code points with the
    remaining separators, pack runs of shorter pieces greedily up to ``size`` carrying up to
    ``overlap`` into the next chunk; chunks are stripped and blank ones dropped.

    One row in, one array out: the recursion depth is bounded by the number of separators, so it
    unrolls into a fixed expression of array functions (no Python, no shuffle). Packing keeps
    integers (window start, offset, length) in the accumulator, never strings.
    """
    _check(size, overlap)
    seps = list(DEFAULT_SEPARATORS if separators is None else separators)
    if not seps:
        raise ValueError("need at least one separator")
    items = _level_sql(f"`{text}`", "0", size, overlap, seps)
    for _ in range(len(seps) - 1):
        inner = _level_sql("it.txt", "it.nxt", size, overlap, seps)
        items = f"flatten(transform({items}, it -> IF(it.nxt < 0, array(it), {inner})))"
    return F.expr(f"transform(filter({items}, z -> z.txt != ''), z -> z.txt)")


# ---------------------------------------------------------------------------------------------
# The same splitters by any measure of length
# ---------------------------------------------------------------------------------------------

# A run without white space. Printable ASCII runs are read by one range, not by the whole class.
WORD = f"(?:[!-~]++|{NON_WS_CLASS})++"
MEASURES = {
    "chars": lambda t: F.length(t),
    "words": lambda t: F.size(F.regexp_extract_all(t, F.lit(WORD), F.lit(0))),
    "bytes": lambda t: F.octet_length(t),
}


def _measure(length):
    """A Column function from text to a non-negative integer: a name in ``MEASURES`` or the function itself."""
    return MEASURES[length] if isinstance(length, str) else length


def _spans(measures: Column, size: int, overlap: int) -> Column:
    """Greedy packing over the measures of consecutive pieces: ``array<struct<a, e, long>>`` in text order, pieces ``a`` to ``e``
    (1-based, inclusive) form one chunk; ``long`` marks one piece that measures ``size`` or more and stands alone.

    The fold keeps integers only. ``a`` is the window's first piece, ``tot`` its measure; closing a window drops pieces from its
    front until at most ``overlap`` is left and the next piece fits."""
    def state(a, tot, out):
        return F.struct(a.cast("int").alias("a"), tot.cast("long").alias("tot"), out.alias("out"))

    def span(a, e, long=False):
        return F.array(F.struct(a.cast("int").alias("a"), e.cast("int").alias("e"), F.lit(long).alias("long")))

    none = F.expr("CAST(array() AS array<struct<a:int,e:int,long:boolean>>)")

    def closed(acc, i):
        return F.when(acc["a"] < i, F.concat(acc["out"], span(acc["a"], i - 1))).otherwise(acc["out"])

    def shifted(acc, i, m):
        drop = F.aggregate(
            F.sequence(acc["a"], i - 1), F.struct(acc["a"].alias("a"), acc["tot"].alias("tot")),
            lambda st, _: F.when((st["tot"] > overlap) | ((st["tot"] + m > size) & (st["tot"] > 0)),
                                 F.struct((st["a"] + 1).alias("a"), (st["tot"] - F.element_at(measures, st["a"])).alias("tot")))
            .otherwise(st))
        return let(drop, lambda st: state(st["a"], st["tot"] + m, closed(acc, i)))

    def step(acc, i):
        m = F.element_at(measures, i)
        return (F.when(m >= size, state(i + 1, F.lit(0), F.concat(closed(acc, i), span(i, i, True))))
                .when((acc["tot"] + m > size) & (acc["a"] < i), shifted(acc, i, m))
                .otherwise(state(acc["a"], acc["tot"] + m, acc["out"])))

    n = F.size(measures)
    return F.when(n == 0, none).otherwise(F.aggregate(
        F.sequence(F.lit(1), n), state(F.lit(1), F.lit(0), none), step, lambda acc: closed(acc, n + 1)))


def _joined(pieces: Column, a: Column, e: Column) -> Column:
    return F.array_join(F.slice(pieces, a, e - a + 1), "")


def _items(pieces: Column, measure, size: int, overlap: int, nxt: Column) -> Column:
    """``array<struct<txt, nxt>>``: finished chunks (stripped, ``nxt = -1``) and long pieces with the separator to go on with."""
    def item(p, s):
        txt = _joined(p, s["a"], s["e"])
        again = s["long"] & (nxt >= 0)
        return F.struct(F.when(s["long"], txt).otherwise(ustrip(txt)).alias("txt"), F.when(again, nxt).otherwise(F.lit(-1)).alias("nxt"))

    return let(pieces, lambda p: let(F.transform(p, lambda x: measure(x).cast("long")), lambda m: F.transform(
        _spans(m, size, overlap), lambda s: item(p, s))))


def measured_chunks(text, size: int, overlap: int, length="words", separators: list[str] | None = None) -> Column:
    """C1 by any measure: pieces, separators, packing and overlap as in ``recursive_chunks``, but ``size`` and ``overlap`` count what
    ``length`` measures (P3): ``chars``, ``words``, ``bytes`` or a function from a text Column to an integer Column. A window
    measures the sum of its pieces. The empty separator cuts single code points, each measured on its own. A null text
    gives null, an empty one no chunk; a long piece left after the last separator is kept as it is."""
    _check(size, overlap)
    measure = _measure(length)
    seps = list(DEFAULT_SEPARATORS if separators is None else separators)
    if not seps:
        raise ValueError("need at least one separator")

    def pieces(t, c):
        def cut(sep):
            if sep == "":
                return F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))
            parts = F.transform(F.split(t, _regex_quote(sep), -1), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(sep), x)))
            return F.filter(parts, lambda x: x != "")

        out = cut(seps[-1])
        for i in reversed(range(len(seps) - 1)):
            out = F.when(c == i, cut(seps[i])).otherwise(out)
        return out

    def level(t, frm):
        # the first separator from ``frm`` on that occurs; the empty one always does; else the last
        choice = F.lit(len(seps) - 1)
        for i in reversed(range(len(seps))):
            found = F.lit(True) if seps[i] == "" else F.instr(t, seps[i]) > 0
            choice = F.when((frm <= i) & found, F.lit(i)).otherwise(choice)
        last = [i for i, s in enumerate(seps) if s == ""] + [len(seps) - 1]
        return let(choice, lambda c: _items(pieces(t, c), measure, size, overlap,
                                            F.when(c.isin(*last), F.lit(-1)).otherwise(c + 1)))

    items = level(col_(text), F.lit(0))
    for _ in range(len(seps) - 1):
        items = F.flatten(F.transform(items, lambda it: F.when(it["nxt"] < 0, F.array(it)).otherwise(level(it["txt"], it["nxt"]))))
    return F.transform(F.filter(items, lambda z: z["txt"] != ""), lambda z: z["txt"])


# Fixed value: a word with the white space behind it, or the white space that a text begins with.
WORD_UNIT = f"{WORD}{WS_CLASS}*+|{WS_CLASS}++"


def measured_windows(text, size: int, overlap: int, length="words", unit: str = WORD_UNIT) -> Column:
    """C2 by any measure: the text cut into units (matches of ``unit``, by default words), consecutive units packed into windows of
    at most ``size``, each next window beginning with the last units of at most ``overlap``; stripped, blank ones dropped.
    A unit that measures ``size`` or more is a window of its own. With words: ``size`` words every ``size - overlap``."""
    _check(size, overlap)
    if length == "words" and unit == WORD_UNIT:
        # every unit measures one: windows by arithmetic, no fold
        step = size - overlap

        def windows(u):
            starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil((F.size(u) - overlap) / step).cast("int")) - 1)
            cut = F.transform(starts, lambda k: ustrip(F.array_join(F.slice(u, k * step + 1, size), "")))
            return F.when(u.isNotNull(), cut)

        wins = let(F.regexp_extract_all(ustrip(text), F.lit(unit), F.lit(0)), windows)
    else:
        items = _items(F.regexp_extract_all(col_(text), F.lit(unit), F.lit(0)), _measure(length), size, overlap, F.lit(-1))
        wins = F.transform(items, lambda z: ustrip(z["txt"]))
    return F.filter(wins, lambda w: w != "")



def chunk_with(df: DataFrame, text_col: str, splitter: str = "recursive", out: str = "chunks", **kw) -> DataFrame:
    """Add ``out`` (ARRAY<STRING>) with the chosen splitter (C1, C2, C7 or C10) on ``text_col``; with ``length`` C1 and C2 go by
    that measure (P3)."""
    if splitter in ("recursive", "window") and "length" in kw:
        by = measured_chunks if splitter == "recursive" else measured_windows
        return df.withColumn(out, by(F.col(text_col), **kw))
    if splitter == "recursive":
        return df.withColumn(out, recursive_chunks(text_col, **kw))
    if splitter == "window":
        return df.withColumn(out, window_chunks(F.col(text_col), **kw))
    if splitter == "semantic":
        return df.withColumn(out, semantic_chunks(F.col(text_col), **kw))
    if splitter == "paragraph":
        return df.withColumn(out, paragraph_chunks(F.col(text_col), **kw))
    raise ValueError(f"unknown splitter {splitter!r}")


# ---------------------------------------------------------------------------------------------
# Semantic splitting
# ---------------------------------------------------------------------------------------------

def split_sentences(text) -> Column:
    """Sentences split after ``. ? !`` followed by white space (empty trailing piece kept)."""
    return F.split(col_(text), SENTENCE_SPLIT, -1)


def token_buckets(text, dim: int = 64) -> Column:
    """Word tokens of the lower-cased text hashed into ``[0, dim)`` by the first 32 bits of md5."""
    toks = F.filter(F.split(F.lower(col_(text)), "[^\\p{L}\\p{N}_]+", -1), lambda w: w != "")
    return F.transform(toks, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dim)))


def bucket_counts(buckets, dim: int = 64) -> Column:
    """Dense count vector of a bucket list; each count is one native ``array_remove`` pass."""
    return let(col_(buckets), lambda b: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: (F.size(b) - F.size(F.array_remove(b, i.cast("long")))).cast("double")))


def unit(v) -> Column:
    return let(col_(v), lambda v: let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)),
                                      lambda norm: F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))))


def sparse_counts(buckets) -> Column:
    """Sorted runs of a bucket list: ``array<struct<bucket, n>>``. One sort and one pass over its run ends."""
    def runs(b):
        last = F.filter(F.sequence(F.lit(1), F.size(b)), lambda i: (i == F.size(b)) | (F.element_at(b, i) != F.get(b, i)))
        return let(last, lambda e: F.transform(e, lambda i, k: F.struct(
            F.element_at(b, i).alias("bucket"), (i - F.when(k > 0, F.get(e, k - 1)).otherwise(F.lit(0))).cast("long").alias("n"))))

    none = F.expr("CAST(array() AS array<struct<bucket:bigint,n:bigint>>)")
    return let(F.array_sort(col_(buckets)), lambda b: F.when(F.size(b) > 0, runs(b)).otherwise(none))


def sparse_unit(buckets) -> Column:
    """The non-zero components ``array<struct<bucket, weight>>`` of ``hashed_embedding``, from a bucket list."""
    def scaled(r):
        norm = F.sqrt(F.aggregate(r, F.lit(0).cast("long"), lambda acc, x: acc + x["n"] * x["n"]).cast("double"))
        return let(norm, lambda d: F.transform(r, lambda x: F.struct(x["bucket"].alias("bucket"), (x["n"] / d).alias("weight"))))

    return let(sparse_counts(buckets), scaled)


def hashed_embedding(text, dim: int = 64) -> Column:
    """C4 default embedder: bag of lower-cased word tokens hashed into ``dim`` buckets by md5,
    L2-normalised (all zeros when the text has no token). Native expressions only; a model-backed
    embedder can replace it (any Column of ARRAY<DOUBLE>)."""
    return unit(bucket_counts(token_buckets(text, dim), dim))


def cosine_distance(a, b) -> Column:
    """1 - cosine similarity of two vectors (C5); null when either side is null; similarity 0
    when either vector is all zeros."""
    def body(p):
        a, b = p["a"], p["b"]
        dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
        na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))
        nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x * x))
        sim = F.when((na > 0) & (nb > 0), dot / (na * nb)).otherwise(F.lit(0.0))
        return F.when(a.isNotNull() & b.isNotNull(), F.lit(1.0) - sim)

    return let(F.struct(col_(a).alias("a"), col_(b).alias("b")), body)


def adjacent_distances(df: DataFrame, key: str, order: str, vec: str, out: str = "distance") -> DataFrame:
    """Distance between each vector and the previous one in ``order`` within ``key`` (null for
    the first). The previous vector comes from ``ordinal_lag`` (a join on a global ordinal), not
    from a window partitioned by ``key``, so one large group does not land in one task."""
    from .grouped import ordinal_lag

    lagged = ordinal_lag(df, key, order, [vec], suffix="_prev")
    return lagged.withColumn(out, cosine_distance(F.col(vec + "_prev"), F.col(vec))).drop(vec + "_prev")


def percentile_breaks(df: DataFrame, key: str, dist: str = "distance", amount: float = 50.0,
                      out: str = "is_break", digits: int = 9) -> DataFrame:
    """Flag distances above the ``amount``-th percentile (linear interpolation) of their group.

    Distances are rounded to ``digits`` first so ties do not depend on summation order. The
    threshold comes from ``grouped_percentile`` (global ordinal + joins on it), not from a
    percentile aggregate that would hold a large group's values in one task."""
    from .grouped import grouped_percentile

    r = df.withColumn("_r", F.round(F.col(dist), digits))
    thr = grouped_percentile(r, key, "_r", amount / 100.0, out="_thr")
    return (r.join(thr, key, "left")
            .withColumn(out, F.coalesce(F.col("_r") > F.col("_thr"), F.lit(False))).drop("_thr", "_r"))


def semantic_chunks(text, amount: float = 50.0, dim: int = 64, max_chars: int | None = None,
                    digits: int = 9, embedder=None) -> Column:
    """C7 on one document row: sentences (C3) -> each sentence with one neighbour per side ->
    hashed embedding (C4) -> distance to the next sentence (C5) -> break where the distance is
    above the document's ``amount``-th percentile (C6, linear interpolation) -> sentences of a group
    joined by one blank. A text of one sentence stays whole. ``max_chars`` (off by default, as in
    the original) re-splits over-long groups with C2. Array expressions only; no shuffle.

    ``embedder`` (optional) maps the document's ARRAY of neighbour-joined sentences to an ARRAY of
    vectors, e.g. ``pandas_embedder(load_model)``; the default is the hashed embedder (C4)."""
    return sentence_groups(split_sentences(text), amount, dim, max_chars, digits, embedder)


def neighbour_windows(s: Column) -> Column:
    """Each sentence joined by a blank with one neighbour on each side."""
    n = F.size(s)
    return F.transform(F.sequence(F.lit(0), n - 1),
                       lambda i: F.array_join(F.slice(s, F.greatest(i - 1, F.lit(0)) + 1,
                                                      F.least(i + 1, n - 1) - F.greatest(i - 1, F.lit(0)) + 1), " "))


def sentence_groups(sentences: Column, amount: float = 50.0, dim: int = 64, max_chars: int | None = None,
                    digits: int = 9, embedder=None) -> Column:
    """Group ordered sentences where the neighbour distance exceeds the percentile."""

    def with_vectors(s, vecs):
        n = F.size(s)

        def with_norms(v, norms):
            # the same arithmetic as ``cosine_distance``, with each vector's norm computed once
            def dist(i):
                a, b = F.element_at(v, i + 1), F.element_at(v, i + 2)
                dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
                return distance(dot, F.element_at(norms, i + 1), F.element_at(norms, i + 2))

            return F.transform(F.sequence(F.lit(0), n - 2), dist)

        dists = let(vecs, lambda v: let(
            F.transform(v, lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y * y))),
            lambda norms: with_norms(v, norms)))
        return let(dists, lambda d: _groups(s, n, d, amount))

    def distance(dot, na, nb):
        sim = F.when((na > 0) & (nb > 0), dot / (na * nb)).otherwise(F.lit(0.0))
        return F.round(F.lit(1.0) - sim, digits)

    def with_sentences(s):
        n = F.size(s)
        # A window is the token multiset of a sentence and its two neighbours, so every dot product of windows is a sum of
        # products of sentences at most three apart. Those are sparse and exact integers: runs of one against the other's map.
        runs = F.transform(s, lambda x: let(sparse_counts(token_buckets(x, dim)), lambda r: F.struct(
            r.alias("r"), F.map_from_entries(r).alias("m"))))

        def products(c):
            def product(p, k):
                other = F.get(c, p + k)["m"]
                return F.when(p + k < n, F.aggregate(F.get(c, p)["r"], F.lit(0).cast("long"), lambda acc, x: acc + x["n"] * F.coalesce(
                    other[x["bucket"]], F.lit(0).cast("long")))).otherwise(F.lit(0).cast("long"))

            return F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.array(*[product(p, k) for k in range(4)]))

        def with_products(g):
            def at(p, k):
                return F.coalesce(F.get(F.get(g, p), F.lit(k)), F.lit(0).cast("long"))

            def norm(i):
                return F.sqrt((at(i - 1, 0) + at(i, 0) + at(i + 1, 0) + 2 * (at(i - 1, 1) + at(i, 1) + at(i - 1, 2))).cast("double"))

            def dist(i, norms):
                dot = (at(i - 1, 1) + at(i - 1, 2) + at(i - 1, 3) + at(i, 0) + 2 * at(i, 1) + at(i, 2) + at(i + 1, 0) + at(i + 1, 1))
                return distance(dot.cast("double"), F.get(norms, i), F.get(norms, i + 1))

            dists = let(F.transform(F.sequence(F.lit(0), n - 1), norm),
                        lambda norms: F.transform(F.sequence(F.lit(0), n - 2), lambda i: dist(i, norms)))
            return let(dists, lambda d: _groups(s, n, d, amount))

        return let(let(runs, products), with_products)

    if embedder is not None:
        # a Python UDF may not run inside a lambda: embed at top level, then bind the result
        both = F.struct(sentences.alias("s"), embedder(neighbour_windows(sentences)).alias("v"))
        chunks = let(both, lambda sv: F.when(F.size(sv["s"]) <= 1, sv["s"]).otherwise(with_vectors(sv["s"], sv["v"])))
    else:
        chunks = let(sentences, lambda s: F.when(F.size(s) <= 1, s).otherwise(with_sentences(s)))
    if max_chars:
        chunks = F.flatten(F.transform(chunks, lambda c: F.when(F.length(c) > max_chars, window_chunks(c, max_chars, 0))
                                       .otherwise(F.array(c))))
    return chunks


def _groups(s: Column, n: Column, d: Column, amount: float) -> Column:
    def with_sorted(srt):
        m = F.size(srt)
        pos = F.lit(amount / 100.0) * (m - 1)
        lo = F.floor(pos).cast("int")
        thr = F.element_at(srt, lo + 1) + (pos - lo) * (F.element_at(srt, F.least(lo + 2, m)) - F.element_at(srt, lo + 1))
        # break after sentence i when distance i is above the threshold; groups lie between breaks
        return let(thr, lambda t: let(F.filter(F.sequence(F.lit(0), n - 2), lambda i: F.element_at(d, i + 1) > t),
                                      lambda brk: _join_groups(s, n, brk)))

    return let(F.array_sort(d), with_sorted)


def _join_groups(s: Column, n: Column, brk: Column) -> Column:
    nb = F.size(brk)

    def start(g):
        return F.when(g == 0, F.lit(0)).otherwise(F.element_at(brk, F.greatest(g, F.lit(1))) + 1)

    def end(g):
        return F.when(g < nb, F.element_at(brk, F.least(g + 1, F.greatest(nb, F.lit(1))))).otherwise(n - 1)

    return F.transform(F.sequence(F.lit(0), nb),
                       lambda g: F.array_join(F.slice(s, start(g) + 1, end(g) - start(g) + 1), " "))


# ---------------------------------------------------------------------------------------------
# Paragraphs or fixed token counts
# ---------------------------------------------------------------------------------------------

def paragraph_chunks(text, tokens: int | None = None) -> Column:
    """One chunk per non-blank paragraph (split at line breaks), or, with ``tokens``, runs of
    that many white-space separated tokens joined by one blank."""
    t = col_(text)
    if tokens is None:
        return F.filter(F.transform(F.split(t, "\n+", -1), lambda p: ustrip(p)), lambda p: p != "")
    toks = F.filter(F.split(t, WS_CLASS + "+", -1), lambda w: w != "")
    n = F.size(toks)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / tokens).cast("int"), F.lit(1)) - 1),
                       lambda k: F.array_join(F.slice(toks, k * tokens + 1, tokens), " "))


# ---------------------------------------------------------------------------------------------
# Chunk rows and their metadata
# ---------------------------------------------------------------------------------------------

METADATA_FIELDS = ["source", "chunk_index", "total_chunks", "file_type", "processed_at"]


def explode_chunks(df: DataFrame, chunks: str = "chunks", filename: str = "filename", file_type=None,
                   processed_at=None, keep: list[str] | None = None) -> DataFrame:
    """One row per chunk with ``chunk_index`` (0-based), ``total_chunks`` and the metadata
    struct ``source, chunk_index, total_chunks, file_type, processed_at``."""
    keep = keep or []
    ft = file_type if file_type is not None else F.regexp_extract(F.col(filename), r"(\.[^./\\]*)$", 1)
    at = processed_at if processed_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    base = df.select(*keep, F.col(filename).alias("filename"), F.col(chunks).alias("_chunks"),
                     (ft if isinstance(ft, Column) else F.lit(ft)).alias("_ft"),
                     (at if isinstance(at, Column) else F.lit(at)).alias("_at"))
    # posexplode_outer + a filter above it: a plain posexplode makes Catalyst infer
    # ``size(chunks) > 0`` and push it down to the scan, evaluating the splitter twice
    rows = (base.select(*keep, "filename", F.size("_chunks").alias("total_chunks"), "_ft", "_at",
                        F.posexplode_outer("_chunks").alias("chunk_index", "chunk_text"))
            .where(F.col("chunk_text").isNotNull()))
    meta = F.struct(F.col("filename").alias("source"), F.col("chunk_index"), F.col("total_chunks"),
                    F.col("_ft").alias("file_type"), F.col("_at").alias("processed_at"))
    return rows.select(*keep, "filename", F.col("chunk_index").cast("int").alias("chunk_index"), "chunk_text",
                       F.col("total_chunks").cast("int").alias("total_chunks"), meta.alias("metadata"))


def encode_metadata(meta) -> Column:
    """Metadata struct -> JSON text."""
    return F.to_json(col_(meta))


# ---------------------------------------------------------------------------------------------
# C4: model embedders (Arrow batches, one model per Python worker)
# ---------------------------------------------------------------------------------------------

_MODELS: dict = {}


def pandas_embedder(load_model, batch_size: int = 256):
    """Column function ARRAY<STRING> -> ARRAY<ARRAY<DOUBLE>> backed by a model.

    ``load_model()`` returns an object whose ``encode(list_of_str)`` gives unit vectors; it runs
    once per Python worker (cached by the factory), not per row or batch. Texts of a whole Arrow
    batch are encoded together in slices of ``batch_size``."""

    @F.pandas_udf("array<array<double>>")
    def embed(texts: pd.Series) -> pd.Series:
        model = _MODELS.get(load_model)
        if model is None:
            model = _MODELS[load_model] = load_model()
        flat = [t for row in texts for t in (row if row is not None else [])]
        vecs = []
        for i in range(0, len(flat), batch_size):
            vecs.extend([list(map(float, v)) for v in model.encode(flat[i:i + batch_size])])
        out, k = [], 0
        for row in texts:
            m = 0 if row is None else len(row)
            out.append(vecs[k:k + m])
            k += m
        return pd.Series(out)

    return embed
