"""Text helpers as native Column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's ``str.isspace`` accepts, written as a regex class that
# both Java and RE2 read the same way. ``str.strip`` and ``str.split()`` use this set; Spark's
# ``trim`` removes blanks only, and Java ``\s`` is ASCII-only.
WS_CLASS = (
    r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
NON_WS_CLASS = "[^" + WS_CLASS[1:]
WS_CHARS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"  # the same
STRIP_PATTERN = f"^{WS_CLASS}+|{WS_CLASS}+$"
# Line breaks of Python ``str.splitlines``.
LINE_BREAK = r"\r\n|[\n\r\x{0B}\f\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """Python ``str.strip()``. Looks at both ends only; a pattern would be tried at every character."""
    return F.btrim(col_(c), F.lit(WS_CHARS))


def has_text(c) -> Column:
    """True when the value holds a non-whitespace character (Python ``bool(s.strip())``)."""
    return col_(c).rlike(NON_WS_CLASS)


def preview(c, n: int | None = None) -> Column:
    """First ``n`` characters, with ``...`` only when the text is longer."""
    from ..fixed import ELLIPSIS, PREVIEW_CHARS

    n = n or PREVIEW_CHARS
    c = col_(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ELLIPSIS))).otherwise(c)


def normalize_newlines(c) -> Column:
    """Universal-newline reading: ``\\r\\n`` and lone ``\\r`` become ``\\n``."""
    return F.regexp_replace(col_(c), r"\r\n?", "\n")


def drop_replacement_chars(c) -> Column:
    """Bytes that failed UTF-8 decoding (read as U+FFFD) are dropped, as with ``errors='ignore'``."""
    return F.regexp_replace(col_(c), "�", "")


def decode_lenient(binary: Column) -> Column:
    """Bytes read as UTF-8; those that are not are dropped (``errors='ignore'``). Valid texts keep
    their own U+FFFD characters."""
    s = binary.cast("string")
    return F.when(F.is_valid_utf8(s), s).otherwise(drop_replacement_chars(F.make_valid_utf8(s)))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (lambda variables are not re-evaluated;
    plain Column references inside lambdas would be, on every use)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fill(template: str, *values) -> Column:
    """``template.format(*values)`` as a native expression (``{}`` or ``{0}`` placeholders;
    values are Columns or column names, shown as strings)."""
    import re

    parts = re.split(r"\{(\d*)\}", template)
    out, auto = [], 0
    for i, p in enumerate(parts):
        if i % 2 == 0:
            if p:
                out.append(F.lit(p))
        else:
            idx = int(p) if p else auto
            auto += 0 if p else 1
            out.append(col_(values[idx]).cast("string"))
    return F.concat(*out)
