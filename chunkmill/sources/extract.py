"""Text extraction from file formats (S1-S9), as native expressions over file or record tables.

Binary PDF, DOCX and XLSX decoding is out of scope: S6-S8 start from rows, pages and paragraphs
that an upstream reader produced.
"""

from __future__ import annotations

import html as html_lib
import html.entities
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import FIELD_SEPARATOR, LOADERS, SHEET_HEADER
from ..functions.text import (LINE_BREAK, col_, decode_lenient, drop_replacement_chars, has_text,
                              let, normalize_newlines, ustrip)


def suffix(path, lower: bool = True) -> Column:
    """Suffix of the last path component (``a.tar.gz`` -> ``.gz``; ``.bashrc`` -> ``""``),
    lower-cased for routing, as written for the chunk metadata."""
    name = F.regexp_extract(col_(path), r"([^/\\]*)$", 1)
    s = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.lower(s) if lower else s


def route_by_extension(path) -> Column:
    """Loader name for a path, null when the suffix is not supported."""
    m = F.create_map(*[x for kv in LOADERS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.element_at(m, suffix(path))


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """File inventory ``path, filename, dir, length, modificationTime, loader`` (content not read)."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
          .select("path", "length", "modificationTime"))
    return df.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
                     F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), "length", "modificationTime",
                     route_by_extension("path").alias("loader"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """S2 over files: one row per file ``path, filename, text`` read whole as UTF-8."""
    df = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return df.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
                     plain_text(F.col("value")).alias("text"))


def plain_text(c) -> Column:
    """Undecodable bytes dropped, ``\\r\\n`` and ``\\r`` read as ``\\n`` (text-mode reading)."""
    return normalize_newlines(drop_replacement_chars(c))


# ----------------------------------------------------------------------------------------------
# S3: HTML
# ----------------------------------------------------------------------------------------------

# An element or comment that is never closed reaches to the end of the text; a quoted attribute may hold ``>``.
SCRIPT = r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)"
STYLE = r"(?is)<style\b[^>]*>.*?(?:</style\s*>|\z)"
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
TAG = r"""<[!/?a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[!/?a-zA-Z][^>]*>"""


# A character reference behind its ``&``: decimal, hexadecimal or named.
REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# The HTML standard's table of names comes with Python; below code point 160 numbers have meanings of their own.
_NAMES = html_lib.entities.html5
_OPEN_NAMES = "^(" + "|".join(sorted((n for n in _NAMES if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
_LOW = [html_lib.unescape(f"&#{n};") for n in range(160)]


def _names_by_head() -> str:
    heads: dict[str, dict[str, str]] = {}
    for name, value in _NAMES.items():
        heads.setdefault(name[:2], {})[name] = value
    return json.dumps(heads)


def _code_point(n: Column) -> Column:
    """The character of number ``n`` (null or above the last code point: U+FFFD)."""
    lost = n.isNull() | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    none = n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE)
    return (F.when(lost, F.lit("\uFFFD")).when(n < 160, F.get(F.array(*[F.lit(c) for c in _LOW]), n.cast("int"))).when(none, F.lit(""))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))


def decode_entities(c) -> Column:
    """Character references as the HTML standard reads them, in native expressions: the text is cut at ``&`` and each
    part's leading reference replaced. A text without ``&`` is returned as it is."""
    names = F.from_json(F.lit(_names_by_head()), "map<string,map<string,string>>")

    def number(digits, base):
        d = F.regexp_replace(digits, "^0+(?=.)", "")
        return F.when(F.length(d) <= 9, F.conv(d, base, 10).cast("long"))

    def named(ref, table):
        # a name that is not listed may begin with one that needs no semicolon
        head = F.regexp_extract(ref, _OPEN_NAMES, 1)
        full = table[F.substring(ref, 1, 2)][ref]
        start = table[F.substring(head, 1, 2)][head]
        return F.coalesce(full, F.when(head != "", F.concat(start, F.substr(ref, F.length(head) + 1))), F.concat(F.lit("&"), ref))

    def part(x, table):
        def decoded(ref):
            value = (F.when(ref == "", F.lit("&")).when(ref == "amp;", F.lit("&")).when(ref == "lt;", F.lit("<")).when(ref == "gt;", F.lit(">"))
                     .when(ref == "quot;", F.lit('"')).when(ref == "nbsp;", F.lit("\u00a0"))
                     .when(ref.rlike("^#[xX]"), _code_point(number(F.regexp_extract(ref, "^#[xX]([0-9a-fA-F]+)", 1), 16)))
                     .when(ref.startswith("#"), _code_point(number(F.regexp_extract(ref, "^#([0-9]+)", 1), 10)))
                     .otherwise(named(ref, table)))
            return F.concat(value, F.substr(x, F.length(ref) + 1))

        return let(F.regexp_extract(x, REFERENCE, 1), decoded)

    def whole(t):
        parts = let(names, lambda table: F.transform(F.split(t, "&", -1), lambda x, i: F.when(i == 0, x).otherwise(part(x, table))))
        return F.when(F.contains(t, F.lit("&")), F.array_join(parts, "")).otherwise(t)

    return let(col_(c), whole)


def html_to_text(html) -> Column:
    """S3: visible text of a page: script/style elements and comments removed, tags dropped
    (text nodes concatenated), references decoded; then per line stripped, split at double
    blanks, pieces stripped, empty ones dropped, joined by ``\\n``. Regex-defined, so malformed
    HTML is read by these rules, not by an HTML parser."""
    t = F.regexp_replace(F.regexp_replace(col_(html), SCRIPT, ""), STYLE, "")
    t = F.regexp_replace(t, COMMENT, "")
    t = F.regexp_replace(t, TAG, "")
    t = decode_entities(t)
    lines = F.transform(F.split(t, LINE_BREAK, -1), lambda x: ustrip(x))
    phrases = F.flatten(F.transform(lines, lambda x: F.split(x, "  ", -1)))
    return F.array_join(F.filter(F.transform(phrases, lambda x: ustrip(x)), lambda x: x != ""), "\n")


# ----------------------------------------------------------------------------------------------
# notebooks
# ----------------------------------------------------------------------------------------------

_NB_CELL = ("struct<cell_type: string, source: variant, "
            "outputs: array<struct<text: variant, data: map<string, variant>>>>")
# version 4 keeps cells at the top; version 3 keeps them in worksheets (read as an upgrade would)
_NB_SCHEMA = f"struct<cells: array<{_NB_CELL}>, worksheets: array<struct<cells: array<{_NB_CELL}>>>>"


def _multiline(v: Column) -> Column:
    """nbformat text fields are a string or a list of strings."""
    return (F.when(F.schema_of_variant(v).startswith("ARRAY"),
                   F.array_join(F.try_variant_get(v, "$", "array<string>"), ""))
            .otherwise(F.try_variant_get(v, "$", "string")))


def notebook_to_text(nb_json) -> Column:
    """Markdown cells' source and code cells' outputs (``text``, else ``data['text/plain']``)
    in order, joined by a blank line; code itself is not included. Null when not a notebook."""
    nb = F.from_json(col_(nb_json), _NB_SCHEMA)

    def cell_parts(cell):
        md = F.array(_multiline(cell["source"]))
        outs = F.transform(F.coalesce(cell["outputs"], F.array()),
                           lambda o: F.when(o["text"].isNotNull(), _multiline(o["text"]))
                           .otherwise(_multiline(F.element_at(o["data"], F.lit("text/plain")))))
        return (F.when(cell["cell_type"] == "markdown", md)
                .when(cell["cell_type"] == "code", F.filter(outs, lambda x: x.isNotNull()))
                .otherwise(F.array().cast("array<string>")))

    cells = F.coalesce(nb["cells"], F.flatten(F.transform(nb["worksheets"], lambda w: w["cells"])))
    return F.when(nb.isNotNull() & cells.isNotNull(), F.array_join(F.flatten(F.transform(cells, cell_parts)), "\n\n"))


# ----------------------------------------------------------------------------------------------
# Records, sheets, pages, paragraphs
# ----------------------------------------------------------------------------------------------

def record_line(fields) -> Column:
    """S5/S6 row text: fields (nulls as ``""``) joined by `` | ``."""
    return F.array_join(F.transform(col_(fields), lambda x: F.coalesce(x, F.lit(""))), FIELD_SEPARATOR)


def ordered_join(df: DataFrame, key: list[str], order: str, text: str, sep: str, out: str = "text") -> DataFrame:
    """Texts of a group joined in ``order`` (one file, sheet or document per group)."""
    g = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_p"))
    return g.select(*key, F.array_join(F.transform("_p", lambda p: p["t"]), sep).alias(out))


def csv_records_to_text(records: DataFrame, file: str = "file", order: str = "record_no", fields: str = "fields") -> DataFrame:
    """Per file, each non-empty record's fields joined by `` | ``, records joined by ``\\n``."""
    r = records.where(F.size(fields) > 0).withColumn("_line", record_line(fields))
    return ordered_join(r, [file], order, "_line", "\n")


# Python csv (excel dialect): fields separated by commas; a field may be quoted, with "" for a
# quote and line breaks inside; records end at a line break outside quotes.
# Possessive runs: the matcher loops instead of recursing, so cells may be of any length.
_CSV_QUOTED = r'"(?:[^"]++|"")*+"'
_CSV_RECORD = rf'(?:{_CSV_QUOTED}|[^"\n]++|")++'
_CSV_FIELD = rf',((?:{_CSV_QUOTED}|[^",]++|")*+)'  # applied to "," + record: every match is non-empty


def csv_file_records(text) -> Column:
    """A whole CSV file (text) -> ARRAY of records, each an ARRAY of fields, blank lines skipped;
    rows keep their own width. Native regular expressions, one file per row."""
    t = normalize_newlines(col_(text))
    recs = F.filter(F.regexp_extract_all(t, F.lit(_CSV_RECORD), 0), lambda r: r != "")

    def unquote(f):
        quoted = f.rlike(r'(?s)^".*"$') & (F.length(f) >= 2)
        return F.when(quoted, F.regexp_replace(f.substr(F.lit(2), F.length(f) - 2), '""', '"')).otherwise(f)

    return F.transform(recs, lambda r: F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), r), F.lit(_CSV_FIELD), 1), unquote))


def csv_file_to_text(text) -> Column:
    """S5 on a whole file: each record's fields joined by `` | ``, records joined by ``\\n``."""
    return F.array_join(F.transform(csv_file_records(text), lambda r: record_line(r)), "\n")


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV files as records ``file, record_no, fields``: blank lines skipped, header kept as a record,
    every record with its own number of fields. A file with quoted line breaks cannot be split, so
    each file is one row until its records are exploded."""
    df = spark.read.format("binaryFile").load(path)
    return df.select(F.col("path").alias("file"), F.posexplode(csv_file_records(decode_lenient(F.col("content")))).alias("record_no", "fields"))


def sheet_rows_to_text(rows: DataFrame, workbook: str = "workbook", sheet_no: str = "sheet_no", sheet: str = "sheet",
                       row_no: str = "row_no", cells: str = "cells") -> DataFrame:
    """Per workbook, per sheet in order: ``Sheet: <name>``, each row that is not all-null
    (nulls as ``""``) joined by `` | ``, then an empty line; all joined by ``\\n``."""
    r = rows.where(F.exists(cells, lambda x: x.isNotNull())).withColumn("_line", record_line(cells))
    per_sheet = (rows.select(workbook, sheet_no, sheet).distinct()
                 .join(ordered_join(r, [workbook, sheet_no], row_no, "_line", "\n", "_rows"), [workbook, sheet_no], "left"))
    block = F.concat(F.lit(SHEET_HEADER), F.col(sheet), F.lit("\n"),
                     F.when(F.col("_rows").isNotNull(), F.concat(F.col("_rows"), F.lit("\n"))).otherwise(F.lit("")))
    return ordered_join(per_sheet.withColumn("_block", block), [workbook], sheet_no, "_block", "\n")


def pages_to_text(pages: DataFrame, doc: str = "doc", page_no: str = "page_no", text: str = "text") -> DataFrame:
    """Non-empty page texts in order joined by a blank line."""
    p = pages.where(F.col(text).isNotNull() & (F.length(text) > 0))
    return ordered_join(p, [doc], page_no, text, "\n\n")


def paragraphs_to_text(paragraphs) -> Column:
    """S8 on an ordered paragraph array: paragraphs with non-blank text, unchanged, joined by a
    blank line."""
    return F.array_join(F.filter(col_(paragraphs), lambda p: has_text(p)), "\n\n")


# ----------------------------------------------------------------------------------------------
# Nested JSON -> "path: value" lines
# ----------------------------------------------------------------------------------------------

def json_leaves(text: str) -> list[str]:
    """Leaf lines ``path: value`` of one JSON text in document order, values as Python prints them
    (integers of any length, ``repr`` of floats, None, True). Containers are walked with a stack
    of iterators, so nesting is limited only by the JSON decoder itself."""
    def children(name, value):
        if isinstance(value, dict):
            return ((f"{name}.{k}" if name else k, v) for k, v in value.items())
        return ((f"{name}[{i}]", v) for i, v in enumerate(value))

    out, stack = [], [iter([("", json.loads(text))])]
    while stack:
        for name, value in stack[-1]:
            if isinstance(value, (dict, list)):
                stack.append(iter(children(name, value)))
                break
            out.append(f"{name}: {value}")
        else:
            stack.pop()
    return out


def _leaves_or_none(text: str | None) -> list[str] | None:
    try:
        return None if text is None else json_leaves(text)
    except (ValueError, RecursionError):  # not JSON, or nested deeper than the decoder goes
        return None


def flatten_json_lines(df: DataFrame, key: str, json_col: str) -> DataFrame:
    """One row per leaf ``key, line_no, line``. Objects give ``a.b``, lists ``a[0]``; empty containers
    give nothing; a scalar root gives ``: value``; a repeated key keeps its last value; a text that is
    not JSON gives no row. No shuffle: each text is flattened where it is."""
    @F.pandas_udf("array<string>")
    def leaves(s: pd.Series) -> pd.Series:
        return s.map(_leaves_or_none)

    return df.select(key, F.posexplode(leaves(F.col(json_col))).alias("line_no", "line"))


def flatten_json_to_text(df: DataFrame, key: str, json_col: str) -> DataFrame:
    """``key, text`` with the leaf lines in document order joined by ``\n``; texts without a leaf give
    no row."""
    @F.pandas_udf("string")
    def joined(s: pd.Series) -> pd.Series:
        return s.map(lambda t: "\n".join(_leaves_or_none(t) or ()) or None)

    return df.select(key, joined(F.col(json_col)).alias("text")).where(F.col("text").isNotNull())
