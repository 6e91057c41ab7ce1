"""Artifact and catalogue tables over a file inventory.

The original lists one folder on one machine; here every operator is a job over an inventory
table ``path, length, modificationTime`` (``binaryFile`` listing with content pruned)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (CHECKPOINT_PREFIX, CONFIG_FILE, EXPORT_TYPE, INVALID_NAME_CHARS, SIZE_LAST_UNIT, SIZE_UNITS,
                     WEIGHT_SUFFIXES)
from ..functions.text import NON_WS_CLASS, WS_CLASS, col_


def format_size(size) -> Column:
    """A3: bytes -> ``%.1f <unit>`` with units B..TB (step 1024), PB beyond; rounding is
    half-even on the exact value, as Python formats floats."""
    x = col_(size).cast("double")
    out = None
    for i, unit in enumerate(SIZE_UNITS):
        v = x / float(1024 ** i)
        txt = F.concat(F.format_string("%.1f", F.bround(v, 1)), F.lit(" " + unit))
        out = F.when(v < 1024.0, txt) if out is None else out.when(v < 1024.0, txt)
    return out.otherwise(F.concat(F.format_string("%.1f", F.bround(x / float(1024 ** len(SIZE_UNITS)), 1)),
                                  F.lit(" " + SIZE_LAST_UNIT)))


def flatten_model_listing(listing: DataFrame, json_col: str = "listing") -> DataFrame:
    """A1: ``{"models": [...]}`` -> one row per model: name, size text, modified, family,
    parameter_size, quantization; missing fields -> ``""`` (size 0)."""
    schema = ("struct<models: array<struct<name: string, size: long, modified_at: string, "
              "details: struct<family: string, parameter_size: string, quantization_level: string>>>>")
    m = listing.select("*", F.posexplode(F.from_json(json_col, schema)["models"]).alias("model_no", "m"))
    e = F.lit("")
    return m.select(
        *[c for c in listing.columns if c != json_col], "model_no",
        F.coalesce("m.name", e).alias("name"), format_size(F.coalesce("m.size", F.lit(0))).alias("size"),
        F.coalesce("m.modified_at", e).alias("modified"), F.coalesce("m.details.family", e).alias("family"),
        F.coalesce("m.details.parameter_size", e).alias("parameter_size"),
        F.coalesce("m.details.quantization_level", e).alias("quantization"))


def parse_text_table(tables: DataFrame, text_col: str = "text", legacy: bool = False) -> DataFrame:
    """A2: white-space separated table text -> rows ``line_no, name, size, modified``; header and
    rows of fewer than 3 fields dropped. ``size`` is the value with its unit (``4.7 GB``) and
    ``modified`` the rest; ``legacy=True`` gives the original column split (size ``4.7``,
    modified ``GB 2 days ago``)."""
    strip = F.regexp_replace(F.col(text_col), f"^{WS_CLASS}+|{WS_CLASS}+$", "")
    lines = tables.select("*", F.posexplode(F.split(strip, "\n", -1)).alias("line_no", "line")).where("line_no > 0")
    parts = F.filter(F.split(F.col("line"), WS_CLASS + "+", -1), lambda p: p != "")
    r = lines.withColumn("_p", parts).where(F.size("_p") >= 3)
    if legacy:
        size, rest = F.element_at("_p", 3), F.slice("_p", F.lit(4), F.size("_p"))
    else:
        size = F.concat_ws(" ", F.element_at("_p", 3), F.element_at("_p", 4))
        rest = F.slice("_p", F.lit(5), F.size("_p"))
    keep = [c for c in tables.columns if c != text_col]
    return r.select(*keep, "line_no", F.element_at("_p", 1).alias("name"), size.alias("size"),
                    F.array_join(rest, " ").alias("modified"))


def parent_dirs(path) -> Column:
    """All ancestor folders of a path (``a/b/c.txt`` -> ``a``, ``a/b``)."""
    parts = F.split(col_(path), "/", -1)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                       lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def dir_size(inventory: DataFrame) -> DataFrame:
    """A4: recursive size per folder (every ancestor of every file). Combined map-side, so the
    root folder (all rows) is not one task's burden."""
    a = inventory.where(F.instr("path", "/") > 0).select(F.explode(parent_dirs("path")).alias("dir"), "length")
    return a.groupBy("dir").agg(F.sum("length").alias("bytes"))


def _in_dir(inventory: DataFrame) -> DataFrame:
    return inventory.select("*", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"),
                            F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))


def list_exports(inventory: DataFrame, root: str) -> DataFrame:
    """A5: sub-folders of ``root`` that hold ``config.json``, with recursive size (text) and the
    newest modification time, newest first."""
    r = root.rstrip("/") + "/"
    inv = inventory.where(F.col("path").startswith(r)).withColumn(
        "top", F.regexp_extract(F.substring("path", F.lit(len(r) + 1), F.length("path")), r"^([^/]+)/", 1)).where(F.col("top") != "")
    f = _in_dir(inv)
    g = f.groupBy("top").agg(F.bool_or((F.col("name") == CONFIG_FILE) & (F.col("dir") == F.concat(F.lit(r), F.col("top")))).alias("_cfg"),
                             F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))
    return g.where("_cfg").select(F.col("top").alias("name"), F.concat(F.lit(r), F.col("top")).alias("path"),
                                  F.lit(EXPORT_TYPE).alias("type"), format_size("bytes").alias("size"), "modified")


def checkpoint_info(inventory: DataFrame, root: str) -> DataFrame:
    """Sub-folders named ``checkpoint-*``: name, step (text after the last ``-``), newest time."""
    r = root.rstrip("/") + "/"
    inv = inventory.where(F.col("path").startswith(r)).withColumn(
        "name", F.regexp_extract(F.substring("path", F.lit(len(r) + 1), F.length("path")), r"^([^/]+)/", 1))
    g = inv.where(F.col("name").startswith(CHECKPOINT_PREFIX)).groupBy("name").agg(F.max("modificationTime").alias("modified"))
    return g.select("name", F.element_at(F.split("name", "-", -1), -1).alias("step"),
                    F.concat(F.lit(r), F.col("name")).alias("path"), "modified")


def valid_model_dirs(inventory: DataFrame) -> DataFrame:
    """Folders holding ``config.json`` and a ``*.safetensors`` or ``*.bin`` file directly."""
    f = _in_dir(inventory)
    weights = F.lit(False)
    for suf in WEIGHT_SUFFIXES:
        weights = weights | F.col("name").endswith(suf)
    g = f.groupBy("dir").agg(F.bool_or(F.col("name") == CONFIG_FILE).alias("cfg"), F.bool_or(weights).alias("w"))
    return g.where(F.col("cfg") & F.col("w")).select("dir")


def merge_settings_deep(defaults: DataFrame, overrides: DataFrame, key: str = "tenant") -> DataFrame:
    """A8 (deep): leaf tables ``tenant, path, value``; an override leaf replaces the default leaf
    of the same path, other leaves of both are kept."""
    d = defaults.select(key, "path", F.col("value").alias("_d"))
    o = overrides.select(key, "path", F.col("value").alias("_o"))
    return d.join(o, [key, "path"], "full").select(key, "path", F.coalesce("_o", "_d").alias("value"))


def merge_settings_shallow(defaults: DataFrame, overrides: DataFrame, key: str = "tenant") -> DataFrame:
    """A8 (shallow): an override of a top-level key replaces that key's whole default subtree."""
    top = F.split(F.col("path"), r"\.", 2)[0]
    o_top = overrides.select(key, top.alias("_top")).distinct()
    kept = defaults.withColumn("_top", top).join(o_top, [key, "_top"], "left_anti").drop("_top")
    return kept.select(key, "path", "value").unionByName(overrides.select(key, "path", "value"))


def valid_name(name) -> Column:
    """Not blank, none of ``/ \\ : * ? " < > |`` or NUL, no leading/trailing dot or blank."""
    n = col_(name)
    bad = F.lit(False)
    for ch in INVALID_NAME_CHARS:
        bad = bad | (F.instr(n, ch) > 0)
    return (n.isNotNull() & n.rlike(NON_WS_CLASS) & ~bad & ~n.startswith(".") & ~n.endswith(".")
            & ~n.startswith(" ") & ~n.endswith(" "))
