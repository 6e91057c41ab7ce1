"""Browsing and selecting chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import NONE_SELECTED, PAGE_EMPTY, PAGE_INFO, PAGE_SIZE, SELECTED
from ..functions.ordering import with_row_index
from ..functions.text import preview


def page_bounds(total: int, page: int, per_page: int = PAGE_SIZE) -> tuple[int, int, int]:
    """(clamped page, pages, offset) for ``total`` rows; ceiling division; empty -> page 0 of 0."""
    pages = (total + per_page - 1) // per_page
    if pages == 0:
        return 0, 0, 0
    page = max(1, min(page, pages))
    return page, pages, (page - 1) * per_page


def page_chunks(store: DataFrame, page: int, per_page: int = PAGE_SIZE) -> DataFrame:
    """B1: one viewer page ``id, filename, chunk_index, preview`` ordered by filename, chunk_index.

    The total is one count (Parquet footers). A stored store carries ``row_no`` (see
    ``write_store``), so the page is a range filter pushed into the scan. Without it, a narrow
    projection (preview, not the text) is numbered by a distributed ordinal: a top-k would merge
    ``offset + per_page`` rows from every partition in one task."""
    total = store.count()
    page, pages, offset = page_bounds(total, page, per_page)
    narrow = store.select(*(["row_no"] if "row_no" in store.columns else []), "id", "filename", "chunk_index",
                          preview("chunk_text").alias("preview"))
    if "row_no" not in store.columns:
        narrow = with_row_index(narrow, ["filename", "chunk_index"], "row_no")
    rows = narrow.where((F.col("row_no") >= offset) & (F.col("row_no") < offset + per_page))
    return rows.orderBy("row_no").select("id", "filename", "chunk_index", "preview")


def page_info(store: DataFrame, page: int, per_page: int = PAGE_SIZE) -> DataFrame:
    """B2: ``Page x of y (Chunks a-b of n)`` computed from the count alone."""
    n = F.count(F.lit(1))
    pages = F.floor((n + per_page - 1) / per_page).cast("long")
    p = F.greatest(F.lit(1), F.least(F.lit(page), pages))
    first = (p - 1) * per_page + 1
    last = F.least(p * per_page, n)
    text = F.when(n == 0, F.lit(PAGE_EMPTY)).otherwise(F.format_string(PAGE_INFO, p, pages, first, last, n))
    return store.agg(text.alias("page_info"))


def selection_table(view: DataFrame) -> DataFrame:
    """``select=false, id, source, chunk_index, preview`` from the reader view."""
    return view.select(F.lit(False).alias("select"), "id", "source", "chunk_index",
                       preview("content").alias("preview"))


def set_selection(table: DataFrame, value: bool) -> DataFrame:
    """Select all (True) or none (False)."""
    return table.withColumn("select", F.lit(value))


def selected_count(table: DataFrame) -> DataFrame:
    """``k / n selected`` (``0 selected`` for an empty table)."""
    n = F.count(F.lit(1))
    k = F.count_if("select")
    return table.agg(F.when(n == 0, F.lit(NONE_SELECTED)).otherwise(F.format_string(SELECTED, k, n)).alias("selected"))


def filter_chunks(view: DataFrame, source: str | None = None, term: str | None = None) -> DataFrame:
    """Rows of one source and/or containing ``term`` (case-insensitive)."""
    out = view
    if source:
        out = out.where(F.col("source") == source)
    if term:
        out = out.where(F.lower("content").contains(term.lower()))
    return out


def random_select(table: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    """Flag ``n`` rows chosen by a seeded hash order (stable across runs; all when fewer).
    Picking is a top-n (bounded), flagged rows are joined back by id."""
    key = F.md5(F.concat(F.col("id").cast("string"), F.lit(f"#{seed}")))
    picked = table.select("id").orderBy(key, "id").limit(n).withColumn("_pick", F.lit(True))
    return (table.join(picked, "id", "left")
            .withColumn("select", F.coalesce(F.col("_pick"), F.lit(False))).drop("_pick"))


def edit_chunks(store: DataFrame, edits: DataFrame) -> DataFrame:
    """Corrected texts ``id, new_text`` written over the store by id. Of several edits of one chunk the last one by
    ``edit_no`` counts (without that column: the greatest text, so the result is defined)."""
    order = F.struct("edit_no", "new_text") if "edit_no" in edits.columns else F.struct("new_text")
    e = edits.groupBy("id").agg(F.max(order)["new_text"].alias("_new"))
    return (store.join(e, "id", "left").withColumn("chunk_text", F.coalesce("_new", "chunk_text")).drop("_new"))
