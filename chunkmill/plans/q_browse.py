"""Queries for browsing and selecting chunks (B1-B9). The viewer store is C."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.browse import (edit_chunks, filter_chunks, page_chunks, page_info, random_select, selected_count,
                                selection_table, set_selection)
from ..operators.store import chunk_view
from ..functions.text import preview
from .fixtures import chunk_store, store_sql
from .registry import query

C = store_sql("C")
PREVIEW = "CASE WHEN length({x}) > 100 THEN substring({x}, 1, 100) || '...' ELSE {x} END"
PICK_SQL = f"SELECT id FROM ({C}) ORDER BY md5(CAST(id AS VARCHAR) || '#0'), id LIMIT 50"


def _pv(x):
    return PREVIEW.format(x=x)


def _page_sql(page: int) -> str:
    return f"""
WITH s AS ({C}), n AS (SELECT count(*) AS total, (count(*) + 999) // 1000 AS pages FROM s),
o AS (SELECT (least(greatest({page}, 1), pages) - 1) * 1000 AS off FROM n)
SELECT id, filename, chunk_index, {_pv('chunk_text')} AS preview
FROM (SELECT *, row_number() OVER (ORDER BY filename, chunk_index) AS rn FROM s)
WHERE rn > (SELECT off FROM o) AND rn <= (SELECT off FROM o) + 1000"""


@query("page_chunks", "B1", _page_sql(2))
def q_page(spark, sf):
    return page_chunks(chunk_store(spark, sf, "C"), 2)


@query("page_chunks_clamped", "B1 (page past the end is clamped)", _page_sql(99))
def q_page_clamped(spark, sf):
    return page_chunks(chunk_store(spark, sf, "C"), 99)


@query("page_info", "B2", f"""
SELECT CASE WHEN n = 0 THEN 'Page 0 of 0' ELSE printf('Page %d of %d (Chunks %d-%d of %d)', p, pages, (p - 1) * 1000 + 1,
       least(p * 1000, n), n) END AS page_info
FROM (SELECT n, pages, greatest(1, least(2, pages)) AS p FROM (SELECT count(*) AS n, (count(*) + 999) // 1000 AS pages FROM ({C})))""")
def q_page_info(spark, sf):
    return page_info(chunk_store(spark, sf, "C"), 2)


@query("chunk_preview", "B3", f"SELECT id, {_pv('chunk_text')} AS preview FROM ({C})")
def q_preview(spark, sf):
    return chunk_store(spark, sf, "C").select("id", preview("chunk_text").alias("preview"))


SEL_SQL = f"SELECT false AS \"select\", id, filename AS source, chunk_index, {_pv('chunk_text')} AS preview FROM ({C})"


@query("selection_table", "B4", SEL_SQL)
def q_selection(spark, sf):
    return selection_table(chunk_view(chunk_store(spark, sf, "C")))


@query("select_all", "B5", f"SELECT true AS \"select\", id, source, chunk_index, preview FROM ({SEL_SQL})")
def q_select_all(spark, sf):
    return set_selection(selection_table(chunk_view(chunk_store(spark, sf, "C"))), True)


@query("selected_count", "B6", f"""
SELECT printf('%d / %d selected', (SELECT count(*) FROM ({PICK_SQL})), count(*)) AS selected FROM ({C})""")
def q_selected_count(spark, sf):
    t = random_select(selection_table(chunk_view(chunk_store(spark, sf, "C"))), 50, seed=0)
    return selected_count(t)


@query("filter_chunks", "B7", f"SELECT id, source, chunk_index FROM (SELECT id, filename AS source, chunk_index, chunk_text FROM ({C})) "
                              "WHERE contains(lower(chunk_text), 'the ')")
def q_filter(spark, sf):
    return filter_chunks(chunk_view(chunk_store(spark, sf, "C")), term="The ").select("id", "source", "chunk_index")


@query("filter_chunks_source", "B7 (by source)", f"""
SELECT id, source, chunk_index FROM (SELECT id, filename AS source, chunk_index FROM ({C})) WHERE source = 'doc_7.txt'""")
def q_filter_source(spark, sf):
    return filter_chunks(chunk_view(chunk_store(spark, sf, "C")), source="doc_7.txt").select("id", "source", "chunk_index")


@query("random_select", "B8", PICK_SQL)
def q_random(spark, sf):
    t = random_select(selection_table(chunk_view(chunk_store(spark, sf, "C"))), 50, seed=0)
    return t.where("select").select("id")


@query("edit_chunks", "B9", f"""
SELECT id, CASE WHEN chunk_index = 0 THEN '[edited] ' || chunk_text ELSE chunk_text END AS chunk_text FROM ({C})""")
def q_edit(spark, sf):
    s = chunk_store(spark, sf, "C")
    edits = s.where(F.col("chunk_index") == 0).select("id", F.concat(F.lit("[edited] "), "chunk_text").alias("new_text"))
    return edit_chunks(s, edits).select("id", "chunk_text")
