"""Queries for extraction (S1-S9) and the sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK
from ..session import scratch_path
from ..sources.extract import (csv_file_to_text, csv_records_to_text,
                               flatten_json_to_text, ordered_join,
                               html_to_text, notebook_to_text, pages_to_text, paragraphs_to_text, plain_text,
                               route_by_extension, sheet_rows_to_text)
from ..sources.store_io import (build_cpt_corpus, count_nonblank_lines, export_jsonl, json_documents, json_offsets, json_manifest,
                                load_samples_strict, load_sft_dataset, read_cpt_corpus, read_store, save_sample_objects, save_samples,
                                write_store)
from .fixtures import FIXED_TIME, NON_WS_SQL, chunk_store, store_sql, strip_sql, table
from .registry import query

C = store_sql("C")
EXT_SQL = "CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.MD' WHEN 'de' THEN '.html' ELSE '.ipynb.py' END"
PATHS_SQL = f"""
SELECT 'corpus/' || source || '/doc_' || CAST(doc_id AS VARCHAR) || {EXT_SQL} AS path FROM documents
UNION ALL SELECT 'web/' || CAST(page_id AS VARCHAR) || '.htm' AS path FROM pages
UNION ALL SELECT regexp_replace(url, '[?#].*$', '') AS path FROM pages"""


@query("route_by_extension", "S1", f"""
SELECT path, CASE lower(regexp_extract(regexp_extract(path, '([^/\\\\]*)$', 1), '^.+(\\.[^.]+)$', 1))
  WHEN '.txt' THEN 'text' WHEN '.md' THEN 'text' WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.html' THEN 'html'
  WHEN '.htm' THEN 'html' WHEN '.ipynb' THEN 'notebook' WHEN '.csv' THEN 'csv' WHEN '.xlsx' THEN 'excel' WHEN '.json' THEN 'json'
  END AS loader
FROM ({PATHS_SQL})""")
def q_route(spark, sf):
    d = table(spark, sf, "documents")
    ext = (F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "fr", ".MD").when(F.col("lang") == "de", ".html")
           .otherwise(".ipynb.py"))
    p1 = d.select(F.concat(F.lit("corpus/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), ext).alias("path"))
    pg = table(spark, sf, "pages")
    p2 = pg.select(F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".htm")).alias("path"))
    p3 = pg.select(F.regexp_replace("url", "[?#].*$", "").alias("path"))
    paths = p1.unionByName(p2).unionByName(p3)
    return paths.select("path", route_by_extension("path").alias("loader"))


@query("load_plain_text", "S2", """
SELECT doc_id, regexp_replace(replace(text, chr(65533), ''), '\\r\\n?', chr(10), 'g') AS text FROM documents""")
def q_plain(spark, sf):
    return table(spark, sf, "documents").select("doc_id", plain_text(F.col("text")).alias("text"))


# The references that the pages hold, their semicolon left out at times; ``&amp;`` goes last.
PAGE_REFERENCES = [("quot", 34), ("copy", 169), ("middot", 183), ("amp", 38)]


def _html_sql():
    t = "html"
    for element in ("script", "style"):
        t = f"regexp_replace({t}, '(?is)<{element}[^a-z0-9>]*[^>]*>.*?</{element}[ \t\r\n]*>', '', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '(?s)<!--.*?-->', '', 'g'), '</?[a-zA-Z!][^>]*>', '', 'g')"
    for name, code in PAGE_REFERENCES:
        t = f"regexp_replace({t}, '&{name};?', chr({code}), 'g')"
    lines = f"list_transform(string_split_regex({t}, '{LINE_BREAK}'), lambda l: {strip_sql('l')})"
    phrases = f"flatten(list_transform({lines}, lambda l: string_split(l, '  ')))"
    return f"array_to_string(list_filter(list_transform({phrases}, lambda p: {strip_sql('p')}), lambda p: p <> ''), chr(10))"


@query("html_to_text", "S3", f"SELECT page_id, {_html_sql()} AS text FROM pages")
def q_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


def notebooks(spark, sf):
    """One notebook per dialog: user turns as markdown cells, assistant turns as code cells with a
    stream output, system turns as code cells with an ``execute_result``."""
    c = table(spark, sf, "conversations")
    code_src = F.array(F.lit("print(reply)\n"), F.lit("# turn ") , F.col("turn").cast("string"))
    cell = (F.when(F.col("role") == "assistant", F.struct(
        F.lit("code").alias("cell_type"), code_src.alias("source"),
        F.array(F.struct(F.lit("stream").alias("output_type"), F.lit("stdout").alias("name"), F.col("text").alias("text"),
                         F.lit(None).cast("map<string,string>").alias("data"))).alias("outputs")))
            .when(F.col("role") == "system", F.struct(
                F.lit("code").alias("cell_type"), code_src.alias("source"),
                F.array(F.struct(F.lit("execute_result").alias("output_type"), F.lit(None).cast("string").alias("name"),
                                 F.lit(None).cast("string").alias("text"),
                                 F.create_map(F.lit("text/plain"), F.col("text")).alias("data"))).alias("outputs")))
            .otherwise(F.struct(F.lit("markdown").alias("cell_type"), F.array(F.col("text")).alias("source"),
                                F.lit(None).cast("array<struct<output_type:string,name:string,text:string,data:map<string,string>>>").alias("outputs"))))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.to_json(cell).alias("cell")))).alias("_c"))
    nb = F.concat(F.lit('{"cells": ['), F.array_join(F.transform("_c", lambda x: x["cell"]), ", "),
                  F.lit('], "metadata": {}, "nbformat": 4, "nbformat_minor": 5}'))
    return g.select("conv_id", nb.alias("notebook"))


@query("notebook_to_text", "S4", """
SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def q_notebook(spark, sf):
    return notebooks(spark, sf).select("conv_id", notebook_to_text(F.col("notebook")).alias("text"))


@query("csv_to_text", "S5", """
SELECT file, string_agg(line, chr(10) ORDER BY record_no) AS text FROM (
  SELECT 'region_' || CAST(n_regionkey AS VARCHAR) || '.csv' AS file, n_nationkey + 1 AS record_no,
         CAST(n_nationkey AS VARCHAR) || ' | ' || n_name || ' | ' || CAST(n_regionkey AS VARCHAR) AS line FROM nation
  UNION ALL
  SELECT DISTINCT 'region_' || CAST(n_regionkey AS VARCHAR) || '.csv', 0, 'n_nationkey | n_name | n_regionkey' FROM nation)
GROUP BY file""")
def q_csv(spark, sf):
    n = table(spark, sf, "nation")
    file = F.concat(F.lit("region_"), F.col("n_regionkey").cast("string"), F.lit(".csv"))
    rows = n.select(file.alias("file"), (F.col("n_nationkey") + 1).cast("long").alias("record_no"),
                    F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("fields"))
    header = n.select(file.alias("file")).distinct().select(
        "file", F.lit(0).cast("long").alias("record_no"),
        F.array(F.lit("n_nationkey"), F.lit("n_name"), F.lit("n_regionkey")).alias("fields"))
    return csv_records_to_text(rows.unionByName(header))


CSV_TEXT_SQL = """
SELECT file, string_agg(line, chr(10) ORDER BY record_no) AS text FROM (
  SELECT 'region_' || CAST(n_regionkey AS VARCHAR) || '.csv' AS file, n_nationkey + 1 AS record_no,
         CAST(n_nationkey AS VARCHAR) || ' | ' || n_name || ' | ' || CAST(n_regionkey AS VARCHAR) AS line FROM nation
  UNION ALL
  SELECT DISTINCT 'region_' || CAST(n_regionkey AS VARCHAR) || '.csv', 0, 'n_nationkey | n_name | n_regionkey' FROM nation)
GROUP BY file"""


@query("csv_file_to_text", "S5 (whole CSV files: quoting, ragged rows)", CSV_TEXT_SQL)
def q_csv_file(spark, sf):
    """One CSV file text per region (header, then nations with quoted names), parsed natively."""
    n = table(spark, sf, "nation")
    file = F.concat(F.lit("region_"), F.col("n_regionkey").cast("string"), F.lit(".csv"))
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(',"'), F.replace(F.col("n_name"), F.lit('"'), F.lit('""')),
                    F.lit('",'), F.col("n_regionkey").cast("string"))
    rows = n.select(file.alias("file"), (F.col("n_nationkey") + 1).cast("long").alias("record_no"), line.alias("line"))
    header = n.select(file.alias("file")).distinct().select("file", F.lit(0).cast("long").alias("record_no"),
                                                            F.lit("n_nationkey,n_name,n_regionkey").alias("line"))
    files = ordered_join(rows.unionByName(header), ["file"], "record_no", "line", "\n", "csv")
    return files.select("file", csv_file_to_text(F.col("csv")).alias("text"))


@query("sheet_rows_to_text", "S6", """
WITH r AS (SELECT l_orderkey AS workbook, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS sheet_no,
                  'status_' || l_linestatus AS sheet, l_linenumber AS row_no,
                  CAST(l_partkey AS VARCHAR) || ' | ' || CAST(l_suppkey AS VARCHAR) || ' | ' || CAST(l_quantity AS VARCHAR) || ' | '
                  || CAST(l_extendedprice AS VARCHAR) || ' | ' || CAST(l_discount AS VARCHAR) || ' | ' || l_returnflag AS line
           FROM lineitem),
s AS (SELECT workbook, sheet_no, 'Sheet: ' || any_value(sheet) || chr(10) || string_agg(line, chr(10) ORDER BY row_no, line) || chr(10) AS block
      FROM r GROUP BY workbook, sheet_no)
SELECT workbook, string_agg(block, chr(10) ORDER BY sheet_no) AS text FROM s GROUP BY workbook""")
def q_sheets(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("workbook"),
                     F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("sheet_no"),
                     F.concat(F.lit("status_"), "l_linestatus").alias("sheet"), F.col("l_linenumber").alias("row_no"),
                     F.array(*[F.col(c).cast("string") for c in
                               ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]]).alias("cells"))
    return sheet_rows_to_text(rows)


@query("pages_to_text", "S7", """
SELECT conv_id AS doc, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text
FROM conversations WHERE text IS NOT NULL AND length(text) > 0 GROUP BY conv_id""")
def q_pages(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page_no"), "text")
    return pages_to_text(c)


@query("paragraphs_to_text", "S8", f"""
SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda p: regexp_matches(p, '{NON_WS_SQL}')),
                               chr(10) || chr(10)) AS text FROM documents""")
def q_paragraphs(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", paragraphs_to_text(F.split("text", "\n", -1)).alias("text"))


@query("flatten_json_to_text", "S9", "SELECT event_id, 'k: ' || CAST(json_extract(props, '$.k') AS VARCHAR) AS text FROM events")
def q_flatten(spark, sf):
    return flatten_json_to_text(table(spark, sf, "events").select("event_id", "props"), "event_id", "props")


def nested_events(spark, sf):
    e = table(spark, sf, "events")
    doc = F.concat(F.lit('{"event": {"id": '), F.col("event_id").cast("string"), F.lit(', "type": "'), F.col("event_type"),
                   F.lit('", "value": '), F.col("value").cast("string"), F.lit(', "props": '), F.col("props"),
                   F.lit(', "tags": ["'), F.col("event_type"), F.lit('", null, true, false], "empty": {}, "none": []}}'))
    return e.select("event_id", doc.alias("doc"))


@query("flatten_json_nested", "S9 (nested objects and lists)", """
SELECT event_id, 'event.id: ' || CAST(event_id AS VARCHAR) || chr(10) || 'event.type: ' || event_type || chr(10)
       || 'event.value: ' || CAST(value AS VARCHAR) || chr(10) || 'event.props.k: ' || CAST(json_extract(props, '$.k') AS VARCHAR)
       || chr(10) || 'event.tags[0]: ' || event_type || chr(10) || 'event.tags[1]: None' || chr(10) || 'event.tags[2]: True'
       || chr(10) || 'event.tags[3]: False' AS text
FROM events""")
def q_flatten_nested(spark, sf):
    return flatten_json_to_text(nested_events(spark, sf), "event_id", "doc")


# ---------------------------------------------------------------------------------------------- sinks

@query("read_chunk_store", "S10", f"SELECT filename, chunk_index, chunk_text FROM ({C})")
def q_read_store(spark, sf):
    root = scratch_path(spark, "store-c")
    write_store(chunk_store(spark, sf, "C"), root)
    return read_store(spark, root, ["filename", "chunk_index", "chunk_text"])


EXPORT_LINE_SQL = ("left(CAST(to_json({'filename': filename, 'chunk_index': chunk_index, 'text': chunk_text}) AS VARCHAR), -1)"
                   " || ',\"metadata\":' || CAST(json(metadata) AS VARCHAR) || '}'")


@query("export_jsonl", "S11", f"SELECT {EXPORT_LINE_SQL} AS line FROM ({C})")
def q_export_jsonl(spark, sf):
    path = scratch_path(spark, "export-jsonl")
    export_jsonl(chunk_store(spark, sf, "C"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("export_json_nested", "S12", f"""
SELECT filename, '[' || string_agg(left(CAST(to_json({{'chunk_index': chunk_index, 'text': chunk_text}}) AS VARCHAR), -1)
       || ',"metadata":' || CAST(json(metadata) AS VARCHAR) || '}}', ',' ORDER BY chunk_index) || ']' AS chunks
FROM ({C}) GROUP BY filename""")
def q_export_json(spark, sf):
    return json_documents(chunk_store(spark, sf, "C"))


@query("single_json_offsets", "S12 (one object in ordered parts)", f"""
WITH s AS (SELECT filename, chunk_index, octet_length(encode(left(CAST(to_json({{'chunk_index': chunk_index, 'text': chunk_text}}) AS VARCHAR), -1)
                  || ',"metadata":' || CAST(json(metadata) AS VARCHAR) || '}}')) AS item,
                  row_number() OVER (ORDER BY filename, chunk_index) AS r,
                  row_number() OVER (PARTITION BY filename ORDER BY chunk_index) AS up,
                  row_number() OVER (PARTITION BY filename ORDER BY chunk_index DESC) AS down FROM ({C})),
b AS (SELECT filename, chunk_index, r, CAST(item + 1 + CASE WHEN up = 1 THEN octet_length(encode(CAST(to_json(filename) AS VARCHAR)))
                  + CASE WHEN r > 1 THEN 3 ELSE 2 END ELSE 1 END + CASE WHEN down = 1 THEN 1 ELSE 0 END AS BIGINT) AS n_bytes FROM s),
h AS (SELECT CAST(octet_length(encode('{{"export_date":"{FIXED_TIME}","total_documents":' || count(DISTINCT filename) || ',"total_chunks":' || count(*)
                  || ',"documents":{{')) + 1 AS BIGINT) AS n FROM ({C}))
SELECT filename, chunk_index, n_bytes, CAST(n + sum(n_bytes) OVER (ORDER BY r) - n_bytes AS BIGINT) AS byte_offset FROM b, h""")
def q_single_json_offsets(spark, sf):
    """Where each chunk's fragment lies in the one exported object."""
    return json_offsets(chunk_store(spark, sf, "C"), FIXED_TIME).select("filename", "chunk_index", "n_bytes", "byte_offset")


@query("export_manifest", "S12 (manifest)", f"SELECT count(DISTINCT filename) AS total_documents, count(*) AS total_chunks FROM ({C})")
def q_manifest(spark, sf):
    return json_manifest(chunk_store(spark, sf, "C")).drop("export_date")


def sample_lines(spark, sf):
    """JSONL lines from the dialogs: user turns answered by the next assistant turn give full
    samples, unanswered user turns lack ``output``, assistant turns carry an extra key, system turns
    are not JSON, and every turn adds a blank line."""
    c = table(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("nrole"), F.col("text").alias("ntext"))
    j = c.join(nxt, ["conv_id", "turn"], "left")
    answered = (F.col("role") == "user") & (F.col("nrole") == "assistant")
    line = (F.when(answered, F.to_json(F.struct(F.col("text").alias("instruction"), F.col("ntext").alias("output"))))
            .when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("instruction"))))
            .when(F.col("role") == "assistant", F.to_json(F.struct(F.lit("Q").alias("instruction"), F.col("text").alias("output"),
                                                                   F.col("turn").alias("extra"))))
            .otherwise(F.col("text")))
    no = F.col("conv_id") * (1 << 32) + F.col("turn") * 2
    return j.select(no.alias("line_no"), line.alias("line")).unionByName(j.select((no + 1).alias("line_no"), F.lit("  ").alias("line")))


LINES_SQL = """
SELECT c.conv_id * 4294967296 + c.turn * 2 AS line_no,
       CASE WHEN c.role = 'user' AND n.role = 'assistant' THEN CAST(to_json({'instruction': c.text, 'output': n.text}) AS VARCHAR)
            WHEN c.role = 'user' THEN CAST(to_json({'instruction': c.text}) AS VARCHAR)
            WHEN c.role = 'assistant' THEN CAST(to_json({'instruction': 'Q', 'output': c.text, 'extra': c.turn}) AS VARCHAR)
            ELSE c.text END AS line
FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1"""


@query("load_samples_strict", "S14", f"""
SELECT line_no, json_extract_string(line, '$.instruction') AS instruction, json_extract_string(line, '$.output') AS output,
       CAST(len(json_keys(line)) AS INTEGER) AS n_keys
FROM ({LINES_SQL}) WHERE json_valid(line) AND json_exists(line, '$.instruction') AND json_exists(line, '$.output')""")
def q_load_strict(spark, sf):
    r = load_samples_strict(sample_lines(spark, sf))
    return r.where("_ok").select("line_no", "instruction", "output", "n_keys")


@query("load_sft_dataset", "S15", f"""
SELECT line_no, coalesce(json_extract_string(line, '$.instruction'), '') AS instruction,
       coalesce(json_extract_string(line, '$.output'), '') AS output
FROM ({LINES_SQL}) WHERE json_valid(line)""")
def q_load_sft(spark, sf):
    r = load_sft_dataset(sample_lines(spark, sf))
    return r.where(~F.col("rejected")).select("line_no", "instruction", "output")


@query("save_samples", "S13", f"""
SELECT json_extract_string(line, '$.instruction') AS instruction, json_extract_string(line, '$.output') AS output
FROM ({LINES_SQL}) WHERE json_valid(line) AND json_exists(line, '$.instruction') AND json_exists(line, '$.output')""")
def q_save(spark, sf):
    r = load_samples_strict(sample_lines(spark, sf)).where("_ok").select("instruction", "output")
    path = scratch_path(spark, "samples")
    save_samples(r, path)
    return spark.read.schema("instruction string, output string").json(path)


@query("save_samples_all_keys", "S13 (whole objects)", f"""
SELECT json_extract_string(line, '$.instruction') AS instruction, json_extract_string(line, '$.output') AS output,
       CAST(len(json_keys(line)) AS INTEGER) AS n_keys
FROM ({LINES_SQL}) WHERE json_valid(line) AND json_exists(line, '$.instruction') AND json_exists(line, '$.output')""")
def q_save_all(spark, sf):
    path = scratch_path(spark, "sample-objects")
    save_sample_objects(load_samples_strict(sample_lines(spark, sf)).where("_ok"), path)
    back = load_samples_strict(spark.read.text(path).withColumnRenamed("value", "line"))
    return back.where("_ok").select("instruction", "output", "n_keys")


CPT_SQL = f"""
SELECT {strip_sql('l')} AS text FROM (SELECT unnest(string_split_regex(chunk_text, '\\r\\n|\\r|\\n')) AS l FROM ({C}))
WHERE {strip_sql('l')} <> ''"""


@query("read_cpt_corpus", "S16+S17", CPT_SQL)
def q_cpt(spark, sf):
    path = scratch_path(spark, "cpt")
    build_cpt_corpus(chunk_store(spark, sf, "C"), path)
    return read_cpt_corpus(spark, path)


@query("count_nonblank_lines", "S18", f"""
SELECT count(*) AS nonblank_lines FROM (SELECT unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS l FROM documents)
WHERE regexp_matches(l, '{NON_WS_SQL}')""")
def q_count_lines(spark, sf):
    d = table(spark, sf, "documents").select(F.explode(F.split("text", "\r\n|\r|\n", -1)).alias("value"))
    return count_nonblank_lines(d)
