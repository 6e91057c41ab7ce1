"""Queries for artifact and catalogue tables (A1-A9) over inventories derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.inventory import (checkpoint_info, dir_size, flatten_model_listing, format_size, list_exports,
                                   merge_settings_deep, merge_settings_shallow, parse_text_table, valid_model_dirs,
                                   valid_name)
from .q_chunking import WS
from .registry import query
from .fixtures import table

INV_SQL = """
SELECT 'exports/' || p_brand || '/shards/' || CAST(p_partkey AS VARCHAR) || '.safetensors' AS path,
       CAST(p_size * 1000 + p_partkey AS BIGINT) AS length, TIMESTAMP '2024-01-01' + to_minutes(p_partkey) AS modificationTime FROM part
UNION ALL
SELECT 'exports/' || p_brand || '/config.json', 100, TIMESTAMP '2024-01-01' + to_minutes(min(p_partkey)) FROM part WHERE p_type = 'ECONOMY' GROUP BY p_brand
UNION ALL
SELECT 'models/' || p_brand || '/w-' || CAST(p_partkey AS VARCHAR) || '.bin', p_size, TIMESTAMP '2024-01-01' FROM part WHERE p_type = 'LARGE'
UNION ALL
SELECT 'models/' || p_brand || '/config.json', 10, TIMESTAMP '2024-01-01' FROM part WHERE p_type = 'PROMO' GROUP BY p_brand
UNION ALL
SELECT 'checkpoints/checkpoint-' || CAST(p_partkey * 50 AS VARCHAR) || '/state.pt', p_size, TIMESTAMP '2024-01-01' + to_minutes(p_partkey)
FROM part WHERE p_type = 'PROMO'"""


def inventory(spark, sf):
    p = table(spark, sf, "part")
    t0 = F.lit("2024-01-01").cast("timestamp_ntz")  # naive, like the SQL twin: no session time zone
    mins = lambda c: t0 + F.make_interval(mins=c.cast("int"))
    a = p.select(F.concat(F.lit("exports/"), "p_brand", F.lit("/shards/"), F.col("p_partkey").cast("string"), F.lit(".safetensors")).alias("path"),
                 (F.col("p_size") * 1000 + F.col("p_partkey")).cast("long").alias("length"), mins(F.col("p_partkey")).alias("modificationTime"))
    b = p.where(F.col("p_type") == "ECONOMY").groupBy("p_brand").agg(F.min("p_partkey").alias("k")).select(
        F.concat(F.lit("exports/"), "p_brand", F.lit("/config.json")).alias("path"), F.lit(100).cast("long").alias("length"),
        mins(F.col("k")).alias("modificationTime"))
    c = p.where(F.col("p_type") == "LARGE").select(
        F.concat(F.lit("models/"), "p_brand", F.lit("/w-"), F.col("p_partkey").cast("string"), F.lit(".bin")).alias("path"),
        F.col("p_size").cast("long").alias("length"), t0.alias("modificationTime"))
    d = p.where(F.col("p_type") == "PROMO").select("p_brand").distinct().select(
        F.concat(F.lit("models/"), "p_brand", F.lit("/config.json")).alias("path"), F.lit(10).cast("long").alias("length"),
        t0.alias("modificationTime"))
    e = p.where(F.col("p_type") == "PROMO").select(
        F.concat(F.lit("checkpoints/checkpoint-"), (F.col("p_partkey") * 50).cast("string"), F.lit("/state.pt")).alias("path"),
        F.col("p_size").cast("long").alias("length"), mins(F.col("p_partkey")).alias("modificationTime"))
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e)


def _fmt_sql(x: str) -> str:
    parts = [f"WHEN {x} / {float(1024 ** i)} < 1024.0 THEN printf('%.1f', {x} / {float(1024 ** i)}) || ' {u}'"
             for i, u in enumerate(["B", "KB", "MB", "GB", "TB"])]
    return f"CASE {' '.join(parts)} ELSE printf('%.1f', {x} / {float(1024 ** 5)}) || ' PB' END"


@query("format_size", "A3", f"""
SELECT doc_id, {_fmt_sql('CAST(n_chars * n_chars * (doc_id + 1) AS DOUBLE)')} AS size FROM documents""")
def q_format_size(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", format_size(F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") + 1)).alias("size"))


LISTING = ('\'{"models":[{"name":"\' || p_name || \':\' || CAST(p_partkey AS VARCHAR) || \'","size":\' || CAST(p_size * 123456789 AS VARCHAR)'
           ' || \',"modified_at":"2024-01-01","details":{"family":"\' || p_brand || \'","parameter_size":"\' || CAST(p_size AS VARCHAR)'
           ' || \'B","quantization_level":"Q4_0"}},{"name":"bare-\' || CAST(p_partkey AS VARCHAR) || \'"}]}\'')


@query("flatten_model_listing", "A1", f"""
SELECT p_partkey, 0 AS model_no, p_name || ':' || CAST(p_partkey AS VARCHAR) AS name, {_fmt_sql('CAST(CAST(p_size AS BIGINT) * 123456789 AS DOUBLE)')} AS size,
       '2024-01-01' AS modified, p_brand AS family, CAST(p_size AS VARCHAR) || 'B' AS parameter_size, 'Q4_0' AS quantization FROM part
UNION ALL
SELECT p_partkey, 1, 'bare-' || CAST(p_partkey AS VARCHAR), '0.0 B', '', '', '', '' FROM part""")
def q_listing(spark, sf):
    p = table(spark, sf, "part")
    s = F.col("p_partkey").cast("string")
    listing = F.concat(F.lit('{"models":[{"name":"'), "p_name", F.lit(":"), s, F.lit('","size":'),
                       (F.col("p_size").cast("long") * 123456789).cast("string"), F.lit(',"modified_at":"2024-01-01","details":{"family":"'),
                       "p_brand", F.lit('","parameter_size":"'), F.col("p_size").cast("string"),
                       F.lit('B","quantization_level":"Q4_0"}},{"name":"bare-'), s, F.lit('"}]}'))
    out = flatten_model_listing(p.select("p_partkey", listing.alias("listing")))
    return out.withColumn("model_no", F.col("model_no").cast("int"))


TABLE_SQL = """'NAME ID SIZE MODIFIED' || chr(10) || replace(p_name, ' ', '-') || ' ' || substring(md5(p_name), 1, 12) || ' '
  || CAST(p_size / 10.0 AS VARCHAR) || ' GB ' || CAST(p_partkey % 7 AS VARCHAR) || ' days ago' || chr(10) || 'short line'"""


def _tables(spark, sf):
    p = table(spark, sf, "part")
    text = F.concat(F.lit("NAME ID SIZE MODIFIED\n"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit(" "),
                    F.substring(F.md5("p_name"), 1, 12), F.lit(" "), (F.col("p_size") / F.lit(10.0)).cast("string"),
                    F.lit(" GB "), (F.col("p_partkey") % 7).cast("string"), F.lit(" days ago\nshort line"))
    return p.select("p_partkey", text.alias("text"))


@query("parse_text_table", "A2", f"""
SELECT p_partkey, 1 AS line_no, replace(p_name, ' ', '-') AS name, CAST(p_size / 10.0 AS VARCHAR) || ' GB' AS size,
       CAST(p_partkey % 7 AS VARCHAR) || ' days ago' AS modified FROM part""")
def q_text_table(spark, sf):
    return parse_text_table(_tables(spark, sf)).withColumn("line_no", F.col("line_no").cast("int"))


@query("parse_text_table_legacy", "A2 (original column split)", f"""
SELECT p_partkey, 1 AS line_no, replace(p_name, ' ', '-') AS name, CAST(p_size / 10.0 AS VARCHAR) AS size,
       'GB ' || CAST(p_partkey % 7 AS VARCHAR) || ' days ago' AS modified FROM part""")
def q_text_table_legacy(spark, sf):
    return parse_text_table(_tables(spark, sf), legacy=True).withColumn("line_no", F.col("line_no").cast("int"))


PAGE_PATHS = "SELECT regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS path, CAST(length(html) AS BIGINT) AS length FROM pages"


@query("dir_size", "A4", f"""
SELECT dir, CAST(sum(length) AS BIGINT) AS bytes FROM (
  SELECT array_to_string(p[1:i], '/') AS dir, length FROM (
    SELECT p, length, unnest(range(1, greatest(len(p) - 1, 1) + 1)) AS i
    FROM (SELECT string_split(path, '/') AS p, length FROM ({PAGE_PATHS}) WHERE strpos(path, '/') > 0)))
GROUP BY dir""")
def q_dir_size(spark, sf):
    pg = table(spark, sf, "pages")
    inv = pg.select(F.regexp_replace("url", "^https?://|[?#].*$", "").alias("path"), F.length("html").cast("long").alias("length"))
    return dir_size(inv)


@query("list_exports", "A5", f"""
SELECT top AS name, 'exports/' || top AS path, 'Safetensors' AS type, {_fmt_sql('CAST(bytes AS DOUBLE)')} AS size, modified
FROM (SELECT regexp_extract(path, '^exports/([^/]+)/', 1) AS top, sum(length) AS bytes, max(modificationTime) AS modified,
             bool_or(regexp_matches(path, '^exports/[^/]+/config\\.json$')) AS cfg
      FROM ({INV_SQL}) WHERE path LIKE 'exports/%' GROUP BY top) WHERE cfg""")
def q_exports(spark, sf):
    return list_exports(inventory(spark, sf), "exports")


@query("checkpoint_info", "A6", f"""
SELECT name, split_part(name, '-', -1) AS step, 'checkpoints/' || name AS path, max(modificationTime) AS modified
FROM (SELECT regexp_extract(path, '^checkpoints/([^/]+)/', 1) AS name, modificationTime FROM ({INV_SQL}) WHERE path LIKE 'checkpoints/%')
WHERE name LIKE 'checkpoint-%' GROUP BY name""")
def q_checkpoints(spark, sf):
    return checkpoint_info(inventory(spark, sf), "checkpoints")


@query("valid_model_dirs", "A7", f"""
SELECT dir FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name FROM ({INV_SQL}))
GROUP BY dir HAVING bool_or(name = 'config.json') AND bool_or(name LIKE '%.safetensors' OR name LIKE '%.bin')""")
def q_model_dirs(spark, sf):
    return valid_model_dirs(inventory(spark, sf))


SETTINGS_SQL = """
WITH d AS (SELECT user_id AS tenant, 'limits.k' AS path, CAST(min(CAST(json_extract(props, '$.k') AS BIGINT)) AS VARCHAR) AS value FROM events GROUP BY user_id
           UNION ALL SELECT user_id, 'stats.value', CAST(min(value) AS VARCHAR) FROM events GROUP BY user_id
           UNION ALL SELECT user_id, 'profile.type', min(event_type) FROM events GROUP BY user_id),
o AS (SELECT user_id AS tenant, 'limits.k' AS path, CAST(max(CAST(json_extract(props, '$.k') AS BIGINT)) AS VARCHAR) AS value FROM events GROUP BY user_id
      UNION ALL SELECT DISTINCT user_id, 'profile.name', 'user-' || CAST(user_id AS VARCHAR) FROM events)"""


def _settings(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    g = e.groupBy(F.col("user_id").alias("tenant"))
    d = (g.agg(F.min(k).cast("string").alias("value")).withColumn("path", F.lit("limits.k"))
         .unionByName(g.agg(F.min("value").cast("string").alias("value")).withColumn("path", F.lit("stats.value")))
         .unionByName(g.agg(F.min("event_type").alias("value")).withColumn("path", F.lit("profile.type"))))
    o = (g.agg(F.max(k).cast("string").alias("value")).withColumn("path", F.lit("limits.k"))
         .unionByName(e.select(F.col("user_id").alias("tenant")).distinct()
                      .withColumn("value", F.concat(F.lit("user-"), F.col("tenant").cast("string"))).withColumn("path", F.lit("profile.name"))))
    return d, o


@query("merge_settings", "A8 (deep)", f"""
{SETTINGS_SQL}
SELECT coalesce(o.tenant, d.tenant) AS tenant, coalesce(o.path, d.path) AS path, coalesce(o.value, d.value) AS value
FROM d FULL OUTER JOIN o ON d.tenant = o.tenant AND d.path = o.path""")
def q_settings_deep(spark, sf):
    d, o = _settings(spark, sf)
    return merge_settings_deep(d, o)


@query("merge_settings_shallow", "A8 (shallow)", f"""
{SETTINGS_SQL}
SELECT tenant, path, value FROM d
WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.tenant = d.tenant AND split_part(o.path, '.', 1) = split_part(d.path, '.', 1))
UNION ALL SELECT tenant, path, value FROM o""")
def q_settings_shallow(spark, sf):
    d, o = _settings(spark, sf)
    return merge_settings_shallow(d, o)


NAMES_SQL = """
SELECT p_partkey, 0 AS variant, p_name AS name FROM part
UNION ALL SELECT p_partkey, 1, ' ' || p_name FROM part
UNION ALL SELECT p_partkey, 2, p_name || '.' FROM part
UNION ALL SELECT p_partkey, 3, '.' || p_name FROM part
UNION ALL SELECT p_partkey, 4, p_name || '/' || p_brand FROM part
UNION ALL SELECT p_partkey, 5, replace(p_name, ' ', '?') FROM part
UNION ALL SELECT p_partkey, 6, repeat(' ', p_size % 3) FROM part
UNION ALL SELECT p_partkey, 7, p_brand || ':' || p_type FROM part
UNION ALL SELECT p_partkey, 8, p_type || '_' || p_brand FROM part"""


@query("valid_name_filter", "A9", f"""
SELECT p_partkey, variant, name,
       regexp_matches(name, '[^{WS[1:-1]}]') AND NOT regexp_matches(name, '[/\\\\:*?"<>|\\x00]')
       AND NOT (starts_with(name, '.') OR ends_with(name, '.') OR starts_with(name, ' ') OR ends_with(name, ' ')) AS valid
FROM ({NAMES_SQL})""")
def q_names(spark, sf):
    p = table(spark, sf, "part")
    v = [F.col("p_name"), F.concat(F.lit(" "), "p_name"), F.concat("p_name", F.lit(".")), F.concat(F.lit("."), "p_name"),
         F.concat("p_name", F.lit("/"), "p_brand"), F.replace(F.col("p_name"), F.lit(" "), F.lit("?")),
         F.repeat(F.lit(" "), (F.col("p_size") % 3).cast("int")), F.concat("p_brand", F.lit(":"), "p_type"),
         F.concat("p_type", F.lit("_"), "p_brand")]
    out = None
    for i, e in enumerate(v):
        r = p.select("p_partkey", F.lit(i).alias("variant"), e.alias("name"))
        out = r if out is None else out.unionByName(r)
    return out.withColumn("valid", valid_name("name"))
