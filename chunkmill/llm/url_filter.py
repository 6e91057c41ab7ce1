"""Weighted URL vocabulary: one Aho-Corasick pass per URL finds strict and soft terms.

A term counts only between boundaries (no letter or digit directly before or after it). A URL is
blocked on one strict term or on ``MIN_SOFT`` distinct soft terms; explicit (host, path) rules come
first, the longest fitting one wins.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule fits it and
a null URL has no hits (allow); a repeated term counts once; repeated rows are judged each for
itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

STRICT = ("porn", "xxx", "casino", "viagra", "adult-x", "spam-farm", "camgirls", "escorts")
SOFT = ("adult", "ads", "bets", "betting", "bonus", "cheap", "free", "jackpot", "loans", "pills", "poker",
        "slots", "spam", "track", "tracker", "win")
MIN_SOFT = 2

# (verdict, host, path): a rule fits its host and all subdomains if the path starts with its path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_AUTOMATA: dict = {}


def _automaton(strict: tuple, soft: tuple):
    """Built once per Python worker from the vocabulary (a parameter of a few hundred terms)."""
    if (strict, soft) not in _AUTOMATA:
        import ahocorasick

        a = ahocorasick.Automaton()
        for t in soft:
            a.add_word(t, (t, False))
        for t in strict:
            a.add_word(t, (t, True))
        a.make_automaton()
        _AUTOMATA[strict, soft] = a
    return _AUTOMATA[strict, soft]


def _word_char(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def count_terms(url: str, strict: tuple = STRICT, soft: tuple = SOFT) -> tuple[int, int]:
    """Distinct strict and soft terms between boundaries in a lower-cased URL."""
    found: dict[str, bool] = {}
    for end, (term, is_strict) in _automaton(strict, soft).iter(url):
        start = end - len(term) + 1
        if (start == 0 or not _word_char(url[start - 1])) and (end + 1 == len(url) or not _word_char(url[end + 1])):
            found[term] = is_strict
    n = sum(found.values())
    return n, len(found) - n


def term_counts(url: Column, strict: tuple = STRICT, soft: tuple = SOFT) -> Column:
    """Struct (n_strict, n_soft) of a lower-cased URL column; null counts nothing."""
    @F.pandas_udf("n_strict int, n_soft int")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([(0, 0) if u is None else count_terms(u, strict, soft) for u in s],
                               columns=["n_strict", "n_soft"])

    return counts(url)


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict: tuple = STRICT,
          soft: tuple = SOFT, min_soft: int = MIN_SOFT) -> DataFrame:
    """page_id, host, path, rule, verdict, and the term counts of each URL."""
    host, path = host_path(F.col("u"))
    df = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("u"))
    df = df.select("page_id", host.alias("host"), path.alias("path"),
                   term_counts(F.translate("u", UPPER, LOWER), strict, soft).alias("c"))
    df = df.withColumn("r", first_rule(F.col("host"), F.col("path"), rules))
    hit = (F.col("c.n_strict") > 0) | (F.col("c.n_soft") >= min_soft)
    own = F.when(hit, F.lit("block")).otherwise(F.lit("allow"))
    return df.select("page_id", "host", "path", F.col("r.rule").alias("rule"),
                     F.coalesce(F.col("r.verdict"), own).alias("verdict"),
                     F.col("c.n_strict").alias("n_strict"), F.col("c.n_soft").alias("n_soft"))


def _sql_count(terms) -> str:
    return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT" for t in terms)


_FIT = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
ORACLE = f"""
WITH a AS (SELECT page_id, translate(url, '{UPPER}', '{LOWER}') AS u,
                  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
b AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
             coalesce({_sql_count(STRICT)}, 0) AS n_strict, coalesce({_sql_count(SOFT)}, 0) AS n_soft FROM a),
r(verdict, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
f AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(r.verdict, length(h || p)) AS verdict
      FROM (SELECT DISTINCT host, path FROM b) AS x
      JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, b.host, b.path, f.rule,
       coalesce(f.verdict, CASE WHEN n_strict > 0 OR n_soft >= {MIN_SOFT} THEN 'block' ELSE 'allow' END) AS verdict,
       n_strict, n_soft
FROM b LEFT JOIN f ON b.host = f.host AND b.path = f.path
"""


def query(spark, sf_dir):
    from .common import table

    return judge(table(spark, sf_dir, "pages", "page_id", "url"))
