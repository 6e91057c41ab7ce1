"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit
per rule. A policy is a named, versioned set of rules, so applying it (or a later version of it)
is one bitwise AND over the ledger, and an ablation is a count of ledger rows per bit pattern: no
text is read again.

Defined cases: a null, empty or blank text has no words (all measurements 0) and fails
``too_few_words``; repeated rows are judged each for itself; an empty table gives an empty ledger;
columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_CLASS, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

# name -> failure condition over the measurements (integer arithmetic, no rounding); the position
# in this table is the rule's bit.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_phrases": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 10 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("too_few_words", "repeated_phrases")

# Versioned policies: later versions only add rules.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "short_words", "long_words"),
    "v2": tuple(RULES),
}
CURRENT = "v2"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def _starts(w: str) -> Column:
    return F.sequence(F.lit(0), F.size(w) - 3)


def _window_hashes(w: str) -> Column:
    return F.when(F.size(w) >= 3, F.transform(
        _starts(w), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))


def _sorted_windows(w: str, h: str) -> Column:
    """Three-word windows sorted with their positions, so that equal ones are neighbours. Texts
    whose window hashes are all distinct have no repeated window (equal windows have equal
    hashes) and are spared the sort; the comparison itself is on the words."""
    return F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(_starts(w), lambda i: F.struct(
        F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i")))))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the measurements of each text."""
    one = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    two = one.select("doc_id", words(F.col("t")).alias("w"), lines.alias("l"),
                     (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).alias("n_symbols"))
    three = two.select("doc_id", "w", "n_symbols", _window_hashes("w").alias("h"), F.size("l").alias("n_lines"),
                       (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"))
    three = three.withColumn("s", _sorted_windows("w", "h")).drop("h")
    same = lambda k, j: F.coalesce(F.get("s", k)["t"] == F.get("s", j)["t"], F.lit(False))
    at = F.sort_array(F.transform(F.filter("s", lambda x, k: same(k, k - 1) | same(k, k + 1)), lambda x: x["i"]))
    four = three.select("doc_id", "w", "n_symbols", "n_lines", "n_dup_lines", at.alias("p"))
    covered = F.aggregate("p", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                          lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")),
                          lambda a: a["n"])
    return four.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"), F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``failure_bits`` (one bit per rule of ``RULES``)."""
    bits = F.lit(0).cast("long")
    for rule, condition in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(bit(rule))).otherwise(F.lit(0)).cast("long"))
    return measure(df, id_col, text_col).withColumn("failure_bits", bits)


def apply_policy(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """``base_failed`` and the policy's verdict ``kept`` for each ledger row."""
    failed = lambda p: F.col("failure_bits").bitwiseAND(F.lit(mask(p))) != 0
    return led.withColumns({"base_failed": failed("base"), "kept": ~failed("base") & ~failed(policy),
                            "policy": F.lit(policy)})


def ablation(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """One row per rule of the policy: documents that fail it, that only it rejects, and that stay
    when it is switched off. The ledger is first counted per bit pattern (at most 2^rules rows)."""
    counts = led.groupBy("failure_bits").agg(F.count("*").alias("n"))
    m = mask(policy)
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("b"))
                                for r in POLICIES[policy]])).alias("r")
    bits, b = F.col("failure_bits").bitwiseAND(F.lit(m)), F.col("r.b")
    rows = counts.select("failure_bits", "n", rules)
    tally = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("long")
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        tally(bits.bitwiseAND(b) != 0).alias("n_failed"), tally(bits == b).alias("n_only"),
        tally(bits.bitwiseAND(F.bitwise_not(b)) == 0).alias("n_kept_without"))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
           "n_lines", "failure_bits")

ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS c FROM pos) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM w LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 50 AS r0, 100 * n_repeat_words > 50 * n_words AS r1, word_chars < 3 * n_words AS r2,
             word_chars > 10 * n_words AS r3, 10 * n_symbols > n_words AS r4, 10 * n_dup_lines > 3 * n_lines AS r5 FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (r0 OR r1) AS base_failed,
       NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5) AS kept, CAST(n_lines AS BIGINT) AS n_lines,
       CAST(r0::INT + 2 * r1::INT + 4 * r2::INT + 8 * r3::INT + 16 * r4::INT + 32 * r5::INT AS BIGINT) AS failure_bits
FROM f
"""


def query(spark, sf_dir):
    from .common import table

    return apply_policy(ledger(table(spark, sf_dir, "documents", "doc_id", "text"))).select(*COLUMNS)
