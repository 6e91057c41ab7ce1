"""The corpus pipeline over ``documents``: language ID, near-duplicates, repeated passages, source mix, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``docs``. ``run`` writes each result as Parquet in the shared checkpoint folder and reads it back as the next
stage's ``docs``, so a stage never recomputes its predecessors and survives a lost executor.

Defined cases, beyond those of the operators: texts are taken whole, however long, and of equally similar documents the one
with the smallest id stays; rows that repeat an id are judged by their own text; rows with a null id pass the near-duplicate stage (they link with nothing) and
lose no passage to each other; a text of which nothing is left is dropped, as its passages all stand in
documents with smaller ids; documents without words are not in the mix; a document that the mix
repeats is one row per copy; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkmill.llm import language, minhash_forest, mixing, packing, suffix_dedup
from chunkmill.llm.common import prepare, stored

# Names that no column of the documents has.
ID, HASH, TIMES = "_pipeline_id", "_pipeline_hash", "_pipeline_times"
# Share of rank agreement below which a text is in none of the learned languages.
LEAST_SCORE = 0.2


def identify_language(spark, docs, sf_dir):
    """Documents in a learned language: those without a letter or unlike every profile go."""
    prepare(spark)
    found = language.predict(F.col("text").cast("string"), language.fit(docs))
    return docs.filter((found["lang_pred"] != language.UNDETERMINED) & (found["score"] >= LEAST_SCORE))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of every group of near-duplicates (five-word shingles, similarity 0.8): the smallest id."""
    prepare(spark)
    kept = minhash_forest.near_duplicates(docs, width=5, share=80, text_hash=True).filter("kept")
    kept = kept.select(F.col("doc_id").alias(ID), F.col("text_hash").alias(HASH)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(ID)) & (F.xxhash64(F.col("text").cast("string")) == F.col(HASH))
    return docs.join(kept, same, "left_semi")


def drop_repeated_passages(spark, docs, sf_dir):
    """Texts without the passages that a document with a smaller id holds (bytes of cut characters go with them)."""
    prepare(spark)
    out = suffix_dedup.cut_documents(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix takes them."""
    prepare(spark)
    taken, _ = mixing.mix(docs, F.array(F.col("source").cast("string")))
    times = taken.filter("taken > 0").select(F.col("doc_id").alias(ID), F.expr("cast(taken div size as int)").alias("n"))
    times = times.groupBy(ID).agg(F.max("n").alias(TIMES))  # rows that repeat an id are taken alike
    out = docs.join(times, F.col("doc_id").eqNullSafe(F.col(ID)))
    return out.withColumn(TIMES, F.explode(F.sequence(F.lit(1), F.col(TIMES)))).select(*docs.columns)


def pack_sequences(spark, docs, sf_dir):
    """Pieces of training sequences."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

# Tokenisation and the similarity of sets have no SQL form; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
