"""Refusals, error branches and fallbacks that the registered queries do not reach."""

import pytest
from pyspark.sql import functions as F

from chunkmill.operators.browse import page_chunks, page_info, selected_count
from chunkmill.operators.merge import active_store, import_as_new_store, import_replace, list_stores, missing_stores
from chunkmill.operators.samples import even_sample, select_by_ids
from chunkmill.operators.store import empty_store
from chunkmill.plans.process import process_documents

SCHEMA = "id long, filename string, chunk_index int, chunk_text string, metadata string, created_at timestamp"


def _store(spark, n=2500):
    return spark.range(n).select(F.col("id") + 1, F.concat(F.lit("f"), (F.col("id") % 97).cast("string"), F.lit(".txt")),
                                 (F.col("id") / 97).cast("int"), F.concat(F.lit("text "), F.col("id").cast("string")),
                                 F.lit("{}"), F.lit(None).cast("timestamp")).toDF(*[c.split()[0] for c in SCHEMA.split(", ")])


def test_page_fallback_equals_stored_row_no(spark):
    from chunkmill.sources.store_io import indexed_store

    s = _store(spark)
    plain = [tuple(r) for r in page_chunks(s, 2).collect()]
    stored = [tuple(r) for r in page_chunks(indexed_store(s), 2).collect()]
    assert plain == stored and len(plain) == 1000
    expect = sorted((r.filename, r.chunk_index, r.id) for r in s.collect())[1000:2000]
    assert [(r[1], r[2], r[0]) for r in plain] == expect


def test_empty_store_texts(spark):
    e = empty_store(spark)
    assert page_info(e, 3).first().page_info == "Page 0 of 0"
    assert page_chunks(e, 1).count() == 0
    sel = e.select(F.lit(False).alias("select"))
    assert selected_count(sel).first().selected == "0 selected"


def test_import_replace_refuses_empty_source(spark):
    target = _store(spark, 10)
    out = import_replace(target, empty_store(spark))
    assert sorted(r.id for r in out.collect()) == list(range(1, 11))


def test_registry_rules(spark):
    reg = spark.createDataFrame([(0, "A"), (1, "B")], "ordinal long, store string")
    assert [r.store for r in list_stores(reg).orderBy("ordinal").collect()] == ["wissensbasis", "A", "B"]
    assert active_store(reg, "B").first().active == "B"
    assert active_store(reg, "nope").first().active == "wissensbasis"
    with pytest.raises(ValueError):
        missing_stores(spark.createDataFrame([("A",)], "store string"), reg)
    stores = _store(spark, 5).withColumn("store", F.lit("A"))
    _, rep = import_as_new_store(stores, reg, "A", "B")
    assert rep.first().message == "Error: Database 'B' already exists"
    _, rep = import_as_new_store(stores, reg, "A", "  ")
    assert rep.first().message == "Error: Please provide a name for the imported database"


def test_sampling_errors(spark):
    rows = spark.range(5).withColumnRenamed("id", "id")
    with pytest.raises(ValueError, match="Cannot generate 6 samples from 5 chunks"):
        even_sample(rows, 6)
    with pytest.raises(ValueError, match="at least 1"):
        even_sample(rows, 0)
    assert [r.id for r in even_sample(rows, 2).orderBy("id").collect()] == [0, 2]
    sel = rows.select("id", F.lit(False).alias("select"))
    with pytest.raises(ValueError, match="No chunks selected"):
        select_by_ids(rows, sel)


def test_process_overwrite(spark, tmp_dir):
    import os

    d = f"{tmp_dir}/docs"
    os.makedirs(d)
    open(f"{d}/a.txt", "w").write("first version. " * 20)
    store = f"{tmp_dir}/store"
    process_documents(spark, d, store, splitter="window", size=100, overlap=0)
    open(f"{d}/a.txt", "w").write("second version. " * 40)
    details, _ = process_documents(spark, d, store, overwrite=True, splitter="window", size=100, overlap=0)
    assert details.first().message.startswith("Successfully processed a.txt")
    from chunkmill.sources.store_io import read_store

    texts = [r.chunk_text for r in read_store(spark, store).orderBy("chunk_index").collect()]
    assert texts and all("second" in t or t.startswith("version") or "version" in t for t in texts)
    assert not any("first" in t for t in texts)
