"""Distributed ordinals, skew-proof grouping and stream-equals-batch."""

from pyspark.sql import functions as F

from chunkmill.functions.ordering import with_row_index
from chunkmill.operators.grouped import grouped_percentile, ordinal_lag
from chunkmill.operators.merge import merge_stores
from chunkmill.streaming.ingest import stream_ingest


def test_row_index_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k"))
    r = with_row_index(df, ["k"], "i", num_partitions=7).collect()
    assert sorted((x.k, x.i) for x in r) == [(k, k) for k in range(5000)]


def test_hot_key_lag_and_percentile(spark):
    # one group holds most rows
    rows = [(0 if i < 900 else 1 + i % 5, i, float(i % 97)) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, o long, v double")
    lag = {(x.g, x.o): x.v_prev for x in ordinal_lag(df, "g", "o", ["v"]).collect()}
    prev = {}
    for g, o, v in sorted(rows):
        assert lag[(g, o)] == prev.get(g)
        prev[g] = v
    import numpy as np

    got = {x.g: x.threshold for x in grouped_percentile(df, "g", "v", 0.5).collect()}
    for g in got:
        assert abs(got[g] - np.percentile([v for gg, _, v in rows if gg == g], 50)) < 1e-9


def test_merge_first_store_wins(spark):
    rows = [("A", 0, "f1", 0, "a"), ("B", 1, "f1", 0, "b"), ("B", 1, "f2", 0, "b2"), ("B", 1, "f2", 1, "b3"),
            ("C", 2, "f2", 0, "c"), ("C", 2, "f3", 0, "c3")]
    df = spark.createDataFrame(rows, "store string, store_rank int, filename string, chunk_index int, chunk_text string")
    got = sorted((r.store, r.filename, r.chunk_index) for r in merge_stores(df).collect())
    assert got == [("A", "f1", 0), ("B", "f2", 0), ("B", "f2", 1), ("C", "f3", 0)]
    again = merge_stores(merge_stores(df))
    assert sorted(r.filename for r in again.collect()) == ["f1", "f2", "f2", "f3"]


def test_stream_equals_batch(spark, tmp_dir):
    src = "/root/testdata/sf0.001/documents.parquet"
    out = stream_ingest(spark, src, f"{tmp_dir}/store", size=512, overlap=50)
    from chunkmill.operators.chunking import explode_chunks, window_chunks

    d = spark.read.parquet(src).select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
                                       window_chunks("text", 512, 50).alias("chunks"))
    batch = explode_chunks(d).select("filename", "chunk_index", "chunk_text")
    a = sorted((r.filename, r.chunk_index, r.chunk_text) for r in out.collect())
    b = sorted((r.filename, r.chunk_index, r.chunk_text) for r in batch.collect())
    assert a == b
    ids = sorted(r.id for r in out.collect())
    assert ids == list(range(1, len(ids) + 1))


def test_stream_multiple_batches_skip_stored_names(spark, tmp_dir):
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    d = f"{tmp_dir}/incoming"
    src.where("doc_id < 80").coalesce(1).write.parquet(f"{d}/a")
    src.where("doc_id >= 80").coalesce(1).write.parquet(f"{d}/b")
    # a later file repeats names that are already stored, with different text
    src.where("doc_id < 20").withColumn("text", F.lit("replacement text")).coalesce(1).write.parquet(f"{d}/c")
    import glob
    import os
    import shutil

    flat = f"{tmp_dir}/flat"
    os.makedirs(flat)
    for i, sub in enumerate("abc"):
        for f in glob.glob(f"{d}/{sub}/*.parquet"):
            shutil.copy(f, f"{flat}/{i}-{sub}.parquet")
    out = stream_ingest(spark, flat, f"{tmp_dir}/store", max_files_per_trigger=1, size=512, overlap=50)
    rows = out.collect()
    assert len({r.batch_id for r in rows}) >= 2
    names = [(r.filename, r.chunk_index) for r in rows]
    assert len(names) == len(set(names))
    assert not any(r.chunk_text == "replacement text" for r in rows)
    ids = sorted(r.id for r in rows)
    assert ids == list(range(1, len(ids) + 1))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stores_are_split_after_the_documents_are_dealt(spark, tmp_dir):
    from chunkmill.plans import fixtures

    sf = tmp_dir
    rows = [(i, None if i == 7 else f"word {i} " * (i * 20), ["en", "fr", "de", None][i % 4], "web") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
    for which in fixtures.STORE_ORDER:
        # the range partition samples its input: below it no text may be split
        text = plan(fixtures._derive_store(spark, sf, which, clustered=True))
        assert "regexp_extract_all" in text.split("RepartitionByExpression")[0] and "regexp_extract_all" not in text.split("RepartitionByExpression")[1]
        want = sorted(map(tuple, fixtures._derive_store(spark, sf, which).collect()), key=lambda r: (r[1], r[2]))
        got = fixtures.chunk_store(spark, sf, which).orderBy("row_no").collect()
        assert [tuple(r)[:-1] for r in got] == want and [r.row_no for r in got] == list(range(len(want)))


def test_metadata_is_cleaned_after_numbering(spark):
    from chunkmill.operators.merge import import_replace
    from chunkmill.operators.store import empty_store

    rows = [(7, "b", 0, "t", "{\"a\":1}"), (3, "a", 0, "u", "{bad"), (5, "a", 1, "v", None)]
    source = spark.createDataFrame(rows, "id long, filename string, chunk_index int, chunk_text string, metadata string")
    out = import_replace(empty_store(spark), source)
    assert "CASE WHEN" in plan(out)  # not below the range partition, which evaluates its input twice
    assert [(r.id, r.filename, r.metadata) for r in out.orderBy("id").collect()] == [(1, "a", "{}"), (2, "a", "{}"), (3, "b", "{\"a\":1}")]


def test_texts_are_grouped_once_however_many_stores(spark):
    from functools import reduce

    from chunkmill.operators.merge import merge_dedup_content

    stores = [spark.createDataFrame([(i, "f", i, f"text {i % 3}", "A") for i in range(6)], "id long, filename string, chunk_index int, chunk_text string, store string")
              .withColumn("store_rank", F.lit(k)) for k in range(3)]
    out = merge_dedup_content(reduce(lambda a, b: a.unionByName(b), stores))
    assert "sha2" not in plan(out) and "Aggregate" not in plan(out)
    assert sorted((r.store_rank, r.id) for r in out.collect()) == [(0, 0), (0, 1), (0, 2)]


def test_strip_is_python_strip(spark):
    from chunkmill.functions.text import WS_CHARS, ustrip

    assert set(WS_CHARS) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
    texts = [None, "", " \n", "\u3000a b\x1f", "a\u200b ", "\x85\xa0ä\u2028\n\n", "plain", "\U0001f600 \u2003", *(f"{c}x{c}y{c}" for c in WS_CHARS)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(ustrip("t")).collect()] == [t if t is None else t.strip() for t in texts]
    assert "regexp" not in plan(df.select(ustrip("t")))
