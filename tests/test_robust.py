"""Inputs that real folders and stores hold: bad bytes, long cells, deep JSON, failing reads, two writers."""

import json

import pytest
from pyspark.sql import functions as F

from chunkmill.operators.browse import edit_chunks
from chunkmill.operators.merge import store_sources
from chunkmill.operators.samples import generation_errors, generation_summary, parse_reply_or_wrap, parse_reply_strict
from chunkmill.operators.store import delete_documents, empty_store
from chunkmill.plans.process import process_documents
from chunkmill.sources import store_io
from chunkmill.sources.extract import csv_file_records, flatten_json_lines, flatten_json_to_text, read_csv_records


def put(path, data):
    with open(path, "wb") as f:
        f.write(data)


def test_a_failing_read_never_publishes_an_empty_store(spark, tmp_dir, monkeypatch):
    import os

    for name in ("a", "b"):
        os.makedirs(f"{tmp_dir}/{name}")
        put(f"{tmp_dir}/{name}/{name}.txt", b"some text of " + name.encode())
    root = f"{tmp_dir}/store"
    process_documents(spark, f"{tmp_dir}/a", store_root=root, splitter="window", size=100, overlap=10)
    before = store_io.current_version(spark, root)
    monkeypatch.setattr(store_io, "path_missing", lambda e: False)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store_io.current_version(spark, f"{tmp_dir}/nowhere")
    monkeypatch.undo()
    assert store_io.current_version(spark, f"{tmp_dir}/nowhere") is None
    process_documents(spark, f"{tmp_dir}/b", store_root=root, splitter="window", size=100, overlap=10)
    assert {r.filename for r in store_io.read_store(spark, root).collect()} == {"a.txt", "b.txt"}
    assert store_io.current_version(spark, root) > before


def test_second_writer_from_the_same_version_fails(spark, tmp_dir):
    root = f"{tmp_dir}/store"
    rows = spark.createDataFrame([(1, "f", 0, "t", "{}")], "id long, filename string, chunk_index int, chunk_text string, metadata string")
    first = rows.withColumn("created_at", F.current_timestamp())
    store_io.write_store(first, root)
    base = store_io.current_version(spark, root)
    store_io.update_store(spark, root, lambda s: s.unionByName(s.withColumns({"id": F.lit(2).cast("long"), "filename": F.lit("g")})))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        store_io.write_store(empty_store(spark), root, base=base)
    names = spark.createDataFrame([("f",)], "filename string")
    store_io.update_store(spark, root, lambda s: delete_documents(s, names)[0])
    assert [r.filename for r in store_io.read_store(spark, root).collect()] == ["g"]


def test_one_bad_file_fails_alone(spark, tmp_dir):
    put(f"{tmp_dir}/bad.txt", b"hello \xff world")
    put(f"{tmp_dir}/mark.txt", "kept � mark".encode())
    put(f"{tmp_dir}/bad.csv", b"a,b\xfe\n")
    put(f"{tmp_dir}/bad.json", b'{"a": "\xff"}')
    put(f"{tmp_dir}/broken.json", b"{broken")
    put(f"{tmp_dir}/deep.json", json.dumps({"k": 1}).encode())
    root = f"{tmp_dir}-store"
    details, _ = process_documents(spark, tmp_dir, store_root=root, splitter="window", size=100, overlap=10)
    assert {r.filename: r.success for r in details.collect()} == {
        "bad.txt": True, "mark.txt": True, "bad.csv": True, "bad.json": False, "broken.json": False, "deep.json": True}
    texts = {r.filename: r.chunk_text for r in store_io.read_store(spark, root).collect()}
    assert texts["bad.txt"] == "hello  world" and texts["mark.txt"] == "kept � mark" and texts["bad.csv"] == "a | b"


def test_long_and_ragged_csv(spark, tmp_dir):
    cell = "x" * 1_000_000
    rows = [f'{cell},"{cell}"', '"a ""q"", b\nc",d', "1,2,3,4", "5", '"open, end']
    df = spark.createDataFrame([("\n".join(rows),)], "t string")
    got = df.select(csv_file_records("t").alias("r")).first().r
    assert [len(x) for x in got[0]] == [1_000_000, 1_000_000] and got[1] == ['a "q", b\nc', "d"] and got[2:4] == [["1", "2", "3", "4"], ["5"]]
    put(f"{tmp_dir}/r.csv", b"a,b\n1,2,3,4\n\n5\n")
    assert [r.fields for r in read_csv_records(spark, tmp_dir).orderBy("record_no").collect()] == [["a", "b"], ["1", "2", "3", "4"], ["5"]]


def test_json_depth_numbers_and_keys(spark):
    deep = "1"
    for i in range(200):
        deep = f'{{"k{i}": {deep}}}' if i % 2 else f"[{deep}]"
    odd = '{"f": 0.00012345678901234567, "i": 123456789012345678901234567890123456789012, "e": 1e22, "d": 1, "d": 2, "n": null, "t": true, "x": [], "s": 1E-7}'
    df = spark.createDataFrame([(1, deep), (2, odd), (3, "not json"), (4, None)], "k long, j string")
    got = {r.k: r.text for r in flatten_json_to_text(df, "k", "j").collect()}
    assert set(got) == {1, 2} and got[1].endswith(": 1") and got[1].count("[0]") == 100
    assert got[2].split("\n") == ["f: 0.00012345678901234567", "i: 123456789012345678901234567890123456789012", "e: 1e+22", "d: 2", "n: None", "t: True", "s: 1e-07"]
    plan = flatten_json_lines(df, "k", "j")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_all_errors_and_all_keys(spark):
    results = spark.range(40).select(F.col("id").alias("request_no"), F.lit(None).cast("string").alias("sample"), F.lit("bad").alias("error"))
    assert generation_errors(results).count() == 40
    assert tuple(generation_summary(results).first()) == (0, 40, False)
    reply = '{"instruction": "a", "output": "b", "level": 3, "tags": ["x"]}'
    df = spark.createDataFrame([(reply,), ('{"instruction": "1", "output": "x", "output": "y"}',)], "r string")
    one, two = (r.s for r in df.select(parse_reply_or_wrap("r", F.lit("f")).alias("s")).collect())
    assert json.loads(one.sample) == json.loads(reply) and two.output == "y"
    assert [r.s.output for r in df.select(parse_reply_strict("r").alias("s")).collect()] == ["b", "y"]


def test_edits_and_sources(spark):
    store = spark.createDataFrame([(1, "a", "S", "f"), (2, "b", "S", "f")], "id long, chunk_text string, store string, filename string")
    edits = spark.createDataFrame([(1, "x", 1), (1, "c", 2)], "id long, new_text string, edit_no int")
    assert sorted((r.id, r.chunk_text) for r in edit_chunks(store, edits).collect()) == [(1, "c"), (2, "b")]
    assert [tuple(r) for r in store_sources(store).collect()] == [("S", "f", 2)]


def test_html_of_real_pages(spark):
    from chunkmill.sources.extract import html_to_text

    cases = {'<a title="x > y">link</a> &#1114112;&trade; &rarr; &times; &#38;lt; &ampx &am': "link �™ → × &lt; &x &am",
             "text<script>var a = 1; <b>": "text", "a<!-- never closed <b>x": "a", "1 < 2 <b>bold</b> <i class='a>b'>it</i>": "1 < 2 bold it",
             "<p title=\"open>text</p>": "text", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert [r.t for r in df.select(html_to_text("h").alias("t")).collect()] == list(cases.values())
