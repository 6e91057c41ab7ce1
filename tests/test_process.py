"""The folder-level job on literal files of every supported kind."""

import json
import os

from pyspark.sql import functions as F

from chunkmill.operators.store import delete_documents, empty_store, ingest, with_rows
from chunkmill.plans.process import process_documents
from chunkmill.sources.store_io import read_store, update_store, write_store


def test_process_folder(spark, tmp_dir):
    d = f"{tmp_dir}/docs"
    os.makedirs(f"{d}/sub")
    open(f"{d}/a.txt", "w").write("This is a test document. " * 100)
    open(f"{d}/b.MD", "w").write("# Title\r\n\r\nSome *markdown* text.")
    open(f"{d}/sub/c.html", "w").write("<html><title>T</title><body><p>Hallo  Welt</p><script>x()</script></body></html>")
    open(f"{d}/d.json", "w").write(json.dumps({"math": {"algebra": [{"name": "x"}]}, "n": 1}))
    open(f"{d}/e.csv", "w").write("Word,Translation\nHaus,house\n")
    open(f"{d}/f.ipynb", "w").write(json.dumps({"cells": [{"cell_type": "markdown", "source": "hi"}], "nbformat": 4}))
    open(f"{d}/g.py", "w").write("print(1)")
    open(f"{d}/h.txt", "w").write("   \n  ")
    open(f"{d}/i.json", "w").write("{broken")
    store = f"{tmp_dir}/store"
    details, summary = process_documents(spark, d, store, splitter="window", size=100, overlap=10)
    got = {r.filename: (r.success, r.message, r.chunks) for r in details.collect()}
    assert got["a.txt"] == (True, "Successfully processed a.txt: 28 chunks", 28)
    assert got["b.MD"][0] and got["c.html"][0] and got["d.json"][0] and got["e.csv"][0] and got["f.ipynb"][0]
    assert got["g.py"] == (False, "Could not extract text from g.py", 0)
    assert got["h.txt"] == (False, "File h.txt is empty", 0)
    assert got["i.json"] == (False, "Could not extract text from i.json", 0)
    s = summary.first()
    assert (s.total_files, s.successful, s.failed) == (9, 6, 3)
    texts = {r.filename: r.chunk_text for r in read_store(spark, store).where("chunk_index = 0").collect()}
    assert texts["c.html"] == "THallo\nWelt"
    assert texts["d.json"] == "math.algebra[0].name: x\nn: 1"
    assert texts["e.csv"] == "Word | Translation\nHaus | house"
    assert texts["b.MD"] == "# Title\n\nSome *markdown* text."
    # a second run skips everything already stored
    details2, _ = process_documents(spark, d, store, splitter="window", size=100, overlap=10)
    msgs = {r.filename: r.message for r in details2.collect()}
    assert msgs["a.txt"] == "File a.txt already processed (use overwrite=True to reprocess)"
    assert read_store(spark, store).count() == read_store(spark, store).select("filename", "chunk_index").distinct().count()


def put(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_requested_paths(spark, tmp_dir):
    d = f"{tmp_dir}/docs"
    os.makedirs(d)
    put(f"{d}/a.txt", "some words")
    put(f"{d}/b.txt", "more words")
    put(f"{d}/c.txt", " ")
    put(f"{d}/other.txt", "not requested")
    asked = [f"{d}/b.txt", f"{d}/gone.txt", f"{d}/a.txt", f"{d}/c.txt", f"{d}/b.txt", f"{d}/x.py"]
    requested = spark.createDataFrame(list(enumerate(asked)), "input_order long, path string")
    root = f"{tmp_dir}/s"
    details, summary = process_documents(spark, d, root, splitter="window", size=100, overlap=0, requested=requested)
    got = [tuple(r)[1:] for r in details.orderBy("input_order").collect()]
    assert got == [("b.txt", True, "Successfully processed b.txt: 1 chunks", 1), ("gone.txt", False, f"File not found: {d}/gone.txt", 0),
                   ("a.txt", True, "Successfully processed a.txt: 1 chunks", 1), ("c.txt", False, "File c.txt is empty", 0),
                   ("b.txt", False, "File b.txt already processed (use overwrite=True to reprocess)", 0),
                   ("x.py", False, f"File not found: {d}/x.py", 0)]
    assert tuple(summary.first()) == (6, 2, 4, 2)
    assert {r.filename for r in read_store(spark, root).collect()} == {"a.txt", "b.txt"}
    nothing = spark.createDataFrame([(0, f"{d}/gone.txt")], "input_order long, path string")
    details, _ = process_documents(spark, d, root, requested=nothing)
    assert [r.message for r in details.collect()] == [f"File not found: {d}/gone.txt"]


def test_one_new_file_writes_its_own_bytes_only(spark, tmp_dir):
    def files(root):
        return {os.path.join(b, f): os.path.getsize(os.path.join(b, f)) for b, _, fs in os.walk(root) for f in fs}

    added = {}
    for n in (2, 300):
        d, root = f"{tmp_dir}/docs{n}", f"{tmp_dir}/s{n}"
        os.makedirs(d)
        for i in range(n):
            put(f"{d}/f{i}.txt", f"text {i} " * 300)
        process_documents(spark, d, root, splitter="window", size=100, overlap=0)
        one = f"{tmp_dir}/one{n}"
        os.makedirs(one)
        put(f"{one}/new.txt", "new text " * 300)
        before = files(root)
        process_documents(spark, one, root, splitter="window", size=100, overlap=0)
        after = files(root)
        assert all(after[p] == size for p, size in before.items())
        added[n] = sum(size for p, size in after.items() if p not in before)
    assert abs(added[300] - added[2]) < 400


def test_overwrite_marks_old_chunks_and_keeps_the_last_of_a_name(spark, tmp_dir):
    d, root = f"{tmp_dir}/docs", f"{tmp_dir}/s"
    os.makedirs(f"{d}/sub")
    put(f"{d}/a.txt", "one " * 50)
    put(f"{d}/b.txt", "kept " * 50)
    process_documents(spark, d, root, splitter="window", size=100, overlap=0)
    data = {p for p, _, _ in os.walk(f"{root}/data")}
    put(f"{d}/a.txt", "two " * 10)
    put(f"{d}/sub/a.txt", "three " * 60)
    os.remove(f"{d}/b.txt")
    details, summary = process_documents(spark, d, root, overwrite=True, splitter="window", size=100, overlap=0)
    assert [r.chunks for r in details.orderBy("input_order").collect()] == [1, 4] and summary.first().successful == 2
    rows = read_store(spark, root).orderBy("id").collect()
    assert {r.filename for r in rows} == {"a.txt", "b.txt"}
    assert all("three" in r.chunk_text for r in rows if r.filename == "a.txt")
    assert data < {p for p, _, _ in os.walk(f"{root}/data")}
    assert len({r.id for r in rows}) == len(rows)


def test_a_store_of_versions_is_taken_over(spark, tmp_dir):
    root, d = f"{tmp_dir}/s", f"{tmp_dir}/docs"
    rows = spark.createDataFrame([(7, "old.txt", 0, "t", "{}"), (9, "old.txt", 1, "u", "{}")],
                                 "id long, filename string, chunk_index int, chunk_text string, metadata string")
    write_store(rows.withColumn("created_at", F.current_timestamp()), root)
    os.makedirs(d)
    put(f"{d}/old.txt", "again")
    put(f"{d}/new.txt", "new")
    details, _ = process_documents(spark, d, root, splitter="window", size=100, overlap=0)
    assert {r.filename: r.success for r in details.collect()} == {"old.txt": False, "new.txt": True}
    assert [(r.id, r.filename) for r in read_store(spark, root).orderBy("id").collect()] == [(7, "old.txt"), (9, "old.txt"), (10, "new.txt")]
    names = spark.createDataFrame([("old.txt",)], "filename string")
    update_store(spark, root, lambda s: delete_documents(s, names)[0])
    assert [r.id for r in read_store(spark, root).collect()] == [10]


def test_texts_are_not_shuffled_for_the_verdict(spark):
    files = spark.range(1000).select(F.col("id").alias("input_order"), F.concat(F.lit("f"), F.col("id") % 700).alias("filename"),
                                     F.lit("some text. " * 20).alias("text"), F.lit(".txt").alias("file_type"))
    for overwrite in (False, True):
        details, _ = ingest(files, empty_store(spark), overwrite=overwrite, splitter="window", size=50, overlap=0, build_store=False)
        plan = details._jdf.queryExecution().optimizedPlan().toString()
        assert details.where("success").count() == (1000 if overwrite else 700)
        text = details._jdf.queryExecution().executedPlan().toString()
        exchanges = [x for x in text.splitlines() if "Exchange" in x and "Broadcast" not in x]
        assert "_bits" in plan and not any("text" in x for x in exchanges)


def test_many_wanted_keys_are_joined_by_a_shuffle(spark):
    df = spark.range(1000).withColumnRenamed("id", "key")
    wanted = spark.range(0, 1000, 3).withColumnRenamed("id", "key")
    want = list(range(0, 1000, 3))
    for most in (1, 1 << 20):
        assert sorted(r.key for r in with_rows(df, "key", wanted, most_words=most).collect()) == want
    negative = spark.createDataFrame([(-1,), (-64,), (-65,), (5,)], "key long")
    assert sorted(r.key for r in with_rows(negative, "key", negative.where("key != -64")).collect()) == [-65, -1, 5]
