"""Streaming ingestion and progress: state for names, details, replays, restarts, compaction."""

import glob
import os

import pandas as pd
from pyspark.sql import functions as F

from chunkmill.sources import log_store
from chunkmill.sources.store_io import read_store
from chunkmill.streaming import ingest as st


def drop_files(spark, folder, rows, n_files=1):
    """New files of the watched folder."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.repartition(n_files).write.mode("append").parquet(folder)


def details(spark, store):
    return sorted((r.input_order, r.success, r.message.split(" ")[0], r.chunks) for r in st.stream_details(spark, store).collect())


def test_names_are_kept_in_state_and_every_file_gets_a_row(spark, tmp_dir):
    folder, store, ckpt = f"{tmp_dir}/in", f"{tmp_dir}/s", f"{tmp_dir}/c"
    drop_files(spark, folder, [(1, "one " * 200), (2, None), (3, " \n"), (4, "four"), (4, "four again"), (5, "")])
    st.stream_ingest(spark, folder, store, checkpoint=ckpt, size=100, overlap=0)
    first = read_store(spark, store).collect()
    assert details(spark, store) == [(1, True, "Successfully", 8), (2, False, "Could", 0), (3, False, "File", 0), (4, False, "File", 0),
                                     (4, True, "Successfully", 1), (5, False, "Could", 0)]
    # earlier folders are not read by later triggers: not their chunks, not their names
    hidden = [p for p in glob.glob(f"{store}/data/*/*.parquet") + glob.glob(f"{store}/names/*/*.parquet")]
    kept = {p: open(p, "rb").read() for p in hidden}
    for p in hidden:
        open(p, "wb").write(b"")
    drop_files(spark, folder, [(4, "later"), (2, "now with text"), (6, "six " * 100)], 3)
    st.stream_ingest(spark, folder, store, checkpoint=ckpt, max_files_per_trigger=1, size=100, overlap=0, compact_every=0)
    for p, raw in kept.items():
        open(p, "wb").write(raw)
    rows = read_store(spark, store).collect()
    assert {r.filename: r.chunk_text for r in rows if r.chunk_index == 0 and r.filename in ("doc_4.txt", "doc_2.txt")} == {
        "doc_4.txt": next(r.chunk_text for r in first if r.filename == "doc_4.txt"), "doc_2.txt": "now with text"}
    got = details(spark, store)
    assert (2, True, "Successfully", 1) in got and (4, False, "File", 0) in got and (6, True, "Successfully", 4) in got and len(got) == 9
    assert len({r.id for r in rows}) == len(rows)


def test_a_replayed_batch_changes_nothing(spark, tmp_dir):
    store, source = f"{tmp_dir}/s", f"{tmp_dir}/src"
    drop_files(spark, source, [(1, "one " * 100), (2, "two")])
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")]

    def read_files(paths):
        return spark.read.parquet(*paths).select(*place, F.col("doc_id").alias("input_order"), F.concat(F.lit("f"), "doc_id").alias("filename"),
                                                 "text", F.lit(".txt").alias("file_type"))

    verdicts = spark.read.parquet(source).select(F.col("doc_id").alias("input_order"), F.concat(F.lit("f"), "doc_id").alias("filename"),
                                                 F.lit("ok").alias("verdict"), *place)
    for _ in range(3):
        st.ingest_batch(verdicts, 0, store, read_files, size=100, overlap=0)
    assert log_store.manifest(spark, store).commit == 1
    assert [(r.id, r.filename) for r in read_store(spark, store).orderBy("filename", "id").collect()] == [
        *[(i, "f1") for i in sorted(r.id for r in read_store(spark, store).where("filename = 'f1'").collect())],
        *[(r.id, "f2") for r in read_store(spark, store).where("filename = 'f2'").collect()]]
    assert len(details(spark, store)) == 2


def test_batches_are_compacted(spark, tmp_dir):
    folder, store = f"{tmp_dir}/in", f"{tmp_dir}/s"
    for i in range(5):
        drop_files(spark, folder, [(i, f"text {i} " * 50)])
    st.stream_ingest(spark, folder, store, max_files_per_trigger=1, compact_every=2, size=100, overlap=0)
    state = log_store.manifest(spark, store)
    assert len(state.folders) <= 2 and state.chunks == read_store(spark, store).count()
    assert {r.filename for r in read_store(spark, store).collect()} == {f"doc_{i}.txt" for i in range(5)}


def test_verdicts_of_one_name():
    class State:
        exists = False

        def update(self, value):
            self.exists = True

    def frame(*rows):
        return pd.DataFrame([(o, "f", v, "p", o) for o, v in rows], columns=["input_order", "filename", "verdict", "path", "row"])

    state = State()
    out = pd.concat(list(st._first_of_a_name(("f",), iter([frame((5, "ok"), (7, "empty")), frame((3, "ok"), (4, "ok")), frame((9, "ok"))]), state)))
    assert dict(zip(out["input_order"], out["verdict"])) == {5: "already", 7: "empty", 3: "ok", 4: "already", 9: "already"}
    out = pd.concat(list(st._first_of_a_name(("f",), iter([frame((1, "ok"), (2, "no_text"))]), state)))
    assert dict(zip(out["input_order"], out["verdict"])) == {1: "already", 2: "no_text"}


def test_progress_survives_a_restart(spark, tmp_dir):
    folder, table, ckpt = f"{tmp_dir}/in", f"{tmp_dir}/t", f"{tmp_dir}/c"

    def put(rows):
        spark.createDataFrame(rows, "kind string").coalesce(1).write.mode("append").parquet(folder)

    put([("a",), ("b",), ("a",), (None,)])
    got = st.stream_progress(spark, folder, "kind", table, checkpoint=ckpt)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 2), ("b", 1), (None, 1)], key=str)
    put([("a",)])
    put([("c",)])
    got = st.stream_progress(spark, folder, "kind", table, checkpoint=ckpt, max_files_per_trigger=1)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 3), ("b", 1), ("c", 1), (None, 1)], key=str)
    # a replayed trigger overwrites its own version
    last = max(int(p.split("=")[1]) for p in os.listdir(table) if "=" in p)
    st.progress_batch(spark.createDataFrame([("c", 1)], "status string, n long"), last, table)
    assert sorted(map(tuple, st.read_progress(spark, table).collect()), key=str) == sorted([("a", 3), ("b", 1), ("c", 1), (None, 1)], key=str)
    got = st.read_progress(spark, table)
    assert tuple(st.progress_done(got, 12).first()) == (6, 12, 0.5)
    assert tuple(st.progress_done(st.read_progress(spark, f"{tmp_dir}/none"), 0).first()) == (0, 0, 1.0)


def test_native_verdicts_like_the_rule_for_one_name(spark):
    import random

    class State:
        def __init__(self):
            self.exists = False

        def update(self, value):
            self.exists = True

    rnd, states, taken = random.Random(3), {}, set()
    cols = ["input_order", "filename", "verdict", "path", "row"]
    for b in range(3):
        rows = [(o, rnd.choice(["a", "b", "c", "d", None]), rnd.choice(["ok", "ok", "empty", "no_text"]), f"p{b}", o) for o in rnd.sample(range(100), 14)]
        want = set()
        for name in {r[1] for r in rows}:
            pdf = pd.DataFrame([r for r in rows if r[1] == name], columns=cols).astype({"filename": object})
            for out in st._first_of_a_name((name,), iter([pdf]), states.setdefault(name, State())):
                want |= {(o, v) for o, v in zip(out["input_order"], out["verdict"])}
        fresh = {r[1] for r in rows if r[2] == "ok"} - taken
        taken |= fresh
        arrived = [(*r, False) for r in rows] + [(None, n, "ok", None, None, True) for n in fresh]
        df = spark.createDataFrame(arrived, st._VERDICT + ", fresh boolean").repartition(3)
        assert {(r.input_order, r.verdict) for r in st.batch_verdicts(df).collect()} == want


def test_no_python_runs_per_name(spark, tmp_dir):
    drop_files(spark, f"{tmp_dir}/in", [(i, f"text {i}") for i in range(20)])
    schema = spark.read.parquet(f"{tmp_dir}/in").schema
    files = spark.readStream.schema(schema).parquet(f"{tmp_dir}/in").select(
        F.col("doc_id").alias("input_order"), F.col("doc_id").cast("string").alias("filename"), F.lit("ok").alias("verdict"), F.lit("p").alias("path"),
        F.col("doc_id").alias("row"))
    plan = st.file_arrivals(files)._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Deduplicate" in plan


def test_a_trigger_of_few_files_is_split_by_all_cores(spark, tmp_dir):
    folder, store = f"{tmp_dir}/in", f"{tmp_dir}/s"
    drop_files(spark, folder, [(i, f"text {i} " * 50) for i in range(200)])
    st.stream_ingest(spark, folder, store, max_files_per_trigger=1, size=100, overlap=0)
    assert len(log_store.manifest(spark, store).folders[0].parts) > 1  # one file, one trigger
