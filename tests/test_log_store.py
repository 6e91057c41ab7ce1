"""The log-structured store: appends, bitmap deletes, conditional commits, compaction."""

import os

import pytest
from pyspark.sql import functions as F

from chunkmill.operators.browse import page_chunks
from chunkmill.operators.merge import import_merge, merge_id_map, merge_renumbered, publish_merge
from chunkmill.operators.store import append_chunks, delete_documents
from chunkmill.sources import log_store as ls
from chunkmill.sources.store_io import read_store

COLS = ["id", "filename", "chunk_index", "chunk_text", "metadata"]


def chunks(spark, files, tag="x"):
    rows = [(f, i, f"{tag} {f} {i}", "{}") for f, n in files for i in range(n)]
    return spark.createDataFrame(rows, "filename string, chunk_index int, chunk_text string, metadata string")


def names(spark, *files):
    return spark.createDataFrame([(f,) for f in files], "filename string")


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def written(root):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(root) for f in files}


def test_append_equals_the_operator_and_ids_are_dense(spark, tmp_dir):
    root = f"{tmp_dir}/s"
    a, b = chunks(spark, [("b.txt", 3), ("a.txt", 70)]), chunks(spark, [("c.txt", 2), ("0.txt", 130)])
    ls.append(spark, root, a.repartition(3))
    state = ls.append(spark, root, b.repartition(4))
    got = rows(read_store(spark, root))
    want = append_chunks(append_chunks(ls.read(spark, ls.Manifest(root)), a), b)
    assert got == rows(want)
    assert [r[0] for r in got] == list(range(1, 206)) and state.chunks == 205 and state.last_id == 205
    numbered = ls.read(spark, state, row_no=True).orderBy("row_no").collect()
    assert [r["row_no"] for r in numbered] == list(range(205))
    assert [r["id"] for r in numbered] == list(range(1, 206))


def test_bytes_of_an_append_do_not_depend_on_the_store(spark, tmp_dir):
    sizes = {}
    for label, n in (("small", 1), ("large", 4000)):
        root = f"{tmp_dir}/{label}"
        ls.append(spark, root, chunks(spark, [(f"f{i}", 10) for i in range(n)]))
        before = written(root)
        ls.append(spark, root, chunks(spark, [("new.txt", 5)]).coalesce(1))
        after = written(root)
        assert all(after[p] == s for p, s in before.items())  # nothing is rewritten
        sizes[label] = sum(s for p, s in after.items() if p not in before)
    assert sizes["large"] < sizes["small"] * 1.1 + 200


def test_deletes_are_bitmaps(spark, tmp_dir):
    root = f"{tmp_dir}/s"
    files = [(f"f{i:03d}", 1 + i % 150) for i in range(60)]
    state = ls.append(spark, root, chunks(spark, files).repartition(4))
    state = ls.append(spark, root, chunks(spark, [("g", 64), ("h", 1), ("i", 200)]))
    data = {p: s for p, s in written(f"{root}/data").items()}
    store, gone = ls.read(spark, state), names(spark, "f003", "f059", "g", "f059", "nobody")
    want, n = delete_documents(store, gone)
    want = rows(want)
    state, deleted = ls.delete(spark, root, gone)
    assert deleted == n.first()[0] == 4 + 60 + 64
    assert rows(read_store(spark, root)) == want and state.chunks == len(want)
    assert written(f"{root}/data") == data  # no chunk was rewritten
    # a second delete adds to the bitmaps; names, pages and imports see only live documents
    state, deleted = ls.delete(spark, root, names(spark, "f010", "g", "i"))
    assert deleted == 11 + 200
    live = rows(read_store(spark, root))
    assert {r[1] for r in live} == {r["filename"] for r in ls.filenames(spark, state).collect()}
    for number in (1, 2, 3, 99):
        assert [tuple(r) for r in ls.page(spark, state, number, 700).collect()] == [
            tuple(r) for r in page_chunks(read_store(spark, root), number, 700).collect()]
    more = chunks(spark, [("f010", 2), ("f011", 5), ("z", 1)], "new").withColumns(
        {"id": F.monotonically_increasing_id(), "created_at": F.lit(None).cast("timestamp")})
    merged = import_merge(read_store(spark, root), more)
    assert {r["filename"] for r in merged.where("chunk_text like 'new%'").collect()} == {"f010", "z"}
    assert ls.delete(spark, root, names(spark, "nobody"))[1] == 0
    # compaction keeps rows and ids, and touches only what needs it
    before = ls.manifest(spark, root)
    after = ls.compact(spark, root, small_rows=100, share=0.2)
    assert rows(read_store(spark, root)) == live and after.chunks == len(live)
    kept = {f.name for f in before.folders if f.deleted <= 0.2 * f.rows and f.rows >= 100}
    assert kept <= {f.name for f in after.folders} and len(after.folders) == len(kept) + 1
    state, deleted = ls.delete(spark, root, names(spark, "h", "f011"))
    assert deleted == 13 and rows(read_store(spark, root)) == [r for r in live if r[1] not in ("h", "f011")]
    nxt = ls.append(spark, root, chunks(spark, [("new", 1)]))
    assert max(r[0] for r in rows(ls.read(spark, nxt))) == state.last_id + 1  # ids are not used again


def test_a_hot_file_over_many_parts(spark, tmp_dir):
    root = f"{tmp_dir}/s"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        state = ls.append(spark, root, chunks(spark, [("hot", 5000), ("a", 3), ("z", 10)]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(state.folders[0].parts) > 1
    state, deleted = ls.delete(spark, root, names(spark, "hot"))
    assert deleted == 5000 and state.chunks == 13
    assert [r["filename"] for r in ls.page(spark, state, 1).collect()] == ["a"] * 3 + ["z"] * 10


def test_pending_deletes_are_bounded(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(ls, "MOST_WORDS", 20)
    root = f"{tmp_dir}/s"
    ls.append(spark, root, chunks(spark, [(f"f{i:03d}", 40) for i in range(100)]))
    ls.append(spark, root, chunks(spark, [("g", 10)]))
    state = ls.manifest(spark, root)
    for k in range(6):
        state, deleted = ls.delete(spark, root, names(spark, *[f"f{i:03d}" for i in range(k * 10, k * 10 + 10)]))
        assert deleted == 400 and state.words <= 20
    got = rows(read_store(spark, root))
    assert len(got) == 1610 == state.chunks and min(r[0] for r in got) == 2401


def test_replace_in_one_commit(spark, tmp_dir):
    root = f"{tmp_dir}/s"
    state = ls.append(spark, root, chunks(spark, [("a", 3), ("b", 4)]))
    new = chunks(spark, [("a", 2), ("c", 1)], "new").withColumn("doc", F.col("filename"))
    state = ls.replace_documents(spark, root, new, names(spark, "a"), superseded=spark.createDataFrame([("c",)], "doc string"))
    assert state.commit == 2
    assert [(r[0], r[1], r[3][:3]) for r in rows(read_store(spark, root))] == [(4, "b", "x b"), (5, "b", "x b"), (6, "b", "x b"), (7, "b", "x b"),
                                                                             (8, "a", "new"), (9, "a", "new")]


def test_one_of_two_writers_wins(spark, tmp_dir):
    root = f"{tmp_dir}/s"
    base = ls.append(spark, root, chunks(spark, [("a", 1)]))
    ls.append(spark, root, chunks(spark, [("b", 1)]), base=base)
    with pytest.raises(ls.CommitConflict):
        ls.append(spark, root, chunks(spark, [("c", 1)]), base=base)
    # both files of one commit number, as on a store without an atomic create: the smaller writer id counts
    entry = [tuple("0" if n == "writer" else "none" if n == "action" else None for n in ls._LOG_FIELDS)]
    spark.createDataFrame(entry, ls._LOG.rsplit(",", 1)[0]).coalesce(1).write.mode("append").json(f"{root}/log/commit=2")
    assert [r[1] for r in rows(read_store(spark, root))] == ["a"]


def test_snapshots_bound_the_replay(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(ls, "SNAPSHOT_EVERY", 3)
    root = f"{tmp_dir}/s"
    for i in range(7):
        state = ls.append(spark, root, chunks(spark, [(f"f{i}", 2)]), txn=("stream", i))
    assert ls.append(spark, root, chunks(spark, [("again", 2)]), txn=("stream", 6)).commit == 7  # a replayed batch changes nothing
    assert ls.manifest(spark, root) == state and state.txns == {"stream": 6}
    for commit in range(1, 6):  # not read any more
        for p in written(f"{root}/log/commit={commit}"):
            open(p, "w").close()
    assert ls.manifest(spark, root) == state
    assert len(rows(read_store(spark, root))) == 14


def test_chunks_of_a_document_must_lie_together(spark, tmp_dir):
    mixed = chunks(spark, [("a", 2), ("b", 1)]).coalesce(1).orderBy("chunk_index", "filename").withColumn("doc", F.col("filename")).coalesce(1)
    with pytest.raises(Exception, match="do not lie together"):
        ls.append(spark, f"{tmp_dir}/s", mixed)


def test_empty(spark, tmp_dir):
    assert ls.manifest(spark, f"{tmp_dir}/none") is None
    state = ls.append(spark, f"{tmp_dir}/s", chunks(spark, []))
    assert state.chunks == 0 and read_store(spark, f"{tmp_dir}/s").count() == 0
    assert ls.page(spark, state, 1).count() == 0
    with pytest.raises(ValueError):
        ls.delete(spark, f"{tmp_dir}/none", names(spark, "a"))


def test_merge_publishes_new_ids(spark, tmp_dir):
    def store(rank, files, tag, meta="{}"):
        return chunks(spark, files, tag).withColumns({"id": F.monotonically_increasing_id() + 1, "store_rank": F.lit(rank),
                                                      "metadata": F.lit(meta), "created_at": F.lit(None).cast("timestamp")})

    stores = store(0, [("a", 2), ("b", 3)], "s0").coalesce(1).unionByName(store(1, [("b", 1), ("c", 2)], "s1", "not json").coalesce(1))
    ids = merge_id_map(stores)
    assert sorted(r.id for r in ids.collect()) == list(range(1, 8))
    got = merge_renumbered(stores).collect()
    assert len({r.id for r in got}) == 7 and {r.metadata for r in got if r.filename == "c"} == {"{}"}
    root = f"{tmp_dir}/s"
    total = publish_merge(spark, stores, root).first()
    assert (total.documents, total.chunks) == (3, 7)
    more = store(0, [("c", 9), ("d", 2)], "s2").coalesce(1)
    total = publish_merge(spark, more, root).first()  # the target comes first
    assert (total.documents, total.chunks) == (4, 9)
    out = rows(read_store(spark, root))
    assert [r[0] for r in out] == list(range(1, 10)) and all(r[3].startswith("s1") for r in out if r[1] == "c")
    assert publish_merge(spark, more, root).first().chunks == 9  # a repeat adds nothing
