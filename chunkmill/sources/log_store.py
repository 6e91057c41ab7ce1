"""Log-structured chunk store: immutable batch folders, a manifest log, deletes as bitmaps, compaction.

Layout under a store's root::

    data/folder=<name>/     one batch of chunks, written once and never changed
    names/folder=<name>/    its documents: where each one's chunks start and how many there are
    deletes/<id>/           bitmaps of deleted rows: one word of 64 rows per line, for some folders
    log/commit=<number>/    one commit: the folders it adds, their new bitmaps, the folders it drops

A row's place is (folder, part file, position in the part). Rows carry no number of their own: a folder's
manifest entry holds the rows of each part and its first id, so ``id`` and ``row_no`` are an offset plus a
position, and a batch is written in one pass, without numbering its texts first. What an append writes depends
on the batch only.

A commit is a small file that must not exist yet. Of two writers that took the same number (also on stores
whose "create" isn't atomic) readers and writers both take the one with the smaller writer id; the other one
gets ``CommitConflict`` and nothing of it is ever read. Every ``SNAPSHOT_EVERY``-th commit repeats all live folders,
so a reader replays a bounded number of commits.

Deletes never rewrite chunks: the documents' ranges become bitmap words that the scan applies. The words
of all live folders stay below ``MOST_WORDS`` (checked at every delete: beyond it the folders with most deletes
are compacted first), so they may be broadcast, as may the offsets (one row per part file). ``compact`` merges small
folders and folders with many deletes; rows keep their ids.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import PAGE_SIZE
from ..functions.text import preview
from ..session import cut_lineage, range_partitioned

SNAPSHOT_EVERY = 20
MOST_WORDS = 1 << 20  # words of 64 rows with pending deletes: some 30 MB when broadcast
SMALL_ROWS = 1 << 16  # folders below this are merged by a compaction
DELETED_SHARE = 0.2  # folders with a larger share of deleted rows are rewritten by a compaction

_DATA = ("part int, at long, doc string, id long, filename string, chunk_index int, chunk_text string, metadata string, "
         "created_at timestamp, folder string")
_NAMES = "part int, doc string, filename string, first_at long, chunks long, folder string"
_WORDS = "folder string, part int, word long, bits long"
_LOG = ("writer string, action string, folder string, parts array<int>, part_rows array<long>, first_id long, last_id long, "
        "deletes string, deleted long, words long, stream string, batch long, commit long")
_ORDER_BITS = 33  # monotonically_increasing_id = part << 33 | position


class CommitConflict(RuntimeError):
    """Another writer committed on top of the same state."""


@dataclass(frozen=True)
class Folder:
    """A live folder. ``first_id`` is None where rows keep stored ids (after a compaction)."""

    name: str
    parts: tuple = ()
    part_rows: tuple = ()
    first_id: int | None = None
    last_id: int = 0
    deletes: str | None = None
    deleted: int = 0
    words: int = 0

    @property
    def rows(self) -> int:
        return sum(self.part_rows)


@dataclass(frozen=True)
class Manifest:
    """The state of a store after some commit."""

    root: str
    commit: int = 0
    folders: tuple = field(default_factory=tuple)  # in commit order
    last_id: int = 0
    txns: dict = field(default_factory=dict)  # stream -> its last committed batch

    @property
    def chunks(self) -> int:
        return sum(f.rows - f.deleted for f in self.folders)

    @property
    def words(self) -> int:
        return sum(f.words for f in self.folders)


# ---------------------------------------------------------------------------------------------- log

def _missing(e: AnalysisException) -> bool:
    from .store_io import path_missing

    return path_missing(e)


def manifest(spark: SparkSession, root: str) -> Manifest | None:
    """The newest state of the store, None if there is no log. Reads the commits since the last snapshot."""
    root = root.rstrip("/")
    try:
        log = spark.read.schema(_LOG).json(f"{root}/log")
    except AnalysisException as e:
        if _missing(e):
            return None
        raise
    newest = log.agg(F.max("commit")).first()[0]
    if newest is None:
        return None
    start = newest - newest % SNAPSHOT_EVERY
    rows = log.where(F.col("commit") >= start).collect()
    state = Manifest(root)
    for number in sorted({r["commit"] for r in rows}):
        mine = [r for r in rows if r["commit"] == number]
        writer = min(r["writer"] for r in mine)
        state = _replay(state, number, [r for r in mine if r["writer"] == writer])
    return state


def _replay(state: Manifest, number: int, actions: list) -> Manifest:
    folders = {} if any(a["action"] == "snapshot" for a in actions) else {f.name: f for f in state.folders}
    last, txns = state.last_id, dict(state.txns)
    for a in sorted(actions, key=lambda a: (a["action"] == "drop", a["action"] == "deletes", a["folder"] or "")):
        if a["action"] == "drop":
            folders.pop(a["folder"], None)
        elif a["action"] == "deletes":
            folders[a["folder"]] = replace(folders[a["folder"]], deletes=a["deletes"], deleted=a["deleted"], words=a["words"])
        elif a["action"] == "add":
            folders[a["folder"]] = Folder(a["folder"], tuple(a["parts"]), tuple(a["part_rows"]), a["first_id"], a["last_id"],
                                          a["deletes"], a["deleted"] or 0, a["words"] or 0)
        elif a["action"] == "batch":
            txns[a["stream"]] = a["batch"]
        last = max(last, a["last_id"] or 0)
    return Manifest(state.root, number, tuple(sorted(folders.values(), key=lambda f: f.name)), last, txns)


def _entry(writer: str, action: str, f: Folder | None = None, **values) -> tuple:
    if f is not None:
        values |= {"folder": f.name, "parts": list(f.parts), "part_rows": list(f.part_rows), "first_id": f.first_id,
                   "last_id": f.last_id, "deletes": f.deletes, "deleted": f.deleted, "words": f.words}
    return (writer, action, *[values.get(name) for name in _LOG_FIELDS[2:]])


def commit(spark: SparkSession, base: Manifest, add: list[Folder] = (), deletes: list[Folder] = (), drop: list[str] = (),
           txn: tuple[str, int] | None = None) -> Manifest:
    """Publish changes on top of ``base``; raises ``CommitConflict`` if another writer was faster."""
    number, writer = base.commit + 1, uuid.uuid4().hex
    rows = [_entry(writer, "add", f) for f in add] + [_entry(writer, "deletes", f) for f in deletes]
    rows += [_entry(writer, "drop", Folder(name)) for name in drop]
    rows += [_entry(writer, "batch", stream=txn[0], batch=txn[1])] if txn else []
    as_rows = [dict(zip(_LOG_FIELDS, r, strict=True)) for r in rows]
    after = _replay(base, number, as_rows)
    if number % SNAPSHOT_EVERY == 0:
        rows = [_entry(writer, "snapshot", last_id=after.last_id)] + [_entry(writer, "add", f) for f in after.folders]
        rows += [_entry(writer, "batch", stream=s, batch=b) for s, b in after.txns.items()]
    path = f"{base.root}/log/commit={number}"
    schema = _LOG.rsplit(",", 1)[0]
    try:
        spark.createDataFrame(rows or [_entry(writer, "none")], schema).coalesce(1).write.mode("errorifexists").json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_ALREADY_EXISTS":
            raise CommitConflict(f"commit {number} of {base.root} exists") from e
        raise
    winner = spark.read.schema(schema).json(path).agg(F.min("writer")).first()[0]
    if winner != writer:
        raise CommitConflict(f"commit {number} of {base.root} went to another writer")
    return after


_LOG_FIELDS = [c.split()[0] for c in _LOG.split(", ")][:-1]


# ---------------------------------------------------------------------------------------------- scans

def _words(spark: SparkSession, folders) -> DataFrame | None:
    """Pending deletes of ``folders`` (each folder's newest bitmap); None if there are none."""
    paths: dict[str, list[str]] = {}
    for f in folders:
        if f.deletes:
            paths.setdefault(f.deletes, []).append(f.name)
    out = None
    for path, names in paths.items():
        one = spark.read.schema(_WORDS).parquet(path).where(F.col("folder").isin(names))
        out = one if out is None else out.unionByName(one)
    return out


def _without_deleted(spark: SparkSession, rows: DataFrame, folders, at: str) -> DataFrame:
    words = _words(spark, folders)
    if words is None:
        return rows
    words = F.broadcast(words.withColumnsRenamed({"folder": "_f", "part": "_p"}))  # at most MOST_WORDS rows
    place = F.expr(f"shiftright({at}, 6)")
    hit = F.expr(f"(shiftright(bits, cast({at} & 63 as int)) & 1) = 1")
    joined = rows.join(words, (rows["folder"] == F.col("_f")) & (rows["part"] == F.col("_p")) & (place == F.col("word")), "left")
    return joined.where(F.col("bits").isNull() | ~hit).select(*rows.columns)


def _offsets(spark: SparkSession, folders) -> DataFrame:
    """(folder, part) -> first id (null: stored) and first row number: one row per part file."""
    out, row = [], 0
    for f in folders:
        first = f.first_id
        for p, n in zip(f.parts, f.part_rows, strict=True):
            out.append((f.name, p, first, row))
            first = None if first is None else first + n
            row += n
    return F.broadcast(spark.createDataFrame(out, "folder string, part int, _first_id long, _first_row long"))


def _scan(spark: SparkSession, state: Manifest, kind: str, schema: str, folders=None) -> DataFrame:
    folders = state.folders if folders is None else folders
    if not folders:
        return spark.createDataFrame([], schema)
    paths = [f"{state.root}/{kind}/folder={f.name}" for f in folders]
    return spark.read.schema(schema).option("basePath", f"{state.root}/{kind}").parquet(*paths)


def read(spark: SparkSession, state: Manifest, row_no: bool = False, folders=None, batch_id: bool = False) -> DataFrame:
    """The live chunks ``id, filename, chunk_index, chunk_text, metadata, created_at``. ``row_no`` adds each row's
    number from the manifest's offsets (commit order; numbers of deleted rows are not used again before a compaction), ``batch_id`` the number of the commit
    that wrote the row's folder."""
    folders = state.folders if folders is None else folders
    cols = [F.coalesce("id", F.col("_first_id") + F.col("at")).alias("id"), "filename", "chunk_index", "chunk_text", "metadata", "created_at"]
    if row_no:
        cols.append((F.col("_first_row") + F.col("at")).alias("row_no"))
    if batch_id:
        cols.append(F.regexp_extract("folder", r"^b-(\d+)-", 1).cast("long").alias("batch_id"))
    rows = _without_deleted(spark, _scan(spark, state, "data", _DATA, folders), folders, "at")
    return rows.join(_offsets(spark, state.folders), ["folder", "part"]).select(*cols)


def documents(spark: SparkSession, state: Manifest) -> DataFrame:
    """The live documents ``folder, part, doc, filename, first_at, chunks``: narrow rows, no chunk is read."""
    return _without_deleted(spark, _scan(spark, state, "names", _NAMES), state.folders, "first_at")


def batch_documents(spark: SparkSession, state: Manifest) -> DataFrame:
    """The documents of the newest folder, also those that its own commit marked as deleted."""
    return _scan(spark, state, "names", _NAMES, state.folders[-1:])


def filenames(spark: SparkSession, state: Manifest) -> DataFrame:
    """T4 from the side tables."""
    return documents(spark, state).select("filename").distinct()


def page(spark: SparkSession, state: Manifest, number: int, per_page: int = PAGE_SIZE) -> DataFrame:
    """B1: one page ``id, filename, chunk_index, preview`` in (filename, chunk_index) order.

    The documents are put in order (narrow rows, range partitioned) and their chunk counts added up, per
    partition and over partitions; only the documents that overlap the page (at most ``per_page``) are then
    read from the chunks, by a pushed-down filter on their names."""
    from ..operators.browse import page_bounds

    number, _, offset = page_bounds(state.chunks, number, per_page)
    docs = documents(spark, state).groupBy("filename").agg(F.sum("chunks").alias("chunks"))
    docs = cut_lineage(range_partitioned(docs, ["filename"]).withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright("_mid", _ORDER_BITS)
    # a window of one partition, rows already in order
    inside = Window.partitionBy(pid).orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sums = docs.groupBy(pid.alias("_pid")).agg(F.sum("chunks").alias("_n"))
    sums = sums.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    placed = docs.withColumn("_in", F.coalesce(F.sum("chunks").over(inside), F.lit(0))).join(F.broadcast(sums), pid == F.col("_pid"))
    placed = placed.select("filename", (F.col("_in") + F.col("_off")).alias("start"), "chunks")
    hits = placed.where((F.col("start") < offset + per_page) & (F.col("start") + F.col("chunks") > offset))
    hits = hits.orderBy("start").collect()  # at most per_page documents
    if not hits:
        return read(spark, state).limit(0).select("id", "filename", "chunk_index", preview("chunk_text").alias("preview"))
    rows = read(spark, state).where(F.col("filename").isin([h["filename"] for h in hits]))
    rows = rows.select("id", "filename", "chunk_index", preview("chunk_text").alias("preview"))
    return rows.orderBy("filename", "chunk_index", "id").offset(offset - hits[0]["start"]).limit(per_page)


# ---------------------------------------------------------------------------------------------- changes

def _write_folder(spark: SparkSession, root: str, number: int, rows: DataFrame, stored_ids: bool) -> Folder:
    """Write one immutable folder and its documents; nothing refers to it before its commit."""
    name = f"b-{number:013d}-{uuid.uuid4().hex[:8]}"
    mid = F.monotonically_increasing_id()
    doc = F.col("doc").cast("string") if "doc" in rows.columns else F.lit(None).cast("string")
    made = F.col("created_at") if "created_at" in rows.columns else F.current_timestamp()
    rows.select(F.shiftright(mid, _ORDER_BITS).cast("int").alias("part"), mid.bitwiseAND(F.lit((1 << _ORDER_BITS) - 1)).alias("at"),
                doc.alias("doc"), (F.col("id") if stored_ids else F.lit(None)).cast("long").alias("id"), "filename",
                F.col("chunk_index").cast("int").alias("chunk_index"), "chunk_text", F.col("metadata").cast("string").alias("metadata"),
                made.cast("timestamp").alias("created_at")).write.parquet(f"{root}/data/folder={name}")
    written = spark.read.schema(_DATA).option("basePath", f"{root}/data").parquet(f"{root}/data/folder={name}")
    # a document's chunks lie together: one range per (part, document)
    ranges = written.groupBy("part", "doc", "filename").agg(F.min("at").alias("first_at"), F.max("at").alias("_last"),
                                                            F.count(F.lit(1)).alias("chunks"))
    whole = F.col("_last") - F.col("first_at") + 1 == F.col("chunks")
    chunks = F.when(whole, F.col("chunks")).otherwise(F.raise_error(F.concat(F.lit("chunks do not lie together: "), F.col("filename"))))
    ranges.select("part", "doc", "filename", "first_at", chunks.alias("chunks")).write.parquet(f"{root}/names/folder={name}")
    kept = spark.read.schema(_NAMES).option("basePath", f"{root}/names").parquet(f"{root}/names/folder={name}")
    parts = sorted(tuple(r) for r in kept.groupBy("part").agg(F.sum("chunks")).collect())  # one row per part file
    last = (written.agg(F.max("id")).first()[0] or 0) if stored_ids else 0
    return Folder(name, tuple(p for p, _ in parts), tuple(n for _, n in parts), None, last)


def _numbered(f: Folder, base: Manifest) -> Folder:
    return replace(f, first_id=base.last_id + 1, last_id=base.last_id + f.rows)


def delete_words(docs: DataFrame) -> DataFrame:
    """Ranges ``folder, part, first_at, chunks`` as bitmap words ``folder, part, word, bits``."""
    last = F.col("first_at") + F.col("chunks") - 1
    each = docs.select("folder", "part", "first_at", last.alias("last"),
                       F.explode(F.sequence(F.shiftright("first_at", 6), F.shiftright(last, 6))).alias("word"))
    lo, hi = F.greatest("first_at", F.shiftleft("word", 6)), F.least("last", F.shiftleft("word", 6) + 63)
    each = each.select("folder", "part", "word", (lo.bitwiseAND(F.lit(63))).cast("int").alias("lo"), (F.lit(63) - (hi - lo)).cast("int").alias("cut"))
    return each.groupBy("folder", "part", "word").agg(F.expr("bit_or(shiftleft(shiftrightunsigned(-1L, cut), lo))").alias("bits"))


def _mark(spark: SparkSession, state: Manifest, docs: DataFrame, folders=None) -> list[Folder]:
    """New bitmaps, written, of the folders that hold any of the ranges ``docs``."""
    folders = state.folders if folders is None else folders
    path = f"{state.root}/deletes/{uuid.uuid4().hex}"
    new, old = delete_words(docs), _words(spark, folders)
    if old is not None:
        hit = new.select("folder").distinct()
        new = new.unionByName(old.join(F.broadcast(hit), "folder", "left_semi"))  # at most one row per folder
        new = new.groupBy("folder", "part", "word").agg(F.bit_or("bits").alias("bits"))
    new.write.parquet(path)
    sums = spark.read.schema(_WORDS).parquet(path).groupBy("folder").agg(
        F.sum(F.bit_count("bits")).alias("deleted"), F.count(F.lit(1)).alias("words")).collect()  # one row per folder
    by_name = {f.name: f for f in folders}
    return [replace(by_name[r["folder"]], deletes=path, deleted=r["deleted"], words=r["words"]) for r in sums]


def append(spark: SparkSession, root: str, rows: DataFrame, base: Manifest | None = None, txn: tuple[str, int] | None = None) -> Manifest:
    """Append chunks ``filename, chunk_index, chunk_text, metadata`` (and ``created_at``) as one new folder. Ids follow the
    store's largest id. Rows that carry ``doc`` (the key of their document, whose chunks must lie together) are written as
    they come; others are first brought into (filename, chunk_index) order. Bytes written depend on ``rows`` only.
    ``txn`` (stream, batch) makes a replay of a committed batch change nothing."""
    base = base or manifest(spark, root) or Manifest(root.rstrip("/"))
    if txn and base.txns.get(txn[0], -1) >= txn[1]:
        return base
    rows = rows if "doc" in rows.columns else _clustered(rows.drop("id"))
    f = _write_folder(spark, base.root, base.commit + 1, rows, stored_ids=False)
    return commit(spark, base, add=[_numbered(f, base)], txn=txn)


def delete(spark: SparkSession, root: str, names: DataFrame, base: Manifest | None = None) -> tuple[Manifest, int]:
    """Delete all chunks of the named files; returns the new state and the number of deleted chunks. No chunk
    is read or rewritten, unless the pending deletes outgrow ``MOST_WORDS``: then a compaction comes first."""
    state = base or manifest(spark, root)
    if state is None:
        raise ValueError(f"no store at {root}")
    docs = documents(spark, state).join(names.select("filename").distinct(), "filename", "left_semi")
    marked = _mark(spark, state, docs)
    if not marked:
        return state, 0
    after = {f.name: f for f in state.folders} | {f.name: f for f in marked}
    if sum(f.words for f in after.values()) > MOST_WORDS:
        trial = replace(state, folders=tuple(sorted(after.values(), key=lambda f: f.name)))
        return _rewrite(spark, state, trial, _worst(trial), marked), state.chunks - trial.chunks
    new = commit(spark, state, deletes=marked)
    return new, state.chunks - new.chunks


def _worst(state: Manifest) -> list[Folder]:
    """Folders whose rewriting brings the pending deletes below half of the bound, most deletes first."""
    out, left = [], state.words
    for f in sorted(state.folders, key=lambda f: -f.words):
        if left <= MOST_WORDS // 2:
            break
        out.append(f)
        left -= f.words
    return out


def replace_documents(spark: SparkSession, root: str, rows: DataFrame, names: DataFrame, base: Manifest | None = None,
                      superseded: DataFrame | None = None) -> Manifest:
    """Delete the named files and append ``rows`` in one commit. ``superseded`` (documents ``doc`` of ``rows``) are
    written and marked as deleted at once."""
    base = base or manifest(spark, root) or Manifest(root.rstrip("/"))
    f = _numbered(_write_folder(spark, base.root, base.commit + 1, rows, stored_ids=False), base)
    old = documents(spark, base).join(names.select("filename").distinct(), "filename", "left_semi")
    ranges, folders = old.select("folder", "part", "first_at", "chunks"), base.folders
    if superseded is not None:
        mine = _scan(spark, base, "names", _NAMES, [f]).join(superseded.select(F.col("doc").cast("string").alias("doc")).distinct(),
                                                              "doc", "left_semi")
        ranges, folders = ranges.unionByName(mine.select("folder", "part", "first_at", "chunks")), (*folders, f)
    marked = _mark(spark, base, ranges, folders)
    new = next((m for m in marked if m.name == f.name), f)
    return commit(spark, base, add=[new], deletes=[m for m in marked if m.name != f.name])


def _rewrite(spark: SparkSession, base: Manifest, state: Manifest, victims: list[Folder], marked: list[Folder] = ()) -> Manifest:
    """Merge ``victims`` (seen with the bitmaps of ``state``) into one folder clustered by file name; rows keep their ids."""
    dropped = {f.name for f in victims}
    f = _write_folder(spark, base.root, base.commit + 1, _clustered(read(spark, state, folders=victims)), stored_ids=True)
    return commit(spark, base, add=[f], deletes=[m for m in marked if m.name not in dropped], drop=sorted(dropped))


def _clustered(rows: DataFrame) -> DataFrame:
    """A file's chunks together and in order; a hot file name is dealt over several parts (one range in each)."""
    return range_partitioned(rows, ["filename", "chunk_index", *(["id"] if "id" in rows.columns else [])])


def compact(spark: SparkSession, root: str, small_rows: int = SMALL_ROWS, share: float = DELETED_SHARE) -> Manifest:
    """Rewrite small folders and folders with many deletes as one folder; the others are not touched. Earlier
    folders stay on disk for readers of an earlier state."""
    state = manifest(spark, root)
    if state is None:
        raise ValueError(f"no store at {root}")
    small = [f for f in state.folders if f.rows < small_rows]
    victims = {f.name: f for f in state.folders if f.deleted > share * f.rows} | ({f.name: f for f in small} if len(small) > 1 else {})
    if not victims:
        return state
    return _rewrite(spark, state, state, list(victims.values()))


def publish(spark: SparkSession, root: str, store: DataFrame, base: Manifest | None = None) -> Manifest:
    """The rows of ``store`` become the whole store (one folder); ids are kept."""
    base = base or Manifest(root.rstrip("/"))
    f = _write_folder(spark, base.root, base.commit + 1, _clustered(store), stored_ids=True)
    return commit(spark, base, add=[f], drop=[old.name for old in base.folders])
