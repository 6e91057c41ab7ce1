"""WARC archives: segmented writing, and reading with segment reassembly.

Writing: one record per row of pages. Of the pages with equal payloads (at least ``min_bytes`` long) the
one with the smallest id becomes a response, the others revisits that refer to it. The response
block is an HTTP message with chunked transfer framing; a block longer than ``segment_bytes`` is cut
into a first segment and continuation records that name their origin, their number and, in the
last one, the total length. Records are Spark rows of text, written by Spark's own text writer with the
WARC record end as line separator, so files are committed like any other table and may lie in any
store that Spark knows. Files are gzip-compressed as a whole.

Reading: each archive file is unpacked piece by piece and parsed record by record (lengths decide, not separators); whole
blocks are decoded at once, segments are grouped by their origin, ordered by number, checked for
gaps and against the total length, joined, and their chunk framing decoded.

Defined cases: null html is an empty payload; a null page id sorts last; every row is archived and comes back as
a row, also rows that repeat an id, a payload or both (of rows tied on the smallest id one is the response, the
others refer to its id); long payloads are cut into segments and joined again, whole in one task; line breaks in a
URL are percent-encoded; an empty table gives an empty archive; other columns are ignored. A record whose segments are
incomplete is an error.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import with_rows
from .common import arrow_schema, stored

CRLF = "\r\n"
END = CRLF + CRLF
DATE = "2026-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_PER_FILE = 512  # of at most segment_bytes each
READ_BYTES = 1 << 20  # bytes that the reader unpacks at once
HTTP = CRLF.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", ""))


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight groups of 20 bits, four digits each."""
    hexed = F.sha1(payload)
    digits = []
    for g in range(8):
        v = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(BASE32), (F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def _pieces(binary: Column, size: int) -> Column:
    """Consecutive pieces of at most ``size`` bytes, as strings of raw bytes; empty if no bytes."""
    n = F.ceil(F.octet_length(binary) / F.lit(size)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(
        binary, ((k - 1) * size + 1).cast("int"), F.lit(size)).cast("string"))).otherwise(F.array().cast("array<string>"))


def chunked(binary: Column, chunk_bytes: int) -> Column:
    """Chunked transfer framing of a payload, as a string of raw bytes."""
    framed = F.transform(_pieces(binary, chunk_bytes), lambda c: F.concat(
        F.lower(F.hex(F.octet_length(c).cast("long"))), F.lit(CRLF), c, F.lit(CRLF)))
    return F.concat(F.array_join(framed, ""), F.lit("0" + END))


def _header(**fields) -> Column:
    """A record's header lines; fields whose value is null are left out."""
    lines = [F.lit("WARC/1.1" + CRLF)]
    for name, value in fields.items():
        lines.append(F.coalesce(F.concat(F.lit(name.replace("_", "-") + ": "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*lines, F.lit(CRLF))


def records(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = 8192, segment_bytes: int = 32768) -> DataFrame:
    """One row ``value`` per WARC record (header and block, without the record end).

    Every row gets a number of its own, which its record id carries; the numbered rows are written once, so that the choice
    of responses and the payloads agree. Responses are found over narrow rows (digest, length, id, number) and
    then picked by number, so payloads are not shuffled."""
    src = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "html")
    src = stored(src, "warc-pages").select(
        "row", "page_id", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("uri"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    src = src.withColumn("n", F.octet_length("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    narrow = stored(src.select("row", "page_id", "uri", "digest", "n"), "warc-rows")
    place = F.struct(F.col("page_id").isNull().alias("null_id"), "page_id", "row")
    first = narrow.filter(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.min(place).alias("f"))
    first = first.select("digest", "n", F.col("f.page_id").alias("first_id"), F.col("f.row").alias("first_row"))
    chosen = first.select(F.col("first_row").alias("row"))
    if min_bytes > 0:
        chosen = chosen.unionByName(narrow.filter(F.col("n") < min_bytes).select("row"))
    full = with_rows(src, "row", chosen)
    rid = lambda page, digest, row: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), digest,
                                             F.lit(":"), row.cast("string"), F.lit(">"))
    common = {"WARC_Date": F.lit(DATE), "WARC_Target_URI": F.col("uri"),
              "WARC_Payload_Digest": F.concat(F.lit("sha1:"), F.col("digest"))}
    block = F.concat(F.lit(HTTP + "Transfer-Encoding: chunked" + END), chunked(F.col("payload"), chunk_bytes)).cast("binary")
    full = full.select("row", "page_id", "uri", "digest", block.alias("block"))
    full = full.select("row", "page_id", "uri", "digest", F.octet_length("block").alias("total"),
                       F.posexplode(_pieces(F.col("block"), segment_bytes)).alias("k", "part"))
    many, last = F.col("total") > segment_bytes, (F.col("k") + 1) * segment_bytes >= F.col("total")
    origin = rid(F.col("page_id"), F.col("digest"), F.col("row"))
    response = F.concat(_header(
        WARC_Type=F.when(F.col("k") == 0, F.lit("response")).otherwise(F.lit("continuation")),
        WARC_Record_ID=F.when(F.col("k") == 0, origin).otherwise(
            F.concat(F.regexp_replace(origin, ">$", ":"), (F.col("k") + 1).cast("string"), F.lit(">"))),
        Content_Type=F.lit("application/http;msgtype=response"),
        WARC_Segment_Number=F.when(many, (F.col("k") + 1).cast("string")),
        WARC_Segment_Origin_ID=F.when(F.col("k") > 0, origin),
        WARC_Segment_Total_Length=F.when(many & last, F.col("total").cast("string")),
        Content_Length=F.octet_length("part").cast("string"), **common), F.col("part"))
    # revisits carry only the HTTP header with the payload's length
    again = narrow.join(first, ["digest", "n"]).filter(F.col("row") != F.col("first_row"))
    head = F.concat(F.lit(HTTP + "Content-Length: "), F.col("n").cast("string"), F.lit(END))
    revisit = F.concat(_header(
        WARC_Type=F.lit("revisit"), WARC_Record_ID=rid(F.col("page_id"), F.col("digest"), F.col("row")),
        Content_Type=F.lit("application/http;msgtype=response"),
        WARC_Profile=F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        WARC_Refers_To=rid(F.col("first_id"), F.col("digest"), F.col("first_row")),
        Content_Length=F.octet_length(head).cast("string"), **common), head)
    return full.select(response.alias("value")).unionByName(again.select(revisit.alias("value")))


def write_archive(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, **sizes) -> None:
    """Write ``page_id, url, html`` as WARC files under ``path``; with ``records_per_file`` records of at
    most ``segment_bytes`` each, a file's size is bounded."""
    (records(pages, **sizes).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def unpacked(raw: bytes) -> Iterator[bytes]:
    """The bytes of an archive file, piece by piece: plain, or gzip as a whole or member by member."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    while raw:
        z, rest = zlib.decompressobj(31), raw
        while not z.eof:
            piece, rest = z.decompress(rest, READ_BYTES), z.unconsumed_tail
            if piece:
                yield piece
            elif not rest and not z.eof:
                raise ValueError("archive file cut short")
        raw = z.unused_data


def parse_records(raw: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields (names in lower case) and block of each record of one archive file. Holds one record and
    one piece of the file at a time."""
    pieces, held, done = unpacked(raw), bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while held[:2] == b"\r\n" or len(held) < 2:  # record ends
            if held[:2] == b"\r\n":
                del held[:2]
                done += 2
            elif not more():
                if held:
                    raise ValueError(f"no WARC record at byte {done}")
                return
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError(f"record cut short at byte {done}")
        lines = bytes(held[:end]).split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {done}")
        head = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        stop = end + 4 + int(head["content-length"])
        while len(held) < stop:
            if not more():
                raise ValueError(f"record cut short at byte {done}")
        yield head, bytes(held[end + 4:stop])
        del held[:stop]
        done += stop


def decode_http(block: bytes) -> bytes:
    """The payload of an HTTP message; chunked transfer framing is removed."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        if body[end + 2 + n:end + 4 + n] != b"\r\n":
            raise ValueError("broken chunk framing")
        out.append(body[end + 2:end + 2 + n])
        at = end + 4 + n


def payload_facts(payload: bytes) -> tuple[int, str]:
    return len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page_of(urn: str | None) -> int | None:
    page = urn.removeprefix("<urn:page:").split(":")[0] if urn else ""
    return int(page) if page else None


_PARSED = ("record_id string, page_id long, uri string, record_type string, refers_to long, stated_digest string, payload_bytes long, "
           "payload_digest string, segment int, total long, block binary")


def _parse(batches):
    import pyarrow as pa

    schema = arrow_schema(_PARSED)
    for batch in batches:
        for raw in batch.column("content"):
            rows, size = [], 0
            for head, block in parse_records(raw.as_py()):
                kind, number = head["warc-type"], head.get("warc-segment-number")
                if kind not in ("response", "revisit", "continuation", "resource", "conversion"):
                    continue  # warcinfo, request, metadata: not pages
                origin = head.get("warc-segment-origin-id", head["warc-record-id"])
                row = {"record_id": origin, "page_id": _page_of(origin), "segment": int(number) if number else None,
                       "total": int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None}
                if kind != "continuation":
                    row |= {"uri": head.get("warc-target-uri"), "record_type": kind, "refers_to": _page_of(head.get("warc-refers-to")),
                            "stated_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None}
                if number:
                    row["block"] = block
                elif kind == "revisit":
                    stated = [x for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    row |= {"payload_bytes": int(stated[0].split(b":")[1]) if stated else None,
                            "payload_digest": row["stated_digest"]}
                else:
                    row["payload_bytes"], row["payload_digest"] = payload_facts(decode_http(block) if kind == "response" else block)
                rows.append(row)
                size += len(block) if number else 0
                if len(rows) == 1000 or size > READ_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _facts(block: Column) -> Column:
    @F.pandas_udf("n long, digest string")
    def facts(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if b is None else payload_facts(decode_http(bytes(b))) for b in s],
                            columns=["n", "digest"])

    return facts(block)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of the archives under ``path``, segments reassembled."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    parsed = raw.mapInArrow(_parse, _PARSED)
    whole = parsed.groupBy("record_id").agg(
        *[F.max(c).alias(c) for c in ("page_id", "uri", "record_type", "refers_to", "stated_digest", "payload_bytes", "payload_digest", "total")],
        F.array_sort(F.collect_set(F.when(F.col("segment").isNotNull(), F.struct("segment", "block")))).alias("parts"))
    # a record in segments: numbers 1..n without a gap, joined length as stated
    n = F.size("parts")
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "")
    good = (F.get("parts", n - 1)["segment"] == n) & (F.octet_length(block) == F.col("total"))
    block = F.when(n > 0, F.when(F.coalesce(good, F.lit(False)), block).otherwise(F.raise_error(
        F.concat(F.lit("incomplete segments of "), F.col("record_id")))))
    whole = whole.withColumn("s", _facts(block.cast("binary")))
    bytes_, digest = F.coalesce("payload_bytes", "s.n"), F.coalesce("payload_digest", "s.digest")
    digest = F.when(F.coalesce(F.col("stated_digest") != digest, F.lit(False)), F.raise_error(F.concat(
        F.lit("payload digest differs in "), F.col("record_id")))).otherwise(digest)
    return whole.select("page_id", bytes_.alias("payload_bytes"), digest.alias("payload_digest"), "record_type",
                        "refers_to", F.col("uri").alias("target_uri"), n.alias("n_segments"))


ORACLE = """
WITH p AS (SELECT row_number() OVER () AS rn, page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS first_id FROM p
      WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST, rn)),
b AS (SELECT h, list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + CAST((('0x' || substr(hexed, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4)))::INT & 31 AS INT), 1)),
             'string_agg', '') AS digest FROM (SELECT h, sha1(h) AS hexed FROM (SELECT DISTINCT h FROM p)))
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN first_id END AS refers_to
FROM f JOIN b USING (h)
"""


def query(spark, sf_dir):
    from .common import scratch_path, table

    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return read_archive(spark, path).drop("target_uri", "n_segments")
