"""WARC archives: writing with segments, revisits and chunked transfer framing, and reading them back whole.

Writing: of records with equal payloads (of at least ``min_revisit`` bytes) the one with the largest id is a
``response``, the others are ``revisit`` records that name it and carry no payload.  A response's body is framed in
chunks; where record blocks are longer than ``segment_bytes`` they are cut into a first segment and ``continuation``
records.  Spark's text writer stores the records in any file system, compressed, a bounded number in each file.

Reading: files are parsed record by record, whoever wrote them.  Segments are grouped by their origin's identifier,
ordered by segment number and joined; their number and total length must be as declared.  The chunk framing is then
decoded, and the payload's digest compared with the header's, where that is a SHA-1.  Records that hold no payload
(``warcinfo``, ``request``, ``metadata``) are passed over.  Damaged records come back with ``problem`` saying why, and
reading goes on with the next record, or the next member of a damaged compressed file, that can be found.

Null payloads are empty; null URLs become an empty target.  Rows with equal ids are separate records, told apart by a
row number in the record's identifier (of rows with equal payloads and the largest id, one stays the response; a table
must give its rows in the same order when it is read twice, as files do).  Rows
with a null id are written with the id ``null`` and come back with a null id.  Other columns are ignored; an empty table
gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import small

CRLF = b"\r\n"
TYPE = "application/http; msgtype=response"
HEADER = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "origin string, kind string, segment int, total long, refers_to string, digest string, length long, block binary, problem string"


@dataclass(frozen=True)
class Layout:
    segment_bytes: int = 16_384
    chunk_bytes: int = 4_096
    min_revisit: int = 0
    records_per_file: int = 2_000


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = framed.index(CRLF, at)
        n = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            if framed[at : at + 2] != CRLF:
                raise ValueError("the framing does not end")
            return b"".join(out)
        if framed[at + n : at + n + 2] != CRLF:
            raise ValueError("a chunk is not as long as it says")
        out.append(framed[at : at + n])
        at += n + 2


def _record(kind: str, name: str, block: bytes, fields: dict[str, str]) -> bytes:
    """One record without the two line ends after it."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "WARC-Date": "1970-01-01T00:00:00Z"} | fields | {"Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + CRLF + block


def name_of(page_id: str, row: int) -> str:
    return f"urn:page:{page_id}:{row}"


def records(page_id: str, row: int, url: str, payload: bytes, refers_to: str | None, layout: Layout = Layout()) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response and its continuations."""
    name, shared = name_of(page_id, row), {"WARC-Target-URI": "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url), "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield _record("revisit", name, block, shared | {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": PROFILE, "Content-Type": TYPE})
        return
    block = HEADER + chunked(payload, layout.chunk_bytes)
    if len(block) <= layout.segment_bytes:
        yield _record("response", name, block, shared | {"Content-Type": TYPE})
        return
    cuts = range(0, len(block), layout.segment_bytes)
    for k, at in enumerate(cuts, 1):
        part = {"WARC-Segment-Number": str(k)}
        if k > 1:
            part["WARC-Segment-Origin-ID"] = f"<{name}>"
        if k == len(cuts):
            part["WARC-Segment-Total-Length"] = str(len(block))
        kind, own = ("response", name) if k == 1 else ("continuation", f"{name}:{k}")
        yield _record(kind, own, block[at : at + layout.segment_bytes], (shared | {"Content-Type": TYPE} if k == 1 else {"WARC-Target-URI": shared["WARC-Target-URI"]}) | part)


def parsed(archive: bytes) -> Iterator[dict | str]:
    """The records of an uncompressed archive as headers and ``block``; what is wrong with a damaged one, in its place."""
    at = 0
    while at < len(archive):
        try:
            if not archive.startswith(b"WARC/", at):
                raise ValueError(f"no record begins at byte {at}")
            end = archive.index(CRLF + CRLF, at)
            lines = archive[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            n = int(head["content-length"])
            if n < 0 or end + 4 + n > len(archive):
                raise ValueError("a record is not as long as it says")
            if archive[end + 4 + n : end + 8 + n] not in (CRLF + CRLF, b"", CRLF):
                raise ValueError("a record does not end where it says")
            yield head | {"block": archive[end + 4 : end + 4 + n]}
            at = end + 4 + n
        except (ValueError, KeyError) as problem:
            yield f"{type(problem).__name__}: {problem}"
            at = archive.find(CRLF + b"WARC/", at + 1)
            if at < 0:
                return
        while archive.startswith(CRLF, at):
            at += 2


def unpacked(raw: bytes) -> Iterator[bytes | str]:
    """What the members of a compressed file hold, in one piece between two damaged members; else the file itself."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    at, sound = 0, []
    while at < len(raw):
        member, to = zlib.decompressobj(31), at
        try:
            while not member.eof:
                if to >= len(raw):
                    raise EOFError("a compressed member is cut off")
                sound.append(member.decompress(raw[to : to + 65_536]))
                to += 65_536
            at = min(to, len(raw)) - len(member.unused_data)
        except (zlib.error, EOFError) as problem:
            yield b"".join(sound)
            yield f"{type(problem).__name__}: {problem}"
            sound, at = [], raw.find(b"\x1f\x8b\x08", at + 1)
            if at < 0:
                return
    yield b"".join(sound)


def write(pages: DataFrame, path: str, layout: Layout = Layout(), id_column: str = "page_id", payload: str = "html", url: str = "url") -> None:
    """Write the archives below ``path``."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8")
    own = F.struct(F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("row"))
    rows = pages.select(own.alias("own"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("body")).withColumn("sha", F.sha1("body"))
    # payloads that occur again, each with the record that stays; most have none, so their digests are a short table
    again = rows.filter(F.octet_length("body") >= layout.min_revisit).groupBy("sha").agg(F.max("own").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    placed = rows.join(small(again), "sha", "left").select("own", "url", "body", F.when(F.col("kept") != F.col("own"), F.col("kept")).alias("kept"))
    text = lambda c: F.coalesce(F.col(f"{c}.id").cast("string"), F.lit("null"))
    placed = placed.select(text("own").alias("id"), "own.row", "url", "body", F.when(F.col("kept").isNotNull(), F.concat_ws(":", text("kept"), F.col("kept.row"))).alias("to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[bytes] = []
            size = 0
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for one in records(*r, layout):
                    made.append(one)
                    size += len(one)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])
                    made, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    # the text writer puts the two line ends that close a record after each value
    out = placed.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", layout.records_per_file).text(path)


def _fields(head: dict) -> tuple | None:
    """What reading needs of one record; None if it holds no payload."""
    kind, block = head.get("warc-type", "").lower(), head["block"]
    if kind not in ("response", "revisit", "continuation", "resource"):
        return None
    number = int(head.get("warc-segment-number", 0))
    origin = head["warc-segment-origin-id" if kind == "continuation" else "warc-record-id"].strip("<>")
    length = None
    if kind == "revisit":
        found = [v for k, _, v in (x.partition(b":") for x in block.split(CRLF)) if k.lower() == b"content-length"]
        length = int(found[0]) if found else None
        block = b""
    total = int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None
    name, _, value = head.get("warc-payload-digest", "").partition(":")
    return origin, kind, number, total, head.get("warc-refers-to", "").strip("<>") or None, value if name.lower() == "sha1" and value else None, length, block, None


def page_of(origin: str | None) -> str | None:
    """The page's id in an identifier of ``name_of``; None in any other."""
    found = re.fullmatch(r"urn:page:(.*):[0-9]+", origin or "", re.DOTALL)
    return None if found is None or found[1] == "null" else found[1]


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(CRLF + CRLF)
    framed = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(CRLF))
    return dechunked(body) if framed else body


def read(spark: SparkSession, path: str) -> DataFrame:
    """``page_id`` (text; null in archives of others), ``payload`` (null for revisits), ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to`` (text; the record's identifier in archives of others),
    ``n_segments``, ``problem``, ``record_id`` of every record."""
    names = [x.split(" ")[0] for x in PARSED.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    put = lambda rows, schema: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], names=names) if rows else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                wrong = lambda problem: (None, "", 0, None, None, None, None, b"", problem)
                for part in unpacked(content.as_py()):
                    for head in parsed(part) if isinstance(part, bytes) else [part]:
                        try:
                            rows.append(wrong(head) if isinstance(head, str) else _fields(head))
                        except (ValueError, KeyError) as problem:
                            rows.append(wrong(f"{type(problem).__name__}: {problem}"))
                rows = [r for r in rows if r is not None]
                if rows:
                    yield put(rows, types)

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(parse, PARSED)
    whole = found.filter("segment = 0").select("origin", "kind", F.lit(1).alias("n"), "refers_to", "digest", "length", "block", "problem")
    parts = F.sort_array(F.collect_list(F.struct("segment", "block", "total", "digest", "refers_to")))
    joined = found.filter("segment > 0").groupBy("origin").agg(parts.alias("p"))
    total, size = F.aggregate("p", F.lit(None).cast("long"), lambda a, x: F.coalesce(a, x["total"])), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    gap = F.exists(F.transform("p", lambda x, i: x["segment"] != i + 1), lambda x: x)
    trouble = F.when(gap, "a segment is missing or comes twice").when(total.isNull(), "the last segment is missing").when(total != size, "the segments are not as long as they say")
    joined = joined.select("origin", F.lit("response").alias("kind"), F.size("p").alias("n"), F.lit(None).cast("string").alias("refers_to"), F.get("p", F.lit(0))["digest"].alias("digest"), F.lit(None).cast("long").alias("length"), F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["block"])).alias("block"), trouble.alias("problem"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(9)]
            for origin, kind, n, to, declared, length, block, problem in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload, actual, size = None, declared, length
                if kind in ("response", "resource") and problem is None:
                    try:
                        payload = _payload(block) if kind == "response" else block
                        actual, size = digest(payload), len(payload)
                        problem = None if declared in (None, actual) else "the payload has another digest"
                    except ValueError as e:
                        problem = str(e)
                for column, value in zip(columns, (page_of(origin), payload, size, actual, kind, page_of(to) if (to or "").startswith("urn:page:") else to, n, problem, origin), strict=True):
                    column.append(value)
            types = [pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_segments", "problem", "record_id"])

    return whole.unionByName(joined).mapInArrow(finish, "page_id string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string, n_segments int, problem string, record_id string")


def oracle_sql(layout: Layout = Layout()) -> str:
    """The registered query's rows in SQL: all payloads count (``min_revisit`` 0)."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = [f"('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {15 - 5 * k} & 31" for g in range(8) for k in range(4)]
    base32 = " || ".join(f"substr('{letters}', ({x})::INT + 1, 1)" for x in parts)
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT h, max(page_id) AS kept FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, {base32} AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to,
  CAST(CASE WHEN page_id <> kept THEN 1 ELSE greatest(1, ceil(({len(HEADER)} + n // {layout.chunk_bytes} * ({layout.chunk_bytes} + {len(f"{layout.chunk_bytes:x}")} + 4) + CASE WHEN n % {layout.chunk_bytes} > 0 THEN n % {layout.chunk_bytes} + length(to_hex(n % {layout.chunk_bytes})) + 4 ELSE 0 END + 5) / {layout.segment_bytes})) END AS INT) AS n_segments, NULL::VARCHAR AS problem
FROM (SELECT *, octet_length(encode(body)) AS n FROM p) AS p JOIN k USING (h)
"""
