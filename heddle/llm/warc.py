"""Web archives (WARC 1.1): pages written as records, and read back with their segments put together.

Writing.  A page is a response record: HTTP headers, then the page in chunked transfer coding.  Pages of least_shared bytes
and more with equal contents are written once, as the response of the largest page_id; the others are revisit records of it,
without the page.  A record of over segment_bytes is cut: its first part stays a response with segment number 1, the others
are continuation records that name the first one as their origin; the last one tells the total length.  Every record is a
gzip member of its own; a task starts another file after file_bytes.  A task that runs again writes files under other names;
only those named in the manifest, which is written when all is well, are ever read.

Reading.  Records that are whole are decoded where they are read.  Segments are grouped by their origin, ordered by number
and put together if none lacks and the lengths add up to the total.  Then the chunked coding is taken off and the digest
compared.  Revisits take length and digest from the response they refer to.  What is wrong with a record is told in its
column problem; such a record has no payload.

Memory: a record at a time, and the segments of one record.  Pages are shuffled only if their contents may occur twice.

Defined results: null contents are empty; a null page_id is written without one and is less than all others.  Repeated rows
(same page_id and contents) are all responses if they have the largest page_id, else all revisits; they share a record id,
so each of their segments comes several times and each comes back as often.  A null url is left out; white space and control
characters in a url are percent-encoded.  An empty table gives no records.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import marked, shared_dir, short_batches, stage

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
SAFE = {c: f"%{c:02X}" for c in [*range(0x21), 0x7F]}
RECORD = "record_id string, record_type string, page_id bigint, url string, refers_to_record string, payload_bytes bigint, payload_digest string, problem string"
SEGMENT = "origin string, number int, total bigint, page_id bigint, url string, digest string, block binary"


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.UUID(name)}>"


def chunked(payload: bytes, size: int = 8192) -> bytes:
    """payload in chunked transfer coding."""
    out = []
    for a in range(0, len(payload), size):
        part = payload[a : a + size]
        out += (b"%x\r\n" % len(part), part, b"\r\n")
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer coding; raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("the chunks have no end")
        digits = body[at:end].split(b";")[0].strip()
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("a chunk has no size")
        size = int(digits, 16)
        at = end + 2
        if not size:
            rest = body[at:]
            if rest != b"\r\n" and not rest.endswith(b"\r\n\r\n"):  # trailers, if any, end with a blank line
                raise ValueError("the last chunk is not ended")
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, str | int | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"".join([b"WARC/1.1\r\n", head.encode(), b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r\n"])


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of a record; raises ValueError if it is damaged."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = fields.get("content-length", "")
    if not size.isdigit() or len(rest) < int(size):
        raise ValueError("the record is shorter than its length")
    return fields, rest[: int(size)]


def payload_of(block: bytes) -> bytes:
    """The body of a block of HTTP headers and body, without the transfer coding."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        raise ValueError("no HTTP headers")
    coded = any(line.split(b":")[0].strip().lower() == b"transfer-encoding" and b"chunked" in line.lower() for line in head.split(b"\r\n")[1:])
    return unchunked(body) if coded else body


def _hex(digest: str | None) -> str | None:
    """A digest field ("sha1:" and base 32 or hex digits) as hex digits."""
    value = (digest or "").partition(":")[2]
    if len(value) == 32:
        return base64.b32decode(value.upper()).hex()
    return value.lower() or None


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", body: str = "html", least_shared: int = 1000, segment_bytes: int = 1 << 20, file_bytes: int = 256 << 20, chunk_bytes: int = 8192, level: int = 6, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes pages to folder (a URI that all executors reach); returns the manifest: file, n_records, n_bytes."""
    spark = pages.sparkSession
    content = F.coalesce(F.col(f"`{body}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), content.alias("body")).withColumn("digest", F.sha1("body"))
    large = F.octet_length("body") >= least_shared
    shared = rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1 and kept is not null")
    shared = stage(shared.select(F.xxhash64("digest").alias("key"), F.col("digest").alias("shared"), "kept"), "warc-shared")
    rows = marked(rows.withColumn("key", F.xxhash64("digest")), shared.select("key")).withColumn("_maybe", F.col("_maybe") & large)
    alone = rows.filter("not _maybe").withColumn("kept", F.lit(None).cast("bigint"))
    some = rows.filter("_maybe").join(shared.drop("key"), F.col("digest") == F.col("shared"), "left").drop("shared")
    rows = alone.unionByName(some)
    refers = F.when(F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id")), F.col("kept"))
    name = lambda i: F.md5(F.concat(F.coalesce(i.cast("string"), F.lit("")), F.lit(" "), "digest"))
    rows = rows.select("page_id", "url", "digest", refers.alias("refers_to"), name(F.col("page_id")).alias("name"), F.when(refers.isNotNull(), name(refers)).alias("refers_name"), F.when(refers.isNull(), F.col("body")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, file, files, n_records, n_bytes, serial = None, "", 0, 0, 0, 0

        def ended() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"file": file, "n_records": n_records, "n_bytes": n_bytes}], schema=pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in batches:
            for r in batch.to_pylist():
                for fields, block in _records(r, segment_bytes, chunk_bytes, date, f"{task.taskAttemptId()}-{serial}"):
                    if out is None:
                        file = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{files:04d}.warc.gz"
                        out, files, n_records, n_bytes = store.open_output_stream(f"{base}/{file}", compression=None), files + 1, 0, 0
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                    n_bytes += out.write(squeeze.compress(record(fields, block)) + squeeze.flush())
                    n_records += 1
                    if n_bytes >= file_bytes:
                        yield ended()
                        out = None
                serial += 1
        if out is not None:
            yield ended()

    with short_batches(spark):
        return stage(rows.mapInArrow(run, "file string, n_records bigint, n_bytes bigint"), "warc-files")


def _records(r: dict, segment_bytes: int, chunk_bytes: int, date: str, unique: str) -> Iterator[tuple[list, bytes]]:
    """Fields and block of each record of a page."""
    target = r["url"].translate(SAFE) if r["url"] is not None else None
    digest = "sha1:" + base64.b32encode(bytes.fromhex(r["digest"])).decode()
    about = [("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Page-ID", r["page_id"]), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if r["refers_name"] is not None:
        own = hashlib.md5(f"revisit {unique} {r['name']}".encode()).hexdigest()
        yield [("WARC-Type", "revisit"), ("WARC-Record-ID", _urn(own)), ("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(r["refers_name"])), *about], HTTP
        return
    block = HTTP + chunked(r["body"], chunk_bytes)
    origin = _urn(r["name"])
    first = [("WARC-Type", "response"), ("WARC-Record-ID", origin), *about]
    if len(block) <= segment_bytes:
        yield first, block
        return
    yield [*first, ("WARC-Segment-Number", 1)], block[:segment_bytes]
    for k, a in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        own = hashlib.md5(f"continuation {k} {unique} {r['name']}".encode()).hexdigest()
        total = len(block) if a + segment_bytes >= len(block) else None
        yield [("WARC-Type", "continuation"), ("WARC-Record-ID", _urn(own)), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], block[a : a + segment_bytes]


def members(stream, size: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a file, each decompressed by itself."""
    rest = b""
    while rest or (rest := stream.read(size)):
        one, out = zlib.decompressobj(31), []
        while not one.eof:
            if not rest and not (rest := stream.read(size)):
                raise ValueError("the file ends within a record")
            out.append(one.decompress(rest))
            rest = one.unused_data
        yield b"".join(out)


def _rows(stream, file: str, row, damaged) -> Iterator[tuple]:
    """What row makes of a file's records, and what damaged makes of those that cannot be read; nothing for None.

    After a record that is not WARC the next one is read; after one that is not gzip the file is left.
    """
    found = members(stream)
    while True:
        try:
            data = next(found, None)
        except (zlib.error, ValueError) as wrong:
            data, made = None, damaged(f"{file}: {wrong}")
        else:
            if data is None:
                return
            try:
                made = row(*parsed(data))
            except ValueError as wrong:
                made = damaged(f"{file}: {wrong}")
        if made is not None:
            yield made
        if data is None:
            return


def _scan(manifest: DataFrame, folder: str, schema: str, row, damaged=lambda wrong: None, most: int = 4 << 20) -> DataFrame:
    """Rows that row(fields, block) makes of the records of the manifest's files, and damaged(what) of unreadable ones."""
    spark = manifest.sparkSession
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = pa.schema([(f.split()[0], {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        made = lambda held: pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held], schema=kinds)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                held, size = [], 0
                with store.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for r in _rows(stream, file, row, damaged):
                        held.append(r)
                        size += 200 + sum(len(x) for x in r if isinstance(x, bytes))
                        if size > most:
                            yield made(held)
                            held, size = [], 0
                if held:
                    yield made(held)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), manifest.count() // 4)
    with short_batches(spark, 16):
        return manifest.select("file").repartition(parts).mapInArrow(run, schema)


def _number(value: str | None) -> int | None:
    return int(value) if value and value.removeprefix("-").isdigit() else None


def _decoded(record_id: str | None, page_id: int | None, url: str | None, digest: str | None, block: bytes, with_payload: bool) -> tuple:
    """The row of a response, from its whole block."""
    try:
        payload = payload_of(block)
    except ValueError as wrong:
        return (record_id, "response", page_id, url, None, None, None, str(wrong), *[None] * with_payload)
    found = hashlib.sha1(payload).hexdigest()
    if digest and digest != found:
        return (record_id, "response", page_id, url, None, None, None, "the payload has another digest", *[None] * with_payload)
    return (record_id, "response", page_id, url, None, len(payload), found, None, *[payload] * with_payload)


def read(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """One row for each response and revisit of the manifest's files, whole again, and each record that cannot be read: record_id, record_type, page_id, url,
    refers_to_record, payload_bytes, payload_digest, problem, and payload (null for revisits) if asked for."""
    schema = RECORD + ", payload binary" * with_payload

    def whole(fields: dict[str, str], block: bytes) -> tuple | None:
        kind = fields.get("warc-type")
        if kind not in ("response", "revisit") or "warc-segment-number" in fields:
            return None
        about = (fields.get("warc-record-id"), _number(fields.get("warc-page-id")), fields.get("warc-target-uri"), _hex(fields.get("warc-payload-digest")))
        if kind == "revisit":
            return (about[0], kind, about[1], about[2], fields.get("warc-refers-to"), None, about[3], None, *[None] * with_payload)
        return _decoded(*about, block, with_payload)

    def segment(fields: dict[str, str], block: bytes) -> tuple | None:
        if "warc-segment-number" not in fields:
            return None
        origin = fields.get("warc-segment-origin-id") or fields.get("warc-record-id")
        return (origin, int(fields["warc-segment-number"]), _number(fields.get("warc-segment-total-length")), _number(fields.get("warc-page-id")), fields.get("warc-target-uri"), _hex(fields.get("warc-payload-digest")), block)

    def damaged(wrong: str) -> tuple:
        return (None, "damaged", None, None, None, None, None, wrong, *[None] * with_payload)

    segments = _scan(manifest, folder, SEGMENT, segment)
    return _scan(manifest, folder, schema, whole, damaged).unionByName(assembled(segments, with_payload))


def assembled(segments: DataFrame, with_payload: bool = True) -> DataFrame:
    """Rows like those of read() for records that came in segments (origin, number, total, page_id, url, digest, block).

    Equal records share an origin and come back as often as the first segment is there; of the others one copy is enough.
    """
    schema = RECORD + ", payload binary" * with_payload
    names = [f.split()[0] for f in schema.split(", ")]
    distinct = segments.groupBy("origin", "number").agg(
        F.any_value("block").alias("block"), F.max("total").alias("total"), F.collect_list(F.when(F.col("number") == 1, F.struct("page_id", "url", "digest"))).alias("first")
    )
    groups = distinct.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "total", "block"))).alias("parts"), F.flatten(F.collect_list("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(f.split()[0], {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in schema.split(", ")])
        for batch in batches:
            for i in range(batch.num_rows):
                origin, parts, first = (batch.column(k)[i].as_py() for k in ("origin", "parts", "first"))
                numbers, block = [p["number"] for p in parts], b"".join(p["block"] for p in parts)
                wrong = None
                if numbers != list(range(1, len(parts) + 1)) or parts[-1]["total"] is None:
                    wrong = "segments are missing"
                elif len(block) != parts[-1]["total"]:
                    wrong = "the segments do not add up to the total length"
                rows = []
                for about in first or [{"page_id": None, "url": None, "digest": None}]:
                    row = (origin, "response", about["page_id"], about["url"], None, None, None, wrong, *[None] * with_payload) if wrong else _decoded(origin, about["page_id"], about["url"], about["digest"], block, with_payload)
                    rows.append(dict(zip(names, row, strict=True)))
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return groups.mapInArrow(run, schema)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (the response's page_id), problem.

    records should be staged, without payloads: it is read for the revisits and for the responses they refer to.
    """
    target = records.filter("record_type = 'response' and problem is null").groupBy(F.col("record_id").alias("_target")).agg(F.max("page_id").alias("_page"), F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_digest"))
    revisits = records.filter("record_type = 'revisit'").join(target, F.col("refers_to_record") == F.col("_target"), "left")
    problem = F.when(F.col("_target").isNull(), "the response it refers to is not there").when(~F.col("_digest").eqNullSafe(F.col("payload_digest")), "the response it refers to has another digest")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"]
    revisits = revisits.withColumns({"problem": problem, "payload_bytes": F.col("_bytes"), "refers_to": F.col("_page")})
    return records.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("bigint")).select(*columns).unionByName(revisits.select(*columns))


def write_and_read(pages: DataFrame, folder: str | None = None, segment_bytes: int = 1 << 14, **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from its archives read back; an error
    if a record of them is damaged."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/heddle-warc-{uuid.uuid4().hex}"
    manifest = write(pages, folder, segment_bytes=segment_bytes, **options)
    with short_batches(spark, 16):
        records = stage(read(manifest, folder, with_payload=False), "warc-records")
    out = resolved(records)
    sound = F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("WARC record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?")), F.lit(": "), "problem")))
    return out.select("page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), "refers_to")
