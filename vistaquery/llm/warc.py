"""WARC archives: writing with revisits and segments, and reading with segment reassembly.

Writing.  Each part of the pages becomes one .warc.gz file, a gzip member per record.  Of pages
with equal payloads of at least MIN_BYTES, the first (smallest page_id, then place) is a
response and all others revisit it; smaller ones are responses.  A response's block is an HTTP
response whose body has chunked transfer framing; a block beyond `segment` bytes goes into a
first record and continuation records.

Reading.  Files are inflated as they come, once, a record at a time.  Continuations and their first record
are grouped by the origin's identifier, ordered by segment number and joined if the numbers
have no gap and the total length is right; then the chunked framing is undone and the payload
held against its digest.  A record that fails has a null payload and says why in `error`.

Null html: empty payload.  Null page_id: its record has none, never is the one that others
revisit unless all of them lack one, and then they are all responses.  Null url: a URN of the
page.  Repeated rows: one response, the others revisit it.  Pages of one id and payload: either
is the response.  Empty table: no files.  A payload of any length is written and read whole, in
segments.  Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import give_back, locate, new_name, remove, stage, work_dir

MIN_BYTES, SEGMENT, CHUNK = 100, 32 << 10, 8 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
OUT = "record_id string, record_type string, page_id long, target_uri string, refers_to_id string, payload binary, error string"
READ = OUT + ", digest string, segment int, origin_id string, total long, block binary"
_STEP = 1 << 16


def record_id(*of) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(map(str, of)).encode()).digest())}>"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(x), x) for x in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The body without chunked framing (extensions and trailers are dropped); ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without a size line")
        size = int(body[at:end].split(b";")[0].strip() or b"x", 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of another length")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("HTTP header without an end")
    fields = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    return unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + pack.flush()


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, own_id: str, segment: int) -> Iterator[bytes]:
    digest = hashlib.sha256(payload).hexdigest()
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else f"urn:page:{page_id}"
    fields = [("WARC-Record-ID", own_id), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", page_id)]
    if refers_to is not None:
        block = HTTP + b"\r\n"
        yield _record([("WARC-Type", "revisit"), *fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("Content-Type", "application/http;msgtype=response")], block)
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    fields = [("WARC-Type", "response"), *fields, ("Content-Type", "application/http;msgtype=response")]
    yield _record(fields + [("WARC-Segment-Number", 1)] * (len(pieces) > 1), pieces[0])
    for k, piece in enumerate(pieces[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(pieces) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(own_id, k)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", own_id), ("WARC-Segment-Number", k), *last], piece)


def write_archives(pages: DataFrame, segment: int = SEGMENT, folder: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) and returns a table of the files (path)."""
    spark = pages.sparkSession
    folder = folder or work_dir(spark, "warc")
    staged = stage(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), folder, "pages", ["page_id"])

    def keys(part: str) -> Iterator[pa.RecordBatch]:
        t = staged.read(part, ["page_id", "html"])
        raw = [(x or "").encode() for x in t["html"].to_pylist()]
        big = [i for i in range(len(raw)) if len(raw[i]) >= MIN_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(big), pa.string()), pa.array(big, pa.int32()), t["page_id"].combine_chunks().take(pa.array(big, pa.int64())), pa.array([hashlib.sha256(raw[i]).digest() for i in big], pa.binary())], names=["part", "ord", "page_id", "digest"])

    key = "part string, ord int, page_id long, digest binary"
    staged.each(keys, key).write.parquet(f"{folder}/keys")
    rows = spark.read.schema(key).parquet(f"{folder}/keys")
    first = rows.where("page_id is not null").groupBy("digest").agg(F.min(F.struct("page_id", "part", "ord")).alias("first"))
    revisits = rows.join(first, "digest").where("part != first.part or ord != first.ord").select("part", "ord", F.col("first.page_id").alias("refers_to"))
    responses = first.select("first.part", "first.ord", F.lit(None).cast("long").alias("refers_to"))
    every = staged.parts().select("part", F.lit(-1).alias("ord"), F.lit(None).cast("long").alias("refers_to"))

    def write(t: pa.Table) -> pa.Table:
        part = t["part"][0].as_py()
        role = dict(zip(t["ord"].to_pylist(), t["refers_to"].to_pylist()))
        pages = staged.read(part)
        uri = new_name(folder, "pages") + ".warc.gz"
        fs, path = locate(uri)
        with fs.open_output_stream(path, compression=None) as out:  # each record is a member of its own
            out.write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", part)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            for i, (page_id, url, html) in enumerate(zip(*(pages[c].to_pylist() for c in ("page_id", "url", "html")))):
                payload = (html or "").encode()
                # the one that others refer to has an identifier of its page and payload
                own = record_id(page_id, hashlib.sha256(payload).hexdigest()) if i in role and role[i] is None else record_id("row", part, i, page_id)
                for record in page_records(page_id, url, payload, role.get(i), own, segment):
                    out.write(record)
        return pa.table({"path": [uri]})

    role = revisits.unionByName(responses).unionByName(every)
    role.repartition(max(2 * staged.n, 1), "part").groupBy("part").applyInArrow(write, "path string").write.parquet(f"{folder}/files")
    staged.remove()
    remove(f"{folder}/keys")
    return spark.read.schema("path string").parquet(f"{folder}/files")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one by one."""
    tool, out, raw = zlib.decompressobj(31), [], stream.read(_STEP)
    while raw:
        out.append(tool.decompress(raw))
        raw = tool.unused_data
        if tool.eof:
            yield b"".join(out)
            tool, out = zlib.decompressobj(31), []
        raw = raw or stream.read(_STEP)
    if out:  # cut off
        yield b"".join(out)


def records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    fs, p = locate(path)
    with fs.open_input_stream(p, compression=None) as f:
        for member in members(f):
            head, _, rest = member.partition(b"\r\n\r\n")
            fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head.decode().split("\r\n")[1:] if ":" in x)}
            yield fields, rest[: int(fields.get("content-length", 0))]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


_OUT, _READ = (pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in y.split(", "))]) for y in (OUT, READ))


def _finished(fields: tuple, digest: str | None, block: bytes | None, error: str | None) -> tuple:
    payload = None
    if error is None and fields[1] == "response":
        try:
            payload = payload_of(block)
            if digest and digest != f"sha256:{hashlib.sha256(payload).hexdigest()}":
                payload, error = None, "another payload digest"
        except ValueError as e:
            error = str(e)
    return (*fields, payload, error)


def read_archives(spark: SparkSession, files: DataFrame, folder: str | None = None) -> DataFrame:
    """A row per response and revisit record of the files (path); a revisit's payload is null, as it is that of the record it refers to."""
    folder = folder or work_dir(spark, "records")

    def fields_of(f: dict[str, str]) -> tuple:
        page = f.get("x-page-id")
        return (f.get("warc-record-id"), f.get("warc-type"), int(page) if page else None, f.get("warc-target-uri"), f.get("warc-refers-to"))

    def read(batches):
        """Whole records finished, segments as they are."""
        for paths in batches:
            for path in paths.column(0).to_pylist():
                rows, size = [], 0
                for f, block in records(path):
                    if number := f.get("warc-segment-number"):
                        origin = f.get("warc-segment-origin-id") or f.get("warc-record-id")
                        total = f.get("warc-segment-total-length")
                        rows.append((*fields_of(f), None, None, f.get("warc-payload-digest"), int(number), origin, int(total) if total else None, block))
                    elif f.get("warc-type") in ("response", "revisit"):
                        rows.append((*_finished(fields_of(f), f.get("warc-payload-digest"), block, None), None, None, None, None, None))
                    size += len(block)
                    if size > 4 << 20:
                        yield _batch(rows, _READ)
                        rows, size = [], 0
                yield _batch(rows, _READ)
                give_back()

    n = max(files.count(), 1)
    files.select("path").repartition(n, "path").mapInArrow(read, READ).write.option("compression", "zstd").parquet(f"{folder}/read")
    found = spark.read.schema(READ).parquet(f"{folder}/read")

    def joined(t: pa.Table) -> pa.Table:
        """The segments of one record: no more than its block, which one page's payload makes."""
        rows = sorted({r["segment"]: r for r in t.to_pylist()}.values(), key=lambda r: r["segment"])
        block = b"".join(r["block"] for r in rows)
        first, total = rows[0], rows[-1]["total"]
        error = None
        if [r["segment"] for r in rows] != list(range(1, len(rows) + 1)):
            error = "a segment is missing"
        elif total is None or total != len(block):
            error = "another total length"
        fields = tuple(first[c] for c in ("record_id", "record_type", "page_id", "target_uri", "refers_to_id"))
        return pa.Table.from_batches([_batch([_finished(fields, first["digest"], block, error)], _OUT)])

    names = [f.name for f in _OUT]
    return found.where("segment is null").select(names).unionByName(found.where("segment is not null").drop("payload", "error").groupBy("origin_id").applyInArrow(joined, OUT))


def payload_table(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest (of the full payload, also of revisits), record_type, refers_to, error."""
    folder = work_dir(spark, "payloads")
    rows = read_archives(spark, files).select("record_id", "record_type", "page_id", "refers_to_id", "error", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    of = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"))
    again = rows.where("record_type = 'revisit'").join(of, "refers_to_id", "left").select("page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to", F.when(F.col("n").isNull(), "no such record").alias("error"))
    return rows.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "error").unionByName(again)
