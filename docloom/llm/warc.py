"""WARC archives: records are written in segments and put together again when read.

A page becomes a response record whose block is an HTTP message with a chunked body, or a revisit that
refers to an equal payload. Blocks over SEGMENT bytes are cut into a first record and continuation
records, which carry the origin's identifier and their number; the last has the total length. Archives hold
at most FILE_RECORDS records, so that one fits in a task's memory however long the payloads are.

Archives are compressed by gzip as whole files. Reading parses the records of each archive, compressed or not, groups
continuation records by the origin's identifier, orders them by segment number, checks numbers and total length, and decodes
the chunked framing. Whole records skip the grouping and are not shuffled. What fails a check has a note in the column problem
and no payload; an archive that breaks off gives its records up to there and a row with a note.

Defined results: a null payload is empty. Every input row gets a record, also repeated rows and rows without
a key. Columns beside the key, url and payload are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import new_path, sift, slices, write_shared

SEGMENT, CHUNK, FILE_RECORDS, REVISIT = 32_768, 4096, 1000, 1000
END = "\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in the framing of Transfer-Encoding: chunked."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for i in range(0, len(payload), size) for p in [payload[i : i + size]]]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        if n < 0 or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def record(fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def clean_url(url: str | None) -> str | None:
    return re.sub(r"\s", "%20", url) if url else None


def records(key: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, ident: str, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page; refers: the key of the response that a revisit stands for."""
    kind = "response" if refers is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + (b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload) if refers is None else b"Content-Length: %d\r\n\r\n" % len(payload))
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{ident}>", "WARC-Date": DATE, "WARC-Target-URI": clean_url(url), "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response", "X-Page-Id": key}
    if refers is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-Id": refers}
    if len(block) <= segment:
        return [record(fields, block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record(fields | {"WARC-Segment-Number": 1}, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.UUID(ident), str(n))}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": f"<urn:uuid:{ident}>", "WARC-Segment-Number": n}
        out.append(record(more | ({"WARC-Segment-Total-Length": len(block)} if n == len(parts) else {}), part))
    return out


def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        for lo, hi in slices(batch.column("payload")):
            out = []
            for key, url, payload, digest, refers in zip(*(batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("key", "url", "payload", "digest", "refers")), strict=True):
                count += 1
                ident = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{task}/{count}/{key}"))
                out += records(key, url, payload, digest, refers, ident)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def write(pages: DataFrame, key: str, payload: str, path: str) -> str:
    """Write a record for each row of pages to archives in path. The largest key of equal payloads of REVISIT bytes or more is the response.

    Every record is followed by two line ends, which is what the text writer puts between its rows.
    """
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(key).cast("long").alias("key"), url.alias("url"), F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = pages.select(F.col(key).cast("long").alias("key"), F.encode(F.col(payload), "UTF-8").alias("payload")).where(F.octet_length("payload") >= REVISIT)
    last = long.select("key", F.sha1("payload").alias("digest")).groupBy("digest").agg(F.max("key").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    last = write_shared(last, "warc-last", waves=1)
    refers = F.when(F.col("last").isNotNull() & ~F.col("key").eqNullSafe(F.col("last")), F.col("last"))
    some, rest = sift(rows.withColumn("short", F.xxhash64("digest")), "short", last.select(F.xxhash64("digest")))  # the others' payloads are not shuffled
    rows = some.join(last, "digest", "left").select("key", "url", "payload", "digest", refers.alias("refers"))
    rows = rows.union(rest.select("key", "url", "payload", "digest", F.lit(None).cast("long")))
    out = rows.mapInArrow(make, "record binary").select(F.col("record").cast("string").alias("value"))
    out.write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)
    return path


FIELDS = ("WARC-Type", "WARC-Record-ID", "WARC-Segment-Origin-ID", "WARC-Segment-Number", "WARC-Segment-Total-Length", "X-Page-Id", "X-Refers-To-Page-Id", "WARC-Payload-Digest", "WARC-Target-URI")
PARTS = "origin string, number int, total bigint, kind string, key bigint, refers bigint, digest string, url string, block binary, wrong string"


def unzipped(content: bytes) -> tuple[bytes, str | None]:
    """An archive's bytes, compressed (in one member or more) or not, and what is wrong with them, up to where they break off."""
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(content))
        except zlib.error as e:
            return b"".join(out), f"the compressed archive is damaged: {e}"
        if not member.eof:
            return b"".join(out), "the compressed archive is cut short"
        content = member.unused_data
    return b"".join([*out, content]), None


def parse(data: bytes) -> Iterator[tuple]:
    """Origin, number, total length, kind, key, refers, digest, url, block and None of each record of an archive; where it breaks off, a row with a note."""
    at = 0
    while at < len(data):
        try:
            end = data.index(b"\r\n\r\n", at)
            head = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
            n = int(head["Content-Length"])
            block = data[end + 4 : end + 4 + n]
            if n < 0 or len(block) < n:
                raise ValueError("a record is cut short")
            kind, ident, origin, number, total, key, refers, digest, url = map(head.get, FIELDS)
            whole = lambda x: None if x is None else int(x)
            row = (origin or ident, whole(number) or 0, whole(total), kind, whole(key), whole(refers), digest and digest.removeprefix("sha1:"), url, block, None)
        except (ValueError, KeyError) as e:
            yield (None, 0, None, None, None, None, None, None, b"", f"the archive breaks off at byte {at}: {e}")
            return
        yield row
        at = end + 4 + n + len(END)


def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())
    names = [x.split()[0] for x in PARTS.split(", ")]
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    for batch in batches:
        for data in batch.column("content"):
            content, wrong = unzipped(data.as_py())
            rows, size = [] if wrong is None else [(None, 0, None, None, None, None, None, None, b"", wrong)], 0
            for row in parse(content):
                if row[-1] and wrong:  # it has its note
                    continue
                rows.append(row)
                size += len(row[-2])
                if size > 4_000_000:
                    yield make(rows)
                    rows, size = [], 0
            if rows:
                yield make(rows)


def message(block: bytes) -> tuple[bytes | None, int | None, str | None]:
    """Payload, its length (of a revisit: as its header says) and what is wrong, of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    try:
        if fields.get(b"transfer-encoding") == b"chunked":
            payload = dechunked(body)
            return payload, len(payload), None
        return body, int(fields.get(b"content-length", len(body))), None
    except ValueError as e:
        return None, None, str(e)


READ = "key bigint, url string, kind string, refers bigint, digest string, payload binary, payload_bytes bigint, problem string"


def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records with all their parts in order: checks numbers, length and digest, and decodes the message."""
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string())
    for batch in batches:
        rows = []
        for parts in batch.column("parts").to_pylist():
            first = parts[0]
            block = b"".join(p["block"] for p in parts)
            total = parts[-1]["total"]
            payload = size = None
            if first["wrong"]:
                wrong = first["wrong"]
            elif first["number"] > 1 or first["number"] == 1 and ([p["number"] for p in parts] != list(range(1, len(parts) + 1)) or total != len(block)):
                wrong = "segments are missing or their length is wrong"
            elif first["number"] == 0 and len(parts) > 1:
                wrong = "two records share an identifier"
            else:
                payload, size, wrong = message(block)
                if wrong is None and first["kind"] == "response" and first["digest"] != hashlib.sha1(payload).hexdigest():
                    wrong = "the digest is wrong"
            rows.append((first["key"], first["url"], first["kind"], first["refers"], first["digest"], payload if first["kind"] == "response" and not wrong else None, size, wrong))
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """key, url, kind, refers, digest, payload (of responses), payload_bytes, problem for each logical record in path."""
    parts = spark.read.format("binaryFile").load(path).select("content").mapInArrow(split, PARTS)
    one = F.struct("number", "total", "kind", "key", "refers", "digest", "url", "block", "wrong")
    whole = parts.where("number = 0").select(F.array(one).alias("parts"))
    cut = parts.where("number > 0").groupBy("origin").agg(F.sort_array(F.collect_list(one)).alias("parts")).select("parts")
    return whole.mapInArrow(assemble, READ).union(cut.mapInArrow(assemble, READ))


def round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """Write pages to archives in the shared folder and read these back."""
    spark = pages.sparkSession
    return read(spark, write(pages, key, payload, new_path(spark, "warc")))
