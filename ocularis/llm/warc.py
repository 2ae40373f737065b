"""WARC archives as a chunked record table.

Pages are written as WARC/1.1 archives of one gzip member a record: a ``warcinfo``, then ``response``
for the page with the smallest page_id among equal payloads of at least ``least`` bytes, ``revisit``
(HTTP headers alone, naming the response's page and target) for the others. The block of a response is
an HTTP message with the payload as its body. Record ids are unique in all archives of a call; the
page_id stands in a field of its own. Equality comes from SHA-1 digests and lengths, which Spark
computes and groups; only page ids are joined back to the pages.

Payloads travel as chunks. On the way in Spark cuts a payload into ``CHUNK``-byte slices, which the
writer compresses one by one. On the way out the reader streams an archive in blocks and gives rows
(record, chunk number, bytes, length and digest so far): the last chunk of a record carries the
digest of all, so that no record is ever held as a whole. A cut archive, a record of another length
than its header says, a payload with another digest than its header's and an archive with another
number of records than were written raise ``DamagedArchive``.

Archives appear under their names by a rename, one a task, so that tasks can run again.

Defined cases: null html is an empty payload; a null url is written as ``about:blank``; a url with
control characters is quoted in its standard field and whole in one of its own, so that every url
comes back as it was; repeated page_ids are records of their own, and all records with the smallest
page_id of their payload are responses; a null page_id is written as an
empty one and read back as null, and is the response only where no other page has its payload; an
empty table writes no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import mapped, rows, scratch, written

CHUNK, BLOCK = 1 << 20, 1 << 18
_END = b"\r\n"
_NO_TARGET = "about:blank"
#: Longest header block that a reader takes for one.
_LONGEST_HEADER = 1 << 24


class DamagedArchive(ValueError):
    """An archive that doesn't hold what was written."""



def classified(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages with page_id, url, payload (binary), record_type and refers_to."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    every = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    sums = written(every.select("page_id", "url", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size")), "warc-digests")
    firsts = sums.filter(F.col("size") >= least).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.min_by("url", F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("first_url"), F.count("*").alias("n")).filter("n > 1")
    marks = sums.join(firsts, ["sha", "size"]).select(F.col("page_id").alias("id"), F.col("sha").alias("of"), "first", "first_url").distinct()
    joined = every.withColumn("sha", F.sha1("payload")).join(marks, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("of")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "sha", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_to_url"))


_FIELDS = ("page_id", "url", "record_type", "refers_to", "refers_to_url", "size", "sha")


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each slice of a payload, in order within its record; an empty payload has one empty slice."""
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("payload") / chunk).cast("int") - 1)
    cut = records.withColumn("size", F.octet_length("payload").cast("long")).withColumn("last", last)
    each = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("k"))
    return each.select(*_FIELDS, "k", (F.col("k") == F.col("last")).alias("is_last"), F.expr(f"substring(payload, k * {chunk} + 1, {chunk})").alias("data"))


def _digest(raw: bytes) -> str:
    return base64.b32encode(raw).decode().rstrip("=")


def _target(url: str | None, field: str) -> list[str]:
    """The standard field of a url, and where that can't hold it unchanged, one with the whole of it."""
    quoted = re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or _NO_TARGET)
    whole = [f"X-{field}-Base64: {base64.b64encode(url.encode()).decode()}"] if url is not None and (quoted != url or url == _NO_TARGET) else []
    return [f"WARC-{field}: {quoted}", *whole]


def _targeted(about: dict[str, str], field: str) -> str | None:
    if (whole := about.get(f"X-{field}-Base64")) is not None:
        return base64.b64decode(whole).decode()
    return None if about.get(f"WARC-{field}", _NO_TARGET) == _NO_TARGET else about[f"WARC-{field}"]


def _record(kind: str, name: str, date: str, fields: list[str], content: str, length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", *fields, f"Content-Type: {content}", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + _END * 2


def _header(row: dict, name: str, date: str) -> bytes:
    """The WARC header block of a page's record, and the HTTP headers that its block begins with."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    number = lambda x: "" if x is None else str(x)
    fields = [*_target(row["url"], "Target-URI"), f"X-Page-ID: {number(row['page_id'])}", f"WARC-Payload-Digest: sha1:{_digest(bytes.fromhex(row['sha']))}"]
    revisit = row["record_type"] == "revisit"
    if revisit:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", *_target(row["refers_to_url"], "Refers-To-Target-URI"), f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {number(row['refers_to'])}"]
    return _record(row["record_type"], name, date, fields, "application/http; msgtype=response", len(http) + (0 if revisit else row["size"])) + http


def _information(name: str, date: str) -> bytes:
    block = b"software: ocularis\r\nformat: WARC File Format 1.1\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(_record("warcinfo", name, date, [], "application/warc-fields", len(block)) + block + _END * 2) + pack.flush()


def write(records: DataFrame, chunk: int = CHUNK) -> list[tuple[str, int]]:
    """Writes classified records; path and number of records of each archive, a row a file."""
    to = scratch(records.sparkSession, "warc")
    call, date = uuid.uuid4(), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def archive(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        store, path = fs.FileSystem.from_uri(f"{to}/pages-{task:08d}.warc.gz")
        temporary, out, pack, n = f"{path}.{uuid.uuid4().hex}.tmp", None, None, 0
        name = lambda k: uuid.uuid5(call, f"{task}:{k}")
        columns = (*_FIELDS, "k", "is_last", "data")
        for part in rows(batches, *columns):
            for row in (dict(zip(columns, r, strict=True)) for r in part):
                if out is None:
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(temporary, compression=None)
                    out.write(_information(name("info"), date))
                if row["k"] == 0:
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(pack.compress(_header(row, name(n), date)))
                if row["record_type"] == "response":
                    out.write(pack.compress(row["data"]))
                if row["is_last"]:
                    out.write(pack.compress(_END * 2) + pack.flush())
                    n += 1
        if out is not None:
            out.close()
            store.move(temporary, path)
            yield pa.RecordBatch.from_arrays([pa.array([f"{to}/{path.rpartition('/')[2]}"]), pa.array([n], pa.int64())], names=["path", "n"])

    return sorted(tuple(r) for r in mapped(chunked(records, chunk), archive, "path string, n long").collect())


def _members(path: str, block: int) -> Iterator[tuple[bytes, bool]]:
    """The unpacked bytes of an archive, piece by piece, and whether a record ends with this one."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at, compression=None) as stream:
        unpack, packed, pending, within = zlib.decompressobj(31), b"", False, False
        while packed or pending or (packed := stream.read(block)):
            within = within or bool(packed)
            try:
                piece = unpack.decompress(packed, block)
            except zlib.error as e:
                raise DamagedArchive(f"{path}: {e}") from e
            packed, pending = unpack.unconsumed_tail, len(piece) == block
            if unpack.eof:
                packed = unpack.unused_data
                unpack, pending, within = zlib.decompressobj(31), False, False
                yield piece, True
            elif piece:
                yield piece, False
        if within:
            raise DamagedArchive(f"{path} ends within a record")


def _parsed(head: bytes) -> dict[str, str]:
    return dict(x.partition(": ")[::2] for x in head.decode().split("\r\n")[1:])


def chunks(path: str, chunk: int = CHUNK, block: int = BLOCK) -> Iterator[dict]:
    """The records of an archive as chunk rows, with the length and the SHA-1 of the payload so far."""
    held, about, http, left, k, size, sha = bytearray(), None, None, 0, 0, 0, None

    def damaged(what: str) -> DamagedArchive:
        return DamagedArchive(f"{path}, record {(about or {}).get('WARC-Record-ID', 'without a header')}: {what}")

    def row(data: bytes) -> dict:
        digest = _digest(sha.digest())
        if not left and about["WARC-Type"] == "response" and "sha1:" + digest != about["WARC-Payload-Digest"]:
            raise damaged("another digest than its header's")
        return {"about": about, "http": http, "k": k, "data": data, "size": size, "digest": digest, "is_last": not left}

    for piece, ends in _members(path, block):
        held += piece
        if about is None and (at := held.find(_END * 2)) >= 0:
            if not held.startswith(b"WARC/1."):
                raise damaged("no WARC header")
            about = _parsed(bytes(held[:at]))
            del held[: at + 4]
            left, http, k, size, sha = int(about["Content-Length"]), None, 0, 0, hashlib.sha1()
        paged = about is not None and about["WARC-Type"] in ("response", "revisit")
        if paged and http is None and (at := held.find(_END * 2)) >= 0:
            http = _parsed(bytes(held[:at]))
            del held[: at + 4]
            left -= at + 4
            if about["WARC-Type"] == "response" and left != int(http["Content-Length"]):
                raise damaged("another length than its HTTP header's")
        if len(held) > _LONGEST_HEADER + block and (about is None or (paged and http is None)):
            raise damaged("no end of its headers")
        while paged and http is not None and left and len(held) >= min(chunk, left):
            data = bytes(held[: min(chunk, left)])
            del held[: len(data)]
            left, size = left - len(data), size + len(data)
            sha.update(data)
            yield row(data)
            k += 1
        if ends:
            if about is None or (paged and (http is None or left or bytes(held) != _END * 2)):
                raise damaged("another length than its header's")
            if paged and not k:  # an empty body
                yield row(b"")
            held, about = bytearray(), None


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def record_table(spark, archives: list[tuple[str, int]], data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """page_id, record_type, refers_to, chunk (number), size and digest so far, is_last and, if asked for, data of every chunk.

    A revisit's size and digest are those that its HTTP and WARC headers give for its payload."""
    schema = "page_id long, url string, record_type string, refers_to long, chunk int, size long, digest string, is_last boolean" + ", data binary" * data

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def read(batches):
        import pyarrow as pa

        for part in rows(batches, "path", "n"):
            for path, n in part:
                made, done = [], 0
                for x in chunks(path, chunk):
                    a = x["about"]
                    revisit = a["WARC-Type"] == "revisit"
                    row = {"page_id": _number(a["X-Page-ID"]), "url": _targeted(a, "Target-URI"), "record_type": a["WARC-Type"], "refers_to": _number(a.get("X-Refers-To-Page-ID")), "chunk": x["k"], "size": int(x["http"]["Content-Length"]) if revisit else x["size"], "digest": a["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else x["digest"], "is_last": x["is_last"]}
                    made.append(row | ({"data": x["data"]} if data else {}))
                    done += x["is_last"]
                    if len(made) == (16 if data else 1024):
                        yield pa.RecordBatch.from_pylist(made, schema=kinds)
                        made = []
                if done != n:
                    raise DamagedArchive(f"{path}: {done} records of {n}")
                yield pa.RecordBatch.from_pylist(made, schema=kinds)

    files = spark.createDataFrame(archives, "path string, n long")
    return mapped(files.repartition(max(1, len(archives))), read, schema)


def report(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, from the archives written for them."""
    table = record_table(pages.sparkSession, write(classified(pages, least)), data=False)
    return table.filter("is_last").select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
