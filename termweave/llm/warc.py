"""WARC archives as a Spark data source, and revisit records for repeated payloads.

Archives made here hold each record as a gzip member whose header has the member's lengths (the 'sl' field of the WARC
standard), so a reader inflates a record's first bytes, looks at its headers, and seeks past the rest if a pushed-down filter
on record type or another header rules it out, or if payloads aren't asked for (option payload=false). Other archives are
read too: plain files are sought through by Content-Length, and gzip files without those lengths, in one member or many, are
inflated as a stream, of which unwanted blocks are passed over and not kept. Writers end a file at ``max_file_mb``; each file
is one partition to read. A path is a file, or a folder: of one with a manifest, written on commit, only the files of the
attempts that succeeded are read, and never those of lost or repeated tasks; of one without, all .warc and .warc.gz files.
Paths may be on any file system that pyarrow's from_uri opens.

Defined results: a null payload is empty; a null id or URL leaves out its header and reads as null; rows that repeat the
smallest id of a group of equal payloads are responses too, other rows of the group revisit it; with null ids only, all are
responses; an empty table gives an archive without records; a record of any length is written and read, in memory one at a
time. CR and LF in header values are written as %0D and %0A. Header names are compared whatever their case; a value's
continued lines are joined by a blank; of a repeated header the first counts. The payload is what follows the HTTP headers
in records of type application/http, the whole block in others, and null in revisits. Extra columns take no part.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import bound_batches, ship, staged

#: Columns that are headers, and their names in a record.
HEADERS = {
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest", "payload_length": "WARC-X-Payload-Length",
}
SCHEMA = "warc_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary"
MANIFEST, HTTP = "_MANIFEST.json", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ROWS, BYTES, PEEK, CHUNK = 256, 16 << 20, 2_048, 1 << 18
#: First responses that are broadcast, about 100 bytes each; more are joined by a shuffle.
BROADCAST_FIRSTS = 100_000


def member(data: bytes) -> bytes:
    """A gzip member with the field of its compressed and raw lengths, or without where they don't fit its four bytes."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    total, end = 12 + 12 + len(body) + 8, struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if max(total, len(data)) > 0xFFFFFFFF:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + end
    extra = b"sl" + struct.pack("<HII", 8, total, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + end


def record(row: dict) -> bytes:
    block = b"" if row["warc_type"] == "revisit" else HTTP + (row["payload"] or b"")
    clean = lambda x: str(x).replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", *(f"{name}: {clean(row[c])}" for c, name in HEADERS.items() if row.get(c) is not None), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Plain:
    """A file's bytes from a place on; skip seeks."""

    def __init__(self, file, at: int = 0):
        self.file, self.at, self.size = file, at, file.size()

    def read(self, n: int) -> bytes:
        self.file.seek(self.at)
        data = self.file.read(min(n, self.size - self.at))
        self.at += len(data)
        return data

    def skip(self, n: int) -> None:
        self.at = min(self.size, self.at + n)


class _Inflated:
    """What the gzip members of a file from a place on hold, one after the other."""

    def __init__(self, file, at: int):
        self.raw, self.z, self.held = _Plain(file, at), None, b""

    def _more(self) -> bool:
        data = self.z.unconsumed_tail if self.z is not None and not self.z.eof else self.z.unused_data if self.z is not None else b""
        data = data or self.raw.read(CHUNK)
        if self.z is None or self.z.eof:
            data = data.lstrip(b"\0")  # padding between members
            if data:
                self.z = zlib.decompressobj(31)
        if not data:
            if self.raw.at < self.raw.size:
                return True
            if self.z is not None and not self.z.eof:
                raise ValueError("the archive ends within a gzip member")
            return False
        self.held += self.z.decompress(data, CHUNK)
        return True

    def read(self, n: int) -> bytes:
        parts, got = [], 0
        while got < n:
            if not self.held and not self._more():
                break
            part, self.held = self.held[: n - got], self.held[n - got :]
            parts.append(part)
            got += len(part)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n > 0 and (part := self.read(min(n, CHUNK))):
            n -= len(part)


_blank = re.compile(rb"\r?\n\r?\n")


def parsed_headers(head: bytes) -> dict[str, str]:
    """Headers by lower-case name, of what stands before the first blank line."""
    lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    found, name = {}, None
    for line in lines[1:]:
        if line[:1] in (" ", "\t"):
            if name:
                found[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        if name in found or not name:
            name = None
        else:
            found[name] = value.strip()
    return found


def _payload(headers: dict[str, str], block: bytes) -> bytes | None:
    if headers.get("warc-type") == "revisit":
        return None
    if not headers.get("content-type", "").lower().startswith("application/http"):
        return block
    end = _blank.search(block)
    return block[end.end() :] if end else b""


def _stream_records(source, wanted, payloads: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Records one after the other: headers, then a block of Content-Length bytes that is read or skipped."""
    data = b""
    while True:
        data = data.lstrip(b"\r\n")
        while not (end := _blank.search(data)):
            more = source.read(PEEK)
            if not more:
                if data.strip():
                    raise ValueError("the archive ends within a record's headers")
                return
            data = (data + more).lstrip(b"\r\n")
        headers = parsed_headers(data[: end.start()])
        length, data = int(headers.get("content-length", "0")), data[end.end() :]
        take = wanted(headers)
        if take and payloads and headers.get("warc-type") != "revisit":
            block = data[:length] + source.read(max(0, length - len(data)))
            if len(block) < length:
                raise ValueError("the archive ends within a record's block")
            yield headers, _payload(headers, block)
        else:
            source.skip(max(0, length - len(data)))
            if take:
                yield headers, None
        data = data[length:]


def records(file, wanted, payloads: bool = True) -> Iterator[tuple[dict, bytes | None]]:
    """(headers by lower-case name, payload) of the records of an open archive whose headers satisfy wanted; blocks of the others are passed over."""
    size, at = file.size(), 0
    while at < size:
        file.seek(at)
        data = file.read(PEEK)
        if data[:2] != b"\x1f\x8b":
            yield from _stream_records(_Plain(file, at), wanted, payloads)
            return
        if data[:4] != b"\x1f\x8b\x08\x04" or data[12:14] != b"sl":
            yield from _stream_records(_Inflated(file, at), wanted, payloads)
            return
        total = struct.unpack_from("<I", data, 16)[0]
        begin = 12 + struct.unpack_from("<H", data, 10)[0]
        z = zlib.decompressobj(-15)
        raw, have = z.decompress(data[begin : min(len(data), total - 8)]), min(len(data), total - 8)
        while not (end := _blank.search(raw)):
            more = file.read(min(PEEK, total - 8 - have))
            if not more:
                raise ValueError(f"no headers in the record at {at}")
            raw, have = raw + z.decompress(more), have + len(more)
        headers = parsed_headers(raw[: end.start()])
        if wanted(headers):
            payload = None
            if payloads and headers.get("warc-type") != "revisit":
                file.seek(at + have)
                block = raw[end.end() :] + z.decompress(file.read(total - 8 - have)) + z.flush()
                payload = _payload(headers, block[: int(headers["content-length"])])
            yield headers, payload
        at += total


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Files(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads, self.equal, self.prefixes = path, payloads, {}, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = HEADERS.get(f.attribute[0], "").lower() if getattr(f, "attribute", None) and f.attribute[0] != "payload_length" else None
            if name and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[name] = self.equal.get(name, values) & values
            elif name and isinstance(f, StringStartsWith):
                self.prefixes.setdefault(name, []).append(f.value)
            elif not (name and isinstance(f, IsNotNull)):
                yield f
            elif name != "warc-type":  # every record has one, if blank
                self.prefixes.setdefault(name, []).append("")

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(root).type == fs.FileType.File:
            return [_File(root)]
        if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_file(f"{root}/{MANIFEST}") as f:
                found = [f"{root}/{x}" for x in json.loads(f.read())["files"]]
        else:
            found = [x.path for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.path.lower().endswith((".warc", ".warc.gz"))]
        return [_File(x) for x in sorted(found)] or [_File("")]

    def wanted(self, headers: dict) -> bool:
        """headers are by lower-case name; a missing type is blank."""
        headers = {"warc-type": ""} | headers
        return all(headers.get(k) in v for k, v in self.equal.items()) and all(k in headers and all(headers[k].startswith(p) for p in ps) for k, ps in self.prefixes.items())

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        kinds = {c: pa.int64() if c == "payload_length" else pa.string() for c in HEADERS} | {"payload": pa.binary()}

        def batch(rows: list[tuple[dict, bytes | None]]) -> pa.RecordBatch:
            cols = {c: [h.get(name.lower()) for h, _ in rows] for c, name in HEADERS.items()} | {"payload": [p for _, p in rows]}
            cols["warc_type"] = [x or "" for x in cols["warc_type"]]
            cols["payload_length"] = [None if x is None else int(x) for x in cols["payload_length"]]
            return pa.RecordBatch.from_arrays([pa.array(cols[c], kind) for c, kind in kinds.items()], list(kinds))

        rows, held = [], 0
        with fs.FileSystem.from_uri(self.path)[0].open_input_file(partition.path) as file:
            for headers, payload in records(file, self.wanted, self.payloads):
                rows.append((headers, payload))
                held += len(payload or b"")
                if len(rows) >= ROWS or held >= BYTES:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, max_bytes: int):
        self.path, self.max_bytes = path, max_bytes

    def write(self, iterator) -> WriterCommitMessage:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        names, out, held = [], None, 0
        try:
            for row in (row for batch in iterator for i in range(0, batch.num_rows, ROWS) for row in batch.slice(i, ROWS).to_pylist()):
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, held = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                data = member(record(row))
                out.write(data)
                held += len(data)
                if held >= self.max_bytes:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
        return _Files(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps({"files": [n for m in messages if m is not None for n in m.names]}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            system.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    """format("warc"): load and save SCHEMA's columns. Options: payload (true), max_file_mb (64)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(float(self.options.get("max_file_mb", "64")) * (1 << 20)))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Records (SCHEMA) of pages: of equal payloads of min_bytes at least, the one with the smallest id is the response."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload").cast("long"))
    groups = rows.filter(F.col("length") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    firsts = staged(groups.filter("n > 1 and first is not null").select(F.col("digest").alias("__digest"), "first"), "warc-firsts")
    few = firsts.limit(BROADCAST_FIRSTS + 1).count() <= BROADCAST_FIRSTS
    met = rows.join(F.broadcast(firsts) if few else firsts, F.col("digest") == F.col("__digest"), "left")
    again = F.coalesce(~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    return met.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"), name("id").alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.when(again, name("first")).alias("refers_to"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.col("length").alias("payload_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write(records_df: DataFrame, path: str, max_file_mb: float = 64) -> None:
    register(records_df.sparkSession)
    bound_batches(records_df.sparkSession)
    records_df.write.format("warc").option("max_file_mb", str(max_file_mb)).mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records (SCHEMA) of an archive; warc_type is blank in a record without it.

    Spark keeps what a plan has pushed with the relation until another plan pushes anew. A filter that always holds makes each
    plan do so; for two differently filtered scans in one plan call this twice.
    """
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path).filter(F.col("warc_type").isNotNull())


def resolved(found: DataFrame) -> DataFrame:
    """record_id, warc_type, refers_to, payload_length and payload_digest (SHA-256, hex) of records as read: those of the payload
    itself, and of a revisit those of the response it refers to, also as read (null without it)."""
    own = found.select("record_id", "warc_type", "refers_to", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("d"))
    own = staged(own, "warc-read")
    again = own.filter("warc_type = 'revisit'")
    wanted = staged(again.select("refers_to").filter("refers_to is not null").distinct(), "warc-referred")
    few = wanted.limit(BROADCAST_FIRSTS + 1).count() <= BROADCAST_FIRSTS
    side = F.broadcast if few else (lambda df: df)
    held = own.filter("warc_type <> 'revisit'").join(side(wanted.select(F.col("refers_to").alias("record_id"))), "record_id", "left_semi")
    held = held.groupBy("record_id").agg(F.min(F.struct("n", "d")).alias("of")).select(F.col("record_id").alias("refers_to"), "of")
    met = again.drop("n", "d").join(side(held), "refers_to", "left").select("record_id", "warc_type", "refers_to", "of.n", "of.d")
    return own.filter("warc_type <> 'revisit'").unionByName(met).withColumnsRenamed({"n": "payload_length", "d": "payload_digest"})


#: DuckDB, for the query.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha256(b) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest
"""
