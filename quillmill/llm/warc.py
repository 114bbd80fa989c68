"""WARC archives as a PySpark Python data source (operator 9).

``spark.read.format("quillwarc")``: one partition per archive file (the writer rolls files, so that a
partition is bounded; an archive that others wrote is one partition whatever its size), planned from
the folder's manifests of committed files. Equality and IN filters on ``record_type`` and equality,
IN and prefix filters on other header columns are pushed into the reader: each record's header block
is parsed first, and the block of a record that the predicates rule out is not decoded. In plain
archives it is skipped by a seek, and so it is in the gzip archives written here, whose members name
their own compressed length in the header's extra field (subfield ``sl``); members without it are
inflated to their end. Option ``payload`` = ``digest`` streams payloads through SHA-1 and returns none;
``none`` skips them all.

``df.write.format("quillwarc")`` writes records with one gzip member each (or plain, option
``compress`` = ``false``). Every write commits by a manifest of its own, so a task that was lost or run
twice leaves no records, mode ``append`` adds to what stands, and ``overwrite`` replaces it.

A record whose block is shorter than its Content-Length, a cut gzip member and a payload that is not
that of its SHA-1 header are errors, as is a file that does not start with a record; option ``verify``
= ``false`` leaves the digest alone (archives of others may digest a payload before its transfer
coding). A response holds an HTTP message whose body is the payload; a revisit holds the header only
and names the response by WARC-Refers-To.

Nulls and edges: a null or empty payload has no bytes; null header fields are left out and read back
as null; line breaks in header values are written as spaces. A payload of any length is one record.
Rows that repeat are records each. An empty table is an empty archive. Columns that are not of
``SCHEMA`` are ignored when writing.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import json
import re
import struct
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from .common import Scratch, hot_keys, salted_join

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_bytes long, payload_digest string, refers_to string, payload binary"
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_bytes": "X-Payload-Length"}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL_BYTES = 64_000_000
MANIFEST = "_committed-"
CHUNK = 1 << 16
HEAD = 1 << 11  # what is inflated at a time where a header is read
BROADCAST_ROWS = 1_000_000


def _fs(path: str):
    from pyarrow import fs

    path = re.sub("^s3[an]://", "s3://", path)
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest_header(payload_sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(payload_sha1).decode()


def hex_digest(header: str | None) -> str | None:
    if header is None:
        return None
    kind, _, value = header.rpartition(":")
    if kind.lower() not in ("", "sha1", "sha-1"):
        return header  # another digest, told as it is
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def member(data: bytes) -> bytes:
    """One gzip member whose extra field holds its own length and that of the data."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    extra = b"sl" + struct.pack("<HII", 8, 24 + len(body) + 8, len(data) & 0xFFFFFFFF)
    return struct.pack("<4BIBBH", 31, 139, 8, 4, 0, 0, 255, len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def member_length(header: bytes) -> int | None:
    """The length that a member's first bytes name, if they do."""
    if header[:3] != b"\x1f\x8b\x08" or len(header) < 24 or not header[3] & 4 or header[12:14] != b"sl":
        return None
    return struct.unpack("<I", header[16:20])[0]


def render(record: dict) -> bytes:
    """One record, uncompressed. ``payload_bytes`` and ``payload_digest`` may be given for a revisit."""
    payload = bytes(record.get("payload") or b"")
    revisit = record["record_type"] == "revisit"
    digest = record.get("payload_digest")
    digest = digest_header(hashlib.sha1(payload).digest() if digest is None else bytes.fromhex(digest))
    length = record.get("payload_bytes")
    length = len(payload) if length is None else length
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    clean = lambda v: str(v).replace("\r", " ").replace("\n", " ")
    lines = [("WARC-Type", record["record_type"]), ("WARC-Record-ID", f"<{clean(record['record_id'])}>"), ("WARC-Date", record.get("warc_date") or "1970-01-01T00:00:00Z")]
    if record.get("target_uri") is not None:
        lines.append(("WARC-Target-URI", clean(record["target_uri"])))
    if record.get("refers_to") is not None:
        lines.append(("WARC-Refers-To", f"<{clean(record['refers_to'])}>"))
    if revisit:
        lines.append(("WARC-Profile", IDENTICAL))
    lines += [("WARC-Payload-Digest", digest), ("X-Payload-Length", length), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode() + block + b"\r\n\r\n"


class _Plain:
    """Reads on through a plain archive; what is skipped is not read."""

    def __init__(self, stream):
        self.stream = io.BufferedReader(stream, CHUNK) if not hasattr(stream, "peek") else stream
        self.size = self.stream.seek(0, 2)
        self.stream.seek(0)

    def line(self) -> bytes:
        return self.stream.readline()

    def read(self, n: int) -> bytes:
        return self.stream.read(n)

    def skip(self, n: int) -> None:
        if self.stream.seek(n, 1) > self.size:
            raise ValueError("the archive ends within a record")


class _Gzip:
    """Reads on through an archive of gzip members, inflating in pieces."""

    def __init__(self, stream):
        self.stream, self.raw, self.z, self.out = stream, b"", None, b""
        self.at = 0  # where in the file ``raw`` begins
        self.end = None  # where the member ends, if its header tells

    def _fill(self, n: int) -> bool:
        while len(self.raw) < n:
            more = self.stream.read(CHUNK)
            if not more:
                return False
            self.raw += more
        return True

    def _more(self, most: int = CHUNK) -> bool:
        if not self._fill(1):
            if self.z is not None:
                raise ValueError("the archive ends within a gzip member")
            return False
        if self.z is None:
            self._fill(24)
            n = member_length(self.raw[:24])
            self.end = None if n is None else self.at + n
            self.z = zlib.decompressobj(31)
        before = len(self.raw)
        self.out += self.z.decompress(self.raw, most)
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        self.at += before - len(self.raw)
        if self.z.eof:
            self.z = None
        return True

    def line(self) -> bytes:
        while (k := self.out.find(b"\n")) < 0 and self._more(HEAD):
            pass
        k = k + 1 if k >= 0 else len(self.out)
        line, self.out = self.out[:k], self.out[k:]
        return line

    def read(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n:
            if not self.out and not self._more():
                break
            part, self.out = self.out[: n - have], self.out[n - have :]
            parts.append(part)
            have += len(part)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        if self.z is not None and self.end is not None and n > len(self.out):
            # the rest of the record is the rest of its member: go on behind it
            if self.end > self.stream.seek(0, 2):
                raise ValueError("the archive ends within a gzip member")
            self.stream.seek(self.end)
            self.raw, self.z, self.out, self.at, self.end = b"", None, b"", self.end, None
            return
        while n > 0:
            if not self.out and not self._more():
                raise ValueError("the archive ends within a record")
            k = min(n, len(self.out))
            self.out, n = self.out[k:], n - k


def read_records(stream, compressed: bool, wanted=lambda head: True, payload: str = "full", verify: bool = True):
    """Yields (head, payload or None) of the records that ``wanted`` accepts by their head alone."""
    source = _Gzip(stream) if compressed else _Plain(stream)
    while True:
        line = source.line()
        while line in (b"\r\n", b"\n"):
            line = source.line()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := source.line()) not in (b"\r\n", b"\n"):
            if not line.endswith(b"\n"):
                raise ValueError("the archive ends within a record's header")
            name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
            head[name.strip().lower()] = value.strip()
        left = int(head.get("content-length", 0))
        row = {k: head.get(h.lower()) for k, h in HEADERS.items()}
        row["payload_digest"] = told = hex_digest(row["payload_digest"])
        row["payload_bytes"] = None if row["payload_bytes"] is None else int(row["payload_bytes"])
        for k in ("record_id", "refers_to"):
            row[k] = row[k] and row[k].removeprefix("<").removesuffix(">")
        if not wanted(row):
            source.skip(left)
            continue
        body = None
        if row["record_type"] != "revisit" and payload != "none":
            if head.get("content-type", "").startswith("application/http"):
                while left > 0 and (line := source.line()):
                    left -= len(line)
                    if line in (b"\r\n", b"\n"):
                        break
            sha, n, parts = hashlib.sha1(), 0, []
            while left > 0:
                part = source.read(min(left, CHUNK if payload == "digest" else left))
                if not part:
                    raise ValueError(f"record {row['record_id']} ends {left} bytes too early")
                sha.update(part)
                n, left = n + len(part), left - len(part)
                if payload == "full":
                    parts.append(part)
            if verify and told is not None and ":" not in told and told != sha.hexdigest():
                raise ValueError(f"the payload of record {row['record_id']} is not that of its digest")
            row |= {"payload_bytes": n, "payload_digest": sha.hexdigest()}
            body = b"".join(parts) if payload == "full" else None
        source.skip(left)
        yield row, body


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _manifests(store, root: str) -> list[str]:
    from pyarrow import fs

    if store.get_file_info(root).type != fs.FileType.Directory:
        return []
    return sorted(x.path for x in store.get_file_info(fs.FileSelector(root)) if x.base_name.startswith(MANIFEST))


def _listed(store, manifest: str) -> list[str]:
    with store.open_input_stream(manifest) as f:
        return json.loads(f.read())


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: str, verify: bool):
        self.path, self.payload, self.verify, self.filters = path, payload, verify, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if isinstance(f, (EqualTo, In, StringStartsWith)) and name in HEADERS and name not in ("payload_bytes", "payload_digest"):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, head: dict) -> bool:
        for f in self.filters:
            v = head[f.attribute[0]]
            if v is None:
                return False
            if not (v == f.value if isinstance(f, EqualTo) else v in f.value if isinstance(f, In) else v.startswith(f.value)):
                return False
        return True

    def partitions(self):
        from pyarrow import fs

        store, root = _fs(self.path)
        manifests = _manifests(store, root)
        if manifests:
            return [_Part(f"{root}/{x}") for m in manifests for x in _listed(store, m)]
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            return [_Part(root)]
        found = [x.path for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.path.endswith((".warc", ".warc.gz"))]
        return [_Part(x) for x in sorted(found)]

    def read(self, partition):
        if partition is None:
            return
        store, _ = _fs(self.path)
        with store.open_input_file(partition.path) as f:
            for row, body in read_records(f, partition.path.endswith(".gz"), self._wanted, self.payload, self.verify):
                yield (row["record_id"], row["record_type"], row["target_uri"], row["warc_date"], row["payload_bytes"], row["payload_digest"], row["refers_to"], body)


class _Wrote(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, compress: bool, overwrite: bool):
        self.path, self.compress, self.overwrite = path, compress, overwrite

    def write(self, rows):
        store, root = _fs(self.path)
        store.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for row in rows:
            if out is None:
                files.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.compress)
                out, size = store.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
            data = render(row.asDict())
            if self.compress:
                data = member(data)
            out.write(data)
            size += len(data)
            if size >= ROLL_BYTES:
                out.close()
                out = None
        if out is not None:
            out.close()
        return _Wrote(files)

    def commit(self, messages):
        store, root = _fs(self.path)
        store.create_dir(root, recursive=True)
        before = _manifests(store, root) if self.overwrite else []
        with store.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())
        # the new manifest stands before the old ones go, and their files after them
        gone = [x for m in before for x in _listed(store, m)]
        for m in before:
            store.delete_file(m)
        for x in gone:
            store.delete_file(f"{root}/{x}")

    def abort(self, messages):
        store, root = _fs(self.path)
        for m in messages:
            for x in m.files if m is not None else ():
                store.delete_file(f"{root}/{x}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "quillwarc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "full"), self.options.get("verify", "true").lower() != "false")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], self.options.get("compress", "true").lower() != "false", overwrite)


def read_warc(spark, path: str, payload: str = "full", verify: bool = True) -> DataFrame:
    """The records of the archives under ``path``. Spark offers a Python reader its filters only where
    the session's ``spark.sql.python.filterPushdown.enabled`` is set when the query runs, so it is set."""
    if payload not in ("full", "digest", "none"):
        raise ValueError("payload must be full, digest or none")
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("quillwarc").option("payload", payload).option("verify", str(verify).lower()).load(path)


def write_warc(records: DataFrame, path: str, compress: bool = True, mode: str = "append") -> None:
    """Writes rows of ``SCHEMA``'s columns; mode ``append`` adds to the folder, ``overwrite`` replaces it."""
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be append or overwrite")
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("quillwarc").option("compress", str(compress).lower()).mode(mode).save(path)


def page_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """A WARC record per page: of equal payloads of ``least_bytes`` at least, the largest page_id is
    the response and the others revisit it (rows that repeat that page_id are responses too, and a
    null page_id revisits or, if alone, responds). Record ids are ``urn:page:<page_id>``. Up to
    ``BROADCAST_ROWS`` groups of copies are broadcast; more are joined by a shuffle of the payloads.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    # the copies' groups by digest: one narrow row each, and only of what repeats
    digests = pages.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("payload_digest"), F.octet_length("html").alias("n")).where(F.col("n") >= least_bytes)
    groups = scratch.cut(digests.groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("k")).where("k > 1"))
    kept = groups.select("payload_digest", "kept")
    if groups.count() <= BROADCAST_ROWS:  # payloads stay where they are read
        joined = rows.join(F.broadcast(kept), "payload_digest", "left")
    else:
        hot = hot_keys(groups, ["payload_digest"], groups.agg(F.sum("k")).first()[0])
        joined = salted_join(rows, kept, hot, ["payload_digest"], "page_id", "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return joined.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(datetime.date(2000, 1, 1).isoformat() + "T00:00:00Z").alias("warc_date"),
        "payload_bytes",
        "payload_digest",
        F.when(revisit, urn(F.col("kept"))).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Writes ``page_records`` to the shared folder and reads the archives back, payloads digested."""
    scratch = Scratch(pages.sparkSession, "warc")
    write_warc(page_records(pages, least_bytes), f"{scratch.root}/archive")
    back = read_warc(pages.sparkSession, f"{scratch.root}/archive", "digest")
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
