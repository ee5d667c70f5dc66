"""Recorded responses as a Spark data source: web archives (WARC, one gzip member a
record, or plain) read and written as tables.

    recorded.register(spark)
    spark.read.format("warc").load(folder).where("status = 200")
    fetched.write.format("warc").mode("append").save(folder)

Columns: url, fetched_at, status, content_type, charset, body, file, offset.  A schema
that names some of them (``spark.read.schema("url string, status int")``) makes the reader
leave out the rest: without ``body`` no body is decoded.  Comparisons of url, status,
content_type, fetched_at and file with a value are tested in the reader, on the record's
header, before its body is decoded; a file that a filter rules out is not opened.

A file is read in splits of ``splitBytes`` (128 MB): a split begins at the first record
that starts in it.  Files lie in any store that ``pyarrow.fs`` opens.  Bodies are decoded
from chunked transfer and from gzip and deflate, to ``maxBody`` bytes (10 MB); a longer one
is null, as are the fields that a broken record lacks; a file cut short ends with its last
whole record.  Requests and other kinds of records are passed over."""

from __future__ import annotations

import datetime
import posixpath
import re
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

from ..functions import catalog as C

SCHEMA = "url string, fetched_at timestamp, status int, content_type string, charset string, body binary, file string, offset long"
_TESTED = ("url", "status", "content_type", "fetched_at", "file")
_CHUNK = 1 << 20


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:/"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Split(D.InputPartition):
    file: str
    start: int
    end: int


class WarcSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> D.DataSourceReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema, overwrite: bool) -> D.DataSourceWriter:
        return WarcWriter(schema, self.options["path"], overwrite)


class WarcReader(D.DataSourceReader):
    def __init__(self, schema, options: dict):
        self.schema, self.path = schema, options["path"]
        self.split = int(options.get("splitBytes", options.get("splitbytes", 128 << 20)))
        self.most = int(options.get("maxBody", options.get("maxbody", C.MAX_BODY)))
        self.filters: list = []

    def pushFilters(self, filters):
        kinds = (D.EqualTo, D.In, D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual, D.StringStartsWith, D.IsNotNull)
        for f in filters:
            if isinstance(f, kinds) and len(f.attribute) == 1 and f.attribute[0] in _TESTED:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list:
        from pyarrow import fs

        store, root = _store(self.path)
        about = store.get_file_info(root)
        files = [about] if about.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        found = [f for f in files if f.is_file and not any(p.startswith(("_", ".")) for p in f.path[len(root) :].split("/")) and self._fits({"file": f.path})]
        return [Split(f.path, at, min(at + self.split, f.size)) for f in sorted(found, key=lambda f: f.path) for at in range(0, f.size, self.split)]

    def _fits(self, told: dict) -> bool:
        """False if a filter rules out a row that holds ``told``; columns it lacks pass."""
        for f in self.filters:
            if f.attribute[0] not in told:
                continue
            v = told[f.attribute[0]]
            if v is None or not _compare(f, v):
                return False
        return True

    def read(self, partition: Split):
        names = [f.name for f in self.schema.fields]
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as f:
            for at, record in records(f, partition.start, partition.end):
                head, told, payload = _parse(record)
                if head.get("warc-type") != "response":
                    continue
                told |= {"file": partition.file, "offset": at}
                if self._fits(told):
                    if "body" in names:
                        told["body"] = _body(payload, told, self.most)
                    yield tuple(told.get(n) for n in names)


def _compare(f, v) -> bool:
    if isinstance(f, D.IsNotNull):
        return True
    if isinstance(f, D.In):
        return v in f.value
    w = f.value
    if isinstance(v, datetime.datetime) and isinstance(w, datetime.datetime):
        w = w if w.tzinfo else w.astimezone()
    tests = {D.EqualTo: lambda: v == w, D.GreaterThan: lambda: v > w, D.GreaterThanOrEqual: lambda: v >= w, D.LessThan: lambda: v < w, D.LessThanOrEqual: lambda: v <= w, D.StringStartsWith: lambda: v.startswith(w)}
    return tests[type(f)]()


def records(f, start: int, end: int):
    """(offset, bytes) of the records that begin in [start, end) of an open file."""
    f.seek(0)
    zipped = f.read(2) == b"\x1f\x8b"
    yield from _members(f, start, end) if zipped else _plain(f, start, end)


def _begins(data: bytes) -> bool:
    """Whether gzip data begins a record: enough of it unpacks to a record's first line."""
    try:
        return zlib.decompressobj(31).decompress(data, 16).startswith(b"WARC/")
    except zlib.error:
        return False


def _members(f, start: int, end: int):
    f.seek(start)
    held, at = b"", start
    while at < end:  # to the first member of the split
        held += f.read(_CHUNK)
        spot = held.find(b"\x1f\x8b\x08")
        if spot < 0:
            if len(held) < 3:
                return
            at, held = at + len(held) - 2, held[-2:]
            if not (more := f.read(1)):
                return
            held += more
            continue
        at, held = at + spot, held[spot:]
        if len(held) < 4096:
            held += f.read(4096)
        if _begins(held):
            break
        at, held = at + 3, held[3:]
    while at < end:
        unpack, parts, used = zlib.decompressobj(31), [], 0
        try:
            while not unpack.eof:
                held = held or f.read(_CHUNK)
                if not held:
                    return
                parts.append(unpack.decompress(held))
                used += len(held) - len(unpack.unused_data)
                held = unpack.unused_data
        except zlib.error:
            return
        yield at, b"".join(parts)
        at += used


_START = re.compile(rb"WARC/1\.[01]\r\n")


def _plain(f, start: int, end: int):
    f.seek(start)
    held, at = b"", start

    def need(n: int) -> bool:
        nonlocal held
        while len(held) < n and (more := f.read(max(_CHUNK, n - len(held)))):
            held += more
        return len(held) >= n

    while at < end:
        need(_CHUNK)
        m = _START.search(held)
        if not m:
            if len(held) <= 16:
                return
            at, held = at + len(held) - 16, held[-16:]
            if not need(17):
                return
            continue
        at, held = at + m.start(), held[m.start() :]
        if at >= end:
            return
        head = held.find(b"\r\n\r\n")
        size = re.search(rb"(?im)^content-length:\s*(\d+)", held[:head]) if head > 0 else None
        if not size or not need(head + 4 + int(size[1])):
            return
        whole = head + 4 + int(size[1])
        yield at, held[:whole]
        at, held = at + whole, held[whole:]


def _headers(data: bytes) -> dict:
    lines = data.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def _parse(record: bytes) -> tuple[dict, dict, tuple]:
    """(archive header, columns, (http headers, body as sent))."""
    top, _, block = record.partition(b"\r\n\r\n")
    head = _headers(top)
    block = block[: int(head["content-length"])] if head.get("content-length", "").isdigit() else block
    http, _, body = block.partition(b"\r\n\r\n")
    line, fields = http.split(b"\r\n", 1)[0], _headers(http)
    status = re.match(rb"HTTP/\S+ (\d{3})\b", line)
    told = {"url": head.get("warc-target-uri"), "status": int(status[1]) if status else None, "fetched_at": None, "content_type": fields.get("content-type", "").split(";")[0].strip().lower() or None}
    charset = re.search(r"charset\s*=\s*\"?([^\s;\"]+)", fields.get("content-type", ""), re.I)
    told["charset"] = charset[1].lower() if charset else None
    try:
        told["fetched_at"] = datetime.datetime.fromisoformat(head.get("warc-date", ""))
    except ValueError:
        pass
    return head, told, (fields, body)


def _body(payload: tuple, told: dict, most: int) -> bytes | None:
    fields, body = payload
    if "chunked" in fields.get("transfer-encoding", "").lower():
        parts, at = [], 0
        while m := re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n").match(body, at):
            n = int(m[1], 16)
            parts.append(body[m.end() : m.end() + n])
            at = m.end() + n + 2
            if not n:
                break
        body = b"".join(parts)
    packed = fields.get("content-encoding", "").lower()
    if packed in ("gzip", "x-gzip", "deflate"):
        try:
            body = zlib.decompressobj(47 if packed != "deflate" else zlib.MAX_WBITS).decompress(body, most + 1)
        except zlib.error:
            return None
    return body if len(body) <= most else None


@dataclass
class Written(D.WriterCommitMessage):
    file: str


class WarcWriter(D.DataSourceWriter):
    """A file a task, written aside and moved when the job commits, so that a task that
    is run again leaves nothing twice.  Rows need url; fetched_at, status, content_type,
    charset and body where there are such columns."""

    def __init__(self, schema, path: str, overwrite: bool):
        self.names, self.path, self.overwrite, self.job = [f.name for f in schema.fields], path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _aside(self) -> str:
        return posixpath.join(_store(self.path)[1], f"_writing-{self.job}")

    def write(self, rows) -> Written:
        store, _ = _store(self.path)
        store.create_dir(self._aside(), recursive=True)
        file = posixpath.join(self._aside(), f"part-{uuid.uuid4().hex}.warc.gz")
        with store.open_output_stream(file, compression=None) as out:
            for row in rows:
                out.write(_packed({n: v for n, v in zip(self.names, row, strict=True)}))
        return Written(file)

    def commit(self, messages) -> None:
        store, root = _store(self.path)
        if self.overwrite:
            from pyarrow import fs

            for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if f.is_file:
                    store.delete_file(f.path)
        for m in messages:
            if m is not None:
                store.move(m.file, posixpath.join(root, posixpath.basename(m.file)))
        store.create_dir(self._aside(), recursive=True)
        store.delete_dir(self._aside())

    def abort(self, messages) -> None:
        store, _ = _store(self.path)
        store.create_dir(self._aside(), recursive=True)
        store.delete_dir(self._aside())


def _packed(row: dict) -> bytes:
    """A response record as a gzip member."""
    body = row.get("body")
    body = b"" if body is None else body.encode() if isinstance(body, str) else bytes(body)
    kind = row.get("content_type") or "text/html"
    kind += f"; charset={row['charset']}" if row.get("charset") else ""
    http = f"HTTP/1.1 {row.get('status') or 200} -\r\nContent-Type: {kind}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    at = row.get("fetched_at")
    when = at.astimezone(datetime.UTC).isoformat().replace("+00:00", "Z") if at is not None else ""
    url = re.sub(r"[\r\n]", "", row.get("url") or "")
    top = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Target-URI: {url}\r\nWARC-Date: {when}\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    pack = zlib.compressobj(wbits=31)
    return pack.compress(top.encode() + http + b"\r\n\r\n") + pack.flush()
