"""WARC archives, dictionary-compressed.

Each file starts with a skippable frame that holds a Zstandard dictionary trained on records of that file; every record follows
as a Zstandard frame of its own, so records can be read one by one from their offsets. Files are written by the tasks to a store
that driver and executors share; a task that is run again writes files of other names, and only the files named in the manifest,
which is itself a table in the shared folder, are ever read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, join_small, map_arrow, qualified, quoted, table

SKIPPABLE = 0x184D2A5D
#: Records of a task that the dictionary is trained on, in bytes, and the dictionary's size; records are archived in full.
SAMPLE_BYTES, DICT_BYTES = 2_000_000, 48_000
FILE_BYTES = 512_000_000
REVISIT_BYTES = 1000
LEVEL = 3
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "2000-01-01T00:00:00Z"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that has its scheme (see common.qualified), and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _line(name: str, value: str) -> bytes:
    clean = "".join(c if c > " " and c not in "%\x7f" else f"%{ord(c):02X}" for c in value)
    return f"{name}: {clean}\r\n".encode()


def _plain(value: str) -> str:
    """What _line wrote, as it was."""
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'page:{page_id}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit (no payload) where refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = b"WARC/1.1\r\n" + _line("WARC-Type", "response" if refers_to is None else "revisit") + _line("WARC-Record-ID", record_id(page_id)) + _line("WARC-Date", DATE)
    if url is not None:
        head += _line("WARC-Target-URI", url)
    if page_id is not None:
        head += _line("X-Page-ID", str(page_id))
    if refers_to is not None:
        head += _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest") + _line("WARC-Refers-To", record_id(refers_to)) + _line("X-Refers-To-Page-ID", str(refers_to))
    head += _line("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode())
    head += b"Content-Type: application/http;msgtype=response\r\n" + b"Content-Length: %d\r\n\r\n" % len(block)
    return head + block + b"\r\n\r\n"


def warcinfo() -> bytes:
    body = b"software: lakewarden\r\nformat: WARC File Format 1.1\r\n"
    return b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: " + record_id(None).encode() + b"\r\n" + _line("WARC-Date", DATE) + b"Content-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; of too few or too small records, their own bytes serve as one."""
    raw = b"".join(samples)
    try:
        return zstandard.train_dictionary(min(size, max(1024, len(raw) // 8)), samples, k=200, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return (raw or warcinfo())[-size:]


class Writer:
    """One task's archives. sample_bytes of records wait until the dictionary is built; after that each is written at once."""

    def __init__(self, folder: str):
        self.folder, self.files, self.held, self.held_bytes = folder, [], [], 0
        self.dictionary, self.out, self.at = None, None, 0

    def _start(self) -> None:
        if self.dictionary is None:
            self.dictionary = build_dictionary(self.held)
            data = zstandard.ZstdCompressionDict(self.dictionary)
            data.precompute_compress(level=LEVEL)
            self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        fs, base = open_store(self.folder)
        fs.create_dir(base, recursive=True)
        self.out = fs.open_output_stream(f"{base}/{name}", compression=None)
        self.files.append([f"{self.folder}/{name}", 0, 0])
        self._put(struct.pack("<II", SKIPPABLE, len(self.dictionary)) + self.dictionary)
        self._put(self.zip.compress(warcinfo()))

    def _put(self, frame: bytes) -> None:
        self.out.write(frame)
        self.files[-1][2] += len(frame)

    def _write(self, record: bytes) -> None:
        if self.out is None:
            self._start()
        self._put(self.zip.compress(record))
        self.files[-1][1] += 1
        if self.files[-1][2] >= FILE_BYTES:
            self.out.close()
            self.out = None

    def add(self, record: bytes) -> None:
        if self.dictionary is not None:
            self._write(record)
            return
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= SAMPLE_BYTES:
            self._flush()

    def _flush(self) -> None:
        held = self.held
        if held and self.out is None:
            self._start()
        self.held = []
        for r in held:
            self._write(r)

    def close(self) -> list[list]:
        self._flush()
        if self.out is not None:
            self.out.close()
        return self.files


def read_records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record but warcinfo, one at a time."""
    fs, base = open_store(path)
    with fs.open_input_stream(base, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path}: no dictionary frame")
        data = zstandard.ZstdCompressionDict(f.read(size))
        with zstandard.ZstdDecompressor(dict_data=data).stream_reader(f, read_across_frames=True, read_size=1 << 17) as plain:
            buf = b""

            def more() -> bool:
                nonlocal buf
                got = plain.read(1 << 18)
                buf += got
                return bool(got)

            while buf or more():
                while (end := buf.find(b"\r\n\r\n")) < 0:
                    if not more():
                        raise ValueError(f"{path}: cut short")
                head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in buf[:end].decode().split("\r\n")[1:])
                n = int(head["Content-Length"])
                rest = [buf[end + 4 :]]
                have = len(rest[0])
                while have < n + 4:
                    got = plain.read(max(1 << 18, n + 4 - have))
                    if not got:
                        raise ValueError(f"{path}: cut short")
                    rest.append(got)
                    have += len(got)
                whole = b"".join(rest)
                buf = whole[n + 4 :]
                if head["WARC-Type"] != "warcinfo":
                    yield head, whole[:n]


def revisits(pages: DataFrame, id_col: str, html_col: str, salts: int = 16) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a page of larger id has too."""
    p = pages.select(F.col(quoted(id_col)).cast("long").alias("page_id"), F.encode(F.coalesce(F.col(quoted(html_col)).cast("string"), F.lit("")), "UTF-8").alias("b"))
    p = p.where(F.octet_length("b") >= REVISIT_BYTES).select("page_id", F.concat(F.sha1("b"), F.hex(F.xxhash64("b"))).alias("digest"))
    groups = p.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").select("digest", "refers_to")
    d = p.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)))
    g = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return d.join(g, ["digest", "salt"]).where("page_id is null or page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Archive every page under folder (shared by all executors; a path means what it means to Spark); returns the manifest (path,
    n_records, n_bytes), written once.

    Of equal payloads of REVISIT_BYTES or more the page of the largest id is the response, others are revisits of it. A null html
    is an empty payload; a null id is smaller than any other and goes into the record as no id; a null url is left out. Very long
    payloads are archived whole. Rows that repeat the id and the payload of a response are responses as well. An empty table gives
    no archive. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(pages.sparkSession)
    folder = qualified(pages.sparkSession, folder)
    again = scratch.table(revisits(pages, id_col, html_col), "revisits")
    body = F.encode(F.coalesce(F.col(quoted(html_col)).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(quoted(id_col)).cast("long").alias("page_id"), F.col(quoted(url_col)).cast("string").alias("url"), body.alias("body")).withColumn("digest", F.concat(F.sha1("body"), F.hex(F.xxhash64("body"))))
    rows = join_small(rows, again, ["page_id", "digest"], "left", F.col("digest"), salts=1, rows=broadcast_rows).select("page_id", "url", "body", "refers_to")
    kind = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Writer(folder)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                for page_id, url, payload, refers in zip(*(c.to_pylist() for c in b.slice(i, 64).columns), strict=True):
                    w.add(build_record(page_id, url, payload, refers))
        if files := w.close():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*files, strict=True), kind.types, strict=True)], schema=kind)

    manifest = scratch.table(map_arrow(rows, run, "path string, n_records long, n_bytes long"), "manifest")
    scratch.drop(manifest)
    return manifest


def read_warc(manifest: DataFrame) -> DataFrame:
    """The records of the manifest's archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest (SHA-1,
    lower-case hex), payload (null for revisits), ok (the digest and length of what was read are those on record). What was null
    when written is null again; an empty manifest gives no rows."""
    n = max(1, min(manifest.count(), 10_000))
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("ok", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                for head, block in read_records(path):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rsplit(b"Content-Length: ", 1)[1])
                    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    full = head["WARC-Type"] == "response"
                    ok = not full or (len(payload) == size and hashlib.sha1(payload).hexdigest() == digest)
                    page, ref = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                    url = head.get("WARC-Target-URI")
                    rows.append((page and int(page), url if url is None else _plain(url), head["WARC-Type"], ref and int(ref), size, digest, payload if full else None, ok))
                    held += len(payload) + 200
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

    return map_arrow(manifest.select("path").repartition(n), run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, ok boolean")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, archived and read back. The archives go when the program ends; nulls and ties as in write_warc."""
    manifest = write_warc(table(spark, sf_dir, "pages"), Scratch(spark).folder("warc"))
    r = read_warc(manifest)
    wrong = F.raise_error(F.concat(F.lit("payload of page "), F.col("page_id").cast("string"), F.lit(" differs from its digest"))).cast("string")
    return r.select("page_id", "payload_bytes", F.when(F.col("ok"), F.col("payload_digest")).otherwise(wrong).alias("payload_digest"), "record_type", "refers_to")


OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
g AS (SELECT b, max(page_id) AS winner, count(*) AS n FROM p WHERE strlen(b) >= {REVISIT_BYTES} GROUP BY b HAVING count(*) > 1)
SELECT p.page_id, strlen(p.b)::BIGINT AS payload_bytes, sha1(p.b) AS payload_digest,
  CASE WHEN g.winner IS NULL OR g.winner = p.page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN g.winner <> p.page_id THEN g.winner END AS refers_to
FROM p LEFT JOIN g ON p.b = g.b
"""
