"""WARC archives with an index: write records once, then read selected ones by coalesced byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, stage_table

DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, file string, offset long, length long, record_type string, refers_to long, payload_bytes long, payload_digest string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 response record, or a revisit without the payload if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record; raises ``ValueError`` if its lengths or its payload digest do not hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("record length does not hold")
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    want = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != full or digest(payload) != want):
        raise ValueError("payload digest does not hold")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return {
        "page_id": int(page) if page is not None else None,
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": int(refers) if refers is not None else None,
        "payload_bytes": full,
        "payload_digest": want,
        "payload": None if revisit else payload.decode(),
    }


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to``: the smallest id of equal payloads of at least ``min_bytes``, null on itself.

    Digests alone are grouped (partially aggregated, so a hot payload costs one row a task); only the ids and digests of
    later copies meet the pages again, on both, so rows that repeat an id with another payload keep it.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("h", F.sha1("html")).withColumn("n", F.octet_length("html"))
    keys = rows.select("page_id", "h", "n").where(F.col("n") >= min_bytes)
    first = keys.groupBy("h", "n").agg(F.min("page_id").alias("low"), F.count("*").alias("c")).where("c > 1").select("h", "n", "low")
    first = stage_table(first, "warc-first")
    later = keys.join(first, ["h", "n"]).where("page_id > low").select("page_id", "h", "n", F.col("low").alias("refers_to")).distinct()
    return rows.join(stage_table(later, "warc-later"), ["page_id", "h", "n"], "left").select("page_id", "url", "html", "refers_to")


def write_archives(marked: DataFrame, folder: str | None = None, roll_bytes: int = 64 << 20, level: int = 1) -> DataFrame:
    """Write ``mark_revisits`` rows as ``.warc.gz`` files (one gzip member a record) and return their index.

    Each task attempt writes files of its own name, so a rerun after a lost executor leaves files no index entry names.
    """
    folder = folder or fresh_path(marked.sparkSession, "warc")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows: list[dict] = []
            for page_id, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None or at >= roll_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                payload = html.encode()
                member = gzip.compress(build_record(page_id, url, payload, refers), level, mtime=0)
                out.write(member)
                rows.append(
                    {
                        "page_id": page_id, "url": url, "file": f"{folder}/{name}", "offset": at, "length": len(member),
                        "record_type": "response" if refers is None else "revisit", "refers_to": refers,
                        "payload_bytes": len(payload), "payload_digest": digest(payload),
                    }
                )
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX_ARROW)
        if out is not None:
            out.close()

    return stage_table(marked.select("page_id", "url", "html", "refers_to").mapInArrow(each, INDEX), "warc-index")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


_INDEX_ARROW, _RECORD_ARROW = _arrow(INDEX), _arrow(RECORD)


def coalesce_ranges(entries: Iterable[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Merge entries sorted by file and offset into ranges: ``file, begin, end, members``."""
    file, begin, end, members = "", 0, 0, []
    for f, offset, length in entries:
        if members and f == file and offset <= end + gap and offset + length - begin <= most:
            end = max(end, offset + length)
            members.append((offset, length))
        else:
            if members:
                yield file, begin, end, members
            file, begin, end, members = f, offset, offset + length, [(offset, length)]
    if members:
        yield file, begin, end, members


def read_records(index: DataFrame, gap: int = 64 << 10, most: int = 4 << 20) -> DataFrame:
    """Records named by (a selection of) an index: ranges of sorted entries are read once each and parsed.

    A range never exceeds ``most`` bytes unless one record does. Every response's payload is checked against its digest.
    """
    spark = index.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, int, int]]:
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)

        source, opened = None, ""
        for file, begin, end, members in coalesce_ranges(rows(), gap, most):
            if file != opened:
                store, path = pafs.FileSystem.from_uri(file)
                source, opened = store.open_input_file(path), file
            data = source.read_at(end - begin, begin)
            found = [parse_record(zlib.decompress(data[o - begin : o - begin + n], 31)) for o, n in members]
            yield pa.RecordBatch.from_pylist(found, schema=_RECORD_ARROW)

    return entries.mapInArrow(each, RECORD)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write every row as a record, index it, and read all records back through the index.

    Null html is an empty payload; null urls become empty; rows with a null id are responses without an id; rows that
    repeat an id are each a record, and of the same type where their payloads are equal; an empty table gives an empty
    result; other columns are ignored.
    """
    index = write_archives(mark_revisits(pages, id_col, url_col, html_col, min_bytes))
    return read_records(index)
