"""WARC archives, index first: every record's file, offset, length, URL and digest is indexed as it is written, and reads
go to the index, coalescing the sorted byte ranges of the selected records.

Records are gzip members of their own (as .warc.gz files have them), so a byte range holds whole records. Archives go
through pyarrow.fs, so any folder with a URI will do. A task writes a file with a name of its own, and the index names
only the files of tasks that ended well: a task that is lost and run again leaves an unnamed file at worst.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import cut, fresh_path, join_checked, text_slices

#: Payloads from this length on are stored once; equal ones become revisits.
REVISIT_BYTES = 1000
#: Date of the records, as the table has none.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, payload_bytes long, file string, offset long, length long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _record(page_id, url, digest: str, payload: bytes | None, payload_bytes: int, refers_to) -> bytes:
    """A record; payload None: a revisit of the page refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", "WARC-Type: " + ("response" if payload is not None else "revisit"), f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(urn: str) -> int | None:
    inner = urn.strip("<>").rpartition(":")[2]
    return None if inner == "None" else int(inner)


def parse_record(raw: bytes) -> dict:
    """Header fields and payload of one record; a response's digest and length are taken from its payload anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        size, found = len(payload), hashlib.sha1(payload).hexdigest()
        if found != digest:
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload's digest is {found}, the header has {digest}")
    else:
        payload, size = None, int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": payload,
    }


def write_archives(pages: DataFrame, path: str | None = None, level: int = 1) -> DataFrame:
    """Write pages (page_id, url, html) as archives under `path` (a URI in a shared folder) and return their index.

    Of payloads (html in UTF-8; null: empty) that are equal, by SHA-1, and of at least REVISIT_BYTES, the row with the
    largest page_id is the response and all others revisit it; rows that repeat that page_id are responses as well. A
    null page_id is never the largest, unless all are null, which then are responses. Smaller payloads are responses. A
    null url has no header field; white space and control characters in a url are percent-encoded. An empty table
    writes no archive. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    large = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
    repeated = cut(large.where("_n > 1 and _last is not null").select(F.col("payload_digest").alias("_digest"), "_last"), "warc-repeated")
    joined = join_checked(rows, repeated, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") >= REVISIT_BYTES), "left")
    revisits = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    records = joined.select("page_id", "url", F.when(~revisits, F.col("html")).alias("html"), "payload_digest", "payload_bytes", F.when(revisits, F.col("_last")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in text_slices(batches, "html"):
            if out is None:
                store, base = fs.FileSystem.from_uri(path)
                store.create_dir(base, recursive=True)
                name, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                out = store.open_output_stream(name, compression=None)
            index = {k: [] for k in ("record_type", "offset", "length")}
            for page_id, url, text, digest, size, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(_record(page_id, url, digest, None if text is None else text.encode(), size, refers_to)) + z.flush()
                out.write(member)
                for k, v in (("record_type", "revisit" if text is None else "response"), ("offset", at), ("length", len(member))):
                    index[k].append(v)
                at += len(member)
            get = lambda c: b.column(c)
            yield pa.RecordBatch.from_arrays(
                [get("page_id"), get("url"), get("payload_digest"), pa.array(index["record_type"], pa.string()), get("refers_to"), get("payload_bytes"), pa.array([name] * b.num_rows, pa.string()), pa.array(index["offset"], pa.int64()), pa.array(index["length"], pa.int64())],
                ["page_id", "url", "payload_digest", "record_type", "refers_to", "payload_bytes", "file", "offset", "length"],
            )
        if out is not None:
            out.close()

    scheme = path.split("://")[0] + "://" if "://" in path else ""
    index = cut(records.mapInArrow(write, INDEX), "warc-index")
    return index.withColumn("file", F.concat(F.lit(scheme), F.col("file")))


def read_records(selected: DataFrame, chunk_bytes: int = 32 << 20, gap_bytes: int = 64 << 10, payloads: bool = True) -> DataFrame:
    """Read the records of index rows (file, offset, length): READ columns.

    Rows are dealt by (file, chunk of the file) and sorted by offset; ranges that lie less than gap_bytes apart are read
    at once, up to chunk_bytes at a time. A revisit has no payload of its own. Repeated index rows give repeated records.
    """
    spark = selected.sparkSession
    total = selected.agg(F.sum("length")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // chunk_bytes + 1)
    ranges = selected.select("file", "offset", "length").repartition(n, "file", F.floor(F.col("offset") / (chunk_bytes // 8))).sortWithinPartitions("file", "offset")

    def emit(found: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([x[k] if payloads or k != "payload" else None for x in found], t) for k, t in kinds.items()], list(kinds))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_name, handle = None, None
        for b in batches:
            run: list[tuple[int, int]] = []
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            for i, (name, offset, length) in enumerate(rows):
                run.append((offset, length))
                nxt = rows[i + 1] if i + 1 < len(rows) else None
                end = max(o + n for o, n in run[-1:])
                if nxt and nxt[0] == name and nxt[1] <= end + gap_bytes and nxt[1] + nxt[2] - run[0][0] <= chunk_bytes:
                    continue
                if name != open_name:
                    if handle is not None:
                        handle.close()
                    store, inner = fs.FileSystem.from_uri(name)
                    open_name, handle = name, store.open_input_file(inner)
                data = handle.read_at(end - run[0][0], run[0][0])
                yield emit([parse_record(zlib.decompress(data[o - run[0][0] : o - run[0][0] + n], 31)) for o, n in run])
                run = []
        if handle is not None:
            handle.close()

    return ranges.mapInArrow(read, READ)
