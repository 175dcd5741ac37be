"""Zstandard WARC archives: a dictionary in a leading skippable frame, then one frame for each record.

Archives go to the folder that driver and executors share, each under a name of its own attempt; a manifest that
Spark commits names the archives of the attempts that succeeded, so that lost or repeated tasks leave no trace in
what is read back.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisegrid.llm._common import shared_dir, write_table

#: Fixed values of the archive format.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = "archive string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string"


def with_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Add payload, payload_bytes, payload_digest, record_type and refers_to to (page_id, url, html).

    Of records with equal payloads of least_bytes or more, those with the smallest page_id are responses, the others
    revisit it. A null html is an empty payload. Rows that repeat the smallest id are responses too; a null id counts
    as larger than all others, and a payload that only rows without an id have gives responses.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    first = (
        rows.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null")
        .drop("n")
    )
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, "payload_digest", "left").select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first_id")).alias("refers_to"),
    )


def train_dictionary(records: DataFrame, samples: int = 256, sample_bytes: int = 4096, size: int = 16384) -> bytes:
    """A compression dictionary from at most `samples` starts of payloads of `sample_bytes`; empty if they are too few.

    The sample changes how well archives compress, never what they hold.
    """
    rows = records.select(F.substring("payload", 1, sample_bytes).alias("p")).where(F.length("p") > 0).limit(samples).collect()
    try:
        return zstandard.train_dictionary(size, [bytes(r.p) for r in rows]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _line(text: str) -> str:
    """A header value on one line: control characters and non-ASCII ones are percent-encoded."""
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """One record, known by the page's id and the start of the payload's digest, so that pages which repeat an id, or
    have none, are told apart. The HTTP header gives the full payload's length, which a revisit doesn't hold itself."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        VERSION.decode(),
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{digest[:32]}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url) if url else 'urn:page:none'}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}:{digest[:32]}>"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str | None = None, dictionary: bytes = b"", rotate_bytes: int = 64 << 20, date: str = "2026-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write records as with_revisits() gives them, and return the manifest (archive, records, bytes).

    Each task writes archives of about rotate_bytes; memory holds one record at a time. Empty input gives an empty
    manifest.
    """
    spark = records.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        fs.create_dir(path, recursive=True)
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
        out, name, n, size, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, payload, digest, kind, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")), strict=True):
                if out is None:
                    name, n, size = f"part-{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    if dictionary:
                        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                frame = pack.compress(record_bytes(page_id, url, payload, digest, kind, refers_to, date))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= rotate_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["archive", "records", "bytes"])

    return write_table(records.mapInArrow(write, "archive string, records long, bytes long"), "warc-manifest")


def _frames(stream, chunk: int = 1 << 18) -> Iterator[tuple[int, bytes]]:
    """(offset, record bytes) of each data frame; a dictionary in the leading skippable frame serves all of them."""
    held, offset, trained, first = b"", 0, None, True
    while True:
        while len(held) < 8 and (more := stream.read(chunk)):
            held += more
        if not held:
            return
        magic = struct.unpack("<I", held[:4])[0] if len(held) >= 4 else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = struct.unpack("<I", held[4:8])[0] if len(held) >= 8 else 1 << 40
            while len(held) < 8 + size and (more := stream.read(chunk)):
                held += more
            if len(held) < 8 + size:
                raise ValueError(f"skippable frame at {offset} is cut short")
            if first and magic == DICTIONARY_MAGIC:
                raw = held[8 : 8 + size]
                trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompressobj().decompress(raw) if raw[:4] == FRAME_MAGIC else raw)
            held, offset, first = held[8 + size :], offset + 8 + size, False
            continue
        if held[:4] != FRAME_MAGIC:
            raise ValueError(f"no frame at {offset}")
        unpack = zstandard.ZstdDecompressor(dict_data=trained).decompressobj() if trained else zstandard.ZstdDecompressor().decompressobj()
        parts, taken, piece = [], 0, held
        while True:
            parts.append(unpack.decompress(piece))
            taken += len(piece)
            if unpack.eof:
                held = unpack.unused_data
                break
            piece = stream.read(chunk)
            if not piece:
                raise ValueError(f"frame at {offset} is cut short")
        taken -= len(held)
        yield offset, b"".join(parts)
        offset, first = offset + taken, False


def parse_record(raw: bytes) -> dict:
    """Headers, block and payload of one record; raises ValueError on what the format does not allow."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (VERSION, b"WARC/1.0"):
        raise ValueError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line[:40]!r}")
        fields[name.decode("ascii").lower()] = value.strip().decode("utf-8")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name} header")
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit():
        raise ValueError("content-length is no number")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"content-length {length}, but {len(rest) - 4} bytes stand before the record's end")
    block = rest[:length]
    if (d := fields.get("warc-block-digest", "")).startswith("sha256:") and d[7:] != hashlib.sha256(block).hexdigest():
        raise ValueError("block digest differs")
    http, found, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None) if found else None
    digest = fields.get("warc-payload-digest", "")
    digest = digest[7:] if digest.startswith("sha256:") else None
    if fields["warc-type"] == "response":
        if size is not None and size != len(payload):
            raise ValueError(f"payload of {len(payload)} bytes, {size} stated")
        if digest is not None and digest != hashlib.sha256(payload).hexdigest():
            raise ValueError("payload digest differs")
        size = len(payload)
    elif fields["warc-type"] == "revisit" and "warc-refers-to" not in fields:
        raise ValueError("revisit refers to nothing")
    return {"fields": fields, "payload": payload, "size": size, "digest": digest}


def read_archives(archives: DataFrame, payloads: bool = True, permissive: bool = False) -> DataFrame:
    """Read the archives that the column `archive` names: a row for each record, as RECORD_SCHEMA has it.

    A task streams its archives one frame at a time, so that memory depends on the largest record. A frame that can't
    be decoded ends its archive; a record that breaks the format is one row. Both raise, or with permissive give a
    row with `error`. payloads=False leaves payload null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
            rows.clear()
            return out

        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
                offset = 0
                with fs.open_input_stream(path, compression=None) as stream:
                    try:
                        for offset, raw in _frames(stream):
                            try:
                                r = parse_record(raw)
                                f = r["fields"]
                                rows.append((uri, offset, f["warc-record-id"], f["warc-type"], f.get("warc-target-uri"), f.get("warc-refers-to"), r["size"], r["digest"], r["payload"] if payloads and f["warc-type"] == "response" else None, None))
                            except ValueError as e:
                                if not permissive:
                                    raise
                                rows.append((uri, offset, None, None, None, None, None, None, None, str(e)))
                            held += len(raw) if payloads else 100
                            if held > 8 << 20:
                                yield flush()
                                held = 0
                    except (ValueError, zstandard.ZstdError) as e:
                        if not permissive:
                            raise ValueError(f"{uri}: {e}") from e
                        rows.append((uri, offset, None, None, None, None, None, None, None, str(e)))
        yield flush()

    return archives.select("archive").mapInArrow(read, RECORD_SCHEMA)


def page_of(record_id):
    """The page id in a record id that record_bytes() wrote."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+):[0-9a-f]{32}>$", 1).try_cast("long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write a record for each page and read the archives back: one row per page."""
    records = with_revisits(pages)
    manifest = write_archives(records, dictionary=train_dictionary(pages.select(F.encode("html", "UTF-8").alias("payload"))))
    n = manifest.count()
    back = read_archives(manifest.repartition(max(1, min(n, 4096))), payloads=False)
    return back.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
