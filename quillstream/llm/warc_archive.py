"""WARC archives compressed with Zstandard: writer and validating reader.

An archive starts with a skippable frame that holds the dictionary (itself a Zstandard frame, or
nothing if there was too little to learn one from); then each record is one frame. The writer rolls
archives at ``ARCHIVE_BYTES``, so that one archive is one bounded row for the reader. Archives are
named by partition and number, hold rows in a fixed order and are moved into place when complete, so
a task that runs again writes the same files.

Defined results: a null payload is the empty one; records with equal payloads of at least
``REVISIT_BYTES`` bytes are one response (that with the largest page id) and revisits of it; rows
with a null id are responses; repeated rows of that largest id are all responses; an empty table
gives no archives and an empty result; extra columns are ignored. A record that fails a check is
returned with what failed in ``status``, and so is what follows a broken frame, once an archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compressed size at which an archive is closed, and what a dictionary is learnt from at most.
ARCHIVE_BYTES = 8 << 20
SAMPLE_BYTES, SAMPLE_RECORDS, DICTIONARY_BYTES = 1 << 20, 400, 16 << 10
REVISIT_BYTES = 1000
MAGIC_DICTIONARY = 0x184D2A5D
MAGIC_FRAME = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:quillstream:page:"


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): ``refers_to`` is the response's id for revisits, else null."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    shared = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = large.join(shared, "digest").where("page_id <> refers_to").distinct()
    return rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    target = "".join(c for c in url or "about:blank" if c > " " and c != "\x7f") or "about:blank"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>"]
    head += [f"WARC-Target-URI: {target}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archives(records: Iterator[bytes]) -> Iterator[tuple[bytes, int]]:
    """Archives (bytes, number of records) of at most about ``ARCHIVE_BYTES``."""
    import zstandard

    parts: list[bytes] = []
    size, n, waiting, held = 0, 0, [], 0
    tool = None

    def start(sample: list[bytes]):
        try:
            learnt = zstandard.train_dictionary(DICTIONARY_BYTES, sample)
            raw = zstandard.ZstdCompressor(level=9).compress(learnt.as_bytes())
            made = zstandard.ZstdCompressor(level=3, dict_data=learnt, write_checksum=True)
        except zstandard.ZstdError:  # too few or too small samples
            raw, made = b"", zstandard.ZstdCompressor(level=3, write_checksum=True)
        return struct.pack("<II", MAGIC_DICTIONARY, len(raw)) + raw, made

    for record in records:
        if tool is None:
            waiting.append(record)
            held += len(record)
            if held < SAMPLE_BYTES and len(waiting) < SAMPLE_RECORDS:
                continue
            head, tool = start(waiting)
            parts, size, n = [head], len(head), 0
            todo, waiting, held = waiting, [], 0
        else:
            todo = [record]
        for one in todo:
            frame = tool.compress(one)
            parts.append(frame)
            size += len(frame)
            n += 1
        if size >= ARCHIVE_BYTES:
            yield b"".join(parts), n
            tool = None
    if waiting:
        head, tool = start(waiting)
        parts, n = [head, *map(tool.compress, waiting)], len(waiting)
    if tool is not None:
        yield b"".join(parts), n


def write(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write rows of (page_id, url, payload, digest, refers_to) as archives below ``folder``, and a table of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{base}/warc", recursive=True)

        def rows() -> Iterator[bytes]:
            for batch in batches:
                for i in range(0, batch.num_rows, 500):
                    part = batch.slice(i, 500)
                    for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        yield record_bytes(page_id, url, payload, digest, refers_to, date)

        for k, (raw, n) in enumerate(archives(rows())):
            name = f"{base}/warc/part-{task.partitionId():06d}-{k:04d}.warc.zst"
            with store.open_output_stream(f"{name}.{task.taskAttemptId()}.open") as out:
                out.write(raw)
            store.move(f"{name}.{task.taskAttemptId()}.open", name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([len(raw)], pa.int64())], names=["archive", "n_records", "n_bytes"])

    ordered = records.select("page_id", "url", "payload", "digest", "refers_to").sortWithinPartitions("page_id", "digest", "url")
    ordered.mapInArrow(run, "archive string, n_records long, n_bytes long").write.parquet(f"{folder}/manifest")


def frames(raw: bytes, window: int = 16 << 10) -> Iterator[bytes]:
    """The content of each frame of an archive after its dictionary frame; ValueError where it breaks."""
    import zstandard

    if len(raw) < 8 or struct.unpack_from("<I", raw)[0] != MAGIC_DICTIONARY:
        raise ValueError("no dictionary frame")
    length = struct.unpack_from("<I", raw, 4)[0]
    held = raw[8 : 8 + length]
    if len(held) < length:
        raise ValueError("dictionary frame is cut")
    if held.startswith(MAGIC_FRAME):
        held = zstandard.ZstdDecompressor().decompress(held, max_output_size=64 << 20)
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)) if held else zstandard.ZstdDecompressor()
    at = 8 + length
    while at < len(raw):
        one, out = tool.decompressobj(), []
        while not one.eof:
            if at >= len(raw):
                raise ValueError("frame is cut")
            fed = raw[at : at + window]
            try:
                out.append(one.decompress(fed))
            except zstandard.ZstdError as e:
                raise ValueError(f"bad frame: {e}") from e
            at += len(fed) - len(one.unused_data)
        yield b"".join(out)


def parse_record(raw: bytes) -> dict:
    """Fields of one record; ``status`` is "ok" or what is wrong with it."""
    row = dict.fromkeys(("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"))
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        return row | {"status": "no WARC header"}
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    row |= {"record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to", "").strip("<>") or None}
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if not fields.get(k)]
    if missing:
        return row | {"status": f"missing {missing[0]}"}
    if not fields["content-length"].isdigit() or int(fields["content-length"]) != len(rest) - 4 or not rest.endswith(b"\r\n\r\n"):
        return row | {"status": "wrong length"}
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    sent = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode("latin-1").split("\r\n")[1:])}
    try:
        told = base64.b32decode(fields.get("warc-payload-digest", "").removeprefix("sha1:")).hex()
    except ValueError:
        return row | {"status": "bad digest"}
    if row["record_type"] == "revisit":
        row |= {"payload_digest": told, "payload_bytes": int(sent.get("content-length") or 0)}
        return row | {"status": "ok" if row["refers_to"] else "revisit of nothing"}
    row |= {"payload_digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload), "payload": payload}
    return row | {"status": "ok" if row["payload_digest"] == told and sent.get("content-length") == str(len(payload)) else "wrong digest or payload length"}


_SCHEMA = pa.schema([("archive", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("status", pa.string()), ("payload", pa.binary())])


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record of the archives below ``folder``; without ``payloads`` those are left null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                each = frames(content.as_py())
                while True:
                    try:
                        record = next(each, None)
                    except ValueError as e:
                        rows.append(dict.fromkeys(_SCHEMA.names) | {"archive": path, "status": str(e)})
                        record = None
                    if record is not None:
                        rows.append({"archive": path} | parse_record(record))
                        if not payloads:
                            rows[-1]["payload"] = None
                    if rows and (record is None or len(rows) >= 500):
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows = []
                    if record is None:
                        break

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(run, "archive string, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, status string, payload binary")


def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """What the archives say of each page: sizes, digests and revisits, by integer ids."""
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(_ID) + 1}) AS BIGINT)")
    return read(spark, folder, payloads=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "status")
