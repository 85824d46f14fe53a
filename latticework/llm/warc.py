"""WARC archives compressed with a shared Zstandard dictionary, written and read in parallel.

A dictionary is trained on a bounded sample of records. Every archive starts with it, in a skippable frame of the kind that
WARC readers know, and then holds one frame for each record, compressed on its own with the dictionary, so records can be
read one by one. Of records with equal payloads of some size the one with the largest id is kept as the response; the others
become revisit records, which name it and carry the payload's digest and length but no payload.

Archives are written by tasks, under names that no two attempts share, into the folder that driver and executors share; what
the finished tasks report is checkpointed, and only archives named there are read, so lost executors leave no trace.

Defined results: a null payload is empty. Rows that repeat an id are records of their own; those that also share the payload
of the response, and its id, are responses too. A record with a null id is the response only if all of its payload's ids are
null, and is then referred to by none. A null URL is left out. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

# Fixed value: the magic number of a skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
LEAST_SHARED = 1000
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_LONGEST = 64 << 10, 1500, 32 << 10
#: Bytes of payload after which a task starts another archive.
ARCHIVE_BYTES = 256 << 20
DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_uri(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest}')}"


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, length: int, refers_to: int | None) -> bytes:
    """One WARC record; a payload of None makes it a revisit."""
    revisit = payload is None
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<{record_uri(page_id, digest)}>", "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    head["WARC-Payload-Digest"] = f"sha1:{digest}"
    if revisit:
        head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<{record_uri(refers_to, digest)}>", "X-Refers-To-Page": str(refers_to)}
    if page_id is not None:
        head["X-Page"] = str(page_id)
    head |= {"X-Payload-Length": str(length), "Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload or b""))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items()), "\r\n"]).encode("utf-8") + (payload or b"") + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    return fields, rest[: int(fields["Content-Length"])]


def trained(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for records like these; empty if there are too few to train one."""
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class Writer:
    """One archive: the dictionary first, then a frame for each record."""

    def __init__(self, out, dictionary: bytes, level: int = 3):
        self.out, self.bytes, self.records = out, 0, 0
        made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=made, write_checksum=True, write_content_size=True)
        if dictionary:
            self._put(DICTIONARY_FRAME.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.compressor.compress(data))
        self.records += 1


def frames(source, step: int = 1 << 20) -> Iterator[bytes]:
    """The records of one archive, one after the other; memory is bounded by the largest."""
    data = source.read(8)
    made = None
    if len(data) == 8 and int.from_bytes(data[:4], "little") == DICTIONARY_FRAME:
        made = zstandard.ZstdCompressionDict(source.read(int.from_bytes(data[4:], "little")))
        data = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=made) if made else zstandard.ZstdDecompressor()
    one, parts = None, []
    while True:
        if not data:
            data = source.read(step)
            if not data:
                break
        one = one or decompressor.decompressobj()
        parts.append(one.decompress(data))
        data = b""
        if one.eof:
            data = one.unused_data
            yield b"".join(parts)
            one, parts = None, []
    if one is not None:
        raise ValueError("the archive ends within a record")


def _open(uri: str, write: bool):
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path, compression=None) if write else system.open_input_stream(path, compression=None)


def _written(folder: str, dictionary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        paths, records, out, writer, size = [], [], None, None, 0
        for batch in batches:
            for page_id, url, payload, digest, length, kept, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    paths.append(f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(paths):04d}.warc.zst")
                    out = _open(paths[-1], True)
                    writer, size = Writer(out, dictionary.value), 0
                writer.add(record(page_id, url, (payload or "").encode("utf-8") if kept else None, digest, length, refers_to))
                size += length
                if size > ARCHIVE_BYTES:
                    out.close()
                    records.append(writer.records)
                    writer = None
        if writer is not None:
            out.close()
            records.append(writer.records)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(records, pa.int64())], ["path", "records"])

    return run


def write(spark: SparkSession, pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html", least_shared: int = LEAST_SHARED) -> DataFrame:
    """(path, records) of each archive written: all of them are complete when this returns."""
    shared.small_batches(spark)
    folder = folder or shared.new_folder(spark, "warc")
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    rows = pages.select(pages[key].cast("long").alias("page"), pages[url].alias("url"), pages[payload].alias("payload"))
    data = F.encode(F.coalesce("payload", F.lit("")), "utf-8")
    rows = rows.withColumn("digest", F.sha1(data)).withColumn("length", F.octet_length(data).cast("long"))
    small = rows.filter((F.col("length") > 0) & (F.col("length") <= SAMPLE_LONGEST))
    chosen = shared.bounded(small, "page", small.count(), SAMPLE_RECORDS).orderBy("page", "digest").limit(2 * SAMPLE_RECORDS)
    samples = [record(r["page"], r["url"], r["payload"].encode("utf-8"), r["digest"], r["length"], None) for r in chosen.collect()]
    dictionary = spark.sparkContext.broadcast(trained(samples))
    groups = rows.filter(F.col("length") >= least_shared).groupBy(F.col("digest").alias("d"), F.col("length").alias("n")).agg(F.max("page").alias("top"), F.count("*").alias("of"))
    groups = groups.filter("of > 1 AND top IS NOT NULL").select("d", "n", "top")
    out = rows.join(groups, (F.col("digest") == F.col("d")) & (F.col("length") == F.col("n")), "left")
    kept = F.coalesce(F.col("page") == F.col("top"), F.col("top").isNull())
    out = out.select("page", "url", F.when(kept, F.col("payload")).alias("payload"), "digest", "length", kept.alias("kept"), F.when(~kept, F.col("top")).alias("refers_to"))
    return shared.cut(out.mapInArrow(_written(folder, dictionary), "path string, records long"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {k: [] for k in ("page_id", "url", "type", "digest", "length", "refers_to", "payload")}
            seen = size = 0
            with _open(path, False) as source:
                for data in frames(source):
                    head, block = parsed(data)
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = head["WARC-Type"] == "response"
                    if response and hashlib.sha1(block).hexdigest() != digest:
                        raise ValueError(f"{path}: a payload does not have its digest {digest}")
                    row = (int(head["X-Page"]) if "X-Page" in head else None, head.get("WARC-Target-URI"), head["WARC-Type"], digest, len(block) if response else int(head["X-Payload-Length"]), int(head["X-Refers-To-Page"]) if not response else None, block if response else None)
                    for column, value in zip(found.values(), row, strict=True):
                        column.append(value)
                    seen += 1
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pydict(found, _READ)
                        found, size = {k: [] for k in found}, 0
            if seen != records:
                raise ValueError(f"{path}: {seen} records instead of {records}")
            yield pa.RecordBatch.from_pydict(found, _READ)


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("digest", pa.string()), ("length", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """(page_id, url, type, digest, length, refers_to, payload) of every record; payloads of responses are checked against their digests."""
    shared.small_batches(spark)
    n = int(np.clip(archives.count(), 1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return archives.repartition(n, "path").mapInArrow(_read, "page_id long, url string, type string, digest string, length long, refers_to long, payload binary")
