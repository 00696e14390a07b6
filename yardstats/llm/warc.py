"""WARC archives, compressed record by record with a Zstandard dictionary of their own.

Every archive starts with a skippable frame that holds the dictionary, built from its
own first records; each record is a frame by itself. Which record of equal payloads is
the response is settled from ids and digests alone, before a payload is moved.

The archives lie in the folder ``spark.checkpoint.dir`` names or any other that
``pyarrow.fs`` opens by its address. Their names hold Spark's task attempt, and only
archives of tasks that have ended well are listed, so a lost executor leaves at most a
file that nobody lists.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yardstats.llm.shared import write_through
from yardstats.session import work_path

SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their own
SAMPLE_BYTES = 2 << 20  # of an archive's first records, for its dictionary
DICTIONARY_BYTES = 32 << 10
ARCHIVE_BYTES = 512 << 20  # of records before compression; a task goes on in a new archive beyond it
LEVEL = 3

#: What the writer takes and what the reader returns besides.
RECORD = ["page_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to"]


def _digest(payload: Column) -> Column:
    return F.sha1(payload)


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """One record per row of ``pages``: the columns of ``RECORD``, payload null for revisits.

    Of the records of equal payloads of at least ``least`` bytes, that with the smallest
    page_id is the response (null last; of equal ids the one with the smallest url, null
    first; of wholly equal rows any one). All others revisit it. Null html: empty.

    A payload that occurs once stays where it is read. The join is with one row per
    repeated payload; a hot payload is on the big side only.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    whole = pages.select("page_id", "url", payload.alias("payload"))
    whole = whole.withColumn("digest", _digest(F.col("payload")))
    whole = whole.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = write_through(whole.select("page_id", "url", "digest", "payload_bytes"), "warc-rows")
    repeated = rows.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("records")
    ).filter("records > 1").drop("records")
    same = rows.join(repeated, "digest").filter(F.col("page_id").eqNullSafe(F.col("first_id")))
    firsts = same.groupBy("digest", "first_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    firsts = firsts.groupBy("digest", "first_id").agg(F.min(F.struct("url", "copies")).alias("first"))
    firsts = firsts.select("digest", "first_id", F.col("first.url").alias("first_url"), "first.copies")
    firsts = write_through(firsts, "warc-firsts")

    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    several = F.coalesce(is_first & (F.col("copies") > 1), F.lit(False))
    joined = whole.join(firsts, "digest", "left")
    response = F.col("copies").isNull() | is_first
    single = joined.filter(~several).select(
        "page_id", "url", F.when(response, F.col("payload")).alias("payload"), "digest", "payload_bytes",
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.when(~response, F.col("first_id")).alias("refers_to"),
    )
    # Wholly equal rows: one response and the rest as revisits, out of one row and a count.
    equal = whole.join(firsts.filter("copies > 1"), "digest").filter(is_first)
    equal = equal.groupBy("digest").agg(
        F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.first("payload").alias("payload"),
        F.first("payload_bytes").alias("payload_bytes"), F.first("copies").alias("copies"),
    ).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    response = F.col("copy") == 1
    equal = equal.select(
        "page_id", "url", F.when(response, F.col("payload")).alias("payload"), "digest", "payload_bytes",
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.when(~response, F.col("page_id")).alias("refers_to"),
    )
    return single.union(equal).withColumnRenamed("digest", "payload_digest")


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def encode_record(page_id, url, payload, digest, size, kind, refers_to) -> bytes:
    text = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id, digest) if kind == 'response' else f'<urn:uuid:{uuid.uuid4()}>'}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url) if url else 'urn:page'}",
        f"WARC-Payload-Digest: sha1:{text}", f"WARC-Payload-Length: {size}",
    ]
    lines += [f"WARC-Page-Id: {page_id}"] * (page_id is not None)
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
        lines += [f"WARC-Refers-To-Page-Id: {refers_to}"] * (refers_to is not None)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the records; where they are too few or too alike, their first bytes as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=1024, d=8)
    except zstandard.ZstdError:
        raw = b"".join(records)[:DICTIONARY_BYTES] or b"WARC/1.1"
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class _Archive:
    """One archive being written; the first records wait until the dictionary is built."""

    def __init__(self, folder: files.FileSystem, path: str) -> None:
        self.records = self.size = 0
        self._waiting: list[bytes] | None = []
        self._held = 0
        self._out = folder.open_output_stream(path, compression=None)

    def add(self, record: bytes) -> None:
        self.records, self.size = self.records + 1, self.size + len(record)
        if self._waiting is None:
            self._out.write(self._compressor.compress(record))
            return
        self._waiting.append(record)
        self._held += len(record)
        if self._held >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        dictionary = build_dictionary(self._waiting)
        held = dictionary.as_bytes()
        self._out.write(struct.pack("<II", SKIPPABLE, len(held)) + held)
        dictionary.precompute_compress(level=LEVEL)
        self._compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True)
        for record in self._waiting:
            self._out.write(self._compressor.compress(record))
        self._waiting = None

    def close(self) -> None:
        if self._waiting is not None:
            self._begin()
        self._out.close()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the records to ``folder``; returns the list of archives: archive, records, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = files.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        task, done, archive = TaskContext.get(), [], None

        def close() -> None:
            archive.close()
            done.append((f"{folder}/{name}", archive.records, archive.size))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in RECORD)):
                if archive is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):03d}.warc.zst"
                    archive = _Archive(store, f"{path}/{name}")
                archive.add(encode_record(*row))
                if archive.size >= ARCHIVE_BYTES:
                    close()
                    archive = None
        if archive is not None:
            close()
        columns = zip(*done) if done else ([], [], [])
        kinds = (pa.string(), pa.int64(), pa.int64())
        arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, ["archive", "records", "bytes"])

    return write_through(records.select(*RECORD).mapInArrow(run, "archive string, records long, bytes long"), "warc-list")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an open archive."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not start with a dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(stream.read(size))
    plain = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(stream, read_across_frames=True)
    lines = io.BufferedReader(plain, 1 << 18)
    while lines.readline():
        fields = {}
        while (line := lines.readline().decode().rstrip("\r\n")):
            key, _, value = line.partition(": ")
            fields[key] = value
        block = lines.read(int(fields["Content-Length"]))
        lines.read(4)
        yield fields, block


def read_archives(archives: DataFrame, id_type: T.DataType = T.LongType()) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of all records.

    Length and digest of a response are those of the payload read; a revisit states them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                store, path = files.FileSystem.from_uri(archive)
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    for fields, block in read_records(stream):
                        size, digest = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"][5:]
                        if fields["WARC-Type"] == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        page, refers = fields.get("WARC-Page-Id"), fields.get("WARC-Refers-To-Page-Id")
                        rows.append((page, fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], refers))
                        if len(rows) == 10_000:
                            yield _rows(rows, kinds, names)
                            rows = []
                yield _rows(rows, kinds, names)

    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    # One archive per task: the list's rows are small, but each stands for a file.
    listed = archives.select("archive").repartition(max(1, archives.count()))
    found = listed.mapInArrow(run, schema)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def _rows(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write all pages to ``folder`` (a new one in the shared folder) and list the archives."""
    return write_archives(plan_records(pages, least), folder or work_path(pages.sparkSession, "warc"))
