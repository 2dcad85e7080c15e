"""WARC archives compressed record by record with a Zstandard dictionary that stands in a leading skippable frame.

Each archive's dictionary is built from a bounded sample of its own records' heads; each record is a frame by itself, so a
reader that knows the dictionary reads any record by its offset. Of records with equal payloads of at least ``least`` bytes
the one with the largest page_id is a response and the others are revisits that name it; smaller ones are all responses.

Defined results: null html is an empty payload; rows that repeat the chosen page_id and payload are all responses; a null
page_id is written as ``null`` and chosen only if all ids of that payload are null; an empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm.common import AtomicFile, fresh_path, open_file, partitions, stage

DICT_MAGIC = 0x184D2A5D
ROLL_BYTES = 1 << 28
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP head alone, whose Content-Length is that of the full payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    name = lambda x: f"<urn:page:{'null' if x is None else x}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The record's fields; a response's payload must have the digest that its header names."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']} does not hold the payload it names")
    number = lambda x: None if x in (None, "<urn:page:null>") else int(x.removeprefix("<urn:page:").removesuffix(">"))
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload": payload,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To")),
    }


class WarcWriter:
    """Holds the first ``sample`` bytes of records back to build the dictionary, then writes each record as it comes."""

    def __init__(self, folder: str, name: str, dictionary: int, sample: int, level: int):
        self.out, self.size, self.sample, self.level = AtomicFile(folder, name), dictionary, sample, level
        self.held, self.bytes, self.squeeze, self.records = [], 0, None, 0

    def start(self) -> None:
        heads = [r[:4096] for r in self.held]
        try:
            found = zstandard.train_dictionary(self.size, heads, level=self.level)
        except zstandard.ZstdError:  # too few records to train on: their own bytes are the dictionary
            found = zstandard.ZstdCompressionDict(b"".join(heads)[: self.size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        body = found.as_bytes()
        self.out.write(struct.pack("<II", DICT_MAGIC, len(body)) + body)
        self.squeeze = zstandard.ZstdCompressor(level=self.level, dict_data=found, write_checksum=True, write_content_size=True)
        for r in self.held:
            self.put(r)
        self.held = []

    def put(self, r: bytes) -> None:
        self.out.write(self.squeeze.compress(r))

    def add(self, r: bytes) -> None:
        self.records += 1
        if self.squeeze:
            self.put(r)
            return
        self.held.append(r)
        self.bytes += len(r)
        if self.bytes >= self.sample:
            self.start()

    def close(self) -> None:
        if not self.squeeze:
            self.start()
        self.out.close()


def read_archive(folder: str, name: str):
    """The records of an archive, one after another."""
    file = open_file(folder, name)
    magic, length = struct.unpack("<II", file.read(8))
    if magic != DICT_MAGIC:
        raise ValueError(f"{name} does not start with a dictionary")
    body = file.read(length)
    kind = zstandard.DICT_TYPE_AUTO
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=kind)) if body else zstandard.ZstdDecompressor()
    rest, frame, out = b"", opener.decompressobj(), []
    while data := rest or file.read(1 << 20):
        rest = b""
        out.append(frame.decompress(data))
        if frame.eof:
            yield b"".join(out)
            rest, frame, out = frame.unused_data, opener.decompressobj(), []
    if out:
        raise ValueError(f"{name} ends within a record")


def decide(pages: DataFrame, least: int) -> DataFrame:
    """(row, html, ... , digest key, refers_to, revisit): equal payloads are known by their SHA-1 and length.

    Only payloads that occur more than once are joined back, and only their ids move, so a payload that a third of all
    rows share costs a pre-aggregated row per task and no gathering of its pages.
    """
    digests = pages.select("row", "page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("n")).where(F.col("n") >= least)
    again = digests.groupBy("sha", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    hits = digests.join(again, ["sha", "n"]).where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return hits.select("row", "refers_to")


def write_warc(pages: DataFrame, least: int = 0, folder: str | None = None, dictionary: int = 32_768, sample: int = 2_000_000, level: int = 6) -> tuple[str, DataFrame]:
    """Writes the pages (page_id, url, html) to archives of about ``ROLL_BYTES``; returns the folder and a frame (file, records).

    A task's records are in a fixed order, so a task that runs again writes the same archives.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    payload: Column = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = stage(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("row", F.monotonically_increasing_id()), "pages")
    rows = rows.join(stage(decide(rows, least), "revisits"), "row", "left").repartition(partitions(spark), "row").sortWithinPartitions("row").select("page_id", "url", "payload", "refers_to")

    def write(batches):
        part, number, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, body, refers_to = row
                if out is None:
                    name = f"part-{part:06d}-{number:05d}.warc.zst"
                    out = WarcWriter(folder, name, dictionary, sample, level)
                out.add(record(page_id, url, body, payload_digest(body), refers_to, refers_to is not None))
                if out.out.size >= ROLL_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pylist([{"file": name, "records": out.records}])
                    out, number = None, number + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "records": out.records}])

    return folder, rows.mapInArrow(write, "file string, records long")


def read_warc(spark: SparkSession, folder: str, files: list[str], payloads: bool = False) -> DataFrame:
    """A row for each record of the archives."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held = []
                for data in read_archive(folder, name):
                    found = parse(data)
                    held.append({k: found[k] for k in names})
                    if len(held) >= (200 if payloads else 5000):
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, arrow)

    frame = spark.createDataFrame([(f,) for f in files], "file string")
    return frame.repartition(max(1, len(files)), "file").mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the archives, then reads every record back. What reaches the driver is a row for each archive."""
    folder, written = write_warc(pages, least)
    return read_warc(pages.sparkSession, folder, sorted(r["file"] for r in written.collect()))
