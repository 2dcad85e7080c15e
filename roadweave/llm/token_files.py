"""Token-id files: independent Zstandard frames with a trailing seek table and a checksum of every frame.

A file is a skippable frame with a JSON header, the data frames, a skippable frame with the document index (id, whether
the id is null, number of ids), and the seek table of the public seekable format. A frame holds whole documents up to
``FRAME`` ids; a longer document spans frames of its own. So a reader of some documents decompresses only their frames.

Defined results: a null text is an empty one and holds just the end id; rows with equal ids stand in text order, each
for itself; null ids come first; an empty table gives no file and no row; further columns are ignored.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import CACHES, AtomicFile, fresh_path, open_file, partitions
from roadweave.llm.tokens import Encoder, by_text

HEADER_MAGIC, INDEX_MAGIC, SEEK_MAGIC, SEEK_END = 0x184D2A50, 0x184D2A51, 0x184D2A5E, 0x8F92EAB1
FRAME = 1 << 17
ROLL_BYTES, ROLL_DOCUMENTS = 1 << 28, 2_000_000
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("size", "<u8")])
SEEK = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])


@functools.lru_cache(2)
def encoder(source: str, most: int = 400_000) -> Encoder:
    """One encoder for each Python worker, so its cache serves all tasks that the worker runs."""
    return Encoder(source, most)


CACHES.append(encoder.cache_clear)


def skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class IdWriter:
    """Writes documents one after another; ``close`` adds the index and the seek table."""

    def __init__(self, folder: str, name: str, kind: str, level: int, roll: tuple[int, int] = (ROLL_BYTES, ROLL_DOCUMENTS)):
        self.roll = roll
        self.out, self.kind = AtomicFile(folder, name), np.dtype(kind)
        self.squeeze = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.doc_ids, self.nulls, self.sizes, self.seek = array("q"), array("B"), array("Q"), array("I")
        self.held, self.size, self.total = [], 0, 0
        self.out.write(skippable(HEADER_MAGIC, json.dumps({"version": 1, "dtype": self.kind.str}).encode()))

    def frame(self, ids: np.ndarray) -> None:
        plain = ids.tobytes()
        packed = self.squeeze.compress(plain)
        self.out.write(packed)
        self.seek.extend((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def flush(self) -> None:
        if self.size:
            self.frame(np.concatenate(self.held))
        self.held, self.size = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.sizes.append(len(ids))
        self.total += len(ids)
        ids = ids.astype(self.kind)
        if self.size + len(ids) > FRAME:
            self.flush()
        if len(ids) > FRAME:
            for at in range(0, len(ids), FRAME):
                self.frame(ids[at : at + FRAME])
            return
        self.held.append(ids)
        self.size += len(ids)

    def full(self) -> bool:
        """Whether the next document belongs in another file, so index, seek table and what a reader holds stay small."""
        return self.out.size >= self.roll[0] or len(self.sizes) >= self.roll[1]

    def close(self) -> dict:
        self.flush()
        index = np.zeros(len(self.sizes), ENTRY)
        for field, values in (("doc_id", self.doc_ids), ("null", self.nulls), ("size", self.sizes)):
            index[field] = np.frombuffer(values, values.typecode)
        self.out.write(skippable(INDEX_MAGIC, index.tobytes()))
        frames = len(self.seek) // 3
        self.out.write(skippable(SEEK_MAGIC, np.array(self.seek, "<u4").tobytes() + struct.pack("<IBI", frames, 0x80, SEEK_END)))
        self.out.close()
        return {"documents": len(index), "tokens": self.total}


class IdReader:
    """Random access to the documents of one file."""

    def __init__(self, folder: str, name: str):
        self.file = open_file(folder, name)
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_END or flags != 0x80:
            raise ValueError(f"{name} has no seek table with checksums")
        at = size - 9 - frames * SEEK.itemsize
        self.seek = np.frombuffer(self.file.read_at(frames * SEEK.itemsize, at), SEEK)
        _, length = struct.unpack("<II", self.file.read_at(8, 0))
        self.kind = np.dtype(json.loads(self.file.read_at(length, 8))["dtype"])
        self.packed = 8 + length + np.concatenate(([0], np.cumsum(self.seek["packed"], dtype=np.int64)))
        self.plain = np.concatenate(([0], np.cumsum(self.seek["plain"], dtype=np.int64))) // self.kind.itemsize
        index = int(self.packed[-1])
        magic, length = struct.unpack("<II", self.file.read_at(8, index))
        if magic != INDEX_MAGIC:
            raise ValueError(f"{name} has no document index")
        self.index = np.frombuffer(self.file.read_at(length, index + 8), ENTRY)
        self.starts = np.concatenate(([0], np.cumsum(self.index["size"], dtype=np.int64)))
        self.open, self.last = zstandard.ZstdDecompressor(), (-1, np.zeros(0, self.kind))
        self.opened = 0

    def frame(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            plain = self.open.decompress(self.file.read_at(int(self.seek["packed"][k]), int(self.packed[k])))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.seek["check"][k]:
                raise ValueError(f"frame {k} does not have its checksum")
            self.last, self.opened = (k, np.frombuffer(plain, self.kind)), self.opened + 1
        return self.last[1]

    def doc_id(self, i: int) -> int | None:
        return None if self.index["null"][i] else int(self.index["doc_id"][i])

    def ids(self, i: int) -> Iterator[np.ndarray]:
        """The ids of the document at place ``i``, by frame."""
        start, end = int(self.starts[i]), int(self.starts[i + 1])
        k = int(np.searchsorted(self.plain, start, "right")) - 1
        while start < end:
            base = int(self.plain[k])
            part = self.frame(k)[start - base : end - base]
            yield part
            start += len(part)
            k += 1


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", level: int = 3, roll: tuple[int, int] = (ROLL_BYTES, ROLL_DOCUMENTS)) -> tuple[str, DataFrame]:
    """Writes the ids of all texts in ascending id order; returns the folder and a frame (file, part, number, documents, tokens).

    The rows are dealt out by ranges of the id, and each task writes its range block by block into files of about ``roll``
    bytes or documents, numbered in order, so what a task holds is bounded by a file's index and one text. ``tokenizer`` is the path of a tokenizers file on the driver, which goes along with the tasks
    (under 3 MB). Ids are kept in 2 bytes if the vocabulary allows, else in 4.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    shared = spark.sparkContext.broadcast(source)
    folder = folder or fresh_path(spark, "token-files")

    def write(batches):
        known, out, part, number = encoder(shared.value), None, TaskContext.get().partitionId(), 0
        kind = "<u2" if max(end_id, known.tokenizer.get_vocab_size()) <= 1 << 16 else "<u4"

        def finish() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": name, "part": part, "number": number} | out.close()])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s in by_text(texts):
                flat, counts = known.encode(texts[s])
                ends = counts.cumsum()
                for doc, end, n in zip(ids[s], ends.tolist(), counts.tolist(), strict=True):
                    if out and out.full():
                        yield finish()
                        out, number = None, number + 1
                    if out is None:
                        name = f"part-{part:06d}-{number:05d}.ids.zst"
                        out = IdWriter(folder, name, kind, level, roll)
                    out.add(doc, np.append(flat[end - n : end], np.uint32(end_id)))
        if out:
            yield finish()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return folder, rows.mapInArrow(write, "file string, part long, number long, documents long, tokens long")


def read_token_files(spark, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """Per document of the files, given with the number of ids before each: doc_id, start, n_tokens, ids_crc32."""

    def read(batches):
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = IdReader(folder, name)
                for at in range(0, len(file.index), 50_000):
                    out = []
                    for i in range(at, min(at + 50_000, len(file.index))):
                        crc = 0
                        for ids in file.ids(i):
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        out.append((file.doc_id(i), before + int(file.starts[i]), int(file.index["size"][i]), crc))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    frame = spark.createDataFrame(files, "file string, before long")
    return frame.repartition(max(1, len(files)), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_id_output(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the files, then reads every document back. What reaches the driver is a row for each file."""
    folder, written = write_token_files(docs, tokenizer, end_id)
    before, files = 0, []
    for row in sorted(written.collect(), key=lambda r: (r["part"], r["number"])):
        files.append((row["file"], before))
        before += row["tokens"]
    return read_token_files(docs.sparkSession, folder, files)
