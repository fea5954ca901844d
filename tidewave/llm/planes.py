"""Token ids in files of shuffled planes.

A file holds blocks of a fixed number of ids. A block is transposed into byte planes (or bit
planes), each compressed by zstandard; the index at the end of the file has the place of
every plane and the start and length of every document, so that a reader can fetch one
document through the few blocks that hold it.

Layout, little-endian: magic; planes of all blocks; index (zstandard) of int64 arrays; then the
index's length and four numbers: blocks, documents, ids, planes; magic again.

Files carry names of their own for every attempt of a task, and only those in the manifest,
which Spark writes with its own commit, are read: an attempt that was lost leaves no trace in
the results.

Defined results: a null text has no ids besides the end id; a null document id comes
first and stays null; documents with equal ids lie in the order of a hash of their text; an
empty table gives a manifest without rows and reads as an empty table; further columns are
ignored. Document ids are integers, or texts that spell one; others fail.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.llm.chunks import library_memory
from tidewave.llm.memory import give_back
from tidewave.operators.sizing import slots_of

MAGIC = b"IDPLANE1"
BLOCK_IDS = 65_536
TEXT_BYTES_PER_FILE = 64 << 20
LEVEL = 3
MANIFEST = "file_no int, file string, n_docs long, n_ids long"
READ = "doc_id long, file_no int, start long, ids binary"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        table = np.unpackbits(raw, axis=1, bitorder="little")
        return [np.packbits(table[:, i], bitorder="little").tobytes() for i in range(32)]
    return [raw[:, i].tobytes() for i in range(4)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 32:
        table = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(table, axis=1, bitorder="little")
    else:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def file_system(path: str):
    """File system and the path in it, for local paths and any address pyarrow knows; Spark's names of S3 count as S3."""
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    if parts.scheme in ("s3a", "s3n"):
        path = "s3" + path.removeprefix(parts.scheme)
    return fs.FileSystem.from_uri(path)


class PlaneWriter:
    """Writes one file, block by block."""

    def __init__(self, path: str, bits: bool = False, block_ids: int = BLOCK_IDS, level: int = LEVEL):
        import zstandard

        system, inside = file_system(path)
        system.create_dir(inside.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(inside)
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.bits, self.block_ids = bits, block_ids
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.at = 0
        self.blocks: list[list[int]] = []
        self.docs: list[tuple[int, int, int, int]] = []
        self.put(MAGIC)

    def put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, self.n_ids, len(ids)))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block_ids:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, "<u4")
        full = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for a in range(0, full, self.block_ids):
            block = ids[a:min(a + self.block_ids, full)]
            at = self.at
            self.blocks.append([at, len(block), *(self.put(self.pack(p)) for p in to_planes(block, self.bits))])
        self.waiting, self.n_waiting = [ids[full:]], len(ids) - full

    def close(self) -> None:
        self.flush(True)
        index = np.asarray(self.blocks, "<i8").tobytes() + np.asarray(self.docs, "<i8").reshape(-1, 4).tobytes()
        size = self.put(self.pack(index))
        self.put(np.asarray([size, len(self.blocks), len(self.docs), self.n_ids, 32 if self.bits else 4], "<i8").tobytes())
        self.put(MAGIC)
        self.out.close()


class PlaneReader:
    """Reads documents of one file in order, holding one block at a time."""

    def __init__(self, path: str):
        import zstandard

        system, inside = file_system(path)
        self.source = system.open_input_file(inside)
        self.unpack = zstandard.ZstdDecompressor().decompress
        size, tail = self.source.size(), 40 + len(MAGIC)
        end = self.source.read_at(tail, size - tail)
        if end[40:] != MAGIC or self.source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"not a plane file: {path}")
        packed, n_blocks, n_docs, self.n_ids, planes = np.frombuffer(end[:40], "<i8").tolist()
        index = np.frombuffer(self.unpack(self.source.read_at(packed, size - tail - packed)), "<i8")
        cut = n_blocks * (2 + planes)
        self.blocks, self.docs = index[:cut].reshape(n_blocks, -1), index[cut:].reshape(n_docs, 4)
        self.first = np.concatenate([[0], np.cumsum(self.blocks[:, 1])]) if n_blocks else np.zeros(1, np.int64)
        self.held: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def block(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            at, n, *sizes = self.blocks[k].tolist()
            data, planes = self.source.read_at(sum(sizes), at), []
            for s in sizes:
                planes.append(self.unpack(data[:s]))
                data = data[s:]
            self.held = (k, from_planes(planes, n))
        return self.held[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        parts, k = [np.empty(0, "<u4")], int(np.searchsorted(self.first, start, "right")) - 1
        while n:
            block = self.block(k)
            a = start - int(self.first[k])
            part = block[a:a + n]
            parts.append(part)
            start, n, k = start + len(part), n - len(part), k + 1
        return np.concatenate(parts)


def write(
    df: DataFrame, folder: str, tokenizer_json: str, doc_id: str = "doc_id", text: str = "text",
    end_id: int | None = None, bits: bool = False, block_ids: int = BLOCK_IDS,
    text_bytes_per_file: int = TEXT_BYTES_PER_FILE,
) -> DataFrame:
    """Encode whole texts, write them in ascending document order, return the manifest."""
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_files = max(slots_of(spark), math.ceil(total / text_bytes_per_file))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(n_files, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    vocabulary = spark.sparkContext.broadcast(tokenizer_json)
    end = np.asarray([] if end_id is None else [end_id], "<u4")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name, memory = None, "", None
        for batch in batches:
            if batch.num_rows and writer is None:
                name = f"{uuid.uuid4().hex}.ids"
                writer = PlaneWriter(f"{folder}/files/{name}", bits, block_ids)
                memory = library_memory(vocabulary.value)
            if batch.num_rows:
                keys = batch.column(0).to_pylist()
                for key, ids in zip(keys, memory.of(batch.column(1))):
                    writer.add(key, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({
                "file_no": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [name],
                "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})
        del writer, memory
        give_back()

    ordered.mapInArrow(files, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: id, place of its first id in the whole, ids (little-endian bytes)."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)
    places = manifest.select("file_no", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.to_pylist():
                reader = PlaneReader(f"{folder}/files/{place['file']}")
                rows: list[tuple] = []
                held = 0
                for doc_id, null, start, n in reader.docs.tolist():
                    rows.append((None if null else doc_id, place["file_no"], place["base"] + start, reader.ids(start, n).tobytes()))
                    held += 4 * n
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows)
        give_back()

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "file_no", "start", "ids"])

    return places.repartition(slots_of(spark), "file_no").mapInArrow(documents, READ)
