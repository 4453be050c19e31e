"""Operator 8: token ids in files of independent zstandard frames with a seek table at the end.

A file is a run of frames, each compressed alone, then one skippable frame with, for each of them, its compressed size,
its size and the low half of the XXH64 of its content, so that a reader fetches and checks only the frames it needs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored, texts
from .library_ids import VOCABULARY, library_ids

#: Fixed values of the public seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80

FRAME_BYTES = 1 << 18
#: Chunks that a worker process remembers: tasks here hold little else, so more than elsewhere.
REMEMBERED = 600_000


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class SeekWriter:
    """Appends bytes to a stream in frames of FRAME_BYTES; finish() writes the last frame and the seek table."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.stream, self.frame_bytes = stream, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.waiting, self.table = bytearray(), []

    def append(self, data: bytes) -> None:
        self.waiting += data
        while len(self.waiting) >= self.frame_bytes:
            self._frame(bytes(self.waiting[: self.frame_bytes]))
            del self.waiting[: self.frame_bytes]

    def _frame(self, data: bytes) -> None:
        packed = self.compressor.compress(data)
        self.stream.write(packed)
        self.table.append(struct.pack("<III", len(packed), len(data), _checksum(data)))

    def finish(self) -> None:
        if self.waiting:
            self._frame(bytes(self.waiting))
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class SeekReader:
    """Reads byte ranges of such a file (seekable, with read) by the frames they touch; a frame that fails its checksum raises."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.decompressor = file, zstandard.ZstdDecompressor()
        file.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums")
        file.seek(size - 9 - 12 * frames)
        table = np.frombuffer(file.read(12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.r_[0, np.cumsum(table[:, 0])]
        self.begin = np.r_[0, np.cumsum(table[:, 1])]
        self.check = table[:, 2]
        self.held, self.content = -1, b""

    def frame(self, k: int) -> bytes:
        if k != self.held:
            self.file.seek(int(self.at[k]))
            data = self.decompressor.decompress(self.file.read(int(self.at[k + 1] - self.at[k])), max_output_size=int(self.begin[k + 1] - self.begin[k]))
            if _checksum(data) != self.check[k]:
                raise ValueError(f"frame {k} doesn't match its checksum")
            self.held, self.content = k, data
        return self.content

    def read(self, start: int, length: int) -> bytes:
        if start + length > self.begin[-1]:
            raise ValueError("the range ends after the file's content")
        out, k = [], int(np.searchsorted(self.begin, start, "right")) - 1
        while length > 0:
            skip = start - int(self.begin[k])
            part = self.frame(k)[skip : skip + length]
            out.append(part)
            start, length, k = start + len(part), length - len(part), k + 1
        return b"".join(out)


def write_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = 0) -> DataFrame:
    """Encode whole texts (null: empty), append end_id to each and write them in ascending doc_id order to files in folder.

    Returns the stored index: doc_id, file, part (files in ascending order), first (ids before it in its file), n_tokens.
    A null doc_id comes first; repeated ids follow each other by text. An attempt that fails leaves a file that the index
    does not name. Empty table: an empty index and no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encode, end = library_ids(vocabulary, REMEMBERED), struct.pack("<I", end_id)
        task = TaskContext.get()
        name = f"ids-{task.partitionId():07d}-{task.taskAttemptId()}.zst"
        system = path = writer = None
        first = 0
        for b in batches:
            if writer is None:
                system, path = fs.FileSystem.from_uri(folder)
                system.create_dir(path, recursive=True)
                stream = system.open_output_stream(f"{path}/{name}", compression=None)
                writer = SeekWriter(stream)
            counts = []
            for text in b.column(1).to_pylist():
                ids = encode(text) + end
                writer.append(ids)
                counts.append(len(ids) // 4)
            ends = first + np.cumsum(counts, dtype=np.int64) if counts else np.zeros(0, np.int64)
            rows = len(counts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([name] * rows, pa.string()), pa.array([task.partitionId()] * rows, pa.int32()), pa.array(ends - np.array(counts, np.int64)), pa.array(counts, pa.int64())],
                ["doc_id", "file", "part", "first", "n_tokens"],
            )
            first += sum(counts)
        if writer is not None:
            writer.finish()
            stream.close()

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, "doc_id long, file string, part int, first long, n_tokens long"))


def read_ids(index: DataFrame, folder: str) -> DataFrame:
    """The index's rows with ids binary (little-endian unsigned 32-bit), from the files. Any subset of an index will do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids in _ranges(batches, folder):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], [*b.schema.names, "ids"])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in index.dtypes)
    return index.mapInArrow(run, f"{schema}, ids binary")


def _ranges(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    name, reader, file = None, None, None
    for whole in batches:
        for i in range(0, whole.num_rows, 1024):
            b = whole.slice(i, 1024)
            out = []
            for want, first, n in zip(b.column("file").to_pylist(), b.column("first").to_pylist(), b.column("n_tokens").to_pylist(), strict=True):
                if want != name:
                    if file:
                        file.close()
                    file = system.open_input_file(f"{path}/{want}")
                    name, reader = want, SeekReader(file, file.size())
                out.append(reader.read(4 * first, 4 * n))
            yield b, out
    if file:
        file.close()


def read_checksums(index: DataFrame, folder: str) -> DataFrame:
    """The index's rows with ids_crc32, computed from the files in the tasks that read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids in _ranges(batches, folder):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(zlib.crc32, ids), pa.int64())], [*b.schema.names, "ids_crc32"])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in index.dtypes)
    return index.mapInArrow(run, f"{schema}, ids_crc32 long")


def with_start(index: DataFrame) -> DataFrame:
    """The index with start: ids of all documents before. The running sum is over one row a file."""
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return index.join(bases, "part").withColumn("start", F.col("base") + F.col("first")).drop("base")


def file_digests(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = 0) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens (with the end id), ids_crc32."""
    folder = shared_dir(docs.sparkSession)
    index = write_files(docs, folder, vocabulary, end_id)
    return read_checksums(with_start(index), folder).select("doc_id", "start", "n_tokens", "ids_crc32")
