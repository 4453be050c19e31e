"""Writers that leave exact bytes or whole tables in the shared folder."""

from __future__ import annotations

import gzip
import hashlib
import json
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame


class _Counted:
    """A file of pyarrow's that is written through, with its size and digest so far."""

    def __init__(self, out):
        self.out, self.size, self.digest = out, 0, hashlib.sha256()

    def write(self, data: bytes) -> int:
        self.out.write(data)
        self.size += len(data)
        self.digest.update(data)
        return len(data)

    def flush(self) -> None:
        pass


def _written(rows: Iterator[dict], folder: str, name: str) -> dict:
    """Rows as one file, written through, so that no more than a buffer is held."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    n = 0
    with system.open_output_stream(f"{path}/{name}", compression=None) as file:
        counted = _Counted(file)
        with gzip.GzipFile(filename="", fileobj=counted, mode="wb", mtime=0) as out:
            for row in rows:
                out.write(json.dumps(row, sort_keys=True, default=str).encode() + b"\n")
                n += 1
    return {"file": name, "records": n, "bytes": counted.size, "sha256": counted.digest.hexdigest()}


def gzip_json_lines(df: DataFrame, folder: str, columns: list[str]) -> DataFrame:
    """Each partition as one gzip file of JSON lines with sorted keys and no time in its header, so equal rows give equal bytes.

    Returns file, records, bytes, sha256 of each. A file is written under its task's attempt and named in the result only
    once it is whole. Write the result down before reading it twice: each evaluation writes anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in b.to_pylist())
        first = next(rows, None)
        if first is not None:
            task = TaskContext.get()
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.jsonl.gz"
            yield pa.RecordBatch.from_pylist([_written(chain([first], rows), folder, name)])

    return df.select(*columns).mapInArrow(run, "file string, records long, bytes long, sha256 string")


def part_files(df: DataFrame, folder: str, columns: list[str], keys: list[str], order: str) -> DataFrame:
    """One such file for the rows of each value of keys, in the given order; keys, with records, bytes and sha256 of each."""
    kinds = [df.schema[k] for k in keys]
    schema = ", ".join(f"{k.name} {k.dataType.simpleString()}" for k in kinds) + ", file string, records long, bytes long, sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in b.to_pylist())
        task = TaskContext.get()
        for own, part in groupby(rows, lambda r: tuple(r[k] for k in keys)):
            name = "-".join(map(str, own)) + f"-{task.taskAttemptId()}.jsonl.gz"
            made = _written(({c: r[c] for c in columns} for r in part), folder, name)
            yield pa.RecordBatch.from_pylist([dict(zip(keys, own, strict=True)) | made])

    needed = list(dict.fromkeys([*keys, order, *columns]))
    return df.select(*needed).repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)
