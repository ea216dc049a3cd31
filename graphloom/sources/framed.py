"""Framed binary logs as a data source: records of (length, payload, checksum) (OP-S8 to OP-S11, OP-K1, OP-K2)."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from fnmatch import fnmatch

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.sources.files import list_files
from graphloom.store import materialize

#: Fixed value: how a log of proofs begins, and its version.
MAGIC, VERSION = b"GLOG", 1


def frame(payload: bytes) -> bytes:
    return struct.pack("<I", len(payload)) + payload + struct.pack("<I", zlib.crc32(payload))


def frames(data: bytes) -> Iterator[tuple[int, int, bytes, bool]]:
    """(seq, offset, payload, intact) of a file's records; a torn last one is not intact and ends it."""
    at, seq = 0, 0
    while at + 4 <= len(data):
        (n,) = struct.unpack_from("<I", data, at)
        payload = data[at + 4 : at + 4 + n]
        whole = at + 8 + n <= len(data)
        yield seq, at, payload, whole and struct.unpack_from("<I", data, at + 4 + n)[0] == zlib.crc32(payload)
        if not whole:
            return
        at, seq = at + 8 + n, seq + 1


#: Bytes of a file that one task reads.
STRETCH = 64 << 20


def _stretches(path: str, header: bool, stretch: int) -> Iterator[tuple[int, int, int, int]]:
    """(first seq, records, start, end) of a file's stretches, from its records' lengths alone; payloads are passed over.

    A torn record at the end counts and ends its stretch with the file.
    """
    system, inside = fs.FileSystem.from_uri(path)
    with system.open_input_file(inside) as f:
        size, at = f.size(), 0
        if header:
            head = f.read(len(MAGIC) + 1)
            if head != MAGIC + bytes([VERSION]):
                raise ValueError(f"{path} is no log of version {VERSION}")
            at = len(head)
        first, seq, start = 0, 0, at
        while at + 4 <= size:
            f.seek(at)
            at = min(size, at + 8 + struct.unpack("<I", f.read(4))[0])
            seq += 1
            if at - start >= stretch:
                yield first, seq - first, start, at
                first, start = seq, at
        if seq > first:
            yield first, seq - first, start, at


def _records(path: str, first: int, start: int, end: int) -> Iterator[tuple[int, int, bytes, bool]]:
    """(seq, offset, payload, intact) of a stretch's records."""
    system, inside = fs.FileSystem.from_uri(path)
    with system.open_input_file(inside) as f:
        f.seek(start)
        data = f.read(end - start)
    for seq, at, payload, ok in frames(data):
        yield first + seq, start + at, payload, ok


def index_frames(spark: SparkSession, path: str, header: bool = False, stretch: int = STRETCH) -> DataFrame:
    """(path, first, records, start, end): stretches of framed files that tasks can read apart (OP-S9).

    One pass a file over its records' lengths, so a file of any size is an index of a row for each 64 MB. With a header,
    a file must begin with the magic and the version, or the read fails. Files are those that pyarrow's file systems reach.
    """
    found = spark.createDataFrame([(p,) for p, _ in list_files(spark, path)], "path string")

    def run(batches):
        for pdf in batches:
            rows = [(p, *r) for p in pdf["path"] for r in _stretches(p, header, stretch)]
            yield pd.DataFrame(rows, columns=["path", "first", "records", "start", "end"])

    return found.repartition("path").mapInPandas(run, "path string, first long, records long, start long, end long")


def read_frames(spark: SparkSession, path: str, header: bool = False, stretch: int = STRETCH) -> DataFrame:
    """(path, seq, offset, payload, ok) of framed files, a file by as many tasks as it has stretches (OP-S8, OP-S11)."""
    index = index_frames(spark, path, header, stretch)

    def run(batches):
        for pdf in batches:
            for p, first, start, end in zip(pdf["path"], pdf["first"], pdf["start"], pdf["end"], strict=True):
                yield pd.DataFrame([(p, *r) for r in _records(p, first, start, end)], columns=["path", "seq", "offset", "payload", "ok"])

    return index.repartition("path", "start").mapInPandas(run, "path string, seq long, offset long, payload binary, ok boolean")


def write_frames(rows: DataFrame, folder: str, header: bool = False) -> DataFrame:
    """Append rows (payload) to framed files, one for each partition, and return (path, records) (OP-K1, OP-K2).

    Tasks write through pyarrow's file systems. A task that runs again writes another file; the list names those that count.
    """

    def run(batches):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        name, n = f"log-{uuid.uuid4().hex}", 0
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(MAGIC + bytes([VERSION]) if header else b"")
            for pdf in batches:
                for payload in pdf["payload"]:
                    out.write(frame(bytes(payload)))
                n += len(pdf)
        yield pd.DataFrame([(f"{folder}/{name}", n)], columns=["path", "records"])

    return materialize(rows.select(F.col("payload").cast("binary").alias("payload")).mapInPandas(run, "path string, records long"), "logs")


def root_header(slots: DataFrame) -> DataFrame:
    """(log, generation, root): of each log's header slots (log, generation, root, crc) the intact one of the last generation (OP-K2).

    Two slots are written in turn, so that a torn write leaves the one before it. A slot's checksum is over its generation and root.
    """
    whole = F.concat_ws(":", F.col("generation").cast("string"), "root")
    best = slots.where(F.crc32(whole.cast("binary")) == F.col("crc")).groupBy("log").agg(F.max(F.struct("generation", "root")).alias("s"))
    return best.select("log", "s.generation", "s.root")


def intact(records: DataFrame) -> DataFrame:
    """Records before the first broken one of their file (OP-S10)."""
    from graphloom.operators.versions import valid_prefix

    return valid_prefix(records, "path", "seq", F.col("ok"))


def count_frames(spark: SparkSession, path: str, header: bool = False) -> int:
    """Records of framed files, by their lengths; no payload is read (OP-S9)."""
    return index_frames(spark, path, header).agg(F.sum("records")).first()[0] or 0


class FramedLog(DataSource):
    """`spark.read.format("framed_log").load(path)`: a partition for each stretch of the files of a path or glob (OP-S8)."""

    @classmethod
    def name(cls) -> str:
        return "framed_log"

    def schema(self) -> str:
        return "path string, seq long, offset long, payload binary, ok boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.stretch = options.get("path"), int(options.get("stretch", STRETCH))

    def partitions(self) -> list[InputPartition]:
        system, inside = fs.FileSystem.from_uri(self.path.partition("*")[0].rpartition("/")[0] or "/") if "*" in self.path else fs.FileSystem.from_uri(self.path)
        scheme = self.path[: self.path.find("://") + 3] if "://" in self.path else ""
        info = system.get_file_info(inside)
        found = system.get_file_info(fs.FileSelector(inside)) if info.type == fs.FileType.Directory else [info]
        paths = sorted(scheme + f.path for f in found if f.type == fs.FileType.File and ("*" not in self.path or fnmatch(scheme + f.path, self.path)))
        return [InputPartition((p, first, start, end)) for p in paths for first, _, start, end in _stretches(p, False, self.stretch)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, first, start, end = partition.value
        for record in _records(path, first, start, end):
            yield path, *record
