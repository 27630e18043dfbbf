"""Files of packed 42-byte records as a data source: split at record boundaries, read and written in Arrow batches.

    spark.dataSource.register(RecordFiles)
    cards = spark.read.format("packed_records").load(folder)
    cards.write.format("packed_records").mode("append").save(folder)

A file is cut into ranges of whole records, so one large file is read by many tasks; a range is viewed as an array of records
and handed on by column, without an object per record. Paths are those that Arrow's file systems know (local and mounted ones, HDFS,
S3, GCS). What is left behind the last whole record of a file is not read. A value beyond a signed 64-bit integer wraps.

A written file appears in the folder when the whole write is committed; files of tasks that failed or ran twice are removed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StructField, StructType

from .postcards import RECORD_BYTES, RECORD_FIELDS

NAME = "packed_records"
# Records of a range (about 84 MB) and of a batch.
RANGE_RECORDS = 2_000_000
BATCH_RECORDS = 65_536
_STAGING = "_staging-"

RECORD = np.dtype([(name, f"<u{size}") for name, size in RECORD_FIELDS])
SCHEMA = StructType([StructField(name, LongType()) for name, _ in RECORD_FIELDS])


def file_system(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


@dataclass
class Range(InputPartition):
    path: str
    first: int
    records: int


@dataclass
class Written(WriterCommitMessage):
    staged: str
    name: str


class RecordReader(DataSourceReader):
    def __init__(self, path: str, range_records: int):
        self.path, self.range_records = path, range_records

    def partitions(self) -> list[Range]:
        """Ranges of the file or of all files below a folder; hidden names are left out, as Spark does."""
        from pyarrow import fs

        system, root = file_system(self.path)
        found = system.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted((f for f in files if f.is_file), key=lambda f: f.path):
            below = f.path[len(root.rstrip("/")) :]
            if any(part[:1] in ("_", ".") for part in below.split("/")):
                continue
            n = f.size // RECORD_BYTES
            out += [Range(f.path, at, min(self.range_records, n - at)) for at in range(0, n, self.range_records)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as f:
            f.seek(partition.first * RECORD_BYTES)
            left = partition.records
            while left:
                n = min(left, BATCH_RECORDS)
                records = np.frombuffer(f.read(n * RECORD_BYTES), RECORD)
                if len(records) != n:
                    raise OSError(f"{partition.path} became shorter while it was read")
                yield pa.RecordBatch.from_arrays([pa.array(records[c].astype(np.int64)) for c in RECORD.names], list(RECORD.names))
                left -= n


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        if overwrite:
            raise ValueError("record files are only added to")
        self.path, self.staging = path, f"{_STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        staging, name = f"{root}/{self.staging}", f"part-{uuid.uuid4().hex}.bin"
        system.create_dir(staging, recursive=True)
        with system.open_output_stream(f"{staging}/{name}") as f:
            for batch in iterator:
                records = np.empty(batch.num_rows, RECORD)
                for c in RECORD.names:
                    records[c] = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                f.write(records.tobytes())
        return Written(self.staging, name)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        for m in messages:
            if m:
                system.move(f"{root}/{m.staged}/{m.name}", f"{root}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = file_system(self.path)
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


class RecordFiles(DataSource):
    """Options: the path, and ``rangerecords``, records of a range."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options["path"], int(self.options.get("rangerecords", RANGE_RECORDS)))

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], overwrite)


def read_records(spark: SparkSession, path: str, range_records: int = RANGE_RECORDS) -> DataFrame:
    """Postcards of packed record files."""
    spark.dataSource.register(RecordFiles)
    return spark.read.format(NAME).option("rangerecords", range_records).load(path)


def write_records(cards: DataFrame, path: str) -> None:
    """Adds files of packed records. Nulls are not allowed, and values keep as many bits as their field has."""
    cards.sparkSession.dataSource.register(RecordFiles)
    cards.select(*RECORD.names).write.format(NAME).mode("append").save(path)
