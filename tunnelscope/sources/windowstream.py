"""Window files as a stream in the order of their numbers.

The offset of the stream is a window number: a batch holds the files of the next windows by number, whatever the order or time they were written
in, and a restarted stream goes on behind the last window of its progress folder. Rows are (window, path), one per file, so the
driver handles names only and each batch is read by the plans of batch runs. A window is complete when its file is there; a file
whose window the stream has passed is late and stays out (``late_files``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import IntegerType, StructType

from ..functions.fields import WINDOW_FILE_PATTERN
from .recordfiles import file_system
from .windows import window_files

NAME = "window_files"
SCHEMA = "window int, path string"
_WINDOW = re.compile(WINDOW_FILE_PATTERN)


class WindowFileReader(SimpleDataSourceStreamReader):
    def __init__(self, folder: str, windows: int):
        self.folder, self.windows = folder, windows

    def _between(self, after: int, upto: int | None) -> list[tuple[int, str]]:
        from pyarrow import fs

        system, root = file_system(self.folder)
        scheme = self.folder.split(":", 1)[0] + "://" if "://" in self.folder else "file://"
        host = self.folder.split("://", 1)[1].split("/", 1)[0] if scheme != "file://" else ""
        found = []
        for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            below = f.path[len(root.rstrip("/")) :]
            named = _WINDOW.search(below) if f.is_file and not re.search(r"/[._]", below) else None
            if named and after < int(named[1]) and (upto is None or int(named[1]) <= upto):
                found.append((int(named[1]), f"{scheme}{host}{f.path}"))
        return sorted(found)

    def initialOffset(self) -> dict:
        return {"window": -1}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """Files of the next windows, and the last of them."""
        found = self._between(start["window"], None)
        numbers = sorted({w for w, _ in found})[: self.windows]
        if not numbers:
            return iter([]), start
        return iter([f for f in found if f[0] <= numbers[-1]]), {"window": numbers[-1]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._between(start["window"], end["window"]))

    def commit(self, end: dict) -> None:
        pass


class WindowFiles(DataSource):
    """Options: the path, and ``windows``, the number of windows of a batch."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> WindowFileReader:
        return WindowFileReader(self.options["path"], int(self.options.get("windows", 60)))


def read_window_stream(spark: SparkSession, folder: str, windows: int = 60) -> DataFrame:
    """Files (window, path) of the next ``windows`` windows in each batch."""
    spark.dataSource.register(WindowFiles)
    return spark.readStream.format(NAME).option("windows", windows).load(folder)


def late_files(spark: SparkSession, folder: str, processed: DataFrame) -> DataFrame:
    """Files whose windows lie at or before the last ``processed`` window without being one of them."""
    last = processed.select("window").groupBy().max("window").scalar()
    files = window_files(spark, folder)
    return files.where(files["window"] <= last).join(processed.select("window"), "window", "left_anti")


def read_rows(files: DataFrame, schema: StructType, partitions: int) -> DataFrame:
    """Rows of parquet files (window, path) with the file's window before the columns of ``schema``, for streams and tables.

    Files are read where the rows are wanted, one row group at a time. Columns that a file lacks are null, others are cast.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for window, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = file_system(path)
                with system.open_input_file(name) as f:
                    found = pq.ParquetFile(f)
                    kept = [c for c in target.names if c in found.schema_arrow.names]
                    for part in found.iter_batches(columns=kept):
                        columns = [part.column(c).cast(t) if c in kept else pa.nulls(part.num_rows, t) for c, t in zip(target.names, target.types, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array([window] * part.num_rows, pa.int32()), *columns], ["window", *target.names])

    out = StructType().add("window", IntegerType())
    for field in schema.fields:
        out = out.add(field)
    return files.select("window", "path").repartition(partitions, "window").mapInArrow(run, out)
