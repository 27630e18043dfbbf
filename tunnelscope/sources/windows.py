"""Per-window files: sketch snapshots (parquet), flow keys (CSV), and the events they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SketchGeometry
from ..functions.fields import window_number
from ..operators.minquery import clean_flow_keys, clean_sketch
from ..schemas import EVENT_SCHEMA, FLOW_KEY_SCHEMA

# Spark hides the name of a file it reads in this metadata field.
FILE_PATH = "_metadata.file_path"


def bin_columns(columns: list[str], prefix: str) -> list[str]:
    """Histogram columns ``lat0, lat1, …`` in numeric order (``lat10`` after ``lat2``)."""
    suffix = {c: c[len(prefix) :] for c in columns if c.startswith(prefix)}
    odd = [c for c, s in suffix.items() if not s.isdigit()]
    if odd:
        raise ValueError(f"columns {odd} start with {prefix!r} but are not bins")
    return sorted(suffix, key=lambda c: int(suffix[c]))


def folded(df: DataFrame) -> DataFrame:
    """Bin columns as the arrays ``lat`` and ``iat``."""
    arrays = {p: bin_columns(df.columns, p) for p in ("lat", "iat")}
    return df.withColumns({p: F.array(*cols) for p, cols in arrays.items()}).drop(
        *arrays["lat"], *arrays["iat"]
    )


def geometry_of(df: DataFrame, depth: int, width: int) -> SketchGeometry:
    """Sketch shape with the bin counts found in a snapshot's columns."""
    counts = {p: len(bin_columns(df.columns, p)) for p in ("lat", "iat")}
    return SketchGeometry(depth, width, counts["lat"], counts["iat"])


def run_of(path: Column, run: str | None) -> dict[str, Column]:
    """The column ``run``: the first group of the pattern ``run`` in a path. None if there is no pattern."""
    return {} if run is None else {"run": F.regexp_extract(path, run, 1)}


def read_sketch(spark: SparkSession, folder: str, geometry: SketchGeometry | None = None, run: str | None = None) -> DataFrame:
    """All snapshots of a folder; the window number comes from the file name.

    Where the folder holds those of several devices or recordings, ``run`` is a pattern whose first group tells them apart in the path.

    Columns may be of any numeric type or text, and files may differ in both columns and types: the schema is merged from all
    footers. ``position`` is the place of a row in its window.
    """
    try:
        groups = [_merged(spark, [folder])]
    except Exception as e:
        if not _types_differ(e):
            raise
        files = window_files(spark, folder).orderBy("window", "path").collect()  # one row per file
        groups = _groups(spark, [r.path for r in files])
    return _snapshots(groups, geometry, run)


def _merged(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(*paths)


def _types_differ(e: Exception) -> bool:
    """Whether Spark could not merge schemas as a column has several types."""
    return "CANNOT_MERGE_SCHEMAS" in str(e) or "CANNOT_MERGE_INCOMPATIBLE_DATA_TYPE" in str(e)


def _groups(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """Scans that together read all ``paths``, each of files whose columns have the same types.

    Halves are tried until they merge: types mostly change at some window. What fits together is one scan again.
    """
    found: list[tuple[dict, list[str]]] = []
    todo = [paths]
    while todo:
        part = todo.pop()
        try:
            types = {f.name.lower(): f.dataType for f in _merged(spark, part).schema}
        except Exception as e:
            if len(part) == 1 or not _types_differ(e):
                raise
            todo += [part[len(part) // 2 :], part[: len(part) // 2]]
            continue
        for known, own in found:
            if all(known.get(c, t) == t for c, t in types.items()):
                known.update(types)
                own += part
                break
        else:
            found.append((types, part))
    return [_merged(spark, own) for _, own in found]


def _snapshots(groups: list[DataFrame], geometry: SketchGeometry | None, run: str | None = None) -> DataFrame:
    """Each group cleaned by its own types, and all of them as one table."""
    columns = list(dict.fromkeys(c for g in groups for c in g.columns))
    keys = [c for c in ("qid", "row", "bucket") if c in columns]
    if geometry is None:
        nothing = groups[0].sparkSession.createDataFrame([], ", ".join(f"`{c}` int" for c in columns))
        geometry = geometry_of(nothing, 1, 1)
    out = None
    for raw in groups:
        # A key that other files have is bad here, as it is in a merged scan.
        full = raw.withColumns({c: F.lit(None).cast("bigint") for c in keys if c not in raw.columns})
        numbered = full.withColumns(
            {
                "window": window_number(F.col(FILE_PATH)),
                "position": F.struct(FILE_PATH, F.col("_metadata.row_index")),
                **run_of(F.col(FILE_PATH), run),
            }
        )
        clean = clean_sketch(numbered.where(F.col("window") >= 0), geometry, ("run",) if run else ())
        out = clean if out is None else out.unionByName(clean)
    return out


def window_files(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshot files (path, window) of a folder, from a listing: no file is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return listed.select("path", window_number(F.col("path")).alias("window")).where(F.col("window") >= 0)


def read_first_windows(
    spark: SparkSession, folder: str, n: int, geometry: SketchGeometry | None = None
) -> DataFrame:
    """Snapshots of the first ``n`` windows by number; only their files are scanned. 0 keeps all."""
    if n <= 0:
        return read_sketch(spark, folder, geometry)
    files = window_files(spark, folder)
    first = files.select("window").distinct().orderBy("window").limit(n)
    # Files of n windows.
    paths = [r.path for r in files.join(first, "window", "left_semi").collect()]
    if not paths:
        raise ValueError(f"{folder} has no snapshots")
    return read_files(spark, paths, geometry)


def read_files(spark: SparkSession, paths: list[str], geometry: SketchGeometry | None = None) -> DataFrame:
    """Snapshots of the given files, which may differ in columns and types."""
    try:
        groups = [_merged(spark, paths)]
    except Exception as e:
        if not _types_differ(e):
            raise
        groups = _groups(spark, sorted(paths))
    return _snapshots(groups, geometry)


def read_flow_keys(spark: SparkSession, folder: str, run: str | None = None) -> DataFrame:
    """All flow-key files of a folder; malformed keys are -1 and marked not ``valid``. ``run`` as for ``read_sketch``."""
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("header", True)
        .schema(FLOW_KEY_SCHEMA)
        .csv(folder)
    )
    numbered = raw.withColumns({"window": window_number(F.col(FILE_PATH)), **run_of(F.col(FILE_PATH), run)})
    return clean_flow_keys(numbered.where(F.col("window") >= 0), ("run",) if run else ())


def _file_name(extension: str) -> Column:
    return F.concat(F.lit("window_"), F.col("window"), F.lit(f".{extension}"))


def write_sketch(sketch: DataFrame, folder: str) -> None:
    """One ``window_<n>.parquet`` entry per window."""
    named = sketch.withColumn("file", _file_name("parquet")).drop("window")
    named.repartition("file").write.partitionBy("file").parquet(folder)


def write_flow_keys(keys: DataFrame, folder: str) -> None:
    """One ``window_<n>.csv`` entry per window."""
    named = keys.select("teid", "qfi", "qid", _file_name("csv").alias("file"))
    named.repartition("file").write.partitionBy("file").option("header", True).csv(folder)


def save_compacted(sketch: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Many snapshot files as one table, bucketed by cell.

    Flow queries on such a table do not shuffle it again, and read a few large files.
    """
    cell = ["window", "qid", "row", "bucket"]
    writer = sketch.repartition(buckets, *cell).write.bucketBy(buckets, *cell).sortBy(*cell)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def save_blocks(blocks: DataFrame, table: str, buckets: int, range_windows: int, path: str | None = None) -> None:
    """Register blocks as a table: a folder per ``range_windows`` windows, bucketed by (window, queue) in each.

    ``blocks.block_query`` joins it without a shuffle of the blocks and skips the folders of ranges that have no keys.
    """
    ranged = blocks.withColumn("window_range", F.floor(F.col("window") / range_windows))
    writer = ranged.repartition(buckets, "window", "qid").write.partitionBy("window_range").bucketBy(buckets, "window", "qid").sortBy("window", "qid")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def duplicate_cells(sketch: DataFrame) -> DataFrame:
    """Cells that a snapshot holds more than once; a register dump has none."""
    cell = ["window", "qid", "row", "bucket"]
    return sketch.groupBy(*cell).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def last_copy(sketch: DataFrame, position: str, run: tuple[str, ...] = ()) -> DataFrame:
    """Keep the copy of each cell with the highest ``position`` in its file; the column goes."""
    cell = [*run, "window", "qid", "row", "bucket"]
    rest = [c for c in sketch.columns if c not in (*cell, position)]
    return (
        sketch.groupBy(*cell)
        .agg(F.max_by(F.struct(*rest), position).alias("_row"))
        .select(*cell, "_row.*")
    )


def first_windows(df: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` windows by number; 0 keeps all."""
    if n <= 0:
        return df
    first = df.select("window").distinct().orderBy("window").limit(n)
    return df.where(F.col("window") <= first.select(F.max("window")).scalar())


def paired(keys: DataFrame, sketch: DataFrame, run: tuple[str, ...] = ()) -> DataFrame:
    """Flow keys of windows that have a snapshot."""
    on = [*run, "window"]
    return keys.join(sketch.select(*on).distinct(), on, "left_semi")


def write_events(events: DataFrame, folder: str) -> None:
    """Events as JSON lines."""
    events.select(*EVENT_SCHEMA.fieldNames()).write.json(folder)


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).json(folder)
