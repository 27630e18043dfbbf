"""Causal features per QoS class over its observed windows, the current one included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (
    EWMA_ALPHA,
    EWMA_UNIT,
    EWMA_UNITS,
    RUN_CAP,
    RUN_THRESHOLD,
    Z_LONG_ROWS,
    Z_SHORT_ROWS,
    PipelineConfig,
)
from ..functions import series
from ..plans.slices import history_blocks, running_total

# The inputs of the model.
ROLL_KEYS = [
    "qfi_bw_total",
    "qfi_yellow_bw_share",
    "qfi_red_bw_share",
    "qfi_teid_hhi",
    "qfi_teid_top1_share",
    "feat_lat_p95_ms",
]
Z_KEYS = ["qfi_bw_total", "qfi_yellow_bw_share", "feat_lat_p95_ms"]


def base_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(("feat_", "qfi_"))]


def with_history(
    classes: DataFrame, config: PipelineConfig, base: list[str], keys: list[str], known: str | None = None
) -> DataFrame:
    """Add ``_recent``, the last rows of each row, and ``_ewma``, the exponential averages of the rolled columns.

    ``_recent`` is an array of rows, a row being the array of the ``base`` columns. One frame
    replaces a window function per feature, and a feature is one expression over short arrays, however many
    columns it is computed for. A class's series is cut into blocks that carry their history.
    """
    slices = F.floor(F.col("window") / config.slice_windows)
    averaged = with_averages(classes, keys, [c for c in ROLL_KEYS if c in base], slices, known)
    blocks = history_blocks(averaged, keys, "window", slices, config.block_rows, Z_LONG_ROWS + RUN_CAP, "_rn")
    order = Window.partitionBy(*keys, "_block").orderBy("window")
    frame = order.rowsBetween(1 - Z_LONG_ROWS, 0)
    return blocks.withColumn("_recent", F.collect_list(F.array(*base)).over(frame))


def with_averages(
    classes: DataFrame, keys: list[str], names: list[str], slices: Column, known: str | None = None
) -> DataFrame:
    """Add ``_ewma``, the exponential average of each of ``names`` over the whole series so far, as an array, and ``_rn``, the row's place.

    A step of the average is a linear map, so a unit of rows is one too, and the units before it hand on one number per
    column. That number is stepped through the last unit before, as are the rows of a unit, so results have the digits that a
    step per row gives. The first row of a series starts at its value.

    ``known`` names a column with the averages of rows of an earlier run, null for new rows, which are later; their series go on from there.
    """
    if known:
        earlier = classes.where(F.col(known).isNotNull()).withColumnRenamed(known, "_ewma")
        ended = earlier.groupBy(*keys).agg(F.max_by("_ewma", "window").alias("_from"), F.count(F.lit(1)).alias("_places"))
        fresh = classes.where(F.col(known).isNull()).drop(known).join(ended, keys, "left")
        found = _averaged(fresh, keys, names, slices).withColumn("_rn", F.col("_rn") + F.coalesce("_places", F.lit(0)))
        placed = earlier.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("window")).cast("bigint"))
        return found.drop("_from", "_places").unionByName(placed)
    none = F.lit(None).cast("array<double>")
    return _averaged(classes.withColumn("_from", none), keys, names, slices).drop("_from")


def _averaged(classes: DataFrame, keys: list[str], names: list[str], slices: Column) -> DataFrame:
    """``with_averages`` of rows with ``_from``, the averages before the first of them (null: none)."""
    keep = 1 - EWMA_ALPHA
    row = F.array(*[F.col(c).cast("double") for c in names]) if names else F.array().cast("array<double>")
    ranked = running_total(classes, keys, ["window"], slices, F.lit(1), "_rn")
    place = (F.col("_rn") - 1) % EWMA_UNIT
    ranked = ranked.withColumns({"_unit": F.floor((F.col("_rn") - 1) / EWMA_UNIT), "_place": place, "_row": row})
    # The sum that a whole unit adds, each row weighted by the steps after it; the first row of all has no share of 0.3.
    first = (F.col("_rn") == 1) & F.col("_from").isNull()
    weight = F.when(first, F.lit(1.0)).otherwise(EWMA_ALPHA) * F.pow(F.lit(keep), EWMA_UNIT - 1 - F.col("_place"))
    units = ranked.groupBy(*keys, "_unit").agg(
        F.array(*[F.sum(weight * F.col("_row")[i]) for i in range(len(names))]).alias("_sums"),
        F.sort_array(F.collect_list(F.struct("_place", "_row"))).alias("_rows"),
        F.any_value("_from").alias("_from"),
    )
    earlier = Window.partitionBy(*keys).orderBy("_unit").rowsBetween(-EWMA_UNITS, -1)
    units = units.withColumn("_before", F.collect_list("_sums").over(earlier))

    def stepped(rows: str, start: str, value: str, i: int) -> str:
        step = f"IF(acc IS NULL, {value}[{i}], {EWMA_ALPHA!r}D * {value}[{i}] + {keep!r}D * acc)"
        return f"aggregate({rows}, {start}, (acc, r) -> {step})"

    def whole(i: int) -> str:
        # What lies before all units counts where all units do.
        begin = f"IF(size(_before) = _unit, coalesce(_from[{i}], 0D), 0D)"
        jump = f"aggregate(_before, {begin}, (acc, u) -> acc * {keep**EWMA_UNIT!r}D + u[{i}])"
        return f"IF(_unit = 0, _from[{i}], {jump})"

    def each(text: Callable[[int], str]) -> Column:
        return F.expr(f"array({', '.join(text(i) for i in range(len(names)))})")

    ends = units.withColumn("_end", each(lambda i: stepped("_rows", whole(i), "r._row", i)))
    last = F.lag("_end").over(Window.partitionBy(*keys).orderBy("_unit"))
    carried = ends.select(*keys, "_unit", F.coalesce(last, "_from").alias("_start"))
    inside = Window.partitionBy(*keys, "_unit").orderBy("window").rowsBetween(Window.unboundedPreceding, 0)
    out = ranked.withColumn("_so_far", F.collect_list("_row").over(inside)).join(carried, [*keys, "_unit"])
    averages = each(lambda i: stepped("_so_far", f"_start[{i}]", "r", i))
    return out.withColumn("_ewma", averages).drop("_unit", "_place", "_row", "_so_far", "_start")


def _per_column(names: list[str], columns: list[str], feature: Callable[[str], str]) -> Column:
    """Array of ``feature`` for each of ``names``, given its position ``p`` in ``columns``."""
    positions = ", ".join(str(columns.index(n)) for n in names)
    return F.expr(f"transform(array({positions}), p -> {feature('p')})")


def _past(rows: str, position: str) -> str:
    return f"transform({rows}, row -> get(row, {position}))"


def z_scores(names: list[str], base: list[str], rows: int) -> Column:
    """Robust z-score of the current value against the last ``rows`` rows, per column."""
    now = f"array({', '.join(base)})"

    def feature(position: str) -> str:
        past = series.finite_only(_past("_recent", position))
        return series.robust_z(past, f"get({now}, {position})", rows)

    return _per_column(names, base, feature)


ROLL_FEATURES: dict[str, Callable[[str], str]] = {
    "roll3_med": lambda past: series.median(series.last_rows(past, 3)),
    "roll5_med": lambda past: series.median(series.last_rows(past, 5)),
    "roll9_med": lambda past: series.median(series.last_rows(past, 9)),
    "roll5_max": lambda past: f"array_max({series.last_rows(past, 5)})",
    "roll5_std": lambda past: series.std_pop(series.last_rows(past, 5)),
    "delta": lambda past: f"coalesce(get({past}, size({past}) - 1) - get({past}, size({past}) - 2), 0D)",
    "slope5": lambda past: series.slope(series.last_rows(past, 5)),
}


def roll_features(names: list[str], base: list[str]) -> Column:
    """Rolling medians, maximum, deviation, delta and slope: one struct per column."""

    def all_features(past: str) -> str:
        return f"named_struct({', '.join(f'{n!r}, {fn(past)}' for n, fn in ROLL_FEATURES.items())})"

    return _per_column(names, base, lambda p: series.bind(_past("_recent", p), all_features))


def high_runs(history: DataFrame, z: dict[str, str], keys: list[str]) -> DataFrame:
    """Add, per name, the length of the run of rows up to this one whose z-score is high; capped."""
    frame = (
        Window.partitionBy(*keys, "_block").orderBy("window").rowsBetween(1 - RUN_CAP, 0)
    )
    flags = {n: F.collect_list(F.expr(f"{c} >= {RUN_THRESHOLD}D")).over(frame) for n, c in z.items()}
    flagged = history.withColumns(flags)
    return flagged.withColumns({n: F.expr(series.trailing_run(n)) for n in z})


# Rows before a row that its features look at, but for the averages.
HISTORY_ROWS = Z_LONG_ROWS + RUN_CAP


def engineer(
    classes: DataFrame, config: PipelineConfig, keys: list[str] | None = None, known: str | None = None
) -> DataFrame:
    """All engineered features: 22 base columns, their z-scores, 48 rolling and 12 z features.

    ``keys`` names the series: ``["qfi"]``, or with a switch or run id before it. ``classes`` is
    read twice: pass a table written with ``session.cut``. ``known`` names a column with the averages of rows of an earlier run
    (``averages_of``), of which the last ``HISTORY_ROWS`` of each series are enough.
    """
    keys = keys or ["qfi"]
    base = base_columns(classes)
    history = with_history(classes, config, base, keys, known)
    scored = history.withColumn("_z", z_scores(base, base, Z_LONG_ROWS))
    long_z = {n: f"get(_z, {base.index(n)})" for n in Z_KEYS}
    runs = high_runs(scored, {f"_run_{n}": z for n, z in long_z.items()}, keys)
    own = runs.where(~F.col("_history")).withColumns(
        {
            "_zs": z_scores(Z_KEYS, base, Z_SHORT_ROWS),
            "_roll": roll_features(ROLL_KEYS, base),
        }
    )
    out = {f"rz_{n}": f"get(_z, {i})" for i, n in enumerate(base)}
    for i, name in enumerate(ROLL_KEYS):
        out.update({f"{f}_{name}": f"get(_roll, {i}).{f}" for f in ROLL_FEATURES})
        out[f"ewma_{name}"] = f"get(_ewma, {i})"
    for i, name in enumerate(Z_KEYS):
        out[f"zS_{name}"] = f"get(_zs, {i})"
        out[f"zL_{name}"] = long_z[name]
        out[f"deltaSL_{name}"] = f"get(_zs, {i}) - {long_z[name]}"
        out[f"runlen_hi_{name}"] = f"CAST(_run_{name} AS DOUBLE)"
    return own.selectExpr("window", *keys, *base, *[f"{text} AS {n}" for n, text in out.items()])


def averages_of(engineered: DataFrame) -> Column:
    """The averages of a row, for a later run."""
    return F.array(*[F.col(f"ewma_{name}") for name in ROLL_KEYS])
