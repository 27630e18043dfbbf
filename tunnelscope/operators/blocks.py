"""Sketches as dense register blocks: one row per (window, queue) with one array per measure.

A cell is looked up by its place ``row * width + bucket``, so a flow meets its block once and reads ``depth`` entries of each array.
Nothing is copied per hash row and no flow is grouped again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SketchGeometry
from ..functions.hashing import flow_bucket
from ..session import small_side
from .minquery import FLOW_KEY, clean_flow_keys

BLOCK = ["window", "qid"]


def dense_blocks(sketch: DataFrame, geometry: SketchGeometry, run: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of a sketch from ``clean_sketch``, which holds each cell once. Cells that are not in it count 0.

    Cells outside the geometry belong to no flow and are left out. A block has ``depth * width`` entries per measure, whatever the traffic.
    """
    size = geometry.depth * geometry.width
    inside = F.col("row").between(0, geometry.depth - 1) & F.col("bucket").between(0, geometry.width - 1)
    place = (F.col("row") * geometry.width + F.col("bucket")).cast("int").alias("place")
    cell = F.struct(place, *[F.col(m) for m in geometry.measures])
    listed = sketch.where(inside).groupBy(*run, *BLOCK).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    zero = f"named_struct('place', -1, {', '.join(f'{m!r}, 0L' for m in geometry.measures)})"
    # A dump of all registers has every cell; only others need zeros in the gaps between cells.
    before = "IF(i = 0, -1, cells[i - 1].place)"
    filled = f"flatten(transform(cells, (x, i) -> concat(array_repeat({zero}, x.place - {before} - 1), array(x))))"
    tail = f"array_repeat({zero}, {size - 1} - element_at(cells, -1).place)"
    full = listed.withColumn("cells", F.expr(f"IF(size(cells) = {size}, cells, concat({filled}, {tail}))"))
    return full.select(*run, *BLOCK, *[F.col(f"cells.{m}").alias(m) for m in geometry.measures])


def block_query(
    blocks: DataFrame,
    keys: DataFrame,
    geometry: SketchGeometry,
    copies: int = 1,
    slice_windows: int = 4096,
    buckets: int | None = None,
    range_windows: int | None = None,
    run: tuple[str, ...] = (),
) -> DataFrame:
    """Estimate of every measure for every flow, as ``min_query``: the least of ``depth`` entries of its block.

    Flows and blocks are shuffled once each, by (window, queue), and repeated keys go in the same place. Where a queue holds most flows, ``copies``
    deals its flows to as many tasks by hash, and each gets the block. ``blocks`` stored by ``windows.save_blocks`` in ``buckets`` are
    not shuffled, as flows are dealt to as many; with ``range_windows``, only files of window ranges that have keys are read.
    """
    deal = F.pmod(F.xxhash64("teid", "qfi"), F.lit(copies)).cast("int").alias("part")
    valid = clean_flow_keys(keys, run).where("valid").select(*run, *FLOW_KEY, deal)
    on = [*run, *BLOCK, *(["part"] if copies > 1 else [])]
    dealt = valid.repartition(buckets, *on) if buckets else valid.repartition(*on)
    flows = dealt.dropDuplicates([*run, *FLOW_KEY, "part"])
    if range_windows:
        ranges = valid.select(F.floor(F.col("window") / range_windows).alias("window_range")).distinct()
        blocks = blocks.join(small_side(ranges), "window_range", "left_semi").drop("window_range")
    if copies > 1:
        blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    else:
        flows = flows.drop("part")
    places = {f"_at{r}": flow_bucket("teid", "qfi", str(r), geometry) + r * geometry.width for r in range(geometry.depth)}
    found = flows.withColumns(places).join(blocks, on, "left")

    def least(m: str) -> str:
        reads = ", ".join(f"get({m}, _at{r})" for r in range(geometry.depth))
        return f"coalesce(array_min(array({reads})), 0L) AS {m}"

    sliced = F.floor(F.col("window") / slice_windows).cast("int").alias("slice")
    return found.select(sliced, *run, *FLOW_KEY, *[F.expr(least(m)) for m in geometry.measures])
