"""Per-packet steps: queue choice, policing, watchlist, counters.

A packet row has: ``window, teid, qfi, egress_qid, meter_color, packet_length, hop_latency_ns,
ingress_tstamp_ns`` and the total order ``ts_us, packet_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (
    COLOR_RED,
    DEFAULT_QUEUE,
    NON_TUNNEL_QUEUE,
    QFI_TO_QUEUE,
    REQUEUE_QUEUE,
)
from ..functions.fields import MASK32, qos_flow_index
from ..plans.slices import running_total
from ..session import small_side


def queue_map(packets: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add ``queue``: the class's queue, 7 for an unknown class, 4 for a packet without a tunnel.

    ``mapping`` is a table (qfi, qid); a null ``teid`` marks a packet outside any tunnel.
    """
    named = mapping.select("qfi", F.col("qid").alias("_mapped"))
    joined = packets.join(small_side(named), "qfi", "left")
    queue = F.when(F.col("teid").isNull(), NON_TUNNEL_QUEUE).otherwise(
        F.coalesce("_mapped", F.lit(DEFAULT_QUEUE))
    )
    return joined.withColumn("queue", queue.cast("int")).drop("_mapped")


def mapped_queue(qfi: Column, mapping: dict[int, int] | None = None) -> Column:
    """The class-to-queue map as an expression, for the built-in map of nine classes."""
    pairs = mapping or QFI_TO_QUEUE
    lookup = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, qfi.cast("int")), F.lit(DEFAULT_QUEUE))


def policing_action(color: Column) -> Column:
    """What policing does with a color: count, requeue, drop, or nothing."""
    return (
        F.when(color == 0, "count")
        .when(color.isin(1, 2), "requeue")
        .when(color == COLOR_RED, "drop")
        .otherwise("none")
    )


def police(packets: DataFrame, queue: str = "queue") -> DataFrame:
    """Add ``action``, the queue after policing (requeue wins over the class map) and ``dropped``."""
    action = policing_action(F.col("meter_color"))
    return packets.withColumns(
        {
            "action": action,
            "egress_qid": F.when(action == "requeue", REQUEUE_QUEUE).otherwise(F.col(queue)).cast("int"),
            "dropped": F.when(action == "drop", 1).otherwise(0),
        }
    )


def drop_running_count(packets: DataFrame, slice_us: int) -> DataFrame:
    """Drops seen so far per QoS flow index, in packet order.

    A busy flow is split into time slices of ``slice_us``.
    """
    indexed = packets.withColumn("flow_idx", qos_flow_index(F.col("teid"), F.col("qfi")))
    return running_total(
        indexed,
        ["flow_idx"],
        ["ts_us", "packet_id"],
        F.floor(F.col("ts_us") / slice_us),
        F.when(F.col("meter_color") == COLOR_RED, 1).otherwise(0),
        "drop_count",
    )


def queue_depth_filter(postcards: DataFrame, keep_all: bool = False) -> DataFrame:
    """Postcards taken while the queue held packets."""
    return postcards if keep_all else postcards.where(F.col("queue_depth") > 0)


def postcard_port_filter(frames: DataFrame, port: int = 4567) -> DataFrame:
    """IPv4 UDP frames sent to the collector's port."""
    return frames.where(
        (F.col("ether_type") == 0x0800) & (F.col("protocol") == 17) & (F.col("dst_port") == port)
    )


def first_entry(packets: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Add ``entry_id``: the first watchlist entry that a packet matches, null if there is none.

    Addresses and the protocol match exactly, ports under the entry's masks (0 = any). Of several entries that of the lowest ``priority``
    comes first (a missing one is 0), then that of the lowest id. Entries with the same masks form a table whose
    keys are the masked ports, so there is one equality join for each pair of masks in use, and a packet stays one row.
    """
    masks = ["src_port_mask", "dst_port_mask"]
    priority = F.coalesce("priority", F.lit(0)) if "priority" in watchlist.columns else F.lit(0)
    exact = ["src_addr", "dst_addr", "protocol"]
    keyed = watchlist.select(*exact, *masks, *[F.col(f"{p}_value").bitwiseAND(F.col(f"{p}_mask")).alias(f"_{p}") for p in ("src_port", "dst_port")], F.struct(priority.alias("priority"), "entry_id").alias("_entry"))
    found, hits = packets, []
    # The pairs of masks of a match table are few; each costs one join.
    for i, pair in enumerate(keyed.select(*masks).distinct().collect()):
        alike = F.lit(True)
        for m in masks:
            alike = alike & F.col(m).eqNullSafe(F.lit(pair[m]))
        table = keyed.where(alike).groupBy(*exact, "_src_port", "_dst_port").agg(F.min("_entry").alias(f"_hit{i}"))
        masked = {f"_{p}": F.col(p).bitwiseAND(F.lit(pair[f"{p}_mask"])) for p in ("src_port", "dst_port")}
        found = found.withColumns(masked).join(small_side(table), [*exact, "_src_port", "_dst_port"], "left").drop("_src_port", "_dst_port")
        hits.append(f"_hit{i}")
    if not hits:
        return packets.withColumn("entry_id", F.lit(None).cast(watchlist.schema["entry_id"].dataType))
    first = F.array_min(F.array(*hits))["entry_id"]
    return found.select(*packets.columns, first.alias("entry_id"))


def watchlist_filter(packets: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Packets that match an entry, with the one that counts them.

    Kept packets get their hop latency (32 bit) and the length without the 4-byte check sum.
    """
    matched = first_entry(packets, watchlist).where("entry_id IS NOT NULL")
    latency = (F.col("egress_tstamp_ns") - F.col("ingress_tstamp_ns")).bitwiseAND(F.lit(MASK32))
    return matched.withColumns(
        {"hop_latency": latency, "report_length": F.col("packet_length") - 4}
    )


def watchlist_counters(packets: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Packets and bytes per watchlist entry; an entry without a match counts 0.

    A packet counts for the first entry that it matches, and for no other.
    """
    hits = (
        first_entry(packets, watchlist)
        .where("entry_id IS NOT NULL")
        .groupBy("entry_id")
        .agg(F.count(F.lit(1)).alias("packets"), F.sum("packet_length").alias("bytes"))
    )
    zero = F.lit(0).cast("bigint")
    return watchlist.select("entry_id").join(hits, "entry_id", "left").select(
        "entry_id",
        F.coalesce("packets", zero).alias("packets"),
        F.coalesce("bytes", zero).alias("bytes"),
    )


# Values that ranges match have 16 bits. A queue's values fall into cells of this many.
CELL_VALUES = 256


def elementary_intervals(ranges: DataFrame) -> DataFrame:
    """Disjoint ranges (qid, lo, hi, bin) that match as the installed ones do.

    Where installed ranges overlap, that of the lowest ``priority`` matches (a missing one is 0), then that of the lowest ``lo``, ``hi`` and ``bin``. The ends of a
    queue's ranges are swept once, with the ranges that are open in a heap. A queue has at most 65,536 disjoint ranges.
    """
    priority = F.coalesce("priority", F.lit(0)) if "priority" in ranges.columns else F.lit(0)
    # Of ranges alike only the first can match.
    alike = ranges.where("lo <= hi").groupBy("qid", "lo", "hi").agg(F.min(F.struct(priority.alias("p"), "bin")).alias("_r"))
    narrow = alike.select("qid", F.col("lo").cast("bigint"), F.col("hi").cast("bigint"), F.col("_r.p").cast("bigint").alias("p"), F.col("_r.bin").cast("int").alias("bin"))

    def sweep(table):
        import heapq

        import pyarrow as pa

        lo, hi, p, bins = (table.column(c).to_pylist() for c in ("lo", "hi", "p", "bin"))
        rows = sorted(zip(lo, hi, p, bins, strict=True))
        bounds = sorted({*lo, *(h + 1 for h in hi)})
        out, opened, at = [], [], 0
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            while at < len(rows) and rows[at][0] <= begin:
                l, h, q, b = rows[at]
                heapq.heappush(opened, (q, l, h, b))
                at += 1
            while opened and opened[0][2] < begin:
                heapq.heappop(opened)
            if opened:
                out.append((begin, end - 1, opened[0][3]))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        n = len(columns[0])
        arrays = [pa.array([table.column("qid")[0].as_py()] * n, pa.int32()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True))]
        return pa.Table.from_arrays(arrays, ["qid", "lo", "hi", "bin"])

    return narrow.withColumn("qid", F.col("qid").cast("int")).groupBy("qid").applyInArrow(sweep, "qid int, lo bigint, hi bigint, bin int")


def range_bin(values: DataFrame, ranges: DataFrame, value: str, miss: int, name: str) -> DataFrame:
    """Bin of a 16-bit value by a table of installed ranges (qid, lo, hi, bin, and ``priority`` if they overlap); ``miss`` when none fits.

    Disjoint ranges are cut at multiples of 256, and those of one cell become a short array. A packet meets its cell in an equality join and
    finds its range by binary search, however many a queue has.
    """
    cell = F.explode(F.expr(f"sequence(lo DIV {CELL_VALUES}, hi DIV {CELL_VALUES})")).alias("_cell")
    # No other values exist, so wider ranges are cut to them.
    inside = F.greatest("lo", F.lit(0)).alias("lo"), F.least("hi", F.lit(0xFFFF)).alias("hi")
    swept = elementary_intervals(ranges).select("qid", *inside, "bin").where("lo <= hi")
    pieces = swept.select(F.col("qid").alias("_qid"), cell, "lo", "hi", "bin")
    cells = pieces.groupBy("_qid", "_cell").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "bin"))).alias("_ranges"))
    keyed = values.withColumns({"_qid": F.col("qid").cast("int"), "_cell": F.expr(f"CAST(floor({value} / {CELL_VALUES}) AS BIGINT)")})
    joined = keyed.join(small_side(cells), ["_qid", "_cell"], "left")
    # How many ranges of the cell begin at or before the value, by halving steps.
    steps = f"array({', '.join(str(CELL_VALUES >> i) for i in range(9))})"
    more = f"n + s <= size(_ranges) AND get(_ranges, n + s - 1).lo <= {value}"
    before = F.expr(f"get(_ranges, aggregate({steps}, 0, (n, s) -> IF({more}, n + s, n)) - 1)")
    hit = F.when(before["hi"] >= F.col(value), before["bin"])
    return joined.withColumn(name, F.coalesce(hit, F.lit(miss)).cast("int")).select(*values.columns, name)
