"""One named query per operator, over the given tables.

``packets`` are derived from ``events`` (see ``plans.standin``). Doubles are rounded at the very end
so that another engine's summation order cannot show.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..config import COLOR_RED, QFI_TO_QUEUE
from ..functions import fields, hashing
from ..functions import histogram as H
from ..operators import alarms, blocks, classes, minquery, quality, rates, rolling, scoring, sketch, tunnels
from ..operators import packets as pk
from ..plans import detection
from ..plans import standin as S
from ..plans.slices import previous_value
from ..session import cut, scratch_path
from ..sources import frames, injections, postcards, recordfiles, registers, settings, windows, windowstream
from ..streaming import detect as stream_detection
from ..streaming import episodes as stream_episodes_
from ..streaming import thresholds as stream_limits
from ..streaming.stats import stream_stats

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
CONFIG = S.CONFIG
# Buckets and windows per folder of the stored table of blocks, and windows per batch of a stream.
BUCKETS, RANGE_WINDOWS = 8, 16
WINDOWS_PER_BATCH = 30
GEOMETRY = CONFIG.geometry


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, decimals: int = 9) -> DataFrame:
    """All doubles rounded for output."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: fields.fixed(c, decimals) for c in doubles})


# --- light inputs --------------------------------------------------------------------------------


def exact_tunnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True counters per (window, class, tunnel), straight from the packets."""
    red = F.col("meter_color") == COLOR_RED
    green = F.col("meter_color") == 0
    return (
        S.packets(spark, sf_dir)
        .groupBy("window", "qfi", "teid")
        .agg(
            F.count_if(~red).cast("bigint").alias("pkt_cnt"),
            F.sum(F.when(red, 0).otherwise(F.col("packet_length"))).alias("byte_cnt"),
            F.count_if(green).cast("bigint").alias("green_cnt"),
            F.count_if(~green & ~red).cast("bigint").alias("yellow_cnt"),
            F.count_if(red).cast("bigint").alias("drop_cnt"),
        )
    )


def exact_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traffic and color features of exact counters."""
    counted = exact_tunnels(spark, sf_dir)
    all_pkts = tunnels.color_packets()
    rate = tunnels.traffic_rates(CONFIG)
    return counted.join(tunnels.class_color_totals(counted), ["window", "qfi"]).select(
        "window",
        "qfi",
        "teid",
        *[c.alias(n) for n, c in rate.items()],
        (F.col("yellow_cnt") / all_pkts).alias("feat_yellow_frac"),
        (F.col("drop_cnt") / all_pkts).alias("feat_red_frac"),
        (all_pkts / F.col("class_pkts")).alias("feat_teid_share"),
        F.col("active_teids").alias("feat_qfi_teid_count"),
    )


def exact_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency bins per (window, class) of all packets."""
    edges = F.array(*[F.lit(float(e)) for e in S.LAT_EDGES])
    value = fields.latency_q16(F.col("hop_latency_ns"))
    sent = S.packets(spark, sf_dir).withColumns({"v": value, "edges": edges})
    binned = sent.withColumn("b", F.expr(H.bin_index("v", "edges", len(S.LAT_EDGES))))
    counts = [F.count_if(F.col("b") == i).cast("bigint") for i in range(len(S.LAT_EDGES) + 1)]
    return (
        binned.groupBy("window", "qfi")
        .agg(F.array(*counts).alias("counts"))
        .withColumn("edges", edges)
    )


def class_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value per (window, class): its bytes. Written once, as series plans read twice."""
    series_ = S.packets(spark, sf_dir).groupBy("window", "qfi").agg(
        F.sum("packet_length").cast("double").alias("qfi_bw_total")
    )
    return cut(series_, "series")


def series_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class series with the last rows of each row, own rows only."""
    data = class_series(spark, sf_dir)
    return rolling.with_history(data, CONFIG, ["qfi_bw_total"], ["qfi"]).where("not _history")


def scored_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score from the packets' colors, with thresholds and decisions."""
    weight = F.sum(F.when(F.col("meter_color") == 0, 0).when(F.col("meter_color") == 1, 1).otherwise(3))
    raw = S.packets(spark, sf_dir).groupBy("window", "qfi").agg(
        (weight / F.count(F.lit(1))).alias("score")
    )
    return scoring.decide(raw.withColumn("score", F.least("score", F.lit(1.0))), CONFIG)


def light_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debounced events of the color score, written once."""
    data = cut(scored_series(spark, sf_dir), "scored")
    return cut(alarms.debounce(data, CONFIG.debounce_k, CONFIG.debounce_h), "events")


def light_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alarms.episodes(light_events(spark, sf_dir))


# --- sources and sinks ---------------------------------------------------------------------------


@query
def scan_sketch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = sketch.build(S.packets(spark, sf_dir), S.BINS, GEOMETRY, S.SLICE_US)
    folder = scratch_path(spark, "cms")
    windows.write_sketch(built, folder)
    return windows.read_sketch(spark, folder, GEOMETRY).drop("position")


@query
def scan_wide_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of twelve latency bins, their columns in no order: bins are found in the files and put in the order of their numbers."""
    geometry = replace(GEOMETRY, lat_bins=12)
    edges = settings.same_bins([*S.LAT_EDGES, *(32000 + 4000 * i for i in range(1, 5))], S.IAT_EDGES, 8)
    built = sketch.latency_histogram(S.packets(spark, sf_dir), edges, geometry)
    shuffled = [f"lat{i}" for i in (10, 2, 11, 1, 0, 9, 3, 8, 4, 7, 5, 6)]
    folder = scratch_path(spark, "wide")
    windows.write_sketch(built.select("window", "qid", "row", "bucket", *shuffled, F.lit(0).alias("iat0")), folder)
    cells = windows.folded(windows.read_sketch(spark, folder))
    return cells.select("window", "qid", "row", "bucket", F.array_join(F.col("lat").cast("array<string>"), ",").alias("lat"))


@query
def scan_flow_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "keys")
    windows.write_flow_keys(S.keys(spark, sf_dir), folder)
    return windows.read_flow_keys(spark, folder).where("valid").drop("valid")


@query
def window_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.read(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    path = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("/data/window_"), n, F.lit(".parquet")))
        .when(F.col("event_type") == "error", F.concat(F.lit("Window_"), n, F.lit(".CSV")))
        .when(F.col("event_type") == "view", F.concat(F.lit("window_"), n, F.lit(".json")))
        .otherwise(F.concat(F.lit("window_"), n))
    )
    return events.select("event_id", fields.window_number(path).alias("window"))


@query
def validate_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1)
    short = F.col("event_type") == "error"
    lat = F.concat_ws(
        ",", F.col("user_id").cast("string"), k, F.when(~short, F.col("event_id").cast("string"))
    )
    qid = F.when(F.col("event_type") == "signup", F.concat(F.lit("q"), k)).otherwise(k)
    text = F.concat(
        F.lit('{"bins":{"'), qid, F.lit('":{"latency_us":['), lat, F.lit('],"iat_us":['),
        F.col("user_id").cast("string"), F.lit(","), k, F.lit("]}}}"),
    )
    parsed = S.read(spark, sf_dir, "events").select(settings.bins_from_json(text).alias("cfg"))
    table = settings.bins_table(parsed.select("cfg.bins"))
    found = settings.bin_problems(table)
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query
def bundle_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The third class has no key, so it falls back to the global threshold.
    text = F.concat(
        F.lit('{"feat_cols":["a"],"thr_global":0.5,"thr_map":{"1":'), F.col("value"),
        F.lit(',"2":0.55},"debounce":{"k":2,"h":0.8}}'),
    )
    parsed = S.read(spark, sf_dir, "events").select(
        "event_id", settings.bundle_from_json(text).alias("b")
    )
    mapped = F.try_element_at("b.thr_map", (F.col("event_id") % 3 + 1).cast("string"))
    return parsed.select(
        "event_id",
        (F.col("event_id") % 3 + 1).alias("qfi"),
        F.coalesce(mapped, "b.thr_global").alias("thr"),
        F.col("b.debounce.k").alias("k"),
        F.col("b.debounce.h").alias("h"),
    )


def _postcard_fields() -> dict[str, Column]:
    return {
        "switch_id": F.lit(1),
        "hop_latency": F.col("hop_latency_ns").bitwiseAND(F.lit(fields.MASK32)),
        "egress_qid": F.col("egress_qid"),
        "queue_depth": F.col("packet_length") % 7 * (F.col("packet_id") % 3),
        "egress_port": F.col("packet_id") % 512,
        "ingress_port": F.col("packet_length") % 512,
        "teid": F.col("teid") + 4294960000,
        "qfi": F.col("qfi"),
        "meter_color": F.col("meter_color"),
        "packet_length": F.col("packet_length"),
        "drop_count": F.col("packet_id") * 400_000 % 4294967296,
        "sw_timestamp_ns": F.col("ingress_tstamp_ns"),
        "host_timestamp_ns": F.col("ts_us") * 1000,
    }


@query
def postcard_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = postcards.encode_wire(_postcard_fields())
    # Some payloads are cut one byte short and must disappear.
    cut_short = F.when(F.col("packet_id") % 50 == 7, F.substring(wire, 1, 30)).otherwise(wire)
    sent = S.packets(spark, sf_dir).select("packet_id", cut_short.alias("payload"))
    return postcards.decode_wire(cut(sent, "wire"))


@query
def postcard_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = postcards.encode_record(_postcard_fields())
    stored = S.packets(spark, sf_dir).select("packet_id", record.alias("record"))
    return postcards.decode_records(cut(stored, "records"))


@query
def postcard_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of packed records, written and read by ranges of 1,000 records."""
    folder = scratch_path(spark, "record-files")
    recordfiles.write_records(S.packets(spark, sf_dir).select(*[c.cast("bigint").alias(n) for n, c in _postcard_fields().items()]), folder)
    return recordfiles.read_records(spark, folder, 1_000)


@query
def postcard_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("packet_id") % 20 == 3, F.lit("[Pcap] pkts=1 drops=0 freeze=0")).otherwise(
        postcards.log_line(_postcard_fields())
    )
    lines = S.packets(spark, sf_dir).select("packet_id", line.alias("value"))
    return postcards.parse_log(cut(lines, "log"))


@query
def gtpu_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    teid, qfi = F.col("teid") + 4294960000, F.col("qfi") + 64
    zeros = {n: F.lit("00" * n) for n in (2, 4, 6, 8, 12)}
    ip = F.concat(F.lit("45"), zeros[8], F.when(qfi == 67, "06").otherwise("11"), zeros[2],
                  F.lit("c0a82c0d"), F.lit("c0a82c12"))
    port = F.when(qfi == 68, F.lit("0035")).otherwise(F.lit("0868"))
    l4 = F.concat(F.lit("1f41"), port, zeros[4])
    flags = F.when(qfi == 66, F.lit("30")).otherwise(F.lit("34"))
    tunnel = F.concat(flags, F.lit("ff"), zeros[2], fields.hex_be(teid, 4))
    session = F.concat(zeros[2], F.lit("00"), F.lit("85"), F.lit("01"), F.lit("10"),
                       fields.hex_be(qfi, 1), F.lit("00"))
    ether = F.concat(zeros[12], F.when(qfi == 69, F.lit("0806")).otherwise(F.lit("0800")))
    frame = F.unhex(F.concat(ether, ip, l4, tunnel, session))
    sent = S.packets(spark, sf_dir).select("packet_id", frame.alias("frame"))
    return frames.decode_frames(sent).select("packet_id", "protocol", "dst_port", "teid", "qfi")


def _injection_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of one injector run per event: text, a start, a broken line, and a stop."""
    n = F.col("event_id")
    hex_id = fields.teid_to_hex(F.col("user_id") + 1)
    other = fields.teid_to_hex(F.col("user_id") + 4096)
    start_ns = S.micros("ts") * 1000
    actors = F.concat(
        F.lit(',"actors":{"qfi":'), F.col("user_id") % 9 + 1, F.lit(',"teids":["'), hex_id,
        F.lit('","'), other, F.lit('"]}}'),
    )
    abuse = F.concat(
        F.lit(',"scenario":"policy_abuse","victims":[{"teid":"'), hex_id,
        F.lit('","victim_qfi":5,"fake_qfi":4},{"teid":"'), other,
        F.lit('","victim_qfi":'), F.col("user_id") % 9 + 1, F.lit(',"fake_qfi":6}]}'),
    )
    is_abuse = F.col("event_type") == "purchase"
    start = F.concat(
        F.lit('{"event":"'), F.when(is_abuse, "teid_impersonation").otherwise("start"),
        F.lit('","episode_id":"ep'), n, F.lit('","ts_ns":'), start_ns,
        # Every eleventh log names no class: the one asked for counts.
        F.when(n % 11 == 0, F.regexp_replace(F.when(is_abuse, abuse).otherwise(actors), r'"(?:victim_)?qfi":\d+,', "")).otherwise(
            F.when(is_abuse, abuse).otherwise(actors)
        ),
    )
    stop = F.concat(
        F.lit('  {"event":"'), F.when(is_abuse, "teid_impersonation_end").otherwise("stop"),
        F.lit('","episode_id":"ep'), n, F.lit('","ts_ns":'),
        start_ns + F.col("user_id") * 1_000_000, F.lit("}"),
    )
    lines = F.array(
        F.lit("[injector] starting"), start, F.lit('{"event":"start","ts_ns":'), F.lit('["start"]'),
        F.when(F.col("event_type") != "view", stop),
    )
    return S.read(spark, sf_dir, "events").select(
        F.concat(F.lit("run_"), n, F.lit(".log")).alias("source"),
        F.lit(0).alias("block"),
        (F.col("user_id") % 5 + 20).alias("duration_s"),
        (F.col("user_id") % 3 + 1).alias("requested_qfi"),
        F.when(F.col("event_type") == "signup", n % 2).otherwise(0).alias("rc"),
        F.posexplode(F.array_compact(lines)).alias("line_no", "value"),
    )


@query
def injection_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = injections.parse_log(_injection_lines(spark, sf_dir))
    return parsed.select(
        "source",
        "event",
        "episode_id",
        "ts_ns",
        F.col("actors.qfi").alias("qfi"),
        F.array_join("actors.teids", ",").alias("teids"),
        F.array_join(F.transform("victims", lambda v: v["teid"]), ",").alias("victims"),
    )


def _labels(kind: str, events: list[str], episode: str) -> Query:
    def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = injections.parse_log(_injection_lines(spark, sf_dir))
        labelled = injections.label_episodes(
            log.where(F.col("event").isin(events)), kind, [episode], offset_ms=5, params=["duration_s"]
        )
        return labelled.select(
            "anomaly_type",
            episode,
            "start_ns",
            "end_ns",
            F.array_join("qfis", ",").alias("qfis"),
            F.array_join("teids", ",").alias("teids"),
            "params",
        )

    return labels


REGISTRY["episode_labels"] = _labels("congestion", ["start", "stop"], "episode_id")
REGISTRY["episode_labels_burst"] = _labels("microburst", ["start", "stop"], "source")
REGISTRY["episode_labels_abuse"] = _labels(
    "policy_abuse", ["teid_impersonation", "teid_impersonation_end"], "source"
)


@query
def register_nonzero_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = sketch.colors(S.packets(spark, sf_dir), GEOMETRY)
    index = fields.namespaced_bucket(F.col("bucket"), F.col("qid"), GEOMETRY.width)
    dump = (
        cells.where(F.col("row") == 0)
        .groupBy(index.cast("int").alias("index"))
        .agg(F.sum("green_cnt").alias("green"), F.sum("yellow_cnt").alias("yellow"))
    )
    return registers.top_entries(dump, ["green", "yellow"], 20).select("index", "value", "total")


@query
def register_dump_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All non-zero pairs of a register, written as CSV and read back."""
    cells = sketch.colors(S.packets(spark, sf_dir), GEOMETRY).where(F.col("row") == 1)
    index = fields.namespaced_bucket(F.col("bucket"), F.col("qid"), GEOMETRY.width)
    dump = cells.groupBy(index.cast("int").alias("index")).agg(F.sum("green_cnt").alias("green"), F.sum("yellow_cnt").alias("yellow"))
    folder = scratch_path(spark, "dump")
    registers.write_dump(dump, ["green", "yellow"], folder)
    return registers.read_dump(spark, folder, ["green", "yellow"])


# --- packets -------------------------------------------------------------------------------------


@query
def distinct_flow_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = S.packets(spark, sf_dir).select(
        "window", "teid", "qfi", F.col("egress_qid").alias("qid")
    )
    return minquery.distinct_flow_keys(keys)


@query
def clean_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = (
        F.when(F.col("event_type") == "click", F.lit("n/a"))
        .when(F.col("event_type") == "error", F.lit("NaN"))
        .when(F.col("event_type") == "view", F.lit("Infinity"))
        .when(F.col("event_id") % 10 == 3, F.concat(F.col("event_id"), F.lit("d")))
        .when(F.col("event_id") % 10 == 4, (F.lit(9_007_199_254_740_993) + F.col("event_id")).cast("string"))
        .otherwise(F.col("value").cast("string"))
    )
    return S.read(spark, sf_dir, "events").select(
        "event_id",
        fields.numeric_or(odd, -1).alias("key"),
        fields.finite_or_zero(fields.text_number(odd)).alias("feature"),
    )


@query
def postcard_qdepth_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = S.packets(spark, sf_dir).select(
        "packet_id", _postcard_fields()["queue_depth"].alias("queue_depth"), "packet_length"
    )
    return pk.queue_depth_filter(cards)


@query
def postcard_port_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = S.packets(spark, sf_dir).select(
        "packet_id",
        F.when(F.col("qfi") == 5, 0x0806).otherwise(0x0800).alias("ether_type"),
        F.when(F.col("qfi") == 3, 6).otherwise(17).alias("protocol"),
        F.when(F.col("packet_id") % 2 == 0, 4567).otherwise(2152).alias("dst_port"),
    )
    return pk.postcard_port_filter(headers).select("packet_id", "dst_port")


def _watched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Packets with addresses, and a watchlist made of the packets of one tunnel and class."""
    sent = S.packets(spark, sf_dir).select(
        "packet_id",
        (F.col("teid") + 3232246784).alias("src_addr"),
        (F.col("qfi") + 3232246800).cast("bigint").alias("dst_addr"),
        F.lit(17).alias("protocol"),
        (F.col("packet_id") % 65536).alias("src_port"),
        (F.col("packet_length") % 4096).alias("dst_port"),
        "packet_length",
        "ingress_tstamp_ns",
        (F.col("ingress_tstamp_ns") + F.col("hop_latency_ns")).alias("egress_tstamp_ns"),
    )
    entries = spark.range(6).select(
        F.col("id").alias("entry_id"),
        (F.col("id") + 3232246784).alias("src_addr"),
        (F.col("id") % 5 + 3232246801).alias("dst_addr"),
        F.lit(17).alias("protocol"),
        (F.col("id") * 3).alias("src_port_value"),
        F.when(F.col("id") % 2 == 0, 0).otherwise(3).cast("bigint").alias("src_port_mask"),
        (F.col("id") * 16).alias("dst_port_value"),
        F.when(F.col("id") < 4, 0).otherwise(0x10).cast("bigint").alias("dst_port_mask"),
    )
    return sent, entries


@query
def watchlist_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent, entries = _watched(spark, sf_dir)
    return pk.watchlist_filter(sent, entries).select("packet_id", "hop_latency", "report_length")


@query
def watchlist_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pk.watchlist_counters(*_watched(spark, sf_dir))


@query
def watchlist_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five entries per packet under different masks, which overlap: each packet counts for the first it matches."""
    sent, _ = _watched(spark, sf_dir)
    some = sent.select("packet_id", "src_addr", "dst_addr", "protocol", "src_port", "dst_port", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("v"))

    def mask(*values: int) -> Column:
        return F.get(F.array(*[F.lit(v).cast("bigint") for v in values]), F.col("v"))

    entries = some.select(
        (F.col("packet_id") * 5 + F.col("v")).alias("entry_id"),
        *("src_addr", "dst_addr", "protocol"),
        F.col("src_port").alias("src_port_value"),
        mask(0xFFFF, 0xFF00, 0, 0xFFFF, 0).alias("src_port_mask"),
        F.col("dst_port").alias("dst_port_value"),
        mask(0xFFFF, 0xFFFF, 0xFFF0, 0, 0).alias("dst_port_mask"),
        ((F.col("packet_id") * 7919 + F.col("v") * 104729) % 1000).alias("priority"),
    )
    return pk.watchlist_counters(sent, cut(entries, "entries"))


@query
def range_bin_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range per line item, dealt to six queues: ten thousand overlapping ranges a queue at the third scale factor."""
    line, order = F.col("l_linenumber").cast("bigint"), F.col("l_orderkey").cast("bigint")
    low = (order * 131 + line * 7919) % 60_000
    ranges = S.read(spark, sf_dir, "lineitem").select(
        ((order + line) % 6).cast("int").alias("qid"),
        low.alias("lo"),
        (low + F.col("l_quantity").cast("bigint") * 20).alias("hi"),
        (line % 8).cast("int").alias("bin"),
        (F.col("l_partkey") % 1000).cast("bigint").alias("priority"),
    )
    values = S.packets(spark, sf_dir).select(
        "packet_id", F.col("egress_qid").alias("qid"), fields.latency_q16(F.col("hop_latency_ns")).alias("v")
    )
    return pk.range_bin(values, ranges, "v", 7, "lat_bin").select("packet_id", "lat_bin")


@query
def quantised_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    tick = fields.switch_tick(F.col("ingress_tstamp_ns"))
    bucket = F.col("packet_id") % 512
    return S.packets(spark, sf_dir).select(
        "packet_id",
        fields.latency_q16(F.col("hop_latency_ns") * 1000).alias("lat_q16"),
        fields.iat_q16(tick, F.col("packet_id") * 1000).alias("iat_q16"),
        fields.qos_flow_index(F.col("packet_id") + 4000, F.col("qfi") + 12).alias("flow_idx"),
        fields.namespaced_bucket(bucket, F.col("packet_length") % 11, 512).alias("bucket_qidx"),
    )


@query
def hist_binning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_histograms(spark, sf_dir).select(
        "window", "qfi", *[F.get("counts", F.lit(i)).alias(f"lat{i}") for i in range(8)]
    )


@query
def range_bin_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Installed for queues 0 to 5 only, with a gap under 500: both lead to misses.
    edges = [*S.LAT_EDGES, 65536]
    ranges = spark.range(6).select(
        F.col("id").cast("int").alias("qid"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(lo).cast("bigint").alias("lo"),
                        F.lit(hi - 1).cast("bigint").alias("hi"),
                        F.lit(i + 1).alias("bin"),
                    )
                    for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
                ]
            )
        ),
    )
    values = S.packets(spark, sf_dir).select(
        "packet_id",
        F.col("egress_qid").alias("qid"),
        fields.latency_q16(F.col("hop_latency_ns")).alias("v"),
    )
    lat = pk.range_bin(values, ranges, "v", 7, "lat_bin")
    return pk.range_bin(lat, ranges, "v", 0, "iat_bin").select("packet_id", "lat_bin", "iat_bin")


@query
def qfi_queue_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.range(1).select(
        F.explode(F.create_map(*[F.lit(x) for p in QFI_TO_QUEUE.items() for x in p])).alias(
            "qfi", "qid"
        )
    )
    sent = S.packets(spark, sf_dir).select(
        "packet_id",
        F.when(F.col("teid") == 7, None).otherwise(F.col("teid")).alias("teid"),
        (F.col("qfi") + F.col("packet_id") % 8).cast("int").alias("qfi"),
    )
    return pk.queue_map(sent, mapping)


@query
def policing_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = S.packets(spark, sf_dir).select(
        "packet_id",
        (F.col("packet_length") % 5).cast("int").alias("meter_color"),
        pk.mapped_queue(F.col("qfi")).alias("queue"),
    )
    return pk.police(sent)


@query
def drop_running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = S.packets(spark, sf_dir).select("packet_id", "ts_us", "teid", "qfi", "meter_color")
    return pk.drop_running_count(sent, S.SLICE_US).select("packet_id", "flow_idx", "drop_count")


@query
def port_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = S.packets(spark, sf_dir).withColumn("dev_port", F.col("packet_id") % 16)
    return rates.port_totals(sent, "dev_port")


@query
def counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_window = S.packets(spark, sf_dir).groupBy(F.col("qfi").alias("iface"), "window").agg(
        F.sum("packet_length").alias("bytes"), F.count(F.lit(1)).alias("packets")
    )
    samples = cut(per_window.withColumn("interval_s", F.lit(1)), "samples")
    rated = rates.counter_rates(samples, ["iface"], ["window"], F.floor(F.col("window") / 32))
    return rated.select("iface", "window", "mbps", "gbps", "pkts")


# --- sketches ------------------------------------------------------------------------------------


@query
def sketch_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.traffic(S.packets(spark, sf_dir), GEOMETRY)


@query
def sketch_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.colors(S.packets(spark, sf_dir), GEOMETRY)


@query
def sketch_lat_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.latency_histogram(S.packets(spark, sf_dir), S.BINS, GEOMETRY)


@query
def sketch_iat_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.iat_histogram(S.packets(spark, sf_dir), S.BINS, GEOMETRY, S.SLICE_US)


@query
def iat_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = sketch.bucket_gaps(S.packets(spark, sf_dir), GEOMETRY, S.SLICE_US)
    return gaps.select("packet_id", "qid", "row", "bucket", "iat")


@query
def sketch_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.traffic(S.lineitem_packets(spark, sf_dir), GEOMETRY)


@query
def cms_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = S.packets(spark, sf_dir).select("teid", "qfi").distinct()
    rows = flows.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(3))))
    args = "teid", "qfi", "row"
    return rows.select(
        "teid",
        "qfi",
        "row",
        F.lower(F.expr(hashing.flow_key_hex("teid", "qfi"))).alias("key_hex"),
        hashing.flow_crc(*args).alias("crc"),
        hashing.cms_bucket(*args, 512).alias("bucket"),
    )


@query
def cms_min_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = S.sketch(spark, sf_dir)
    return minquery.min_query(built, S.keys(spark, sf_dir), GEOMETRY).drop("slice")


@query
def cms_block_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The min query over register blocks, flows of a queue dealt to four tasks."""
    built = blocks.dense_blocks(S.sketch(spark, sf_dir), GEOMETRY)
    return blocks.block_query(built, S.keys(spark, sf_dir), GEOMETRY, copies=4).drop("slice")


@query
def cms_stored_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The min query over a stored table of blocks, for the flows of class 2 in windows 10 to 49: other ranges are not read."""
    table, built = f"blocks_{uuid.uuid4().hex}", blocks.dense_blocks(S.sketch(spark, sf_dir), GEOMETRY)
    windows.save_blocks(built, table, BUCKETS, RANGE_WINDOWS, scratch_path(spark, "blocks"))
    some = S.keys(spark, sf_dir).where("qfi = 2 AND window BETWEEN 10 AND 49")
    found = blocks.block_query(spark.table(table), some, GEOMETRY, buckets=BUCKETS, range_windows=RANGE_WINDOWS)
    return found.drop("slice")


@query
def switch_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The switch's own addressing of all flows."""
    flows = S.packets(spark, sf_dir).select("teid", "qfi").distinct()
    rows = flows.withColumn("row", F.expr("explode(sequence(0, 2))"))
    args = ("teid", "qfi", "row")
    return rows.select(*args, hashing.switch_crc(*args).cast("int").alias("crc"), hashing.switch_bucket(*args, 512).alias("bucket"))


@query
def switch_min_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sketch addressed as by the switch, and the min query on it."""
    geometry = replace(GEOMETRY, hashing="switch")
    built = cut(sketch.build(S.packets(spark, sf_dir), S.BINS, geometry, S.SLICE_US), "sketch")
    return blocks.block_query(blocks.dense_blocks(built, geometry), S.keys(spark, sf_dir), geometry).drop("slice")


@query
def window_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Snapshots exist for windows with a forwarded packet of class 1, tunnel 3.
    sent = S.packets(spark, sf_dir)
    snapshots = sent.where("qfi = 1 and teid = 3 and meter_color <> 3").select("window")
    return windows.paired(S.keys(spark, sf_dir), snapshots)


@query
def first_n_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = sketch.traffic(S.packets(spark, sf_dir), GEOMETRY)
    return windows.first_windows(cells, 20)


# --- histograms ----------------------------------------------------------------------------------


def _hist(**outputs: Callable[[str, str], str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = exact_histograms(spark, sf_dir)
        columns = [F.expr(fn("counts", "edges")).alias(n) for n, fn in outputs.items()]
        return rounded(data.select("window", "qfi", *columns))

    return run


REGISTRY["hist_quantile"] = _hist(
    p10=lambda c, e: H.quantile(c, e, 0.10),
    p50=lambda c, e: H.quantile(c, e, 0.50),
    p95=lambda c, e: H.quantile(c, e, 0.95),
)
REGISTRY["hist_tail_head"] = _hist(
    tail=lambda c, e: H.tail_fraction(c, 2), head=lambda c, e: H.head_fraction(c, 2)
)
REGISTRY["hist_exceed"] = _hist(
    cold=lambda c, e: H.exceed_fraction(c, e, "0D"),
    mid=lambda c, e: H.exceed_fraction(c, e, "3000D"),
    top=lambda c, e: H.exceed_fraction(c, e, "40000D"),
)
REGISTRY["hist_below"] = _hist(
    cold=lambda c, e: H.below_fraction(c, e, "0D"),
    mid=lambda c, e: H.below_fraction(c, e, "3000D"),
    top=lambda c, e: H.below_fraction(c, e, "40000D"),
)


# --- tunnel and class features -------------------------------------------------------------------


@query
def active_teids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tunnels.class_color_totals(exact_tunnels(spark, sf_dir))


@query
def teid_traffic_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = tunnels.traffic_rates(CONFIG)
    counted = exact_tunnels(spark, sf_dir)
    return rounded(
        counted.select("window", "qfi", "teid", *[c.alias(n) for n, c in rate.items()]), 12
    )


@query
def teid_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = exact_features(spark, sf_dir)
    return rounded(
        features.select(
            "window", "qfi", "teid", "feat_teid_share", "feat_yellow_frac", "feat_red_frac"
        )
    )


def _limit_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.packets(spark, sf_dir).groupBy("window", "qfi", "teid").agg(
        (F.max("hop_latency_ns") / 1e6).alias("lat_p95_ms"),
        F.min("packet_length").cast("double").alias("iat_p10_us"),
    )


@query
def rolling_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tunnels.rolling_thresholds(cut(_limit_inputs(spark, sf_dir), "tunnels"), CONFIG)
    return rounded(found.select("window", "qfi", "teid", "thr_lat_ms", "thr_iat_us"))


@query
def teid_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = S.sketch(spark, sf_dir)
    table = detection.tunnel_table(built, S.keys(spark, sf_dir), S.BINS, CONFIG)
    return rounded(tunnels.tunnel_features(table, CONFIG))


def _light_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes.aggregate_classes(cut(exact_features(spark, sf_dir), "features"))


@query
def qfi_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["feat_bw_mbps", "feat_pps", "feat_yellow_frac", "feat_red_frac"]
    medians = ["feat_teid_share", "feat_qfi_teid_count"]
    data = _light_classes(spark, sf_dir)
    return rounded(data.select("window", "qfi", *columns, *medians, "qfi_bw_total"))


@query
def qfi_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes below zero, made of every third tunnel, are in no roll-up."""
    odd = F.when(F.col("teid") % 3 == 1, -F.col("qfi")).otherwise(F.col("qfi"))
    features = cut(exact_features(spark, sf_dir).withColumn("qfi", odd), "features")
    return rounded(classes.aggregate_classes(features).select("window", "qfi", "feat_bw_mbps", "qfi_bw_total"))


@query
def qfi_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["qfi_teid_hhi", "qfi_teid_top1_share", "qfi_teid_top2_share", "qfi_frac_teids_active"]
    return rounded(_light_classes(spark, sf_dir).select("window", "qfi", *columns))


@query
def qfi_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_light_classes(spark, sf_dir).select("window", "qfi", "qfi_share_entropy"))


@query
def qfi_color_bw_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["qfi_yellow_bw_share", "qfi_red_bw_share"]
    return rounded(_light_classes(spark, sf_dir).select("window", "qfi", *columns))


def _full_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = S.sketch(spark, sf_dir)
    table = detection.tunnel_table(built, S.keys(spark, sf_dir), S.BINS, CONFIG)
    return detection.class_table(detection.feature_table(table, CONFIG), CONFIG)


@query
def qfi_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_full_classes(spark, sf_dir))


# --- rolling features ----------------------------------------------------------------------------

_NAME = "qfi_bw_total"


def _z(rows: int) -> Column:
    return F.get(rolling.z_scores([_NAME], [_NAME], rows), F.lit(0))


def _rolled(*names: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = series_history(spark, sf_dir).withColumn(
            "r", F.get(rolling.roll_features([_NAME], [_NAME]), F.lit(0))
        )
        return rounded(data.select("window", "qfi", *[f"r.{n}" for n in names]), 6)

    return run


REGISTRY["rolling_stats"] = _rolled(
    "roll3_med", "roll5_med", "roll9_med", "roll5_max", "roll5_std"
)
REGISTRY["delta_lag"] = _rolled("delta")
REGISTRY["slope5"] = _rolled("slope5")


@query
def ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    average = F.get("_ewma", F.lit(0))
    return rounded(series_history(spark, sf_dir).select("window", "qfi", average.alias("ewma")), 6)


@query
def robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = series_history(spark, sf_dir)
    return rounded(data.select("window", "qfi", _z(21).alias("rz")), 6)


@query
def z_short_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = series_history(spark, sf_dir).select("window", "qfi", _z(7).alias("zs"), _z(21).alias("zl"))
    return rounded(data.withColumn("delta_sl", F.col("zs") - F.col("zl")), 6)


@query
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = class_series(spark, sf_dir)
    history = rolling.with_history(data, CONFIG, [_NAME], ["qfi"]).withColumn("z", _z(21))
    runs = rolling.high_runs(history, {"runlen": "z"}, ["qfi"])
    return runs.where("not _history").select("window", "qfi", "runlen")


@query
def qfi_engineered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling.engineer(_full_classes(spark, sf_dir), CONFIG), 7)


# --- scores, alarms, episodes --------------------------------------------------------------------


def _score_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.packets(spark, sf_dir).groupBy("window", "qfi").agg(
        (F.count_if(F.col("meter_color") == 1) / F.count(F.lit(1))).alias("yellow"),
        F.sum("packet_length").cast("double").alias("bytes"),
    )


@query
def tree_score_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ensemble of 5,040 nodes over the color score and the bytes of a window."""
    scored = scoring.score(_score_inputs(spark, sf_dir), ["yellow", "bytes"], S.large_model())
    return rounded(scored.select("window", "qfi", "score"))


@query
def tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-input ensemble over the color score and the bytes of a window."""
    data = _score_inputs(spark, sf_dir)
    model = {
        "base_margin": 0.25,
        "trees": [S.stump(0, 0.3, -1.5, 1.25), S.stump(1, 10000.0, -0.75, 0.5), S.stump(2, 0.5, 0.125, 9.0)],
    }
    scored = scoring.score(data, ["yellow", "bytes", "absent"], model)
    return rounded(scored.select("window", "qfi", "score"))


@query
def threshold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored_series(spark, sf_dir))


@query
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(light_events(spark, sf_dir))


@query
def debounce_inverting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reset level above the threshold (h > 1): one row may set and reset."""
    data = cut(scored_series(spark, sf_dir), "scored")
    return rounded(alarms.debounce(data, 1, 1.3))


@query
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(light_episodes(spark, sf_dir))


@query
def episode_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alarms.transitions(light_events(spark, sf_dir))
    return found.select("window", "qfi", "transition")


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = light_events(spark, sf_dir)
    return alarms.run_summary(events, alarms.episodes(events))


@query
def event_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.event_quality(light_events(spark, sf_dir))


@query
def score_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.score_separation(light_events(spark, sf_dir)))


@query
def threshold_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.threshold_consistency(scored_series(spark, sf_dir))


@query
def episode_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.episode_mix(light_episodes(spark, sf_dir)))


@query
def debounce_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.debounce_effect(light_events(spark, sf_dir))


def full_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.detect(
        S.sketch(spark, sf_dir), S.keys(spark, sf_dir), S.BINS, S.FEAT_COLS, S.MODEL, CONFIG
    )


@query
def detect_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(full_events(spark, sf_dir))


@query
def detect_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run from files to files: snapshots of text and doubles with stale copies of cells, keys with bad rows, settings, model."""
    folder = scratch_path(spark, "run")

    def written(name: str, content: dict) -> str:
        spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.text(f"{folder}/{name}")
        return f"{folder}/{name}"

    built = S.sketch(spark, sf_dir)
    cell = ["qid", "row", "bucket"]
    typed = built.select("window", *[F.col(c).cast("string").alias(c) for c in cell], *[F.col(m).cast("double").alias(m) for m in GEOMETRY.measures])
    stale = typed.where("CAST(bucket AS INT) % 3 = 1").withColumn("pkt_cnt", F.col("pkt_cnt") / 2).withColumn("_turn", F.lit(0))
    named = typed.withColumn("_turn", F.lit(1)).unionByName(stale).withColumn("file", F.format_string("window_%d.parquet", "window"))
    ordered = named.repartition("file").sortWithinPartitions("file", "_turn").drop("window", "_turn")
    ordered.write.partitionBy("file").parquet(f"{folder}/cms")
    keys = S.keys(spark, sf_dir).select("window", *[F.col(c).cast("string").alias(c) for c in ("teid", "qfi", "qid")])
    bad = keys.where("CAST(teid AS INT) % 4 = 0").withColumn("teid", F.concat("teid", F.lit("d")))
    windows.write_flow_keys(keys.unionByName(bad), f"{folder}/keys")
    edges = {str(q): {"latency_us": S.LAT_EDGES, "iat_us": S.IAT_EDGES} for q in S.BINS.lat}
    bins = written("bins", {"bins": edges})
    bundle = written("bundle", {
        "feat_cols": S.FEAT_COLS, "thr_global": CONFIG.thr_global, "thr_map": {str(k): v for k, v in CONFIG.thr_map.items()},
        "debounce": {"k": CONFIG.debounce_k, "h": CONFIG.debounce_h},
    })
    names = {"left_children": "left", "right_children": "right", "split_indices": "feature", "split_conditions": "value"}
    trees = [{k: t[v] for k, v in names.items()} for t in S.MODEL["trees"]]
    model = written("model", {"learner": {"learner_model_param": {"base_score": "5E-1"}, "gradient_booster": {"model": {"trees": trees}}}})

    feat_cols, config = settings.read_bundle(spark, bundle, GEOMETRY, window_secs=CONFIG.window_secs)
    snapshots = windows.read_sketch(spark, f"{folder}/cms", GEOMETRY)
    flow_keys = windows.read_flow_keys(spark, f"{folder}/keys")
    found = detection.detect(snapshots, flow_keys, settings.read_bins(spark, bins), feat_cols, scoring.read_model(spark, model), config)
    windows.write_events(found, f"{folder}/events")
    return rounded(windows.read_events(spark, f"{folder}/events"))


@query
def detect_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots and keys of two devices in one folder: each device is detected as if it were alone."""
    folder = scratch_path(spark, "devices")
    for device in (0, 1):
        sent = cut(S.packets(spark, sf_dir).where(F.col("packet_id") % 2 == device), "packets")
        built = sketch.build(sent, S.BINS, GEOMETRY, S.SLICE_US)
        windows.write_sketch(built, f"{folder}/cms/device_{device}")
        windows.write_flow_keys(sketch.flow_keys(sent), f"{folder}/keys/device_{device}")
    pattern, config = r"/device_(\d+)/", replace(CONFIG, run=("run",))
    snapshots = windows.read_sketch(spark, f"{folder}/cms", GEOMETRY, pattern)
    keys = windows.read_flow_keys(spark, f"{folder}/keys", pattern)
    return rounded(detection.detect(snapshots, keys, S.BINS, S.FEAT_COLS, S.MODEL, config))


@query
def detect_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alarms.episodes(cut(full_events(spark, sf_dir), "events"))
    return rounded(alarms.ordered_episodes(found))


@query
def events_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "events")
    windows.write_events(light_events(spark, sf_dir), folder)
    return rounded(windows.read_events(spark, folder))


# --- text ----------------------------------------------------------------------------------------


@query
def parse_int_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(
        ",", F.col("user_id").cast("string"), F.col("event_type"), F.concat(F.lit(" "), F.col("event_id")),
        F.lit(""),
    )
    parsed = fields.parse_int_list(text)
    return S.read(spark, sf_dir, "events").select(
        "event_id", F.array_join(parsed.cast("array<string>"), "|").alias("parsed")
    )


@query
def parse_qfi_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    victim, fake = F.col("user_id") % 9 + 1, F.col("event_id") % 9 + 1
    text = F.concat(F.lit("3:6, "), victim, F.lit(":"), fake, F.lit(","))
    parsed = fields.parse_qfi_map(text)
    return S.read(spark, sf_dir, "events").select(
        "event_id",
        F.try_element_at(parsed, F.lit(3)).alias("fake_of_3"),
        F.try_element_at(parsed, victim.cast("int")).alias("fake_of_victim"),
    )


@query
def teid_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    teid = F.col("user_id") * 7_654_321 + F.col("event_id")
    text = fields.teid_to_hex(teid)
    return S.read(spark, sf_dir, "events").select(
        "event_id", text.alias("text"), fields.teid_from_hex(text).alias("teid")
    )


# --- time ----------------------------------------------------------------------------------------


@query
def tumbling_1s(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.floor(F.col("ts_us") / 1_000_000)
    return S.packets(spark, sf_dir).groupBy(second.alias("second"), "qfi").agg(
        F.count(F.lit(1)).alias("pkt_cnt"), F.sum("packet_length").alias("byte_cnt")
    )


@query
def postcard_stats_1s(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.timestamp_micros("ts_us").alias("ts")
    depth = _postcard_fields()["queue_depth"].alias("queue_depth")
    stats = postcards.stats_per_second(S.packets(spark, sf_dir).select(ts, depth))
    return stats.select(
        F.unix_seconds("second").alias("second"), "total", "queued"
    )


# --- streams -------------------------------------------------------------------------------------


def _run_stream(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything there is and read what it wrote."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    writer = stream.writeStream.format("parquet").outputMode("append")
    started = (
        writer.option("path", out)
        .option("checkpointLocation", scratch_path(spark, f"{name}-progress"))
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query
def stream_stats_1s(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.timestamp_micros("ts_us").alias("ts")
    depth = _postcard_fields()["queue_depth"].alias("queue_depth")
    cards = scratch_path(spark, "postcards")
    S.packets(spark, sf_dir).select(ts, depth).write.parquet(cards)
    source = spark.readStream.schema("ts timestamp, queue_depth bigint").parquet(cards)
    # The watermark never passes the last seconds of a finite input: a marker an hour later does.
    marker = spark.read.parquet(cards).agg((F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    marker.withColumn("queue_depth", F.lit(0).cast("bigint")).write.mode("append").parquet(cards)
    stats = _run_stream(stream_stats(source), "stats")
    return stats.select(F.unix_seconds("second").alias("second"), "total", "queued")


def _window_files(table: DataFrame, folder: str) -> None:
    """One parquet file per window; the number is in its name."""
    named = table.withColumn("file", F.format_string("window_%d.parquet", "window"))
    named.repartition("file").drop("window").write.partitionBy("file").parquet(folder)


def _run_batches(writer: DataStreamWriter) -> None:
    """Batch after batch until no window is left."""
    started = writer.trigger(processingTime="0 seconds").start()
    started.processAllAvailable()
    started.stop()


def _episode_stream(spark: SparkSession, sf_dir: str) -> stream_episodes_.EpisodeStream:
    """The color score stepped in at least four batches, in window order."""
    folder, scored = scratch_path(spark, "scored"), scored_series(spark, sf_dir)
    _window_files(scored, folder)
    files = windowstream.read_window_stream(spark, folder, WINDOWS_PER_BATCH)
    rest = T.StructType([f for f in scored.schema.fields if f.name != "window"])
    rows = windowstream.read_rows(files, rest, 4)
    job = stream_episodes_.EpisodeStream(scratch_path(spark, "alarms"), CONFIG.debounce_k, CONFIG.debounce_h)
    _run_batches(job.start(rows, scratch_path(spark, "alarms-progress")))
    return job


@query
def stream_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _episode_stream(spark, sf_dir).events(spark)
    return rounded(events.select("window", "qfi", "score", "thr", "pred", "debounced"))


@query
def stream_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of the stream, those still open at its end included."""
    return rounded(_episode_stream(spark, sf_dir).episodes(spark))


@query
def stream_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling thresholds from keyed state, in at least four batches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream_limits.STATE_STORE)
    folder = scratch_path(spark, "tunnels")
    _window_files(_limit_inputs(spark, sf_dir), folder)
    files = windowstream.read_window_stream(spark, folder, WINDOWS_PER_BATCH)
    rest = T._parse_datatype_string("qfi int, teid bigint, lat_p95_ms double, iat_p10_us double")
    found = stream_limits.stream_thresholds(windowstream.read_rows(files, rest, 4))
    out = scratch_path(spark, "limits")
    writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "limits-progress"))
    _run_batches(writer)
    limits = spark.read.schema(found.schema).parquet(out)
    return rounded(limits.select("window", "qfi", "teid", "thr_lat_ms", "thr_iat_us"))


@query
def stream_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detection run over snapshot files in window order, in at least four batches."""
    snapshots, keys = scratch_path(spark, "cms"), scratch_path(spark, "keys")
    windows.write_sketch(S.sketch(spark, sf_dir), snapshots)
    windows.write_flow_keys(S.keys(spark, sf_dir), keys)
    events = scratch_path(spark, "events")
    job = stream_detection.DetectionStream(
        keys, scratch_path(spark, "state"), events, S.BINS, S.FEAT_COLS, S.MODEL, CONFIG
    )
    files = windowstream.read_window_stream(spark, snapshots, WINDOWS_PER_BATCH)
    _run_batches(job.start_files(files, scratch_path(spark, "progress")))
    return rounded(stream_detection.read_stream_events(spark, events).drop("batch"))
