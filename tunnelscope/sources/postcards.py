"""Postcards: per-packet reports in wire form, as 42-byte records, and as log text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import hex_be, hex_le, unsigned_be, unsigned_le

# The wire layout, big endian (field, offset, bytes).
WIRE_BYTES = 31
WIRE_FIELDS = [
    ("switch_id", 0, 1),
    ("hop_latency", 1, 4),
    ("egress_qid", 5, 1),
    ("queue_depth", 6, 3),
    ("egress_port", 9, 2),
    ("ingress_port", 11, 2),
    ("teid", 13, 4),
    ("qfi", 17, 1),
    ("meter_color", 18, 1),
    ("packet_length", 19, 2),
    ("drop_count", 21, 4),
    ("sw_timestamp_ns", 25, 6),
]

# The packed record layout, little endian (field, bytes).
RECORD_BYTES = 42
RECORD_FIELDS = [
    ("switch_id", 1),
    ("hop_latency", 4),
    ("egress_qid", 1),
    ("queue_depth", 4),
    ("egress_port", 2),
    ("ingress_port", 2),
    ("teid", 4),
    ("qfi", 1),
    ("meter_color", 1),
    ("packet_length", 2),
    ("drop_count", 4),
    ("sw_timestamp_ns", 8),
    ("host_timestamp_ns", 8),
]

# The log line (label, field), in printed order.
LOG_FIELDS = [
    ("sw_ts", "sw_timestamp_ns"),
    ("host_ts", "host_timestamp_ns"),
    ("switch_id", "switch_id"),
    ("hop_lat", "hop_latency"),
    ("eg_qid", "egress_qid"),
    ("qdepth", "queue_depth"),
    ("eg_port", "egress_port"),
    ("in_port", "ingress_port"),
    ("TEID", "teid"),
    ("QFI", "qfi"),
    ("color", "meter_color"),
    ("pkt_len", "packet_length"),
    ("drop_cnt", "drop_count"),
]
LOG_PREFIX = "[Postcard] "


def decode_wire(reports: DataFrame, payload: str = "payload") -> DataFrame:
    """Fields of each report; payloads shorter than a report are dropped."""
    fields = {n: unsigned_be(F.col(payload), at, size) for n, at, size in WIRE_FIELDS}
    return reports.where(F.length(payload) >= WIRE_BYTES).withColumns(fields).drop(payload)


def encode_wire(fields: dict[str, Column]) -> Column:
    return F.unhex(F.concat(*[hex_be(fields[n], size) for n, _, size in WIRE_FIELDS]))


def decode_records(records: DataFrame, record: str = "record") -> DataFrame:
    """Fields of packed 42-byte records."""
    out, at = {}, 0
    for name, size in RECORD_FIELDS:
        out[name] = unsigned_le(F.col(record), at, size)
        at += size
    return records.where(F.length(record) == RECORD_BYTES).withColumns(out).drop(record)


def encode_record(fields: dict[str, Column]) -> Column:
    return F.unhex(F.concat(*[hex_le(fields[n], size) for n, size in RECORD_FIELDS]))


def log_line(fields: dict[str, Column]) -> Column:
    parts = []
    for label, name in LOG_FIELDS:
        text = fields[name].cast("string")
        if label == "TEID":
            text = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(fields[name])), 8, "0"))
        parts.append(F.concat(F.lit(f"{label}="), text))
    return F.concat(F.lit(LOG_PREFIX), F.concat_ws(" ", *parts))


def parse_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Fields of postcard log lines; other lines are skipped."""
    text = F.col(line)
    fields = {}
    for label, name in LOG_FIELDS:
        if label == "TEID":
            digits = F.regexp_extract(text, r"\bTEID=0x([0-9a-fA-F]+)", 1)
            fields[name] = F.conv(digits, 16, 10).cast("bigint")
        else:
            fields[name] = F.regexp_extract(text, rf"\b{label}=(\d+)", 1).cast("bigint")
    return lines.where(text.startswith(LOG_PREFIX)).withColumns(fields).drop(line)


def stats_per_second(postcards: DataFrame, ts: str = "ts") -> DataFrame:
    """Reports and reports with a non-empty queue per second, for batch tables and streams."""
    return (
        postcards.groupBy(F.window(ts, "1 second").alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("queue_depth") > 0).cast("bigint").alias("queued"),
        )
        .select(F.col("_w.start").alias("second"), "total", "queued")
    )
