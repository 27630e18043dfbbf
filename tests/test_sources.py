"""Files in and out."""

import json
import struct

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tunnelscope.config import SketchGeometry
from tunnelscope.operators.minquery import min_query
from tunnelscope.operators.rates import counter_rates
from tunnelscope.plans import standin as S
from tunnelscope.session import small_side
from tunnelscope.sources import frames, injections, postcards, recordfiles, registers, settings, windows


def write(path, obj):
    path.write_text(obj if isinstance(obj, str) else json.dumps(obj))
    return str(path)


GOOD = {"latency_us": [1.0, 2.0], "iat_us": [3.0, 4.0, 5.0]}


def test_bins_file(spark, tmp_path):
    path = write(tmp_path / "bins.json", {"bins": {"0": GOOD, "7": GOOD}})
    got = settings.read_bins(spark, path)
    assert got.lat == {0: (1, 2), 7: (1, 2)} and got.iat == {0: (3, 4, 5), 7: (3, 4, 5)}


@pytest.mark.parametrize(
    "bins, problem",
    [
        ({"0": {**GOOD, "latency_us": [2, 1]}}, "not increasing"),
        ({"0": {**GOOD, "latency_us": [1, 1]}}, "not increasing"),
        ({"x": GOOD}, "not an integer"),
        ({"0": {"latency_us": [1]}}, "not a list"),
        ({"0": GOOD, "1": {**GOOD, "latency_us": [1]}}, "latency bin counts differ"),
        ({"0": GOOD, "1": {**GOOD, "iat_us": [1]}}, "iat bin counts differ"),
        ({"0": {**GOOD, "iat_us": [1, None]}}, "not finite"),
    ],
)
def test_bad_bins(spark, tmp_path, bins, problem):
    path = write(tmp_path / "bins.json", {"bins": bins})
    with pytest.raises(ValueError, match=problem):
        settings.read_bins(spark, path)


def test_bins_without_queues(spark, tmp_path):
    with pytest.raises(ValueError, match="no 'bins'"):
        settings.read_bins(spark, write(tmp_path / "bins.json", {"other": 1}))


def test_bundle(spark, tmp_path):
    full = {"feat_cols": ["a", "b"], "thr_global": 0.4, "thr_map": {"3": 0.7}, "debounce": {"k": 3, "h": 0.5}}
    cols, config = settings.read_bundle(spark, write(tmp_path / "full.json", full), window_secs=2.0)
    assert cols == ["a", "b"] and config.thr_map == {3: 0.7} and config.window_secs == 2.0
    assert (config.debounce_k, config.debounce_h) == (3, 0.5)
    bare = write(tmp_path / "bare.json", {"feat_cols": ["a"], "thr_global": 0.4})
    _, config = settings.read_bundle(spark, bare)
    assert (config.debounce_k, config.debounce_h, config.thr_map) == (1, 1.0, {})


def test_natural_order_of_bins():
    names = ["lat10", "lat2", "qid", "lat0"]
    assert windows.bin_columns(names, "lat") == ["lat0", "lat2", "lat10"]
    with pytest.raises(ValueError, match="not bins"):
        windows.bin_columns(["latency"], "lat")


def test_folded(spark):
    df = spark.createDataFrame([(1, 2, 3)], "lat1 int, iat0 int, lat0 int")
    assert windows.folded(df).head().asDict() == {"lat": [3, 1], "iat": [2]}


def test_snapshots_with_missing_measures(spark, tmp_path):
    df = spark.createDataFrame([("0", 1, 2, 9, "x")], "qid string, row int, bucket int, lat0 int, pkt_cnt string")
    df.coalesce(1).write.parquet(str(tmp_path / "mixed" / "window_12.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "mixed" / "other.parquet"))
    (row,) = windows.read_sketch(spark, str(tmp_path / "mixed")).collect()
    assert (row.window, row.qid, row.lat0, row.pkt_cnt, row.byte_cnt) == (12, 0, 9, 0, 0)
    known = df.select(F.lit(0).alias("qid"), "row", "bucket", "lat0")
    known.coalesce(1).write.parquet(str(tmp_path / "known" / "window_7.parquet"))
    (row,) = windows.read_sketch(spark, str(tmp_path / "known"), SketchGeometry(1, 8, 1, 1)).collect()
    assert (row.window, row.qid, row.lat0, row.iat0, row.pkt_cnt, row.byte_cnt) == (7, 0, 9, 0, 0, 0)


def test_compacted_sketch_is_not_shuffled(spark, tmp_path):
    geometry = SketchGeometry(depth=3, width=16)
    keys = S.keys(spark, SMALL)
    sketch = S.sketch(spark, SMALL)
    windows.save_compacted(sketch, "compacted_cells", 8, str(tmp_path / "cells"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = min_query(spark.table("compacted_cells"), keys, geometry)
        plan = stored._jdf.queryExecution().executedPlan().toString()
        plain = min_query(sketch, keys, geometry)
        assert plan.count("Exchange") < plain._jdf.queryExecution().executedPlan().toString().count("Exchange")
        assert stored.exceptAll(plain).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE compacted_cells")


def test_flow_key_files(spark, tmp_path):
    (tmp_path / "window_3.csv").write_text("teid,qfi,qid\n5,1,0\nbad,1,0\n")
    (tmp_path / "window_20.csv").write_text("teid,qfi,qid\n4294967295,9,7\n")
    got = {tuple(r) for r in windows.read_flow_keys(spark, str(tmp_path)).collect()}
    assert got == {(3, 5, 1, 0, True), (3, -1, 1, 0, False), (20, 4294967295, 9, 7, True)}


def test_first_windows_and_copies(spark):
    df = spark.createDataFrame([(w, 0, 0, 1, w * 10 + i, i) for w in (9, 2, 30) for i in (0, 1)], "window int, qid int, row int, bucket int, pkt_cnt int, pos int")
    assert {r.window for r in windows.first_windows(df, 2).collect()} == {2, 9}
    assert windows.first_windows(df, 0).count() == 6
    assert windows.duplicate_cells(df).count() == 3
    assert {r.pkt_cnt for r in windows.last_copy(df, "pos").collect()} == {91, 21, 301}


LAYOUT = "<BIBIHHIBBHIQQ"


def test_record_files(spark, tmp_path):
    values = [(1, 2**32 - 1, 7, 99, 300, 2, 2**31, 5, 3, 1500, 12, 2**47, 1_700_000_000_000_000_000)]
    values += [(2, 5, 0, 0, 1, 2, 3, 4, 0, 64, 0, 6, n) for n in range(25)]
    raw = b"".join(struct.pack(LAYOUT, *v) for v in values)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "cards.bin").write_bytes(raw + raw[:20])  # the last record was not finished
    (tmp_path / "_hidden").write_bytes(raw)
    (tmp_path / "empty.bin").write_bytes(b"")
    for path in (tmp_path, tmp_path / "a" / "cards.bin"):
        for size in (1, 7, 1000):
            cards = recordfiles.read_records(spark, str(path), size)
            assert sorted(map(tuple, cards.collect())) == sorted(values)
            assert cards.rdd.getNumPartitions() == -(-26 // size)


def test_written_record_files(spark, tmp_path):
    values = [(1, 2, 3, 4, 5, 6, 2**32 - 1, 8, 2, 10, 11, 2**40, n) for n in range(50)]
    cards = spark.createDataFrame(values, recordfiles.SCHEMA).repartition(3)
    for _ in range(2):  # files are added
        recordfiles.write_records(cards.select("packet_length", *[c for c in cards.columns if c != "packet_length"]), str(tmp_path / "out"))
    assert sorted(map(tuple, recordfiles.read_records(spark, f"file:{tmp_path}/out").collect())) == sorted(values * 2)
    names = {p.suffix for p in (tmp_path / "out").iterdir()}
    assert names == {".bin"} and len(list((tmp_path / "out").iterdir())) == 6
    failing = cards.withColumn("qfi", F.when(F.col("host_timestamp_ns") == 49, F.raise_error(F.lit("no"))).otherwise(F.col("qfi")).cast("bigint"))
    with pytest.raises(Exception, match="no"):
        recordfiles.write_records(failing, str(tmp_path / "out"))
    assert {p.suffix for p in (tmp_path / "out").iterdir() if not p.name.startswith("_")} == {".bin"}
    assert recordfiles.read_records(spark, str(tmp_path / "out")).count() == 100


def test_wire_form(spark):
    payload = struct.pack("!BIB", 1, 70_000, 3) + bytes([0, 1, 2]) + struct.pack("!HHIBBHI", 8, 9, 77, 5, 1, 900, 4) + bytes(6)
    df = spark.createDataFrame([(bytearray(payload),), (bytearray(payload[:30]),)], "payload binary")
    (row,) = postcards.decode_wire(df).collect()
    assert (row.hop_latency, row.queue_depth, row.teid, row.qfi, row.packet_length) == (70_000, 258, 77, 5, 900)


def frame(proto=17, dport=2152, flags=0x34, ext=0x85, ext_len=1, qfi=0x49, ether=0x0800):
    ip = bytes([0x45]) + bytes(8) + bytes([proto]) + bytes(10)
    udp = struct.pack("!HHHH", 9, dport, 0, 0)
    gtp = bytes([flags, 255]) + bytes(2) + struct.pack("!I", 2**32 - 2)
    return bytearray(bytes(12) + struct.pack("!H", ether) + ip + udp + gtp + bytes([0, 0, 0, ext, ext_len, 0x10, qfi, 0]))


def test_frames(spark):
    cases = [
        (frame(), 2**32 - 2, 9),
        (frame(flags=0x30), 2**32 - 2, 0),
        (frame(flags=0x31), 2**32 - 2, 9),
        (frame(ext=0x84), 2**32 - 2, 0),
        (frame(ext_len=2), 2**32 - 2, 0),
        (frame(proto=6), 0, 0),
        (frame(dport=53), 0, 0),
        (frame(ether=0x0806), 0, 0),
        (frame()[:20], 0, 0),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, frame binary")
    got = {r.i: (r.teid, r.qfi) for r in frames.decode_frames(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_injection_log_files(spark, tmp_path):
    lines = [
        "starting",
        '{"event":"start","episode_id":"e1","ts_ns":5,"actors":{"qfi":3,"teids":["0x1"]}}',
        "[broken",
        '[{"event":"start"}]',
        '{"event":"start","episode_id":"e1","ts_ns":9,"actors":{"qfi":4,"teids":["0x2",""]}}',
        '{"event":"stop","episode_id":"e1","ts_ns":20}',
    ]
    (tmp_path / "a.log").write_text("\n".join(lines))
    log = injections.read_logs(spark, str(tmp_path))
    assert log.count() == 3
    (row,) = injections.label_episodes(log, "microburst", ["episode_id"], offset_ms=1).collect()
    assert (row.start_ns, row.end_ns, row.qfis, row.teids) == (1_000_009, 1_000_020, [4], ["0x2"])


def test_register_dump(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 0), (1, 2, 3), (2, 0, 9), (3, 4, 1)], "index int, green int, yellow int")
    top = registers.top_entries(df, ["green", "yellow"], 2).collect()
    assert [(r["index"], r.value) for r in top] == [(2, "0;9"), (1, "2;3")]
    registers.write_dump(df, ["green", "yellow"], str(tmp_path / "dump"))
    text = spark.read.option("header", True).csv(str(tmp_path / "dump")).collect()
    assert {(r["index"], r["value"]) for r in text} == {("1", "2;3"), ("2", "0;9"), ("3", "4;1")}
    assert registers.nonzero(df, ["green"]).count() == 2


def test_counter_rates_are_cut_not_rounded(spark):
    df = spark.createDataFrame([("a", 1, 0, 0), ("a", 2, 249_999, 3), ("a", 3, 0, 1)], "iface string, n int, bytes bigint, packets bigint").withColumn("interval_s", F.lit(1))
    got = counter_rates(df, ["iface"], ["n"], F.col("n")).orderBy("n").collect()
    assert [(r.mbps, r.gbps, r.pkts) for r in got] == [(1.99, 0.001, 3), (-1.99, -0.001, -2)]
    df = spark.createDataFrame([("a", 1, 0, 0), ("a", 2, 36_250, 3)], "iface string, n int, bytes bigint, packets bigint").withColumn("interval_s", F.lit(1))
    assert counter_rates(df, ["iface"], ["n"], F.col("n")).head().mbps == 0.29


@pytest.mark.parametrize("kind", ["bigint", "double", "string"])
def test_snapshots_of_any_type(spark, tmp_path, kind):
    rows = [(0, 1, 2, 9, 3), (0, 1, 2, 4, 8), (0, 0, 5, 7, None)]
    df = spark.createDataFrame(rows, "qid bigint, row bigint, bucket bigint, lat0 bigint, pkt_cnt bigint")
    for n in (7, 3, 12):
        df.select(*[F.col(c).cast(kind).alias(c) for c in df.columns]).coalesce(1).write.parquet(str(tmp_path / f"window_{n}.parquet"))
    read = windows.read_first_windows(spark, str(tmp_path), 2, SketchGeometry(2, 8, 1, 1))
    assert {r.window for r in read.select("window").collect()} == {3, 7}
    assert len(read.inputFiles()) == 2
    last = windows.last_copy(read, "position").where("window = 3").collect()
    assert {(r.qid, r.row, r.bucket, r.lat0, r.pkt_cnt) for r in last} == {(0, 1, 2, 4, 8), (0, 0, 5, 7, 0)}


@pytest.mark.parametrize("n", [0, 9])
@pytest.mark.parametrize("geometry", [SketchGeometry(2, 8, 1, 2), None])
def test_snapshots_whose_columns_and_types_differ(spark, tmp_path, n, geometry):
    df = spark.createDataFrame([(0, 1, 2, 9, 6, 3, 5)], "qid bigint, row bigint, bucket bigint, lat0 bigint, iat1 bigint, pkt_cnt bigint, drop_cnt bigint")
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    files = {1: df.drop("drop_cnt", "iat1"), 2: df, 3: text, 4: df.withColumn("qid", F.lit("x")), 5: df.drop("row"), 6: text.drop("iat1"), 7: df.withColumn("lat0", F.lit(9.0))}
    for w, snapshot in files.items():
        snapshot.coalesce(1).write.parquet(str(tmp_path / f"window_{w}.parquet"))
    read = windows.read_first_windows(spark, str(tmp_path), n, geometry)
    want = {(w, 0, 1, 2, 9, 0, 6, 3, 5) for w in (2, 3, 7)} | {(1, 0, 1, 2, 9, 0, 0, 3, 0), (4, -1, 1, 2, 9, 0, 6, 3, 5), (5, 0, -1, 2, 9, 0, 6, 3, 5), (6, 0, 1, 2, 9, 0, 0, 3, 5)}
    if geometry is None:  # bins are counted, and iat1 alone is one bin: iat0
        want = {(*r[:6], *r[7:]) for r in want}
        got = read.select("window", "qid", "row", "bucket", "lat0", "iat0", "pkt_cnt", "drop_cnt")
    else:
        got = read.select("window", "qid", "row", "bucket", "lat0", "iat0", "iat1", "pkt_cnt", "drop_cnt")
    assert {tuple(r) for r in got.collect()} == want and read.count() == 7
    assert len(read.inputFiles()) == 7


def test_a_measure_that_the_first_file_lacks_is_read(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 2, 3, 5)], "qid bigint, row bigint, bucket bigint, pkt_cnt bigint, drop_cnt bigint")
    for w, snapshot in ((1, df.drop("drop_cnt")), (2, df), (3, df)):
        snapshot.coalesce(1).write.parquet(str(tmp_path / f"window_{w}.parquet"))
    for n in (0, 2):
        got = windows.read_first_windows(spark, str(tmp_path), n, SketchGeometry(2, 8, 1, 1)).collect()
        assert {(r.window, r.pkt_cnt, r.drop_cnt) for r in got} == {(w, 3, 5 * (w > 1)) for w in range(1, (n or 3) + 1)}


def test_pandas_snapshot(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"qid": [1], "row": [0], "bucket": [3], "lat0": [5.0], "pkt_cnt": ["12d"]}).to_parquet(tmp_path / "window_4.parquet")
    (row,) = windows.read_sketch(spark, str(tmp_path), SketchGeometry(1, 8, 1, 1)).collect()
    assert (row.window, row.qid, row.bucket, row.lat0, row.pkt_cnt) == (4, 1, 3, 5, 0)


def test_small_side_checks_the_size(spark):
    def broadcasts(dim):
        joined = spark.range(100).join(dim, "id")
        return "ResolvedHint" in joined._jdf.queryExecution().analyzed().toString()

    assert broadcasts(small_side(spark.range(10)))
    assert not broadcasts(small_side(spark.range(20), max_rows=10))


def test_filters_and_columns_reach_the_scan(spark):
    plan = S.packets(spark, SMALL).where("packet_id > 900").select("teid")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in text
    assert "GreaterThan(event_id,900)" in text
