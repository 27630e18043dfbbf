"""Sketches, features, scores and the whole run."""

import dataclasses
import json
import random
import math

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tunnelscope.config import PipelineConfig, SketchGeometry
from tunnelscope.operators import classes, minquery, rolling, scoring, sketch, tunnels
from tunnelscope.plans.medians import grouped_medians
from tunnelscope.plans import detection
from tunnelscope.plans import standin as S
from tunnelscope.session import cut
from tunnelscope.sources.settings import same_bins


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def packets(spark):
    return cut(S.packets(spark, SMALL), "packets")


@pytest.fixture(scope="module")
def built(spark, packets):
    return cut(sketch.build(packets, S.BINS, S.CONFIG.geometry, S.SLICE_US), "sketch")


@pytest.mark.parametrize("slice_us", [S.WINDOW_US // 7, S.WINDOW_US, 3 * S.WINDOW_US + 11])
def test_sketch_does_not_depend_on_slices(packets, built, slice_us):
    again = sketch.build(packets, S.BINS, S.CONFIG.geometry, slice_us)
    assert rows(again) == rows(built)


def test_bins_add_up_to_packets(built):
    lat = sum(F.col(f"lat{i}") for i in range(8))
    iat = sum(F.col(f"iat{i}") for i in range(8))
    colors = F.col("green_cnt") + F.col("yellow_cnt")
    bad = built.where((lat != F.col("pkt_cnt")) | (iat != F.col("pkt_cnt")) | (colors != F.col("pkt_cnt")))
    assert bad.count() == 0


def test_estimates_are_never_below_the_truth(spark, packets, built):
    truth = packets.groupBy("window", "teid", "qfi", F.col("egress_qid").alias("qid")).agg(
        F.count_if(F.col("meter_color") != 3).alias("true_pkts"),
        F.sum(F.when(F.col("meter_color") != 3, F.col("packet_length")).otherwise(0)).alias("true_bytes"),
        F.count_if(F.col("meter_color") == 3).alias("true_drops"),
    )
    found = minquery.min_query(built, sketch.flow_keys(packets), S.CONFIG.geometry)
    both = found.join(truth, ["window", "teid", "qfi", "qid"])
    assert both.count() == truth.count()
    low = (F.col("pkt_cnt") < F.col("true_pkts")) | (F.col("byte_cnt") < F.col("true_bytes"))
    assert both.where(low | (F.col("drop_cnt") < F.col("true_drops"))).count() == 0
    # A wide sketch has no collisions and gives the exact counts.
    wide = SketchGeometry(depth=4, width=4096)
    exact = minquery.min_query(
        sketch.build(packets, S.BINS, wide, S.WINDOW_US), sketch.flow_keys(packets), wide
    ).join(truth, ["window", "teid", "qfi", "qid"])
    assert exact.where("pkt_cnt <> true_pkts OR byte_cnt <> true_bytes").count() == 0


def test_missing_cell_forces_zero(spark, packets, built):
    gone = built.where("row <> 1")
    found = minquery.min_query(gone, sketch.flow_keys(packets), S.CONFIG.geometry)
    assert found.agg(F.sum("pkt_cnt")).head()[0] == 0


def test_bad_keys_are_set_aside(spark, built):
    keys = spark.createDataFrame(
        [(1, "5", "1", "0"), (1, "5", "1", "0"), (1, "x", "1", "0"), (1, "5", "300", "0"), (1, "5.7", "2", "")],
        "window int, teid string, qfi string, qid string",
    )
    good = {tuple(r) for r in minquery.distinct_flow_keys(keys).collect()}
    assert good == {(1, 5, 1, 0), (1, 5, 2, -1)}
    assert minquery.rejected_flow_keys(keys).count() == 2
    with pytest.raises(ValueError, match="lacks columns"):
        minquery.distinct_flow_keys(keys.drop("qid"))


def test_unknown_queue_keeps_the_row(spark, built):
    keys = spark.createDataFrame([(0, 0, 0, 8)], "window int, teid bigint, qfi int, qid int")
    table = cut(
        tunnels.tunnel_windows(
            minquery.min_query(built, keys, S.CONFIG.geometry), S.BINS, S.CONFIG
        ),
        "tunnels",
    )
    row = tunnels.tunnel_features(table, S.CONFIG).head()
    assert row.qfi == 0 and row.feat_bw_mbps == 0 and row.feat_lat_roll_p95_exceed_frac == 0
    assert row.feat_qfi_teid_count == 0


def test_class_features_by_hand(spark):
    features = cut(
        spark.createDataFrame(
            [(1, 2, 10, 3.0, 1.0, 0.5, 0.0, 7.0), (1, 2, 11, 1.0, 2.0, 0.0, 1.0, 9.0), (1, 3, 10, 0.0, 0.0, 0.0, 0.0, 1.0), (1, -1, 4, 5.0, 0.0, 0.0, 0.0, 1.0)],
            "window int, qfi int, teid bigint, feat_bw_mbps double, feat_pps double, "
            "feat_yellow_frac double, feat_red_frac double, feat_iat_p10_us double",
        ),
        "features",
    )
    got = {r.qfi: r for r in classes.aggregate_classes(features).collect()}
    assert set(got) == {2, 3}
    two = got[2]
    assert two.feat_bw_mbps == two.qfi_bw_total == 4.0
    assert (two.feat_pps, two.feat_yellow_frac, two.feat_red_frac) == (3.0, 0.5, 1.0)
    assert two.feat_iat_p10_us == 8.0
    assert two.qfi_teid_hhi == 0.625
    assert (two.qfi_teid_top1_share, two.qfi_teid_top2_share) == (0.75, 0.25)
    assert two.qfi_share_entropy == pytest.approx(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)))
    assert two.qfi_frac_teids_active == 1.0
    assert (two.qfi_yellow_bw_share, two.qfi_red_bw_share) == (0.375, 0.25)
    three = got[3]
    assert three.qfi_teid_hhi == three.qfi_share_entropy == three.qfi_teid_top2_share == 0.0


@pytest.fixture(scope="module")
def class_table(spark, packets, built):
    table = detection.tunnel_table(built, sketch.flow_keys(packets), S.BINS, S.CONFIG)
    return detection.class_table(detection.feature_table(table, S.CONFIG), S.CONFIG)


def test_class_invariants(class_table):
    bad = class_table.where(
        "qfi_teid_hhi > 1 + 1e-9 OR qfi_share_entropy < -1e-9 OR qfi_teid_top2_share > qfi_teid_top1_share"
    )
    assert bad.count() == 0


def test_engineered_columns_and_blocks(class_table):
    whole = rolling.engineer(class_table, S.CONFIG)
    assert len(whole.columns) == 106  # window and the 105 of the model
    small = dataclasses.replace(S.CONFIG, block_rows=16, slice_windows=10)
    assert rows(rolling.engineer(class_table, small)) == rows(whole)


def test_tunnel_features_do_not_depend_on_blocks(spark, packets, built):
    table = detection.tunnel_table(built, sketch.flow_keys(packets), S.BINS, S.CONFIG)
    small = dataclasses.replace(S.CONFIG, block_rows=3, slice_windows=10)
    assert rows(tunnels.tunnel_features(table, small)) == rows(tunnels.tunnel_features(table, S.CONFIG))


def test_rolling_by_hand(spark):
    data = [(1, w, float(x)) for w, x in zip((1, 2, 5, 6, 9, 12), (0, 2, 4, 1, 3, 0))]
    df = cut(spark.createDataFrame(data, "qfi int, window int, qfi_bw_total double"), "series")
    history = rolling.with_history(df, PipelineConfig(), ["qfi_bw_total"], ["qfi"])
    name = ["qfi_bw_total"]
    got = history.select(
        "window",
        F.get(rolling.roll_features(name, name), F.lit(0)).alias("r"),
        F.get("_ewma", F.lit(0)).alias("e"),
    ).orderBy("window").collect()
    assert [g.r.roll5_med for g in got] == [0, 1, 2, 1.5, 2, 2]
    assert [g.r.slope5 for g in got] == pytest.approx([0, 2, 2, 0.5, 0.5, -0.5])
    assert [g.r.delta for g in got] == [0, 2, 2, -3, 2, -3]
    assert [g.e for g in got][:5] == pytest.approx([0, 0.6, 1.62, 1.434, 1.9038])


def test_averages_never_forget(spark):
    rng = random.Random(6)
    xs = [1e9, *[0.0] * 140, *[rng.choice([0.0, rng.random(), 1e6]) for _ in range(900)]]
    df = cut(spark.createDataFrame([(1, 2 * w, x) for w, x in enumerate(xs)], "qfi int, window int, qfi_bw_total double"), "series")
    got = rolling.with_history(df, PipelineConfig(block_rows=50, slice_windows=64), ["qfi_bw_total"], ["qfi"]).where("not _history")
    averages = [r[0] for r in got.orderBy("window").select(F.get("_ewma", F.lit(0))).collect()]
    want = [xs[0]]
    for x in xs[1:]:
        want.append(0.3 * x + 0.7 * want[-1])
    assert averages == pytest.approx(want, rel=1e-12)
    assert averages[130] > 0


@pytest.mark.parametrize("cuts", [[1, 30, 400], [200, 201, 500], [700]])
def test_averages_go_on_from_an_earlier_run(spark, cuts):
    rng = random.Random(4)
    xs = [rng.uniform(0, 9) for _ in range(900)]
    schema = "window int, qfi int, qfi_bw_total double, _known array<double>"
    tail, got = [], []
    for lo, hi in zip([0, *cuts], [*cuts, 900]):
        rows = tail + [(w, 1, xs[w], None) for w in range(lo, hi)]
        df = spark.createDataFrame(rows, schema)
        history = rolling.with_history(df, PipelineConfig(block_rows=50, slice_windows=64), ["qfi_bw_total"], ["qfi"], "_known").where("not _history")
        out = history.orderBy("window").select("window", "_ewma", "_recent").collect()
        got += [(r[0], r[1][0], len(r[2])) for r in out if r[0] >= lo]
        tail = [(r[0], 1, xs[r[0]], r[1]) for r in out][-rolling.HISTORY_ROWS :]
    want = [xs[0]]
    for x in xs[1:]:
        want.append(0.3 * x + 0.7 * want[-1])
    assert [r[0] for r in got] == list(range(900))
    assert [r[1] for r in got] == pytest.approx(want, rel=1e-12)
    assert [r[2] for r in got] == [min(w + 1, 21) for w in range(900)]


def test_medians_leave_nulls_out(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 9.0, None, float("nan"))] + [("b", None)], "k string, v double")
    assert {r.k: r.v for r in grouped_medians(df, ["k"], ["v"]).collect()} == {"a": 2.0}


def test_expression_and_array_scores_agree(class_table):
    df = rolling.engineer(class_table, S.CONFIG)
    crooked = {"left": [1, -1, 3, -1, 5, -1, -1], "right": [2, 0, 4, 0, 6, 0, 0], "feature": [0, 0, 1, 0, 2, 0, 0], "value": [0.1, 0.5, 0.3, -0.25, 18.0, 1.5, -2.0]}
    model = {"base_margin": 0.125, "trees": [*S.MODEL["trees"], crooked, {"left": [-1], "right": [-1], "feature": [0], "value": [0.75]}]}
    a = scoring.score_by_expression(df, S.FEAT_COLS + ["absent"], model)
    b = scoring.score_by_arrays(df, S.FEAT_COLS + ["absent"], model)
    left, right = ({(r.window, r.qfi): r.score for r in x.select("window", "qfi", "score").collect()} for x in (a, b))
    assert left == right


def test_large_ensemble_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(0.1, 900.0), (float("nan"), 1e9), (0.97, 20_000.0), (None, None)], "yellow double, bytes double")
    model = S.large_model(12, 3)
    large = scoring.score_by_arrays(df, ["yellow", "bytes"], model)
    assert [r.score for r in large.collect()] == [r.score for r in scoring.score_by_expression(df, ["yellow", "bytes"], model).collect()]
    assert sum(len(t["left"]) for t in S.large_model()["trees"]) > 5_000
    plan = scoring.score(df, ["yellow", "bytes"], S.large_model())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_model_file(spark):
    text = json.dumps(
        {
            "learner": {
                "learner_model_param": {"base_score": "[2.5E-1]"},
                "gradient_booster": {
                    "model": {
                        "trees": [
                            {
                                "left_children": [1, -1, -1],
                                "right_children": [2, -1, -1],
                                "split_indices": [0, 0, 0],
                                "split_conditions": [1.5, -1.0, 2.0],
                            }
                        ]
                    }
                },
            }
        }
    )
    model = scoring.load_model(text)
    df = spark.createDataFrame([(1.0,), (1.5,), (float("nan"),)], "x double")
    got = [r.score for r in scoring.score(df, ["x"], model).collect()]
    base = math.log(0.25 / 0.75)
    sigmoid = lambda m: 1 / (1 + math.exp(-m))
    assert got == pytest.approx([sigmoid(base - 1), sigmoid(base + 2), sigmoid(base - 1)])


def test_zero_window_length(spark):
    config = dataclasses.replace(S.CONFIG, window_secs=0.0)
    rate = tunnels.traffic_rates(config)
    got = spark.range(1).selectExpr("5 AS byte_cnt", "5 AS pkt_cnt").select(*rate.values()).head()
    assert tuple(got) == (0.0, 0.0)


def test_one_hot_tunnel(spark):
    """A third of all packets in one flow of one window."""
    n = 9000
    hot = F.col("id") % 3 == 0
    packets = spark.range(n).select(
        F.col("id").alias("packet_id"),
        F.when(hot, 1).otherwise((F.col("id") % 5).cast("int")).alias("window"),
        F.when(hot, 7).otherwise(F.col("id") % 50).cast("bigint").alias("teid"),
        F.lit(1).alias("qfi"),
        F.lit(0).alias("egress_qid"),
        F.lit(0).alias("meter_color"),
        F.lit(100).cast("bigint").alias("packet_length"),
        (F.col("id") * 5000).alias("hop_latency_ns"),
    ).withColumn("ts_us", F.col("window").cast("bigint") * 1_000_000 + F.col("packet_id") * 100).withColumn(
        "ingress_tstamp_ns", F.col("ts_us") * 1000
    )
    geometry = SketchGeometry(depth=4, width=32)
    bins = same_bins(S.LAT_EDGES, S.IAT_EDGES, 8)
    one, many = (rows(sketch.build(packets, bins, geometry, us)) for us in (10**12, 50_000))
    assert one == many
    assert sum(r[sorted(["bucket", "qid", "row", "window", *geometry.measures]).index("pkt_cnt")] for r in one) == 4 * n


def test_tunnel_sums_reuse_the_flow_shuffle(spark, packets, built):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        flows = minquery.min_query(built, sketch.flow_keys(packets), S.CONFIG.geometry)
        both = (flows, tunnels.tunnel_windows(flows, S.BINS, S.CONFIG))
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in both]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans[0].count("Exchange hashpartitioning") == plans[1].count("Exchange hashpartitioning")
    assert "CartesianProduct" not in plans[1] and "NestedLoop" not in plans[1]
