"""Split plans against plain windows and against small sequential models."""

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tunnelscope.operators import alarms
from tunnelscope.plans.medians import grouped_medians, runner_up
from tunnelscope.plans.slices import (
    history_blocks,
    latest_value,
    previous_value,
    running_total,
)


@pytest.fixture(scope="module")
def series(spark):
    """Three keys, one with most of the rows, window numbers with gaps."""
    rng = random.Random(11)
    rows = []
    for key, n in ((1, 400), (2, 60), (3, 1)):
        w = 0
        for _ in range(n):
            w += rng.choice([1, 1, 1, 2, 9, 40])
            rows.append((key, w, rng.randrange(10), rng.choice([None, None, 5, 6])))
    return spark.createDataFrame(rows, "k int, window int, v int, maybe int").cache()


def plain(key="k"):
    return Window.partitionBy(key).orderBy("window")


def same(left, right):
    a, b = (sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr) for df in (left, right))
    assert a == b


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
@pytest.mark.parametrize("before", [False, True])
def test_running_total(series, width, before):
    slice_by = F.floor(F.col("window") / width)
    got = running_total(series, ["k"], ["window"], slice_by, F.col("v"), "t", before)
    upto = F.sum("v").over(plain().rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    same(got, series.withColumn("t", F.coalesce(upto, F.lit(0))))


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_previous_and_latest(series, width):
    slice_by = F.floor(F.col("window") / width)
    got = previous_value(series, ["k"], ["window"], slice_by, "v", "p")
    same(got, series.withColumn("p", F.lag("v").over(plain())))
    got = latest_value(series, ["k"], ["window"], slice_by, F.col("maybe"), "p")
    same(got, series.withColumn("p", F.last("maybe", True).over(plain())))


@pytest.mark.parametrize("block, history", [(1, 3), (4, 5), (16, 20), (64, 6), (10_000, 20)])
def test_history_blocks(series, block, history):
    blocks = history_blocks(series, ["k"], "window", F.floor(F.col("window") / 50), block, history)
    frame = Window.partitionBy("k", "_block").orderBy("window").rowsBetween(-history, 0)
    got = blocks.withColumn("l", F.collect_list("v").over(frame)).where("not _history")
    want = series.withColumn("l", F.collect_list("v").over(plain().rowsBetween(-history, 0)))
    same(got.drop("_block", "_history"), want)
    sizes = blocks.groupBy("k", "_block").count().agg(F.max("count")).head()[0]
    assert sizes <= block + history


def sequential(rows, k, h):
    buffer, state, out = [], 0, []
    for window, score, thr, pred in rows:
        buffer = (buffer + [pred])[-k:]
        if state == 0:
            state = int(sum(buffer) >= k)
        elif score < thr * h:
            state = 0
        out.append((window, state))
    return out


def model_episodes(states, scores, last):
    out, current = [], None
    for (window, on), score in zip(states, scores):
        if on:
            current = current or [window, 0.0, 0]
            current[1], current[2] = max(current[1], score), current[2] + 1
        elif current:
            out.append((current[0], window - 1, current[1], current[2]))
            current = None
    if current:
        out.append((current[0], last, current[1], current[2]))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = []
    for qfi in range(6):
        w, level = 0, 0.3
        for _ in range(200):
            w += rng.choice([1, 1, 1, 3])
            level = min(1.0, max(0.0, level + rng.uniform(-0.25, 0.25)))
            thr = 0.5 if qfi % 2 else 0.4
            rows.append((qfi, w, level, thr, int(level >= thr)))
    return rows, spark.createDataFrame(
        rows, "qfi int, window int, score double, thr double, pred int"
    ).cache()


@pytest.mark.parametrize("k, h, block", [(1, 1.0, 4096), (2, 0.8, 16), (3, 0.5, 1), (1, 1.3, 8), (3, 1.5, 16), (2, 5.0, 3)])
def test_debounce_and_episodes(scored, k, h, block):
    rows, df = scored
    events = alarms.debounce(df, k, h, slice_windows=40, block_rows=block)
    got = {(r.qfi, r.window): r.debounced for r in events.collect()}
    want, episodes, last = {}, [], max(r[1] for r in rows)
    for qfi in range(6):
        own = [r[1:] for r in rows if r[0] == qfi]
        states = sequential(own, k, h)
        want.update({(qfi, w): s for w, s in states})
        episodes += [(qfi, *e) for e in model_episodes(states, [r[1] for r in own], last)]
    assert got == want
    found = [tuple(r) for r in alarms.episodes(events, slice_windows=30).collect()]
    assert sorted(found) == sorted(episodes)
    marks = alarms.transitions(events, slice_windows=30).groupBy("transition").count()
    counts = {r.transition: r["count"] for r in marks.collect()}
    assert counts.get("start", 0) == len(episodes)


def test_debounce_goes_on_from_known_rows(spark, scored):
    rows, df = scored
    whole = {(r.qfi, r.window): r.debounced for r in alarms.debounce(df, 2, 0.8).collect()}
    old = spark.createDataFrame(
        [(q, w, s, t, p, whole[(q, w)] if w < 150 else None) for q, w, s, t, p in rows if w >= 140],
        "qfi int, window int, score double, thr double, pred int, known int",
    )
    for h, source in ((0.8, whole), (1.3, None)):
        if source is None:
            whole = {(r.qfi, r.window): r.debounced for r in alarms.debounce(df, 2, h).collect()}
            old = spark.createDataFrame(
                [(q, w, s, t, p, whole[(q, w)] if w < 150 else None) for q, w, s, t, p in rows if w >= 140],
                "qfi int, window int, score double, thr double, pred int, known int",
            )
        again = alarms.debounce(old, 2, h, block_rows=8, known="known")
        assert all(r.debounced == whole[(r.qfi, r.window)] for r in again.collect())


def test_debounce_rejects_k(scored):
    with pytest.raises(ValueError):
        alarms.debounce(scored[1], 0)


def test_medians_of_small_and_hot_groups(spark):
    rng = random.Random(2)
    groups = {
        "one": [4.0],
        "two": [1.0, 2.0],
        "ties": [3.0] * 50 + [9.0],
        "hot": [rng.lognormvariate(0, 2) for _ in range(40_001)],
        "hot ties": [float(rng.randrange(3)) for _ in range(30_000)],
        "hot even": [rng.random() for _ in range(20_000)],
    }
    rows = [(g, v, -v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(8)
    for r in grouped_medians(df, ["g"], ["a", "b"]).collect():
        assert r.a == statistics.median(groups[r.g])
        assert r.b == -statistics.median(groups[r.g])


def test_runner_up(spark):
    rows = [("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 1.0), ("b", 1, 2.0), ("c", 1, 0.0), ("c", 2, 7.0)]
    df = spark.createDataFrame(rows, "g string, id int, v double")
    got = {r.g: r.second for r in runner_up(df, ["g"], "v", "id", "second").collect()}
    assert got == {"a": 5.0, "c": 0.0}


def test_runner_up_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id", "CAST(id AS DOUBLE) AS v")
    plan = runner_up(df, ["g"], "v", "id", "second")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
