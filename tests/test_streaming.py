"""Streams give the results of the batch plans."""

import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunnelscope.operators import alarms, tunnels
from tunnelscope.plans import detection
from tunnelscope.plans import standin as S
from tunnelscope.session import scratch_path
from tunnelscope.sources import windows, windowstream
from tunnelscope.streaming import thresholds as limits
from tunnelscope.streaming.detect import DetectionStream, read_sketch_stream, read_stream_events
from tunnelscope.streaming.episodes import EpisodeStream


def test_detection_in_batches(spark):
    sketch, keys = S.sketch(spark, SMALL), S.keys(spark, SMALL).cache()
    sketch = sketch.where("window < 60 AND window <> 31").cache()
    batch = detection.detect(sketch, keys, S.BINS, S.FEAT_COLS, S.MODEL, S.CONFIG)
    want = {(r.window, r.qfi): (r.score, r.pred, r.debounced) for r in batch.collect()}

    snapshots, key_files = scratch_path(spark, "cms"), scratch_path(spark, "keys")
    windows.write_flow_keys(keys, key_files)
    events, progress = scratch_path(spark, "events"), scratch_path(spark, "progress")
    job = DetectionStream(
        key_files, scratch_path(spark, "state"), events, S.BINS, S.FEAT_COLS, S.MODEL, S.CONFIG
    )
    for n, (lo, hi) in enumerate(((0, 3), (3, 40), (40, 60))):
        part = sketch.where(F.col("window").between(lo, hi - 1))
        windows.write_sketch(part, f"{snapshots}/{n}")
        source = read_sketch_stream(spark, snapshots, S.CONFIG, 10_000)
        job.start(source, progress).trigger(availableNow=True).start().awaitTermination()
    got = {
        (r.window, r.qfi): (r.score, r.pred, r.debounced)
        for r in read_stream_events(spark, events).collect()
    }
    assert got.keys() == want.keys()
    for key, (score, pred, debounced) in want.items():
        assert got[key][0] == pytest.approx(score) and got[key][1:] == (pred, debounced)

    late = sketch.where("window = 5")
    windows.write_sketch(late, f"{snapshots}/late")
    source = read_sketch_stream(spark, snapshots, S.CONFIG, 10_000)
    with pytest.raises(Exception, match="after later ones"):
        job.start(source, progress).trigger(availableNow=True).start().awaitTermination()


def run(writer):
    started = writer.trigger(processingTime="0 seconds").start()
    started.processAllAvailable()
    started.stop()


def test_window_files_come_in_order(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for w in (30, 4, 100, 5, 7, 6):  # written in this order
        (folder / f"window_{w}.parquet").write_bytes(b"x")
    (folder / "_SUCCESS").write_bytes(b"")
    (folder / ".window_3.parquet.crc").write_bytes(b"")
    seen = []

    def step(batch, batch_id):
        seen.append((batch_id, sorted(r.window for r in batch.collect())))

    def start():
        files = windowstream.read_window_stream(spark, str(folder), 2)
        run(files.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "progress")))

    start()
    assert [w for _, w in seen] == [[4, 5], [6, 7], [30, 100]]
    # A restart goes on behind the last window; what comes late stays out and is told.
    for w in (101, 99, 8):
        (folder / f"window_{w}.parquet").write_bytes(b"x")
    start()
    assert [w for _, w in seen[3:]] == [[101]]
    processed = spark.createDataFrame([(w,) for _, ws in seen for w in ws], "window int")
    late = windowstream.late_files(spark, str(folder), processed)
    assert {r.window for r in late.collect()} == {8, 99}


def test_rows_of_files_that_differ(spark, tmp_path):
    spark.createDataFrame([(1, "2.5")], "a int, b string").coalesce(1).write.parquet(f"{tmp_path}/window_1.parquet")
    spark.createDataFrame([(7,)], "a bigint").coalesce(1).write.parquet(f"{tmp_path}/window_12.parquet")
    files = windows.window_files(spark, str(tmp_path))
    rows = windowstream.read_rows(files.select("window", "path"), T._parse_datatype_string("a bigint, b double"), 2)
    assert {tuple(r) for r in rows.collect()} == {(1, 1, 2.5), (12, 7, None)}


def scored_rows():
    rows = []
    for qfi in (1, 2, 3):
        for w in range(40):
            score = 0.9 if (w // (4 + qfi)) % 2 else (0.45 if w % 3 == 0 else 0.1)
            rows.append((w, qfi, score, 0.5, int(score >= 0.5)))
    return [r for r in rows if r[1] != 3 or r[0] > 33]  # the third class comes late and stays on


SCORED = "window int, qfi int, score double, thr double, pred int"


@pytest.mark.parametrize("cuts", [[0, 40], [0, 3, 7, 8, 21, 40], [0, 20, 39, 40]])
def test_episodes_in_batches(spark, cuts):
    rows = scored_rows()
    batch = alarms.debounce(spark.createDataFrame(rows, SCORED), 2, 0.8).cache()
    job = EpisodeStream(scratch_path(spark, "alarms"), 2, 0.8)
    for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        part = spark.createDataFrame([r for r in rows if lo <= r[0] < hi][::-1], SCORED)
        job.step(part, n)
        if n % 2:
            job.step(part, n)  # a batch that is run again writes the same
        # A run that stops here has closed its episodes at the last window so far.
        now = batch.where(F.col("window") < hi)
        assert sorted(map(tuple, job.episodes(spark).collect())) == sorted(map(tuple, alarms.episodes(now).collect()))
    got = {(r.window, r.qfi): r.debounced for r in job.events(spark).collect()}
    assert got == {(r.window, r.qfi): r.debounced for r in batch.collect()}
    job.step(spark.createDataFrame([(3, 1, 0.9, 0.5, 1), (41, 1, 0.9, 0.5, 1)], SCORED), len(cuts) - 1)
    assert {r.window for r in job.late(spark).collect()} == {3}
    assert job.events(spark).where("window = 41").count() == 1


def test_thresholds_from_keyed_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", limits.STATE_STORE)
    rng = random.Random(8)
    rows = [(w, q, t, rng.random() * 9, rng.random() * 50) for w in range(24) for q in (1, 2) for t in (5, 6, 7) if rng.random() < 0.7]
    schema = "window int, qfi int, teid bigint, lat_p95_ms double, iat_p10_us double"
    table = spark.createDataFrame(rows, schema)
    named = table.withColumn("file", F.format_string("window_%d.parquet", "window")).repartition("file")
    named.drop("window").write.partitionBy("file").parquet(f"{tmp_path}/tunnels")
    files = windowstream.read_window_stream(spark, f"{tmp_path}/tunnels", 6)
    rest = T._parse_datatype_string("qfi int, teid bigint, lat_p95_ms double, iat_p10_us double")
    found = limits.stream_thresholds(windowstream.read_rows(files, rest, 2))
    progress = f"{tmp_path}/progress"
    run(found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", progress))
    got = {(r.window, r.qfi, r.teid): (r.thr_lat_ms, r.thr_iat_us) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.window, r.qfi, r.teid): (r.thr_lat_ms, r.thr_iat_us) for r in tunnels.rolling_thresholds(table, S.CONFIG).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    # The state holds the last five rows of each tunnel and no more.
    state = spark.read.format("statestore").option("path", progress).option("stateVarName", limits.RECENT).load()
    held = {tuple(r["key"]): r["count"] for r in state.groupBy("key").count().collect()}
    assert held == {k: min(5, sum(r[1:3] == k for r in rows)) for k in {r[1:3] for r in rows}}


def test_detection_over_files_in_batches(spark, tmp_path):
    sketch, keys = S.sketch(spark, SMALL), S.keys(spark, SMALL).cache()
    sketch = sketch.where("window < 48").cache()
    batch = detection.detect(sketch, keys, S.BINS, S.FEAT_COLS, S.MODEL, S.CONFIG)
    want = {(r.window, r.qfi): (r.score, r.pred, r.debounced) for r in batch.collect()}
    snapshots, key_files, state, events, progress = (str(tmp_path / n) for n in ("cms", "keys", "state", "events", "progress"))
    windows.write_flow_keys(keys, key_files)

    def start():
        job = DetectionStream(key_files, state, events, S.BINS, S.FEAT_COLS, S.MODEL, S.CONFIG)
        run(job.start_files(windowstream.read_window_stream(spark, snapshots, 12), progress))
        return job

    # Keys are text in the first files, and measures doubles: each batch is read as in a batch run.
    typed = sketch.where("window < 24").withColumns({c: F.col(c).cast("string") for c in ("qid", "row", "bucket")}).withColumn("pkt_cnt", F.col("pkt_cnt").cast("double"))
    windows.write_sketch(typed, f"{snapshots}/first")
    job = start()
    # Stopped after two batches: the windows and classes so far are those of the events.
    so_far = {r.window: set(r.classes) for r in job.processed(spark).collect()}
    assert so_far == {w: {q for v, q in want if v == w} for w in {w for w, _ in want if w < 24}}
    windows.write_sketch(sketch.where("window >= 24"), f"{snapshots}/second")
    start()
    got = {(r.window, r.qfi): (r.score, r.pred, r.debounced) for r in read_stream_events(spark, events).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == pytest.approx(want[k][0]) and got[k][1:] == want[k][1:] for k in want)
    batches = {r[0] for r in spark.read.json(events).select("batch").distinct().collect()}
    assert len(batches) == 4
