"""Register blocks: results of the min query, plans without further shuffles, and the switch's addressing."""

import dataclasses
import random
import uuid

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tunnelscope.config import SketchGeometry
from tunnelscope.functions import hashing
from tunnelscope.operators import blocks, minquery
from tunnelscope.operators import packets as pk
from tunnelscope.operators import sketch as sk
from tunnelscope.plans import standin as S
from tunnelscope.session import cut, scratch_path
from tunnelscope.sources import windows

G = S.CONFIG.geometry


@pytest.fixture(scope="module")
def built(spark):
    return S.sketch(spark, SMALL)


@pytest.fixture(scope="module")
def keys(spark):
    return cut(S.keys(spark, SMALL), "keys")


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture
def large_sides(spark):
    """Both sides of a join count as large, as they are on a real table."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def above(text, leaf, top):
    """Operators between a leaf of a printed plan and the next ``top`` above it."""
    lines = text.splitlines()
    place = lambda line: next(i for i, c in enumerate(line) if c.isalpha())
    at = next(i for i, line in enumerate(lines) if leaf(line))
    out, indent = [], place(lines[at])
    for line in reversed(lines[:at]):
        if any(c.isalpha() for c in line) and place(line) < indent:
            indent = place(line)
            if top in line:
                return out
            out.append(line)
    raise AssertionError(f"no {top}")


@pytest.mark.parametrize("copies", [1, 3])
def test_blocks_give_the_min_query(built, keys, copies):
    odd = keys.unionByName(keys.where("qfi = 1")).unionByName(keys.limit(3).withColumn("teid", F.lit(-5).cast("bigint")))
    got = blocks.block_query(blocks.dense_blocks(built, G), odd, G, copies)
    assert rows(got) == rows(minquery.min_query(built, odd, G))


def test_sparse_full_and_foreign_cells(spark):
    g = SketchGeometry(depth=2, width=4, lat_bins=1, iat_bins=1)
    cells = [(1, 0, r, b, 10 * r + b) for r in range(2) for b in range(4)]  # every cell
    cells += [(2, 0, 0, 1, 7), (2, 0, 1, 3, 5), (3, 0, 0, 0, 1), (3, 0, 1, 9, 1), (3, 0, 5, 0, 1), (3, -1, 0, 0, 1)]
    table = spark.createDataFrame(cells, "window int, qid int, row int, bucket int, pkt_cnt bigint")
    dense = blocks.dense_blocks(minquery.clean_sketch(table, g), g)
    got = {(r.window, r.qid): list(r.pkt_cnt) for r in dense.collect()}
    assert got == {(1, 0): [0, 1, 2, 3, 10, 11, 12, 13], (2, 0): [0, 7, 0, 0, 0, 0, 0, 5], (3, 0): [1] + [0] * 7, (3, -1): [1] + [0] * 7}


def test_one_exchange_per_side(spark, built, keys, large_sides):
    dense = cut(blocks.dense_blocks(built, G), "dense")
    text = final_plan(blocks.block_query(dense, keys, G))
    assert text.count("Exchange hashpartitioning") == 2 and "Generate" not in text


def test_stored_blocks_are_not_shuffled_and_skip_ranges(spark, built, keys, large_sides):
    table = f"blocks_{uuid.uuid4().hex}"
    windows.save_blocks(blocks.dense_blocks(built, G), table, 4, 16, scratch_path(spark, "stored"))
    some = keys.where("window BETWEEN 20 AND 40 AND qfi = 2")
    found = blocks.block_query(spark.table(table), some, G, buckets=4, range_windows=16)
    assert rows(found) == rows(minquery.min_query(built, some, G))
    text = final_plan(found)
    scan = next(line for line in text.splitlines() if "FileScan" in line and table in line)
    assert "dynamicpruning" in scan.lower()
    assert not [line for line in above(text, lambda line: line == scan, "SortMergeJoin") if "Exchange" in line]


def bitwise(teid, qfi, row):
    key = row << 38 | teid << 6 | qfi
    return hashing.crc16(key.to_bytes(5, "big"))


def test_known_checksum():
    assert hashing.crc16(b"123456789") == 0xBB3D


def test_switch_addresses(spark):
    rng = random.Random(3)
    flows = [(rng.randrange(2**32), rng.randrange(64), rng.randrange(4)) for _ in range(300)] + [(0, 0, 0), (2**32 - 1, 63, 3), (5, 64 + 9, 1)]
    df = spark.createDataFrame(flows, "teid bigint, qfi int, row int")
    for r in df.select("*", hashing.switch_crc("teid", "qfi", "row").alias("c"), hashing.switch_bucket("teid", "qfi", "row", 512).alias("b")).collect():
        want = bitwise(r.teid, r.qfi & 63, r.row)
        assert (r.c, r.b) == (want, want & 511)


def test_switch_geometry_is_checked():
    with pytest.raises(ValueError, match="power of two"):
        hashing.flow_bucket("t", "q", "r", SketchGeometry(3, 500, hashing="switch"))
    with pytest.raises(ValueError, match="two bits"):
        hashing.flow_bucket("t", "q", "r", SketchGeometry(5, 512, hashing="switch"))
    with pytest.raises(ValueError, match="no hash"):
        hashing.flow_bucket("t", "q", "r", SketchGeometry(hashing="other"))


def test_flows_that_collide_once_collide_in_all_rows(spark):
    # The checksum is linear: flows of equal buckets in one row have equal buckets in each, and are estimated by their sum.
    g = dataclasses.replace(G, width=512, hashing="switch")
    sent = S.packets(spark, SMALL).withColumn("qid", F.col("egress_qid"))
    built = cut(sk.build(sent, S.BINS, g, S.SLICE_US), "wide")
    got = blocks.block_query(blocks.dense_blocks(built, g), S.keys(spark, SMALL), g).select("window", "qid", "teid", "qfi", "pkt_cnt")
    bucket = hashing.flow_bucket("teid", "qfi", "2", g).alias("b")
    sums = sent.where("meter_color <> 3").groupBy("window", "qid", bucket).agg(F.count("*").alias("n"))
    off = got.withColumn("b", bucket).join(sums, ["window", "qid", "b"], "left").where("pkt_cnt <> coalesce(n, 0)")
    assert off.count() == 0


def test_first_entry(spark):
    sent = spark.createDataFrame([(1, 1, 2, 17, 80, 443), (2, 1, 2, 17, 81, 443), (3, 1, 2, 6, 80, 443), (4, 9, 9, 17, 1, 1)], "id int, src_addr bigint, dst_addr bigint, protocol int, src_port bigint, dst_port bigint")
    entries = [
        (10, 0, 0, 0, 0, 5), (11, 80, 0xFFFF, 0, 0, 5), (12, 80, 0xFFFF, 443, 0xFFFF, 1), (13, 80, 0xFFFF, 443, 0xFFFF, 1), (14, 0x50, 0xF0, 0, 0, 3),
    ]
    table = spark.createDataFrame([(i, 1, 2, 17, *rest) for i, *rest in entries], "entry_id int, src_addr bigint, dst_addr bigint, protocol int, src_port_value bigint, src_port_mask bigint, dst_port_value bigint, dst_port_mask bigint, priority int")
    got = {r.id: r.entry_id for r in pk.first_entry(sent, table).collect()}
    assert got == {1: 12, 2: 14, 3: None, 4: None}
    assert pk.first_entry(sent, table).columns == [*sent.columns, "entry_id"]
    # Without priorities the lower id is first; an empty list matches nothing.
    assert {r.id: r.entry_id for r in pk.first_entry(sent, table.drop("priority")).collect()} == {1: 10, 2: 10, 3: None, 4: None}
    assert pk.first_entry(sent, table.limit(0)).where("entry_id IS NOT NULL").count() == 0


def test_ranges_that_overlap(spark):
    rng = random.Random(7)
    installed = [(q, lo := rng.randrange(0, 3000), lo + rng.choice([0, 3, 200, 1500]), rng.randrange(8), rng.randrange(5)) for q in (0, 1) for _ in range(120)]
    installed += [(0, 65_000, 70_000, 6, 0), (0, -5, 2, 5, 9), (1, 50, 40, 1, 0)]
    ranges = spark.createDataFrame(installed, "qid int, lo bigint, hi bigint, bin int, priority int")
    asked = [(q, v) for q in (0, 1, 2) for v in [*rng.sample(range(5000), 300), 0, 65_535, 66_000, -1, None]]
    values = spark.createDataFrame(asked, "qid int, v bigint")
    for table, rank in ((ranges, lambda r: (r[4], r[1], r[2], r[3])), (ranges.drop("priority"), lambda r: (r[1], r[2], r[3]))):
        got = {(r.qid, r.v): r.b for r in pk.range_bin(values, table, "v", 7, "b").collect()}
        for q, v in asked:
            fit = [r for r in installed if v is not None and 0 <= v < 65_536 and r[0] == q and r[1] <= v <= r[2]]
            assert got[q, v] == (min(fit, key=rank)[3] if fit else 7), (q, v)
        disjoint = pk.elementary_intervals(table).collect()
        for a in disjoint:
            assert not any(b.qid == a.qid and b.lo <= a.hi and a.lo <= b.hi for b in disjoint if b is not a)
