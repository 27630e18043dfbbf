"""What near-duplicate removal and mixing put on disk: texts that are not shuffled again, few rows for sizes of any range."""

import random
from collections import Counter

import pytest
from corpus import copied_rows, hard_rows, table, words
from pyspark.sql import functions as F
from test_corpora import brute_components, shingle_set

from tunnelscope.llm import jaccard, lookup, mixture, repeats


@pytest.fixture
def no_small_joins(spark):
    """Spark broadcasts nothing by itself, as with tables of any size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def joins_by_shuffle(df):
    return df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")


def test_texts_are_shuffled_once_at_most(spark, no_small_joins):
    docs = table(spark, hard_rows() + copied_rows(2, 6))
    assert joins_by_shuffle(jaccard.one_of_each(docs)) == 0
    assert joins_by_shuffle(mixture.mixed_documents(docs)) == 0


@pytest.mark.parametrize(("bits", "broadcast"), [(1 << 23, False), (1, True)])
def test_one_of_each_however_rows_are_looked_up(spark, monkeypatch, bits, broadcast):
    """All hash classes of ids are one, and numbers of rows are joined by shuffle."""
    monkeypatch.setattr(lookup, "FILTER_BITS", bits)
    if not broadcast:
        monkeypatch.setattr(jaccard, "small_side", lambda df: df)
    rows = hard_rows() + copied_rows(3, 30)
    ids = {i: shingle_set(t, 5) for i, t, *_ in rows if i is not None}
    got = Counter(r["doc_id"] for r in jaccard.one_of_each(table(spark, rows).repartition(7)).collect())
    assert got == Counter({*brute_components(ids, 80, 100).values(), None})


def test_bits_hold_numbers_of_all_partitions(spark):
    numbers = [0, 1, 7, 32767, 32768, 32769, (5 << 33), (5 << 33) + 1, (9 << 33) + 40000]
    rows = spark.createDataFrame([(n, f"t{n}") for n in numbers], "_key bigint, text string")
    for some in (numbers[::2], numbers[1::2], numbers, []):
        keys = spark.createDataFrame([(n,) for n in some], "_key bigint")
        assert sorted(r["_key"] for r in jaccard._numbered(rows, keys).collect()) == sorted(some)


def test_sizes_that_may_be_linked_are_few_classes(spark):
    """Sets of 20,000 words may be linked with those of 4,000 sizes: the join takes a row for a class of them, and each is in one of these."""
    sizes = spark.range(1, 20001).select(F.col("id").alias("n"), F.ceil(F.col("id") * 80 / 100).alias("least"))
    ends = [jaccard._size_class(F.col(c)).alias(f"_{c}") for c in ("least", "n")]
    of = {r["n"]: (r["least"], r["_least"], r["_n"]) for r in sizes.select("n", "least", *ends).collect()}
    assert max(hi - lo for _, lo, hi in of.values()) <= 14
    assert all(of[n][2] <= of[n + 1][2] for n in range(1, 20000)) and all(of[n][2] == n for n in range(1, 64))
    assert all(of[least][2] == lo for least, lo, _ in of.values())


def test_large_regions_of_many_sizes(spark, monkeypatch):
    """Pairs of texts that begin alike and go on to lengths of their own are those of brute force."""
    monkeypatch.setattr(jaccard, "LEAF", 3)
    rng = random.Random(11)
    base = words(rng, 400).split()
    rows = [(i, " ".join(base[: 60 + 8 * i] + words(rng, rng.randint(0, 9)).split()), "en", "a") for i in range(42)]
    sets = {i: shingle_set(t, 5) for i, t, *_ in rows}
    got = {r["doc_id"]: r["component_id"] for r in jaccard.components_of(table(spark, rows), 5, 97, 100).collect()}
    assert got == brute_components(sets, 97, 100)


def test_texts_without_repeats_are_not_shuffled(spark):
    rng = random.Random(12)
    same = words(rng, 90)
    rows = [(i, words(rng, 90), "en", "a") for i in range(40)] + [(100 + i, f"{words(rng, 9)} {same}", "en", "a") for i in range(3)] + [(200, None, "en", "a")]
    out = repeats.without_repeats(table(spark, rows), 240)
    assert {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] not in (100, 101, 102)} == {i: t for i, t, *_ in rows if i not in (100, 101, 102)}
    assert all(len(r["text"]) < 90 for r in out.collect() if r["doc_id"] in (100, 101, 102))
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("bits", [1 << 23, 1])
def test_repeats_however_rows_are_looked_up(spark, monkeypatch, bits):
    monkeypatch.setattr(lookup, "FILTER_BITS", 1 << 23)
    docs = table(spark, hard_rows() + copied_rows(3, 10))
    want = sorted(map(repr, repeats.repeat_digests(docs, 99).collect()))
    monkeypatch.setattr(lookup, "FILTER_BITS", bits)
    assert sorted(map(repr, repeats.repeat_digests(docs, 99).collect())) == want
