"""Exact duplicates against brute force, with a hash that collides too."""

import hashlib
from collections import defaultdict

import pytest
from corpus import SCHEMA, copied_rows, hard_rows, table
from pyspark.sql import functions as F

from tunnelscope.llm import exact

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
ROWS = hard_rows() + copied_rows(2, 4) + [
    (700, "Érer ÉTÉ İ", "fr", "a"), (701, "éRER ÉTÉ İ", "fr", "a"), (702, "ÉRER ÉTÉ İ", "fr", "a"), (703, "One Two", "en", "b"),
    (None, "ONE two", "en", "b"), (None, "no ID here", "en", "a"), (704, "One Two", "en", "b"), (704, "One Two", "en", "b"), (705, "", None, None),
]


def brute(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[(text or "").translate(UPPER)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        ordered = sorted(ids, key=lambda i: (i == keep, -1 if i is None else i))
        out += [(i, keep, len(ids), k == len(ids) - 1, digest) for k, i in enumerate(ordered)]
    return sorted(map(repr, out))


def weak(text):
    """Four values for all texts."""
    return F.encode((F.octet_length(text) % 4).cast("string"), "utf-8")


@pytest.mark.parametrize("digest", [exact.content_hash, weak])
def test_marked_copies(spark, digest):
    got = exact.marked_copies(table(spark, ROWS), digest).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(ROWS)


@pytest.mark.parametrize("digest", [exact.content_hash, weak])
def test_kept_rows_have_all_columns(spark, digest):
    docs = table(spark, ROWS)
    out = exact.without_copies(docs, digest)
    assert out.columns == docs.columns
    kept = [r for r in brute(ROWS) if ", True," in r]
    assert out.count() == len(kept) == len({(r[1] or "").translate(UPPER) for r in ROWS})


def test_a_hot_class_and_a_long_text(spark):
    rows = [(i, "Same", "en", "a") for i in range(400)] + [(1000, "x" * 3_000_000, "en", "a"), (1001, "X" * 3_000_000, "en", "a")]
    got = exact.marked_copies(table(spark, rows)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)


def test_empty_table(spark):
    assert exact.marked_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    assert exact.without_copies(spark.createDataFrame([], SCHEMA)).count() == 0
