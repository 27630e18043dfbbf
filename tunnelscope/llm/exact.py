"""Exact duplicates: groups of a 128-bit content hash, whose members' bytes are compared before they count as copies.

Texts are equal when they are identical after A-Z are lower-cased. Rows are grouped by the MD5 of that form. A group is free of collisions
if its least and its greatest text are the same bytes; both are taken in one aggregation that combines before the shuffle, so
a group of any size costs one text per task. Groups with collisions are grouped anew by the text itself. Of each class
one row stays: that of the largest id, and among rows with that id the one numbered last when the table was read.

A class that holds at least one of ``HOT_SHARE`` rows is looked up by broadcast (there are at most so many); rows of
other classes are joined by shuffle. No task gets the rows of a hot class.

Defined cases: a null text counts as empty; a null id is smaller than any other, and a class without any id has a null ``keep_id``; of rows that
repeat, ids included, exactly one is kept; an empty table gives an empty result; other columns are left out
by ``marked_copies`` and kept by ``without_copies``.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small_side

# A class with at least this part of all rows is hot, so there are at most so many hot classes.
HOT_SHARE = 1000


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased. A text of ASCII alone takes the short way."""
    filled = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(filled) == F.char_length(filled)
    return F.when(ascii_only, F.lower(filled)).otherwise(F.translate(filled, ascii_uppercase, ascii_lowercase))


def content_hash(text: Column) -> Column:
    """128 bits of the text's content."""
    return F.unhex(F.md5(text))


def _kept(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per class its size and the row that stays."""
    best = F.max(F.struct("doc_id", "_row"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), best.alias("_best"))


def _joined(rows: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with their class. Hot classes are at most ``HOT_SHARE`` rows, whatever the table."""
    least = rows.count() / HOT_SHARE
    hot = F.broadcast(classes.filter(F.col("_n") >= F.lit(least)))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(classes.filter(F.col("_n") < F.lit(least)), keys)
    return rows.join(hot, keys).unionByName(rest)


def _read(docs: DataFrame, columns: list[str], digest: Callable[[Column], Column]) -> DataFrame:
    """Rows with a number of their own and the hash of their text, as a table: the numbers don't change any more."""
    named = docs.select(*columns, digest(normalised(F.col("text"))).alias("_hash"))
    return cut(named.withColumn("_row", F.monotonically_increasing_id()), "hashes")


def _classified(docs: DataFrame, columns: list[str], digest: Callable[[Column], Column]) -> DataFrame:
    rows = _read(docs, columns, digest)
    text = normalised(F.col("text"))
    compared = (
        docs.select(digest(text).alias("_hash"), text.alias("_text"))
        .groupBy("_hash")
        .agg(F.min("_text").alias("_least"), F.max("_text").alias("_most"))
        .select("_hash", (F.col("_least") == F.col("_most")).alias("_same"), F.sha2("_least", 256).alias("text_sha256"))
    )
    classes = cut(compared.join(_kept(rows, ["_hash"]), "_hash"), "classes")
    collided = classes.filter("NOT _same").select("_hash")
    found = _joined(rows, classes.filter("_same").drop("_same"), ["_hash"])
    if collided.isEmpty():
        return found
    # Other texts with the same hash: the text itself is the key of the class.
    few = docs.select("*", digest(text).alias("_hash"), text.alias("_text")).join(small_side(collided), "_hash", "left_semi")
    rows = cut(few.select(*columns, "_hash", "_text", F.monotonically_increasing_id().alias("_row")), "collided")
    keys = ["_hash", "_text"]
    by_text = cut(_kept(rows, keys).withColumn("text_sha256", F.sha2("_text", 256)), "classes-by-text")
    return found.unionByName(_joined(rows, by_text, keys).drop("_text"))


def marked_copies(docs: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (of the lower-cased text)."""
    found = _classified(docs, ["doc_id"], digest)
    kept = F.col("_row") == F.col("_best._row")
    return found.select("doc_id", F.col("_best.doc_id").alias("keep_id"), F.col("_n").alias("group_size"), kept.alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return _classified(docs, docs.columns, digest).filter(F.col("_row") == F.col("_best._row")).select(*docs.columns)
