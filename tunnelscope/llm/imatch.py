"""I-Match fingerprints, in DataFrame operations only.

Terms are lower-cased words. A lexicon keeps those whose document frequency lies in a band: neither rare (typing errors,
names) nor common (function words). The lexicon is dealt at random to subsets,
and a document's fingerprint has one hash for each subset: of its sorted, distinct terms in that subset. A small change of text touches few terms, so most subsets keep their hash.

The lexicon's size is bounded by the band, not by the corpus: terms found in at least one of ``1 / LOWEST`` documents are at
most the mean number of distinct terms per document divided by ``LOWEST``. It goes into the plan as a set of hashes, so documents are never shuffled
for their terms.

Defined cases: null and empty texts have the fingerprint of no terms; a text without lexicon terms is fingerprinted by all its
terms; equal texts have equal fingerprints; rows that repeat get one each; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import partitions_of

# Document frequencies of the band, as parts of all documents.
LOWEST, HIGHEST = 1 / 200, 1 / 20
# The lexicon is dealt at random to this many subsets.
SUBSETS = 64
# A text with fewer lexicon terms is fingerprinted by all its terms.
LEAST_TERMS = 3
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased words."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE))
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, lowest: float = LOWEST, highest: float = HIGHEST) -> list[int]:
    """Hashes of the terms in the band, from the counts of all documents."""
    n = docs.count()
    counted = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # At most (mean distinct terms per document) / lowest rows.
    band = counted.filter((F.col("df") >= max(2.0, lowest * n)) & (F.col("df") <= max(2.0, highest * n)))
    return sorted(r["term"] for r in band.select("term").collect())


def fingerprint(text: Column, chosen: list[int], subsets: int = SUBSETS) -> Column:
    """One field per subset, joined by ``-``: its hash in hexadecimal, empty where the text has no term of the subset.

    One more field hashes all terms where the others are empty.
    """

    def field(ts: Column) -> Column:
        return F.when(F.size(ts) > 0, F.lower(F.substring(F.hex(F.xxhash64(ts)), -8, 8))).otherwise(F.lit(""))

    def fields(dealt: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.lit(subsets - 1)), lambda k: field(F.filter(dealt, lambda x: x["subset"] == k)))
        return let(F.array_join(each, "-"), lambda joined: F.concat(joined, F.lit("-"), F.when(F.length(joined) < subsets, field(dealt)).otherwise(F.lit(""))))

    def of(ts: Column) -> Column:
        subset = lambda t: F.pmod(F.xxhash64(t, F.lit("subset")), F.lit(subsets)).cast("int")
        return let(F.transform(ts, lambda t: F.struct(subset(t).alias("subset"), t.alias("term"))), fields)

    def used(every: Column) -> Column:
        kept = F.filter(every, lambda t: t.isin(chosen)) if chosen else F.array().cast("array<bigint>")
        return let(kept, lambda own: F.array_sort(F.when(F.size(own) >= LEAST_TERMS, own).otherwise(every)))

    return let(terms(text), lambda every: let(used(every), of))


def likeness(a: Column, b: Column) -> Column:
    """Part of the subsets with a hash in ``a`` or ``b`` that have the same; 1 for equal fingerprints, 0 to 1."""
    fields = F.zip_with(F.split(a, "-"), F.split(b, "-"), lambda x, y: F.when((x == "") & (y == ""), -1).otherwise((x == y).cast("int")))
    share = let(fields, lambda f: F.size(F.filter(f, lambda v: v == 1)) / F.size(F.filter(f, lambda v: v >= 0)))
    return F.when(a == b, F.lit(1.0)).otherwise(share)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with a struct ``next`` of the ``columns`` of the next row by doc_id, and of the first after the last.

    Rows are cut into ranges of doc_id at quantiles, each range is one window, and the first row of each range, a table
    of one row per range, serves the last row of the one before.
    """
    ranges = 4 * partitions_of(docs)
    parts = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = docs.select(F.percentile_approx("doc_id", parts, F.lit(10 * ranges))).first()[0] or []
    bounds = F.array(*[F.lit(c).cast("bigint") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    rows = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda c: c < F.col("doc_id")))))
    order = [F.col("doc_id").asc_nulls_first(), *[F.col(c) for c in columns]]
    own = F.struct(*columns)
    # The first row of each range: of its lowest doc_id, which few rows share.
    firsts = rows.groupBy(F.col("_range").alias("_r")).agg(F.min("doc_id").alias("_d"))
    heads = rows.join(F.broadcast(firsts), (F.col("_range") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    heads = heads.groupBy("_range").agg(F.min(own).alias("_own"))
    over = Window.orderBy("_range")
    everything = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("_range", F.coalesce(F.lead("_own").over(over), F.first("_own").over(everything)).alias("_head"))
    rows = rows.withColumn("_next", F.lead(own).over(Window.partitionBy("_range").orderBy(*order))).join(after, "_range")
    return rows.select(*docs.columns, F.coalesce("_next", "_head").alias("next"))


def fingerprints_of_edits(docs: DataFrame, lowest: float = LOWEST, highest: float = HIGHEST) -> DataFrame:
    """Per document its fingerprint and that of its edited text: the last quarter replaced by the beginning of the next document.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    chosen = lexicon(docs, lowest, highest)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next.text"), F.lit(1), quarter))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("text"), chosen))
    rows = with_next(rows, ["text", "fingerprint"]).withColumn("edited", edited)
    rows = rows.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        fingerprint(F.col("edited"), chosen).alias("edited_fingerprint"),
        F.col("next.fingerprint").alias("_next"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )
