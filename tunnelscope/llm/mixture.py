"""Mixing sources to target weights.

Every document gets a hash key. Within each source, documents are range-sorted by that key and a
distributed prefix sum of their sizes tells where the budget of the source ends: whole epochs first, then
documents in key order up to the cut, which falls inside one document, so that the budget is met exactly.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is a source of
its own and comes last; rows that repeat are documents of their own; an empty table gives an empty mix. A source
without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side
from .scans import with_prefix_sums

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Target per source: ``share`` of all sizes by weight, at most ``max_epochs`` times a source's size.

    ``sizes`` has one row per source (source, null_source, source_size). Sources are filled by the level at which
    they are full (size over weight): those below the common level are full, the rest share what is left. The
    windows here run over one row per source.
    """
    by_name = Window.orderBy("null_source", "source")
    n = len(weights)
    picked = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int"))
    # All kept whole: budgets in words, caps in words, weights as given.
    s = sizes.withColumn("weight", picked.cast("bigint")).withColumn("cap", F.col("source_size") * max_epochs)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    by_level = Window.orderBy((F.col("cap") / F.col("weight")), "null_source", "source")
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    beyond = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("_all", total)
    s = s.withColumn("_left", F.col("_all") - F.coalesce(F.sum("cap").over(upto), F.lit(0)))
    s = s.withColumn("_fair", F.col("_left") / F.sum("weight").over(beyond))
    # A source is full while the level of those after it reaches its own. The first that isn't sets the level of all after it.
    s = s.withColumn("_pos", F.row_number().over(by_level)).withColumn("_open", F.col("cap") > F.col("_fair") * F.col("weight"))
    whole = Window.partitionBy()
    s = s.withColumn("_first", F.min(F.when(F.col("_open"), F.col("_pos"))).over(whole))
    level = F.max(F.when(F.col("_pos") == F.col("_first"), F.col("_fair"))).over(whole)
    full = F.col("_first").isNull() | (F.col("_pos") < F.col("_first"))
    target = F.when(full, F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return s.select("source", "null_source", "source_size", target.alias("target"))


def _planned(docs: DataFrame, keep: list[str], seed: int, share: float, max_epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """One row per row of ``docs``: its columns ``keep`` in the struct ``_row``, and what the mix takes of it.

    If texts are kept, they are shuffled once, to be in order.
    """
    texts = "text" in keep
    sized = docs.select(
        F.struct(*keep).alias("_row"),
        F.col("doc_id").alias("_id"),
        F.coalesce("source", F.lit("")).alias("_source"),
        F.col("source").isNull().alias("_null"),
        word_count(F.col("text")).alias("_size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("_key"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_text_key"),
    ).withColumn("_group", F.concat(F.col("_null").cast("int").cast("string"), "_source"))
    scanned = with_prefix_sums(sized, "_group", ["_key", "_id", "_text_key"], "_size", "_before", whole_rows=texts)
    sizes = scanned.groupBy(F.col("_source").alias("source"), F.col("_null").alias("null_source")).agg(F.sum("_size").alias("source_size"))
    targets = source_targets(sizes, share, max_epochs, weights).withColumnsRenamed({"source": "_source", "null_source": "_null", "source_size": "_whole", "target": "_target"})
    budget = F.round("_target").cast("bigint")
    whole = F.when(F.col("_whole") > 0, F.floor(budget / F.col("_whole"))).otherwise(F.lit(0)).cast("bigint")
    out = scanned.join(small_side(targets) if texts else targets, ["_source", "_null"]).withColumn("_epochs", whole)
    out = out.withColumn("_rest", budget - F.col("_epochs") * F.col("_whole") - F.col("_before"))
    return out.withColumn("_partial", F.greatest(F.lit(0).cast("bigint"), F.least("_size", "_rest")))


def mix(docs: DataFrame, seed: int = 0, share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, epochs (whole copies), partial (words of one more copy), taken.

    ``docs`` has doc_id, text and source; other columns are left out. Runs agree: keys depend on ``seed``, doc_id and, for ids
    that repeat, the text.
    """
    return _planned(docs, ["doc_id", "source"], seed, share, max_epochs, weights).select(
        "_row.doc_id",
        "_row.source",
        F.col("_size").alias("size"),
        F.col("_whole").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_epochs").alias("epochs"),
        F.col("_partial").alias("partial"),
        (F.col("_epochs") * F.col("_size") + F.col("_partial")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, seed: int = 0, share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document once per whole epoch, and the document at the cut up to its last taken word.

    Documents of which nothing is taken go; ``n_chars``, where there is such a column, follows the text.
    """
    plan = _planned(docs, docs.columns, seed, share, max_epochs, weights)
    lead = F.regexp_substr(F.col("_row.text"), F.concat(F.lit(r"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){"), F.col("_partial").cast("string"), F.lit("}+")))
    whole, part = F.col("_partial") == F.col("_size"), F.col("_partial") > 0
    copies = F.when(F.col("_size") > 0, F.col("_epochs")).otherwise(F.lit(0)) + F.when(whole & part, 1).otherwise(0)
    full = plan.filter(copies > 0).select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)).alias("_copy")).select("_row.*")
    # At most one document per source is cut.
    cut_off = plan.filter(part & ~whole).select("_row", lead.alias("_text"))
    changed = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("bigint")}
    cut_off = cut_off.select(*[changed.get(c, F.col(f"_row.{c}")).alias(c) for c in docs.columns])
    return full.unionByName(cut_off)
