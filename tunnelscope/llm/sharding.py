"""Longest-processing-time sharding of groups that must stay together.

Equal texts are one group. Groups larger than a fixed part of all bytes are scheduled one by one; all smaller groups are
dealt by hash to a fixed number of parcels, and a parcel is scheduled as one. Items (large groups
and parcels) go, largest first, to the least loaded shard through a heap. The number of items depends on the number of
shards alone: a group is large if it holds at least 1 / ``parts`` of all bytes, so there are at most ``parts`` of them, and as
many parcels. The loads differ by at most the largest item; without a huge group that is about one part.

Defined cases: null texts are one group (size 1 each, crc32 0), apart from empty texts; rows that repeat are one group; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .scans import with_prefix_sums

SHARDS = 8
PARTS_PER_SHARD = 1000


def schedule(items: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Shard of each (item, size): largest first to the least loaded shard, ties to the lower shard and item name."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        placed[name] = shard
    return placed


def shard_documents(docs: DataFrame, shards: int = SHARDS, parts_per_shard: int = PARTS_PER_SHARD) -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot (its place in the shard, by doc_id)."""
    spark = docs.sparkSession
    parts = shards * parts_per_shard
    text = F.col("text")
    sized = cut(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
            F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("_group"),
        ),
        "sizes",
    )
    groups = sized.groupBy("_group").agg(F.sum("size").alias("_bytes"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    large = F.col("_bytes") * parts >= F.lit(total)
    parcel = F.concat(F.lit("parcel-"), F.pmod(F.xxhash64("_group"), F.lit(parts)).cast("string"))
    item = F.when(large, F.col("_group")).otherwise(parcel)
    # At most 2 * parts rows, whatever the input.
    items = groups.groupBy(item.alias("_item")).agg(F.sum("_bytes").alias("_bytes"))
    placed = schedule([(r["_item"], r["_bytes"]) for r in items.collect()], shards)
    rows = [(name, shard) for name, shard in placed.items()]
    plan = F.broadcast(spark.createDataFrame(rows, "_item string, shard int"))
    # A document's own group is an item, or else its parcel is.
    own = sized.withColumn("_parcel", parcel).join(plan.withColumnRenamed("shard", "_own"), F.col("_group") == F.col("_item"), "left").drop("_item")
    own = own.join(plan, F.col("_parcel") == F.col("_item"), "left").select("doc_id", "size", "text_crc32", F.coalesce("_own", "shard").alias("shard"), F.lit(1).cast("bigint").alias("_one"))
    return with_prefix_sums(own, "shard", ["doc_id", "text_crc32", "size"], "_one", "slot").drop("_one")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Writes the rows of ``docs`` below ``path``, one folder per shard, and returns the plan. Ids must be distinct here."""
    plan = cut(shard_documents(docs, shards), "shards")
    docs.join(plan.select("doc_id", F.col("shard").alias("_shard")), "doc_id").write.partitionBy("_shard").parquet(path)
    return plan
