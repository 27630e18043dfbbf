"""Token ids in fixed-width, bit-packed blocks.

A block holds whole documents. Its bytes: magic ``IDB1``, the bits per id (1 byte), padding to 8 bytes, the number of documents
and of ids (8 bytes each), where each document begins in the block (8 bytes each, and the end), then the ids, 64
of them in as many 8-byte words as an id has bits, low bits first, little-endian throughout. So id i lies in
group i // 64 at a place that is known without reading others. Blocks are rows of Parquet files with the
shard, the place of the block in it and its document ids beside them: Spark's committer writes them to any store, a lost task leaves
no half file, and a reader finds a range of ids from the columns alone.

Defined cases: a null or empty text is the end id alone; null ids come first; rows that repeat are written as often; an empty
table gives no blocks; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Encoder, Tokenizer, encoded
from .scans import partitions_of

MAGIC = b"IDB1"
# A block is closed at the first document end past this many ids.
BLOCK_IDS = 1 << 15
GROUP = 64


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    groups = -(-len(ids) // GROUP)
    padded = np.zeros(groups * GROUP, dtype=np.uint64)
    padded[: len(ids)] = ids
    lanes = np.ascontiguousarray(padded.reshape(groups, GROUP).T)
    words = np.zeros((bits, groups), dtype=np.uint64)
    for lane in range(GROUP):
        word, shift = divmod(lane * bits, 64)
        words[word] |= lanes[lane] << np.uint64(shift)
        if shift + bits > 64:
            words[word + 1] |= lanes[lane] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").tobytes()


def unpack(payload: memoryview, bits: int, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` (without it), touching only the groups they are in."""
    if last <= first:
        return np.zeros(0, dtype=np.uint32)
    low, high = first // GROUP, -(-last // GROUP)
    words = np.frombuffer(payload, dtype="<u8", count=(high - low) * bits, offset=low * bits * 8)
    words = np.ascontiguousarray(words.reshape(high - low, bits).T)
    mask = np.uint64((1 << bits) - 1)
    lanes = np.empty((GROUP, high - low), dtype=np.uint32)
    for lane in range(GROUP):
        word, shift = divmod(lane * bits, 64)
        value = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | words[word + 1] << np.uint64(64 - shift)
        lanes[lane] = value & mask
    return lanes.T.reshape(-1)[first - low * GROUP : last - low * GROUP]


def write_block(ids: np.ndarray, starts: np.ndarray, bits: int) -> bytes:
    """``starts``: where each document begins, and the end."""
    head = MAGIC + bytes([bits]) + b"\0\0\0" + np.array([len(starts) - 1, len(ids)], dtype="<u8").tobytes()
    return head + starts.astype("<u8").tobytes() + pack(ids, bits)


class Block:
    """A block's bytes, read at random."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if view[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        self.bits = view[4]
        documents, self.n_ids = (int(x) for x in np.frombuffer(view, "<u8", 2, 8))
        self.starts = np.frombuffer(view, "<u8", documents + 1, 24).astype(np.int64)
        self.payload = view[24 + 8 * (documents + 1) :]

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        return unpack(self.payload, self.bits, first, self.n_ids if last is None else last)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


BLOCK_SCHEMA = "shard int, block int, start bigint, n_ids bigint, doc_ids array<bigint>, data binary"


def write_token_files(docs: DataFrame, spec: str, path: str, end_id: int) -> None:
    """Encodes each text, ends it with ``end_id``, and writes blocks in ascending order of doc_id below ``path``.

    ``spec`` is the content of a tokenizer file. Shards are ranges of doc_id; rows of one id may span several.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(shared.value)
        encoder, bits = Encoder(tokenizer), bits_for(tokenizer.size)
        shard, block, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            doc_ids = batch.column(0)
            for part, ids, rows in encoded(encoder, batch.column(1)):
                ids = np.insert(ids, rows[1:], end_id)
                rows = rows + np.arange(len(rows))
                out, k = [], 0
                while k < len(part):
                    last = min(int(np.searchsorted(rows, rows[k] + BLOCK_IDS)), len(part))
                    last = max(last, k + 1)
                    own = ids[rows[k] : rows[last]]
                    data = write_block(own, rows[k : last + 1] - rows[k], bits)
                    out.append((shard, block, total, len(own), doc_ids[part.lo + k : part.lo + last].to_pylist(), data))
                    block, total, k = block + 1, total + len(own), last
                columns = list(zip(*out, strict=True))
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                names = ["shard", "block", "start", "n_ids", "doc_ids", "data"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    # The last key splits rows of one doc_id that would not fit a task.
    keyed = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("_t"), F.xxhash64(F.monotonically_increasing_id()).alias("_r"))
    keys = ["doc_id", "_t", "_r"]
    ranged = keyed.repartitionByRange(partitions_of(docs), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    ranged.mapInArrow(write, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start`` counted over all shards."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # One row per shard.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # The blocks themselves are not shuffled: there is one shard per partition of the write.
    return blocks.join(F.broadcast(shards), "shard").withColumn("start", F.col("start") + F.col("_before")).drop("_before")


def document_digests(blocks: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit integers)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, data in zip(*(batch.column(c) for c in ("start", "doc_ids", "data")), strict=True):
                block = Block(data.as_buffer())
                raw = memoryview(block.ids().astype("<u4")).cast("B")
                at = block.starts
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(at[:-1] + start.as_py()), pa.array(np.diff(at)), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.select("start", "doc_ids", "data").mapInArrow(digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
