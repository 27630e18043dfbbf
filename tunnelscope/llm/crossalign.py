"""Alignment of two tokenisers over the same texts, by windows between anchors.

A text with a space before it is tokenised in full both ways: by a byte-level vocabulary (A) and by a piece vocabulary (B, whose tokeniser
adds that space itself). An anchor is a byte offset at which tokens of both sides end and the next ones of both begin with a space; both is looked up in
the tokens. Anchors cut a document into windows, two short lists of ids. As the bytes of tokens follow from ids, so does all that
happens in a window: its alignment is worked out once per worker and remembered by the ids.

Within a window, offsets at which tokens of both sides end cut the tokens into groups, and two tokens are linked when their bytes overlap.
How many documents of the corpus hold a pair of ids linked is counted per block of texts first. Blocks send one row per pair they hold, not one per document, and get
its count back; counts are put to the documents of a block where the block is. No table of pairs is broadcast or collected.

Defined cases: a text that is null or empty, or whose tokens on either side don't spell it, has no tokens, groups or links; control strings inside texts are plain
text; rows that repeat are a document each; a very long text is a block of its own; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .bpe import Encoder, Tokenizer
from .buffers import TextSlice, spans_of, text_slices

# Bytes of text per block.
BLOCK_BYTES = 1 << 20
# Windows and links a worker remembers; beyond either it starts anew at the next block.
MEMO_WINDOWS, MEMO_LINKS = 150_000, 4_000_000

_MARK = "▁"  # a piece's sign for a space
_SEPARATOR = b"\xff\xff\xff\xff"  # no id


class Pieces:
    """A piece tokeniser for texts that begin with the space it would add.

    Where no piece holds a space after another character, nothing is merged across the beginning of a run of spaces, so a text
    falls into chunks there, and equal chunks are encoded once.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.splits = not any(_MARK in n.lstrip(_MARK) for n in names) and self.library.normalize("a  b ") == f"{_MARK}a{_MARK * 2}b{_MARK}"
        self._names = names
        self.blank = self.library.encode("x ")[len(self.library.encode("x")) :]

    def bytes_of(self) -> list[bytes]:
        is_byte = self.library.is_byte
        return [bytes([int(n[3:5], 16)]) if is_byte(i) else n.replace(_MARK, " ").encode() for i, n in enumerate(self._names)]

    def chunks(self, part: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        begin = np.zeros(len(part.data) + 1, dtype=bool)
        if self.splits and len(part.data):
            blank = part.data == 0x20
            begin[1:-1] = blank[1:] & ~blank[:-1]
            # The sign itself in a text is a space for the library.
            sign = (part.data[:-3] == 0xE2) & (part.data[1:-2] == 0x96) & (part.data[2:-1] == 0x81)
            begin[3:-1][sign] = False
        begin[part.offsets] = True
        starts = np.flatnonzero(begin[:-1])
        return starts, np.append(starts[1:], len(part.data)), np.searchsorted(starts, part.offsets)

    def encode_chunks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks that begin with a space: all ids, where each chunk's begin, and how many they are."""
        raw = data.tobytes()
        ids = self.library.encode([raw[a + 1 : b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], num_threads=1)
        # An empty text has no tokens, not even the space; a last blank of a text has.
        ids = [self.blank if alone else x for x, alone in zip(ids, (ends - starts == 1).tolist(), strict=True)]
        count = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(count.sum()))
        return flat, np.cumsum(count) - count, count


class Spelling:
    """The bytes of each id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.spaced = np.array([t[:1] == b" " for t in tokens], dtype=bool)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spans_of(self.at[ids], self.length[ids])]


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    values.sort()
    at = np.flatnonzero(np.append(np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))
    return values[at], np.diff(np.append(at, len(values)))


class Windows:
    """Alignments of windows by their ids: text of the groups, and the linked pairs (A id, then B id in the low 32 bits)."""

    def __init__(self, a: Spelling, b: Spelling):
        self.a, self.b = a, b
        digits = [str(i).encode() for i in range(max(len(a.length), len(b.length)))]
        self.digits = Spelling(digits)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.links, self.first = array("q"), array("q", [0])

    def full(self) -> bool:
        return len(self.texts) > MEMO_WINDOWS or len(self.links) > MEMO_LINKS

    def add(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> None:
        """Aligns new windows, one after another in ``a`` and ``b`` with ``n_a`` and ``n_b`` ids each.

        Both sides of a window have the same bytes, so windows can stand behind each other. Between two neighbouring ends of
        either side lies one token of each: that is a link, and there is one such stretch for each.
        """
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        ends = _counted(np.concatenate([end_a, end_b]))[0]
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        linked = a[at_a].astype(np.int64) << 32 | b[at_b]
        until = np.searchsorted(ends, end_a[np.cumsum(n_a) - 1], side="right")
        self.first.frombytes((len(self.links) + until).astype(np.int64).tobytes())
        self.links.frombytes(linked.tobytes())
        # Groups as text: ids of A and then of B, each with the sign that follows it.
        shared = ends[(end_a[at_a] == ends) & (end_b[at_b] == ends)]
        of_a, of_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        upto_a, upto_b = np.cumsum(np.bincount(of_a)), np.cumsum(np.bincount(of_b))
        place_a, place_b = np.arange(len(a)) + np.append(0, upto_b)[of_a], np.arange(len(b)) + upto_a[of_b]
        ids, sign = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        sign[place_a[shared[of_a] == end_a]] = ord("|")
        sign[place_b[shared[of_b] == end_b]] = ord(";")
        length = self.digits.length[ids]
        to = np.cumsum(length + 1)
        out = np.empty(to[-1], np.uint8)
        out[spans_of(to - length - 1, length)] = self.digits.spelled(ids)
        out[to - 1] = sign
        text, cuts = out.tobytes().decode(), to[np.cumsum(n_a + n_b) - 1].tolist()
        self.texts += [text[x : y - 1] for x, y in zip([0, *cuts[:-1]], cuts, strict=True)]


class Aligned:
    """Alignment of one block of texts that begin with a space; arrays have an entry per row, but for ``links``, ``times``, ``keys`` and ``docs``."""

    def __init__(self, part: TextSlice, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], memo: Windows):
        self.n = len(part)
        (ids_a, rows_a), (ids_b, rows_b) = a, b
        size = np.diff(part.offsets)
        good = size > 1
        for ids, rows, spelling in ((ids_a, rows_a, memo.a), (ids_b, rows_b, memo.b)):
            total = np.append(0, np.cumsum(spelling.length[ids]))[rows]
            good &= np.diff(total) == size
        # The same number of bytes: compare them.
        for ids, rows, spelling in ((ids_a, rows_a, memo.a), (ids_b, rows_b, memo.b)):
            chosen = ids[np.repeat(good, np.diff(rows))]
            same = spelling.spelled(chosen) == part.data[np.repeat(good, size)]
            if not same.all():
                where = np.repeat(np.flatnonzero(good), size[good])
                good[where[~same]] = False
        count_a, count_b = np.diff(rows_a), np.diff(rows_b)
        ids_a, ids_b = ids_a[np.repeat(good, count_a)], ids_b[np.repeat(good, count_b)]
        self.n_a, self.n_b = np.where(good, count_a, 0), np.where(good, count_b, 0)
        self._cut(ids_a, ids_b, np.cumsum(size[good]), np.flatnonzero(good), memo)

    def _cut(self, ids_a: np.ndarray, ids_b: np.ndarray, row_ends: np.ndarray, rows: np.ndarray, memo: Windows) -> None:
        end_a, end_b = np.cumsum(memo.a.length[ids_a]), np.cumsum(memo.b.length[ids_b])
        shared, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        row_of = np.searchsorted(row_ends, shared)
        self.n_groups = np.zeros(self.n, np.int64)
        self.n_groups[rows] = np.bincount(row_of, minlength=len(rows))
        # A token that begins with a space follows, or another text.
        spaced = np.append(memo.a.spaced[ids_a[1:]], True)[at_a] & np.append(memo.b.spaced[ids_b[1:]], True)[at_b]
        spaced |= shared == row_ends[row_of] if len(rows) else False
        to_a, to_b, row_of = at_a[spaced] + 1, at_b[spaced] + 1, row_of[spaced]
        raw_a, raw_b = ids_a.astype("<u4").tobytes(), ids_b.astype("<u4").tobytes()
        known, found, new, x, y = memo.known, [], [], 0, 0
        number = len(memo.texts)
        for i, (u, v) in enumerate(zip(to_a.tolist(), to_b.tolist(), strict=True)):
            key = raw_a[4 * x : 4 * u] + _SEPARATOR + raw_b[4 * y : 4 * v]
            k = known.get(key)
            if k is None:
                k = known[key] = number
                number += 1
                new.append(i)
            found.append(k)
            x, y = u, v
        if new:
            n_a, n_b = np.diff(to_a, prepend=0)[new], np.diff(to_b, prepend=0)[new]
            memo.add(ids_a[spans_of(to_a[new] - n_a, n_a)], n_a, ids_b[spans_of(to_b[new] - n_b, n_b)], n_b)
        window = np.array(found, dtype=np.int64)
        texts = [memo.texts[k] for k in found]
        bounds = np.searchsorted(row_of, np.arange(len(rows) + 1)).tolist()
        self.groups = [""] * self.n
        for k, row in enumerate(rows.tolist()):
            self.groups[row] = ";".join(texts[bounds[k] : bounds[k + 1]])
        first = np.frombuffer(memo.first, np.int64)
        n_links = np.diff(first)[window]
        pool = np.frombuffer(memo.links, np.int64) if len(memo.links) else np.zeros(0, np.int64)
        links = pool[spans_of(first[window], n_links)]
        del first, pool
        row = np.repeat(rows[row_of], n_links)
        self.n_links = np.bincount(row, minlength=self.n)
        self.keys, place = np.unique(links, return_inverse=True)
        codes, self.times = _counted(row * max(1, len(self.keys)) + place)
        row, self.links = np.divmod(codes, max(1, len(self.keys)))
        self.docs = np.bincount(self.links, minlength=len(self.keys))
        self.row_links = np.append(0, np.cumsum(np.bincount(row, minlength=self.n)))


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def align_documents(docs: DataFrame, spec: str, model: bytes) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``), and what ``with_counts`` needs.

    ``spec`` is the content of A's tokenizer file, ``model`` that of B's. ``links`` are places in the pairs of the block (``times`` each), which its first row
    lists: ``keys`` (A id, then B id in the low 32 bits) and ``docs``, in how many of its documents each is.
    """
    shared = docs.sparkSession.sparkContext.broadcast((spec, model))
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    names = ["doc_id", "block", *counts, "groups", "links", "times", "keys", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = Tokenizer(shared.value[0], special=False), Pieces(shared.value[1])
        encode_a, encode_b = Encoder(a), Encoder(b)
        memo = Windows(Spelling(a.bytes_of()), Spelling(b.bytes_of()))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            wide = pa.large_string()  # a batch of long texts may be longer with its spaces than offsets of 32 bits reach
            texts = pc.binary_join_element_wise(pa.scalar(" ", wide), pc.fill_null(batch.column(1).cast(wide), ""), pa.scalar("", wide))
            for part in text_slices(texts, BLOCK_BYTES):
                done = Aligned(part, encode_a.encode(part), encode_b.encode(part), memo)
                n = len(part)
                own = np.append(0, np.full(n, len(done.keys)))
                columns = [
                    batch.column(0).slice(part.lo, n),
                    pa.array(np.full(n, block)),
                    *(pa.array(getattr(done, c).astype(np.int64)) for c in counts),
                    pa.array(done.groups, pa.string()),
                    _lists(done.row_links, done.links, pa.int32()),
                    _lists(done.row_links, done.times, pa.int32()),
                    _lists(own, done.keys, pa.int64()),
                    _lists(own, done.docs, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
                block += 1
                if memo.full():
                    memo.clear()

    lists = "links array<int>, times array<int>, keys array<bigint>, docs array<bigint>"
    rest = T._parse_datatype_string(f"block bigint, {', '.join(f'{c} bigint' for c in counts)}, groups string, {lists}")
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *rest.fields]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Per pair of ids (``key``) in how many documents it is linked, and whether no other pair of its A id is in more."""
    counts = cut(_pairs(aligned).groupBy("key").agg(F.sum("docs").alias("count")), "pair-counts")
    # One row per id of the vocabulary.
    most = counts.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), F.shiftright(counts["key"], 32) == most["a"]).select("key", "count", (F.col("count") == F.col("most")).alias("best"))


def _pairs(aligned: DataFrame) -> DataFrame:
    listed = aligned.filter(F.size("keys") > 0).select("block", F.posexplode(F.arrays_zip("keys", "docs")).alias("place", "pair"))
    return listed.select("block", "place", F.col("pair.keys").alias("key"), F.col("pair.docs").alias("docs"))


def with_counts(aligned: DataFrame, carried: list[str]) -> DataFrame:
    """``carried`` columns of ``aligned``, n_best and count_sum. ``aligned`` is read several times: pass a table."""
    found = _pairs(aligned).join(pair_counts(aligned), "key").select("block", "place", "count", "best")
    schema = T.StructType([*aligned.select(*carried).schema.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        place = pairs.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
        links, times = (pc.list_flatten(rows.column(c)).to_numpy() for c in ("links", "times"))
        ends = np.append(0, np.cumsum(pc.list_value_length(rows.column("links")).to_numpy()))
        sums = [np.diff(np.append(0, np.cumsum(times * v[links]))[ends]) for v in (best, count)]
        return pa.Table.from_arrays([*(rows.column(c) for c in carried), *map(pa.array, sums)], [*carried, "n_best", "count_sum"])

    blocks = aligned.select("block", "links", "times", *carried).groupBy("block")
    return blocks.cogroup(found.withColumnRenamed("block", "of").groupBy("of")).applyInArrow(run, schema)
