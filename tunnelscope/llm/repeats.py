"""Byte strings that occur more than once in a corpus, by a sparse enhanced suffix array.

A full suffix array of a large corpus is out of reach, and not needed: a string of ``length`` bytes holds a minimizer, the place whose
next few bytes have the lowest hash, and equal strings hold it at the same offset. So only suffixes that begin at
minimizers are sorted. Each minimizer owns the windows (strings of ``length`` bytes) of which it is the minimizer.

1. Minimizers of all texts, with the range of windows each owns; those whose bytes occur once are dropped.
2. For the rest, what precedes (left) and follows (right) within their windows. Rows are shuffled by the bytes' hash and sorted by
   the right context: the suffix array of that hash, in pieces that are complete.
3. A scan with a stack builds the common-prefix intervals of each group, from the deepest up. Members of an interval share its
   depth to the right. Where members from different children meet, their common left extension is looked at (a repeat that
   extends alike to the left on all sides is not maximal): two members repeat the windows between both
   limits. All members of a group are kept, in the order of their left contexts, not just neighbours in the array.
4. A group with more than ``GROUP`` members isn't sorted in one task: its windows are counted by their hash, added up before the shuffle.

Exact copies of whole texts are found by their digest, and one of them stands for all in the steps above.

Texts are compared as UTF-8 bytes, windows never cross documents.

Defined cases: null texts are empty; texts shorter than ``length`` have no windows; rows that repeat are copies of each other; an empty
table gives an empty result; columns other than those needed are kept by ``without_repeats`` and left out by ``repeat_digests``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .buffers import Rolling, mixed, spans_of, text_slices
from .lookup import maybe_among
from .scans import partitions_of

LENGTH = 400
# Bytes whose hash makes a minimizer.
ANCHOR_BYTES = 32
# Members of a group that one task sorts; windows of larger groups are counted by hash instead.
GROUP = 128
_PLACE_BITS = np.uint64(28)


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def minimizers(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of bytes: row, hash, place in the row, and the lowest and highest offset of the place in windows it owns."""
    width = min(ANCHOR_BYTES, length)
    many = length - width + 1
    none = (np.zeros(0, np.int64),) * 5
    if len(data) < length:
        return none
    if len(data) >> int(_PLACE_BITS):
        raise ValueError("a text of over 256 MB")
    hashes = Rolling(data).windows(width)
    value = hashes >> _PLACE_BITS << _PLACE_BITS | np.arange(len(hashes), dtype=np.uint64)
    # Lowest of ``many`` values from each place on: of the rest of its block, and of the beginning of the next.
    padded = np.full(-(-len(value) // many) * many, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(value)] = value
    blocks = padded.reshape(-1, many)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    begins = len(data) - length + 1
    lowest = np.minimum(behind[:begins], ahead[many - 1 : many - 1 + begins])
    place = (lowest & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    starts = spans_of(offsets[:-1], np.maximum(np.diff(offsets) - length + 1, 0))  # windows inside one row
    if not len(starts):
        return none
    place = place[starts]
    row = np.searchsorted(offsets, starts, side="right") - 1
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])))
    last = np.append(first[1:], len(place)) - 1
    at, row = place[first], row[first]
    return row, hashes[at].view(np.int64), at - offsets[row], at - starts[last], at - starts[first]


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """Rows (key, text) to (fp, key, pos, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column(1)):
                row, fp, pos, low, high = minimizers(part.data, part.offsets, length)
                if len(row):
                    keys = batch.column(0).take(pa.array(row + part.lo))
                    yield pa.RecordBatch.from_arrays([pa.array(fp), keys, *(pa.array(x.astype(np.int32)) for x in (pos, low, high))], ["fp", "key", "pos", "low", "high"])

    return texts.mapInArrow(run, "fp bigint, key binary, pos int, low int, high int")


def _common(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of rows, at most ``limit``."""
    differ = a != b
    first = differ.argmax(axis=1)
    return np.minimum(np.where(differ.any(axis=1), first, a.shape[1]), limit)


def _matrix(column: pa.Array, width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as rows of a matrix, and their lengths."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(1, np.uint8)
    n = np.diff(at)
    out = np.zeros((len(column), width), dtype=np.uint8)
    row = np.repeat(np.arange(len(column)), n)
    within = spans_of(np.zeros(len(column), np.int64), n)
    out[row, (n[row] - 1 - within) if backwards else within] = raw[at[0] : at[-1]]
    return out, n


def _scan_group(right: np.ndarray, r_len: np.ndarray, left: np.ndarray, l_len: np.ndarray, length: int, found: list[tuple[int, int, int]], base: int) -> None:
    """Adds (member, lowest offset, highest offset) of repeated windows of one group, sorted by right context."""
    n = len(right)
    depth = np.append(0, _common(right[1:], right[:-1], np.minimum(r_len[1:], r_len[:-1]))).tolist()
    order = np.lexsort(left.T[::-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    near = _common(left[order[1:]], left[order[:-1]], np.minimum(l_len[order[1:]], l_len[order[:-1]])).tolist()
    rank, order = rank.tolist(), order.tolist()

    def meet(x: int, y: int, common: int) -> None:
        # Members at left ranks x < y: windows from length - common on, as far as both go back alike.
        back = min(near[x:y])
        if back + common >= length:
            found.append((base + order[x], length - common, back))
            found.append((base + order[y], length - common, back))

    def joined(a: list[int], b: list[int], common: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        for r in b:
            k = bisect_left(a, r)
            a.insert(k, r)
            if k:
                meet(a[k - 1], r, common)
            if k + 1 < len(a):
                meet(r, a[k + 1], common)
        return a

    # Open intervals: (depth shared by its members, their left ranks in order).
    stack: list[tuple[int, list[int]]] = []
    for i in range(n + 1):
        common = depth[i] if 0 < i < n else -1
        members = [rank[i - 1]] if i else None
        while members is not None and stack and stack[-1][0] > common:
            below, others = stack.pop()
            members = joined(others, members, below)
        if members is not None and i < n:
            if stack and stack[-1][0] == common:
                stack[-1] = (common, joined(stack[-1][1], members, common))
            else:
                stack.append((common, members))


def _repeats_in_groups(sides: DataFrame, length: int) -> DataFrame:
    """Sorted rows (fp, key, pos, low, high, left, right) to spans (key, start, end) of repeated windows."""
    names = ["fp", "key", "pos", "low", "high", "left", "right"]

    def spans(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp, pos, low, high = (batch.column(i).to_numpy() for i in (0, 2, 3, 4))
        right, r_len = _matrix(batch.column(6), length, backwards=False)
        left, l_len = _matrix(batch.column(5), length, backwards=True)
        begin = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
        size = np.diff(np.append(begin, len(fp)))
        found: list[tuple[int, int, int]] = []
        two = begin[size == 2]
        common = _common(right[two], right[two + 1], np.minimum(r_len[two], r_len[two + 1]))
        back = _common(left[two], left[two + 1], np.minimum(l_len[two], l_len[two + 1]))
        for b, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            _scan_group(right[b : b + n], r_len[b : b + n], left[b : b + n], l_len[b : b + n], length, found, b)
        own = np.array(found, dtype=np.int64).reshape(-1, 3)
        member = np.concatenate([two, two + 1, own[:, 0]])
        least, most = np.concatenate([length - common, length - common, own[:, 1]]), np.concatenate([back, back, own[:, 2]])
        least, most = np.maximum(least, low[member]), np.minimum(most, high[member])
        good = least <= most
        member, least, most = member[good], least[good], most[good]
        start, end = pos[member] - most, pos[member] - least + length
        return pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(member)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["key", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last group may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch.select(names)])
            if held is not None:
                table = pa.concat_tables([held, table])
            fp = table.column("fp").to_numpy()
            if not len(fp):
                continue
            cutoff = len(fp) - int((fp == fp[-1]).sum())
            held = table.slice(cutoff)
            for lo in _group_cuts(fp[:cutoff]):
                yield spans(table.slice(lo[0], lo[1] - lo[0]).combine_chunks().to_batches()[0])
        if held is not None and len(held):
            yield spans(held.combine_chunks().to_batches()[0])

    return sides.mapInArrow(run, "key binary, start int, end int")


def _group_cuts(fp: np.ndarray, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of about ``rows`` rows that cut no group."""
    if not len(fp):
        return
    ends = np.append(np.flatnonzero(fp[1:] != fp[:-1]) + 1, len(fp))
    lo = 0
    while lo < len(fp):
        hi = int(ends[min(np.searchsorted(ends, lo + rows), len(ends) - 1)])
        yield lo, hi
        lo = hi


def _sides(joined: DataFrame, length: int) -> DataFrame:
    """Rows (key, text, places) to one row per place of a small group, with its left and right context."""
    names = ["fp", "key", "pos", "low", "high", "left", "right"]
    types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = [pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            keys, texts, places = batch.columns
            flat, at = places.flatten(), places.offsets.to_numpy()
            fp, pos, low, high = (flat.field(i).to_numpy() for i in range(4))
            large = flat.field(4).to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                text = memoryview(texts[i].as_buffer())
                for k in range(int(at[i]), int(at[i + 1])):
                    if not large[k]:
                        p = int(pos[k])
                        out.append((fp[k], keys[i].as_py(), p, low[k], high[k], bytes(text[p - int(high[k]) : p]), bytes(text[p : p - int(low[k]) + length])))
                        if len(out) >= 2048:
                            yield packed()
        if out:
            yield packed()

    return joined.mapInArrow(run, "fp bigint, key binary, pos int, low int, high int, left binary, right binary")


def _windows(joined: DataFrame, length: int) -> DataFrame:
    """Rows (key, text, places) to the windows that places of large groups own: (hash, key, start, end, n, settled).

    A window that occurs twice in its text is settled: its bytes are a row without a count of their own, runs of them as one. For
    other texts one row per text and hash stands for it, with n = 2; a window that occurs once has n = 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, places = batch.columns
            flat, at = places.flatten(), places.offsets.to_numpy()
            pos, low, high = (flat.field(i).to_numpy().astype(np.int64) for i in range(1, 4))
            large = flat.field(4).to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                own = np.arange(at[i], at[i + 1])
                own = own[large[own]]
                if not len(own):
                    continue
                data = np.frombuffer(texts[i].as_buffer(), np.uint8)
                starts = np.sort(spans_of(pos[own] - high[own], high[own] - low[own] + 1))
                hashes, first, which, n = np.unique(Rolling(data).spans(starts, starts + length), return_index=True, return_inverse=True, return_counts=True)
                twice = starts[n[which] > 1]
                new = np.append(True, twice[1:] > twice[:-1] + length) if len(twice) else np.zeros(0, bool)
                begin = twice[new]
                end = twice[np.append(np.flatnonzero(new)[1:] - 1, len(twice) - 1)] + length if len(twice) else begin
                m = len(hashes) + len(begin)
                start = np.append(starts[first], begin)
                columns = [
                    # Runs have a hash of their own, so that they spread over tasks as windows do.
                    np.append(hashes, mixed(begin.astype(np.uint64) ^ hashes[0])).view(np.int64),
                    start.astype(np.int32),
                    np.append(starts[first] + length, end).astype(np.int32),
                    np.append(np.minimum(n, 2), np.zeros(len(begin), np.int64)),
                    np.append(np.zeros(len(hashes), bool), np.ones(len(begin), bool)),
                ]
                c = [pa.array(v) for v in columns]
                yield pa.RecordBatch.from_arrays([c[0], keys.take(pa.array(np.full(m, i))), *c[1:]], ["hash", "key", "start", "end", "n", "settled"])

    return joined.mapInArrow(run, "hash bigint, key binary, start int, end int, n bigint, settled boolean")


def find_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans (key, start, end) of bytes of texts that lie in a window that occurs twice; they may overlap. ``key`` is the text's digest.

    ``docs`` has doc_id and text.
    """
    texts = docs.filter(F.octet_length("text") >= length).select("doc_id", _key(F.col("text")).alias("key"), "text")
    copies = cut(texts.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.max(F.octet_length("text")).alias("bytes")), "texts")
    anchors = cut(_anchors(texts.select("key", "text"), length), "minimizers")
    place = F.xxhash64("key", "pos")
    twice = anchors.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("fp")
    places = anchors.join(twice, "fp").groupBy("fp", "key", "pos", "low", "high").agg(F.count("*").alias("_n")).drop("_n")
    places = cut(places, "places")
    large = cut(places.groupBy("fp").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("fp", F.lit(True).alias("large")), "large-groups")
    # A list per text, as long as the text has minimizers.
    place = F.struct("fp", "pos", "low", "high", F.coalesce("large", F.lit(False)).alias("large"))
    lists = places.join(large, "fp", "left").groupBy("key").agg(F.collect_list(place).alias("places"))
    lists = lists.join(copies.select("key", "doc_id"), "key")
    # Texts without such places are not shuffled.
    some = maybe_among(texts, places.select("key"), "key").filter("_held")
    own = some.alias("t").join(lists.alias("l"), F.col("t.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("t.key") == F.col("l.key")))
    own = own.select("t.key", F.col("t.text").cast("binary").alias("text"), "l.places")
    sides = _sides(own, length).repartition("fp").sortWithinPartitions("fp", "right", "key", "pos")
    in_groups = _repeats_in_groups(sides, length)
    windows = _windows(own, length)
    again = windows.groupBy("hash").agg(F.sum("n").alias("_n")).filter("_n > 1").select("hash", "_n")
    in_large = windows.join(again, "hash", "left").filter("settled OR _n > 1").select("key", "start", "end")
    whole = copies.filter("n > 1").select("key", F.lit(0).alias("start"), F.col("bytes").cast("int").alias("end"))
    return in_groups.unionByName(in_large).unionByName(whole)


def _merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of rows (start, end) sorted by start; runs that touch are one."""
    if not len(spans):
        return spans
    upto = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.append(True, spans[1:, 0] > upto[:-1]))
    return np.stack([spans[first, 0], upto[np.append(first[1:], len(spans)) - 1]], axis=1)


def _runs_of(cell: pa.Scalar) -> list[tuple[int, int]]:
    raw = cell.as_buffer()
    return [] if raw is None else [tuple(r) for r in np.frombuffer(raw, "<i4").reshape(-1, 2).tolist()]


def merged_spans(spans: DataFrame) -> DataFrame:
    """One row per text (key, _spans): its maximal runs as pairs of little-endian 32-bit integers.

    Spans stream by in order; what is held is the runs of one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, np.zeros((0, 2), np.int32)
        for batch in batches:
            n, keys = batch.num_rows, batch.column(0)
            if not n:
                continue
            both = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1)
            change = np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1
            out = []
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), n], strict=True):
                key = keys[lo].as_py()
                if key != held_key:
                    if held_key is not None:
                        out.append((held_key, held.astype("<i4").tobytes()))
                    held_key, held = key, held[:0]
                held = _merged(np.concatenate([held, both[lo:hi]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["key", "_spans"])
        if held_key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (held_key, held.astype("<i4").tobytes())], ["key", "_spans"])

    return spans.select("key", "start", "end").repartition(partitions_of(spans), "key").sortWithinPartitions("key", "start", "end").mapInArrow(run, "key binary, _spans binary")


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` as the struct ``_row``, and the runs of its text (null: none).

    The runs are one small row per text and are looked up from a hash table, so texts are shuffled but not sorted. Those that surely have no
    runs are not shuffled.
    """
    runs = cut(merged_spans(cut(find_repeats(docs, length), "repeats")), "runs")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_text"), _key(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    told = maybe_among(rows, runs, "key")
    exact = told.filter("_held").join(runs.hint("shuffle_hash"), "key", "left")
    plain = told.filter("NOT _held").withColumn("_spans", F.lit(None).cast("binary"))
    return plain.select("_row", "_text", "_spans").union(exact.select("_row", "_text", "_spans"))


# Bytes of text after which a task hands on what it has.
OUT_BYTES = 1 << 20


def repeat_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes)."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, first, size = [], 0, 0
            for i in range(batch.num_rows):
                raw = memoryview(batch.column(1)[i].as_buffer() or b"")
                runs = _runs_of(batch.column(2)[i])
                kept = [raw[a:b] for a, b in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(raw)], strict=True)]
                out.append((len(raw), sum(e - s for s, e in runs), len(runs), b"".join(kept)))
                size += len(raw)
                if size >= OUT_BYTES or i + 1 == batch.num_rows:
                    columns = [pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(out)), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
                    out, first, size = [], i + 1, 0

    rows = _with_spans(docs.select("doc_id", "text"), length).select("_row.doc_id", F.col("_text").cast("binary").alias("_text"), "_spans")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    return rows.mapInArrow(run, schema).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without the repeated bytes, whole characters only, and without texts of which only white space is left.

    ``n_chars``, where there is such a column, follows the text. Texts without repeats stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, first, size = [], 0, 0
            for i in range(batch.num_rows):
                text, runs = batch.column(1)[i], _runs_of(batch.column(2)[i])
                raw, at, kept = text.as_buffer().to_pybytes() if runs else b"", 0, []
                for s, e in runs:
                    while s < e and raw[s] & 0xC0 == 0x80:
                        s += 1
                    while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
                        e -= 1
                    kept.append(raw[at:s])
                    at = e
                out.append(b"".join([*kept, raw[at:]]).decode() if runs else None)
                size += len(raw)
                if size >= OUT_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(out)), pa.array(out, pa.string())], ["_row", "_cut"])
                    out, first, size = [], i + 1, 0

    rows = _with_spans(docs, length)
    schema = T.StructType([rows.schema["_row"], T.StructField("_cut", T.StringType())])
    changed = rows.mapInArrow(run, schema).filter("_cut IS NULL OR length(trim(BOTH ' \\n\\t\\r' FROM _cut)) > 0")
    new = F.col("_cut").isNotNull()
    columns = {"text": F.when(new, F.col("_cut")).otherwise(F.col("_row.text")), "n_chars": F.when(new, F.char_length("_cut").cast("bigint")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else F.lit(0)}
    return changed.select(*[columns.get(c, F.col(f"_row.{c}")).alias(c) for c in docs.columns])
