"""Exact join of documents whose sets of word n-grams are close in Jaccard distance.

Jaccard distance is a metric, but in a corpus nearly all documents are at distance 1 from any document, so pivots
chosen from the whole corpus tell nothing: their windows would copy every document to every region. Regions are therefore
begun where distances below 1 occur, by anchors:

1. Equal sets are one class, at distance 0. One document stands for each class.
2. Shingles have one order for all documents: by the document frequency that a sketch of fixed size estimates, rare first, then by hash. Two sets within
   the radius share a shingle among the first few of each (a prefix whose length follows from the radius). Documents that
   share such an anchor form a region. A pair is looked for in the region of the first anchor it shares, so the places of the anchor
   in both orders bound what the two can have in common.
3. The members of large regions form cells around a *centre*, a pivot that need not be a document: the shingles that most of a few members
   have. Copies with changes of their own lie around it, nearer than they lie to each other. The distance of each member to its centre is worked out once.
   By the triangle inequality the sum of two distances bounds that of a pair from above; the member for which this bound is best is linked with all members
   that it holds for, and these form a star.
4. Near members of a cell that this does not link must share some of what they differ from the centre by. These rests are the sets of a join of
   their own, by their first elements in the order of the cell, and only few pairs meet: changes made independently have nothing in common.
5. All other pairs of a region are compared, unless the difference of their distances to one centre keeps them apart: boundary members meet those outside.

Distances are exact: sums of equal 64-bit hashes of shingles.

Links are head to member and the pairs of steps 4 and 5. They connect what all links within the radius would connect.

Defined cases: texts with fewer words than an n-gram are one n-gram; null texts and texts without words have an empty set and are
linked with nothing; rows that repeat an id are one document of the largest set; rows without an id are left out; an empty table
gives an empty result; other columns are left out. ``one_of_each`` takes all rows one by one and leaves out none before the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, small_side
from .buffers import Rolling, TextSlice, mixed, spans_of, text_slices
from .components import components
from .lookup import bits_of, looked_up, maybe_among

# Counters of the frequency sketch, whatever the corpus.
SKETCH = 1 << 20
_CHUNK = 1 << 12
# Members whose distance to a pivot is worked out in one unit.
BATCH = 32
# A region of at most this many members gets no pivot: its pairs are compared, as far as sizes and anchors let them be linked.
LEAF = 24
# Members of a cell whose shingles make its centre.
CENTRE_OF = 15

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def shingles(part: TextSlice, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each row, repeats included, and where each row begins (one entry more than rows)."""
    starts, ends, first = TextSlice(part.lo, part.hi, _LOWER[part.data], part.offsets).words()
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(part) + 1, np.int64)
    h = Rolling(_LOWER[part.data]).spans(starts, ends)
    n = np.diff(first)
    # A gram of fewer words than asked for is that of a short row.
    grams = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    at = np.append(0, np.cumsum(grams))
    row = np.repeat(np.arange(len(part)), grams)
    begin = first[row] + np.arange(at[-1]) - at[row]
    length = np.minimum(words, n)[row]
    out = np.zeros(at[-1], np.uint64)
    for k in range(words):
        use = k < length
        out[use] = mixed(out[use] * np.uint64(0x9E3779B97F4A7C15) + h[begin[use] + k] + np.uint64(k + 1))
    return out, at


def shingle_sets(part: TextSlice, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row in ascending order, and where each row begins."""
    h, at = shingles(part, words)
    row = np.repeat(np.arange(len(part)), np.diff(at))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(part) + 1))


def frequency_sketch(docs: DataFrame, words: int, num: int, den: int) -> np.ndarray:
    """How much more often than usual the shingles of each of ``SKETCH`` hash classes occur, as a magnitude for ordering.

    Counted are the shingles of lowest hash of each document, twice as many as its anchors: no others become anchors as long as hot
    ones are few.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.uint64)
        for batch in batches:
            for part in text_slices(batch.column(0)):
                h, at = shingle_sets(part, words)
                n = np.diff(at)
                low = spans_of(at[:-1], np.minimum(n, 2 * _anchors_of(n, num, den)))
                total += np.bincount(_class_of(h[low]), minlength=SKETCH).astype(np.uint64)
        for k in range(0, SKETCH, _CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k : k + _CHUNK].tobytes()], pa.binary())], ["first", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, np.ndarray] | None = None
        for batch in batches:
            for first, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is not None and held[0] != first:
                    yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int32()), pa.array([held[1].tobytes()], pa.binary())], ["first", "n"])
                    held = None
                own = np.frombuffer(n, np.uint64)
                held = (first, own if held is None else held[1] + own)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int32()), pa.array([held[1].tobytes()], pa.binary())], ["first", "n"])

    parts = docs.select("text").mapInArrow(count, "first int, n binary")
    # Each piece of the sketch is added up as its rows stream by.
    added = parts.repartition("first").sortWithinPartitions("first").mapInArrow(add, "first int, n binary")
    counts = np.zeros(SKETCH, np.uint64)
    for r in added.collect():  # SKETCH numbers
        counts[r["first"] : r["first"] + _CHUNK] = np.frombuffer(r["n"], np.uint64)
    usual = max(1.0, float(np.median(counts)))
    # Classes near the usual count are alike: their shingles come in the order of their hashes.
    return np.floor(np.log2(np.maximum(counts / usual, 1)) * 2).astype(np.uint8)


def _class_of(h: np.ndarray) -> np.ndarray:
    return (mixed(h) >> np.uint64(44)).astype(np.int64)


def _anchors_of(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """A linked set shares at least ceil(num * n / den) of n shingles, so one of the first n - that + 1 of any order."""
    return np.where(n > 0, n - -(-num * n // den) + 1, 0)


def _prefix_schema() -> str:
    return "doc_id bigint, n bigint, s1 bigint, s2 bigint, prefix array<bigint>"


def _prefixes(docs: DataFrame, sketch: np.ndarray, words: int, num: int, den: int) -> DataFrame:
    """Per document its set size, two sums that identify the set, and the anchors: the first shingles in the common order."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            for part in text_slices(batch.column(1)):
                h, at = shingle_sets(part, words)
                n = np.diff(at)
                row = np.repeat(np.arange(len(part)), n)
                order = np.lexsort((h, level[_class_of(h)], row))
                place = np.arange(len(h)) - at[row]
                many = _anchors_of(n, num, den)
                anchors = h[order][place < many[row]]
                offsets = np.append(0, np.cumsum(many)).astype(np.int32)
                sums = [np.append(np.uint64(0), np.cumsum(mixed(h ^ np.uint64(salt)))) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                s1, s2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(anchors.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, len(part)), pa.array(n), pa.array(s1), pa.array(s2), lists], ["doc_id", "n", "s1", "s2", "prefix"])

    return docs.mapInArrow(run, _prefix_schema())


def _narrowed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id may be among ``ids``, told before the rows are shuffled. An exact join must follow."""
    return maybe_among(rows, ids, "doc_id").filter("_held").drop("_held")


def _numbered(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose ``_key`` is among ``keys``, by one bit for each number, so that the rows are not shuffled.

    Numbers run from the first of each partition on, so the bits take about one byte for eight rows. Those of more rows than ``small_side``
    broadcasts, over 300 million numbers, are joined by shuffle.
    """
    return looked_up(rows, F.col("_key"), small_side(cut(bits_of(keys, F.col("_key")), "bits"))).filter("_held").drop("_held")


def _representatives(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``sets`` that stand for their class (doc_id, n, prefix). Only those that may have copies are shuffled."""
    told = maybe_among(sets.filter("n > 0"), classes.filter("copies > 1"), "s1", "s2", "n")
    # An inner join, as a semi-join is carried out before the look-up. There is one representative of a class.
    exact = told.filter("_held").join(classes.select(F.col("rep").alias("doc_id"), "s1", "s2", "n"), ["doc_id", "s1", "s2", "n"])
    return told.filter("NOT _held").select("doc_id", "n", "prefix").union(exact.select("doc_id", "n", "prefix"))


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of ``ids`` (doc_id), as a table."""
    ids = cut(ids.distinct(), "ids")
    return cut(_narrowed(texts, ids).join(ids, "doc_id"), "texts", "zstd")


def _common(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Rows (a, b) with the sizes of their sets and of what they have in common: (a, b, na, nb, common).

    The text of a goes along once for ``BATCH`` partners. An id with several texts gives a row for each of them.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("_c"))
    units = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("_c") / BATCH)).cast("int").alias("unit"))
    heads = units.select("a", "unit").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "unit", F.lit(None).cast("bigint").alias("b"), "text")
    rows = units.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "unit", "b", "text").union(heads)
    ordered = rows.repartition("a", "unit").sortWithinPartitions("a", "unit", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads_now = None, []
        for batch in batches:
            a, unit, b = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for part in text_slices(batch.column(3)):
                h, at = shingle_sets(part, words)
                for i in range(len(part)):
                    k = part.lo + i
                    own = h[at[i] : at[i + 1]]
                    if (a[k], unit[k]) != now:
                        now, heads_now = (a[k], unit[k]), []
                    if b[k] is None:
                        heads_now.append(own)
                    else:
                        out.extend((a[k], b[k], len(x), len(own), len(np.intersect1d(x, own, assume_unique=True))) for x in heads_now)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "na", "nb", "common"])

    return ordered.mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint, common bigint")


def _may_link(x: str, y: str, num: int, den: int) -> Column:
    """Whether sets that share an anchor at places of their orders may be linked, if it is the first they share.

    What both have in common is then the anchor and what comes behind it in both.
    """
    behind = F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos"))
    return behind * (num + den) >= num * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _checked_by_anchors(pairs: DataFrame, anchors: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose anchors let them be linked: what both have in common is among the anchors of both, or behind those of one."""
    for side in ("a", "b"):
        own = anchors.select(F.col("doc_id").alias(side), F.col("n").alias(f"n{side}"), F.col("prefix").alias(f"p{side}"))
        pairs = pairs.join(own, side)
    most = F.size(F.array_intersect("pa", "pb")) + F.greatest(F.col("na") - F.size("pa"), F.col("nb") - F.size("pb"))
    return pairs.filter(most * (num + den) >= num * (F.col("na") + F.col("nb"))).select("a", "b").distinct()


def _cells(big: DataFrame) -> DataFrame:
    """Cell of each member of large regions (cell, d).

    It is the largest region of the member, and then the largest cell that prevails in any of its regions: a copy whose change hit the
    common region goes to the cell of the others.
    """
    top = big.groupBy("d").agg(F.max(F.struct("c", "s")).alias("_top")).select("d", F.col("_top.s").alias("cell"))
    met = big.select("s", "d").join(top, "d").groupBy("s", "cell").agg(F.count("*").alias("_n"))
    usual = met.groupBy("s").agg(F.max(F.struct("_n", "cell")).alias("_u")).select("s", "_u.*")
    return big.select("s", "d").join(usual, "s").groupBy("d").agg(F.max(F.struct("_n", "cell")).alias("_m")).select(F.col("_m.cell").alias("cell"), "d")


def _centres(members: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Per cell the shingles that more than half of up to ``CENTRE_OF`` of its members have (cell, centre).

    No result depends on what a centre is; a good one is near to many members.
    """
    some = members.withColumn("_t", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).filter(F.col("_t") <= CENTRE_OF).drop("_t")
    told = some.join(texts.withColumnRenamed("doc_id", "d"), "d").select("cell", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_numpy()
            for part in text_slices(batch.column(1)):
                h, at = shingle_sets(part, words)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cell[part.lo : part.hi], np.diff(at))), pa.array(h.view(np.int64))], ["cell", "h"])

    counted = told.mapInArrow(run, "cell bigint, h bigint").groupBy("cell", "h").agg(F.count("*").alias("n"))
    whole = told.groupBy("cell").agg((F.count("*") / 2).alias("half"))
    most = counted.join(whole, "cell").filter("n > half").groupBy("cell").agg(F.collect_list("h").alias("centre"))
    return whole.select("cell").join(most, "cell", "left").select("cell", F.coalesce("centre", F.array().cast("array<bigint>")).alias("centre"))


def _measured(members: DataFrame, centres: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Rows (cell, d, n, far, rest): the size of a member's set, and by how many shingles and by which it differs from the centre of its cell.

    ``rest`` is null where these are more than half of the set: such a member is no near one.

    A cell of any size is dealt to units of ``BATCH`` members, and a centre goes along once for each.
    """
    counts = members.groupBy("cell").agg(F.count("*").alias("_c"))
    units = members.join(counts, "cell").select("cell", "d", F.pmod(F.xxhash64("d"), F.ceil(F.col("_c") / BATCH)).cast("int").alias("unit"))
    heads = units.select("cell", "unit").distinct().join(centres, "cell").select("cell", "unit", F.lit(None).cast("bigint").alias("d"), F.lit(None).cast("string").alias("text"), "centre")
    rows = units.join(texts.withColumnRenamed("doc_id", "d"), "d").select("cell", "unit", "d", "text", F.lit(None).cast("array<bigint>").alias("centre"))
    ordered = rows.union(heads).repartition("cell", "unit").sortWithinPartitions("cell", "unit", F.col("d").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            cell, d = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = []
            for part in text_slices(batch.column(3)):
                h, at = shingle_sets(part, words)
                for i in range(len(part)):
                    k = part.lo + i
                    if d[k] is None:
                        centre = np.sort(batch.column(4)[k].values.to_numpy(zero_copy_only=False).view(np.uint64))
                        continue
                    own = h[at[i] : at[i + 1]]
                    other = np.setxor1d(centre, own, assume_unique=True)
                    out.append((cell[k], d[k], len(own), len(other), other.view(np.int64) if 2 * len(other) <= len(own) else None))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "d", "n", "far", "rest"])

    types = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    return ordered.mapInArrow(run, "cell bigint, d bigint, n bigint, far bigint, rest array<bigint>")


def _starred(measured: DataFrame, num: int, den: int) -> DataFrame:
    """Links (star, d) to the member of each cell that its centre shows to be linked with the most.

    Two sets differ by at most the sum of their distances to the centre. With w = (den + num) * far - (den - num) * n they are linked if their
    w add up to 0 or less, so the member of least w is linked with all that any member is shown to be linked with.
    """
    w = (den + num) * F.col("far") - (den - num) * F.col("n")
    weighed = measured.select("cell", "d", w.alias("w"))
    best = weighed.groupBy("cell").agg(F.min(F.struct("w", "d")).alias("m"))
    joined = weighed.join(best, "cell").filter((F.col("w") + F.col("m.w") <= 0) & (F.col("d") != F.col("m.d")))
    return joined.select(F.col("m.d").alias("star"), "d").distinct()


def _pairs_of_near(near: DataFrame, num: int, den: int) -> DataFrame:
    """Linked pairs (a, b) of near members of one cell that the bound of ``_starred`` does not show.

    What two sets differ by is the sum of their distances to the centre less twice what their rests have in common. So a pair must
    share elements of its rests, the more the farther it is. Independent changes share none, and such members never meet. Rests are ordered by how
    often an element occurs in the cell, rare ones first, and meet in their first elements.
    """
    unit = den + num
    weighed = near.withColumn("w", unit * F.col("far") - (den - num) * F.col("n"))
    least = weighed.groupBy("cell").agg(F.min("w").alias("_low"))
    told = cut(weighed.join(least, "cell").withColumn("_key", F.monotonically_increasing_id()), "near")
    every = told.select("cell", "_key", F.explode("rest").alias("h"))
    often = every.groupBy("cell", "h").agg(F.count("*").alias("_often")).filter("_often > 1")
    # A linked pair has at least so many elements in common, whoever the other one is.
    need = F.greatest(F.ceil((F.col("w") + F.col("_low")) / (2 * unit)), F.lit(1))
    ranked = every.join(often, ["cell", "h"], "left").join(told.select("_key", F.size("rest").alias("_size"), need.alias("_need")), "_key")
    place = F.row_number().over(Window.partitionBy("_key").orderBy(F.coalesce("_often", F.lit(1)), "h"))
    first = ranked.withColumn("_place", place).filter("_place <= _size - _need + 1 AND _often > 1").select("cell", "h", "_key", (F.col("_size") - F.col("_place") + 1).alias("_left"))
    member = told.select("_key", "d", "w", "rest")
    x, y = first.join(told.select("_key", "w"), "_key").alias("x"), first.join(told.select("_key", "w"), "_key").alias("y")
    on = (F.col("x.cell") == F.col("y.cell")) & (F.col("x.h") == F.col("y.h")) & (F.col("x._key") < F.col("y._key")) & (F.col("x.w") + F.col("y.w") > 0)
    # If this is the first element they share, they share no more than what is left of both.
    on = on & (F.col("x.w") + F.col("y.w") <= 2 * unit * F.least("x._left", "y._left"))
    pairs = x.join(y, on).select(F.col("x._key").alias("i"), F.col("y._key").alias("j")).distinct()
    both = pairs.join(member.toDF("i", "a", "wi", "ri"), "i").join(member.toDF("j", "b", "wj", "rj"), "j")
    common = F.size(F.array_intersect("ri", "rj"))
    return both.filter(F.col("wi") + F.col("wj") <= 2 * unit * common).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _settled() -> Column:
    """Pairs of near members of one cell, which ``_starred`` and ``_pairs_of_near`` settle."""
    return F.coalesce(F.col("x.near") == F.col("y.near"), F.lit(False))


def _pairs_of_leaves(members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of small regions that may be linked."""
    x, y = members.alias("x"), members.alias("y")
    on = (F.col("x.s") == F.col("y.s")) & (F.col("x.d") < F.col("y.d")) & ~_settled() & _may_link("x", "y", num, den)
    return x.join(y, on).select(F.col("x.d").alias("a"), F.col("y.d").alias("b")).distinct()


def _size_class(n: Column) -> Column:
    """Small sizes are classes of their own; the larger ones come in 32 classes from each power of two to the next."""
    return F.when(n < 64, n).otherwise(F.floor(F.log2(n) * 32) - 128).cast("bigint")


def _pairs_of_rest(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of large regions that may be linked, and whose distances to a centre don't keep them apart.

    In a region the near members of its most usual cell need not meet each other: each pair has one member at least that is not of them.
    Sets of a cell differ by at least the difference of their distances. Members are joined by size: the smaller of a linked pair has
    one of the sizes that follow from the larger one and the place of its anchor. They are joined by classes of sizes, of which
    these are few for sets of any size.
    """
    counts = rows.filter("near IS NOT NULL").groupBy("s", "near").agg(F.count("*").alias("_n"))
    usual = counts.groupBy("s").agg(F.max(F.struct("_n", "near")).alias("_u")).select("s", F.col("_u.near").alias("usual"))
    rows = rows.join(usual, "s", "left").withColumn("odd", ~F.coalesce(F.col("near") == F.col("usual"), F.lit(False)))
    rows = cut(rows.drop("usual"), "members")
    most = F.floor((F.col("n") - F.col("pos")) * (num + den) / num).cast("bigint") - F.col("n")
    most = F.least(most, F.col("n"))
    least = F.ceil(F.col("n") * num / den).cast("bigint")
    larger = rows.filter(least <= most).withColumns({"least": least, "most": most})
    larger = larger.withColumn("size", F.explode(F.sequence(_size_class(F.col("least")), _size_class(F.col("most")))))
    rows = rows.withColumn("size", _size_class(F.col("n")))
    far = F.abs(F.col("x.far") - F.col("y.far")) * (num + den) > (den - num) * (F.col("x.n") + F.col("y.n"))
    far = F.coalesce((F.col("x.cell") == F.col("y.cell")) & far, F.lit(False))
    order = (F.col("x.n") > F.col("y.n")) | (F.col("x.d") > F.col("y.d"))
    sized = (F.col("x.size") == F.col("y.size")) & F.col("y.n").between(F.col("x.least"), F.col("x.most"))
    on = (F.col("x.s") == F.col("y.s")) & sized & order & ~_settled() & _may_link("x", "y", num, den) & ~far
    one = larger.filter("odd").alias("x").join(rows.alias("y"), on)
    other = larger.filter("NOT odd").alias("x").join(rows.filter("odd").alias("y"), on)
    return one.union(other).select(F.least("x.d", "y.d").alias("a"), F.greatest("x.d", "y.d").alias("b")).distinct()


def links(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between class representatives that join what Jaccard similarity of ``num / den`` or more joins, and membership (doc_id, n, rep).

    ``docs`` has doc_id and text. ``rep`` is null for empty sets.
    """
    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets = cut(_prefixes(texts, frequency_sketch(texts, words, num, den), words, num, den), "sets")
    classes = cut(sets.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    membership = sets.select("doc_id", "n", "s1", "s2").join(classes.drop("copies"), ["s1", "s2", "n"], "left").select("doc_id", "n", "rep")
    anchors = _representatives(sets, classes)
    entries = anchors.select(F.col("doc_id").alias("d"), "n", F.posexplode("prefix").alias("pos", "s"))
    shared = anchors.select(F.explode("prefix").alias("s")).groupBy("s").agg(F.count("*").alias("c")).filter("c > 1")
    regions = cut(entries.join(shared, "s").select("s", "d", "n", "pos", "c"), "regions")
    together = F.col("na") + F.col("nb") - F.col("common")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "candidates")
        met = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
        pairs = cut(_checked_by_anchors(pairs, _representatives(_narrowed(sets, met), classes), num, den), "pairs")
        used = _texts_of(texts, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")))
        return cut(_common(pairs, used, words).filter(den * F.col("common") >= num * together).select("a", "b").distinct(), "linked")

    big = regions.filter(F.col("c") > LEAF)
    none = F.lit(None).cast("bigint")
    if big.isEmpty():
        return linked(_pairs_of_leaves(regions.withColumn("near", none), num, den)), membership
    used = _texts_of(texts, big.select(F.col("d").alias("doc_id")))
    members = cut(_cells(big), "cells")
    measured = cut(_measured(members, cut(_centres(members, used, words), "centres"), used, words), "measured")
    # An id with several texts has no one distance, and is no near member.
    one = measured.groupBy("d").agg(F.count("*").alias("_texts"))
    told = measured.join(one, "d").filter("_texts = 1")
    near = told.filter("rest IS NOT NULL")
    stars = _starred(near, num, den).select(F.col("star").alias("a"), F.col("d").alias("b"))
    found = stars.union(_pairs_of_near(near, num, den))
    places = told.select("d", "cell", "far", F.when(F.col("rest").isNotNull(), F.col("cell")).alias("near"))
    known = regions.join(places, "d", "left")
    pairs = _pairs_of_leaves(known.filter(F.col("c") <= LEAF), num, den)
    rest = _pairs_of_rest(known.filter(F.col("c") > LEAF).drop("c"), num, den)
    return cut(found.union(linked(pairs.union(rest).distinct())).distinct(), "found"), membership


def components_of(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to, its own included)."""
    linked, membership = links(docs, words, num, den)
    comps = components(linked)
    out = membership.join(comps, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with exactly one row of each component: that of the smallest id (none comes first), then of the smallest digest of its text.

    Each row is a document of its own here, whatever its id: rows without one and rows that repeat one are joined like all others.
    A row whose text has no words is a component of its own.
    """
    # Written once, so that the numbers are the same in every scan.
    rows = cut(docs.withColumn("_key", F.monotonically_increasing_id()), "rows", "zstd")
    comps = components_of(rows.select(F.col("_key").alias("doc_id"), "text"), words, num, den)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # The number decides among equal rows only.
    order = F.struct("doc_id", F.md5("text"), F.md5(F.to_json(F.struct(*rest))) if rest else F.lit(None).cast("string"), "_key")
    places = rows.select("_key", order.alias("_order")).join(comps.select(F.col("doc_id").alias("_key"), "component_id"), "_key")
    kept = places.groupBy("component_id").agg(F.min("_order").alias("_least")).select(F.col("_least._key").alias("_key"))
    return _numbered(rows, kept).select(*docs.columns)
