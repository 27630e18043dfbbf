r"""Repair of conversations whose roles don't alternate, at least cost, by divide and conquer in linear space.

A repaired conversation is empty, or an optional system turn and then pairs of a user and an assistant turn. Turns are kept
(K, free), given the role user or assistant (R, 3) or deleted (D, 4, the only choice for blank turns and duplicates), and turns without text are inserted
(I, 3); a truncated turn that is not deleted costs 3 more. Of the cheapest edits those count whose initials come first in ASCII order.

Four states tell what was written last: nothing, system, user, assistant. Each initial leads from a state to one other, so the initials tell all.
A vector holds, for each state, the least cost up to a row and the rank of the first of the cheapest
initials among the states. Two different states have initials of which neither begins the other, so ranks are all that ties need.
A run of rows is solved by a forward vector from its first row and a backward vector of costs from its last one, which meet in the middle:
the state of least total cost, least rank among ties, splits the run in two.

A conversation of any length is cut into blocks of ``BLOCK_ROWS`` rows. Each block gives the least costs and ranks from each state to each state; the blocks of
a conversation are chained by one pass forward that keeps where each state came from and one pass back, both with one vector
in memory; then all blocks are solved side by side. Only the digest of a whole conversation is worked out in one stream, part by part.

Defined cases: null roles and texts are one space; turns that tie are in order of role, the first characters of the text and a digest; a null turn comes
first; rows without a conversation id are a conversation of their own; a role is judged by its first character, and a row with
an empty role can't be kept as it is; a span of turns beyond a long has null gaps; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .scans import partitions_of, with_prefix_sums

BLOCK_ROWS = 4096
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
# What a reroled or an inserted turn becomes after each state.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
# Insertions that end a conversation after each state.
ENDING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

SOLID = r"[^\x20\x09-\x0D]"
# Faults of a row: none, blank, duplicate, truncated.
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)

Vector = tuple[tuple[int, int] | None, ...]  # per state (cost, rank), None where it can't be reached


@lru_cache(maxsize=None)
def steps(initial: str, fault: int) -> tuple[dict[int, tuple[int, str]], ...]:
    """For each state before a row, the state after it and the cheapest (cost, initials) that lead there."""
    out = []
    for state in STATES:
        best: dict[int, tuple[int, str]] = {}
        for inserted in range(4):
            ways = [(state, DELETE, "D")]
            if fault not in (BLANK, DUPLICATE):
                extra = TRUNCATED if fault == CUT_OFF else 0
                ways.append((NEXT[state], REROLE + extra, "R"))
                if (state, initial) in KEPT:
                    ways.append((KEPT[state, initial], extra, "K"))
            for after, cost, letter in ways:
                way = (INSERT * inserted + cost, "I" * inserted + letter)
                best[after] = min(best.get(after, way), way)
            state = NEXT[state]
        out.append(best)
    return tuple(out)


def begin(state: int) -> Vector:
    return tuple((0, 0) if s == state else None for s in STATES)


def _ranked(found: dict[int, tuple[int, tuple]]) -> Vector:
    """Vector of per state (cost, order) with orders replaced by their ranks."""
    order = {s: k for k, s in enumerate(sorted(found, key=lambda s: found[s][1]))}
    return tuple((found[s][0], order[s]) if s in found else None for s in STATES)


def _lowered(vector: Vector) -> tuple[Vector, int]:
    low = min(v[0] for v in vector if v)
    return tuple(v and (v[0] - low, v[1]) for v in vector), low


@lru_cache(maxsize=1 << 16)
def _forward(vector: Vector, initial: str, fault: int) -> tuple[Vector, int]:
    found: dict[int, tuple[int, tuple]] = {}
    for state, known in enumerate(vector):
        if known:
            for after, (cost, letters) in steps(initial, fault)[state].items():
                way = (known[0] + cost, (known[1], letters))
                found[after] = min(found.get(after, way), way)
    return _lowered(_ranked(found))


def forward(vector: Vector, rows: list[tuple[str, int]]) -> Vector:
    """The vector after ``rows``. Costs are kept beside a lowered vector, of which there are few, so each step is looked up."""
    vector, total = _lowered(vector)
    for initial, fault in rows:
        vector, low = _forward(vector, initial, fault)
        total += low
    return tuple(v and (v[0] + total, v[1]) for v in vector)


@lru_cache(maxsize=1 << 16)
def _backward(costs: tuple[int | None, ...], initial: str, fault: int) -> tuple[tuple[int | None, ...], int]:
    out = []
    for state in STATES:
        ways = [cost + costs[after] for after, (cost, _) in steps(initial, fault)[state].items() if costs[after] is not None]
        out.append(min(ways, default=None))
    low = min(c for c in out if c is not None)
    return tuple(c if c is None else c - low for c in out), low


def backward(state: int, rows: list[tuple[str, int]]) -> tuple[int | None, ...]:
    """Per state before ``rows`` the least cost to be in ``state`` after them, less a number that is the same for all."""
    costs: tuple[int | None, ...] = tuple(0 if s == state else None for s in STATES)
    for initial, fault in reversed(rows):
        costs, _ = _backward(costs, initial, fault)
    return costs


def solve(rows: list[tuple[str, int]], before: int, after: int) -> list[str]:
    """The initials of each row on the first of the cheapest ways from state ``before`` to ``after``."""
    if len(rows) == 1:
        return [steps(*rows[0])[before][after][1]]
    middle = len(rows) // 2
    to, back = forward(begin(before), rows[:middle]), backward(after, rows[middle:])
    crossing = min((to[s][0] + back[s], to[s][1], s) for s in STATES if to[s] and back[s] is not None)[2]
    return solve(rows[:middle], before, crossing) + solve(rows[middle:], crossing, after)


def closing(vector: Vector) -> tuple[int, int]:
    """Last state and cost of the cheapest end of a conversation."""
    ways = [(v[0] + INSERT * len(ENDING[s]), v[1], s) for s, v in enumerate(vector) if v]
    cost, _, state = min(ways)
    return state, cost


def written(letters: str, state: int) -> tuple[list[str], str | None, int]:
    """Roles that ``letters`` insert, what becomes of the row (``keep``, a role, or None: deleted), and the state reached, but for a kept row."""
    inserted, fate = [], None
    for letter in letters:
        if letter == "I":
            state = NEXT[state]
            inserted.append(ROLE_OF[state])
        elif letter == "R":
            state = NEXT[state]
            fate = ROLE_OF[state]
        elif letter == "K":
            fate = "keep"
    return inserted, fate, state


def numbered(turns: DataFrame) -> DataFrame:
    """Rows (_conv, pos, turn, role, text, fault): each conversation's rows in order, from 0."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(_key(F.col("conv_id")).alias("_conv"), "turn", role.alias("role"), text.alias("text"))
    order = {"_head": F.substring("text", 1, 64), "_digest": F.md5(F.concat("role", F.lit("\n"), "text")), "_one": F.lit(1)}
    ordered = with_prefix_sums(rows.withColumns(order), "_conv", ["turn", "role", "_head", "_digest"], "_one", "pos")
    placed = cut(ordered.select("_conv", "pos", "turn", "role", "text"), "turns")
    # The first row of each text is found by groups that combine before the shuffle, and joined by its place, which is unique.
    firsts = placed.groupBy("_conv", "role", "text").agg(F.min("pos").alias("pos")).select("_conv", "pos", F.lit(True).alias("_first"))
    # The last solid character, unless it ends a sentence.
    cut_off = F.col("text").rlike(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z")
    fault = F.when(~F.col("text").rlike(SOLID), BLANK).when(F.col("_first").isNull(), DUPLICATE).when(cut_off, CUT_OFF).otherwise(SOUND)
    return placed.join(firsts, ["_conv", "pos"], "left").withColumn("fault", fault.cast("int")).drop("_first")


def _key(conv: Column) -> Column:
    """Text of a conversation id that tells a null one."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Per block: its rows' initials and faults, costs and ranks between all states (-1: no way), and illegal neighbours in it."""
    narrow = rows.select("_conv", F.floor(F.col("pos") / block_rows).alias("block"), "pos", F.substring("role", 1, 1).alias("initial"), "fault")
    dealt = narrow.repartition(partitions_of(rows), "_conv", "block").sortWithinPartitions("_conv", "block", "pos")
    schema = "_conv string, block bigint, initials array<string>, faults array<int>, costs array<bigint>, ranks array<int>, illegal bigint"

    def packed(done: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64()]
        names = ["_conv", "block", "initials", "faults", "costs", "ranks", "illegal"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    def block_row(key: tuple, initials: list[str], faults: list[int]) -> tuple:
        own = list(zip(initials, faults, strict=True))
        ends = [v for s in STATES for v in forward(begin(s), own)]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))
        return *key, initials, faults, [v[0] if v else -1 for v in ends], [v[1] if v else -1 for v in ends], illegal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, initials, faults = None, [], []
        for batch in batches:
            done = []
            for conv, block, _, initial, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key is not None and key != (conv, block):
                    done.append(block_row(key, initials, faults))
                    initials, faults = [], []
                key = (conv, block)
                initials.append(initial)
                faults.append(fault)
            if done:
                yield packed(done)
        if key is not None:
            yield packed([block_row(key, initials, faults)])

    return dealt.mapInArrow(run, schema)


def joined_vector(vector: Vector, costs: list[int], ranks: list[int]) -> tuple[Vector, list[int]]:
    """The vector after a block, and the state each of its states came from (-1: none)."""
    found: dict[int, tuple[int, tuple]] = {}
    came = [-1] * 4
    for state, known in enumerate(vector):
        if known:
            for after in STATES:
                if costs[4 * state + after] >= 0:
                    way = (known[0] + costs[4 * state + after], (known[1], ranks[4 * state + after]))
                    if after not in found or way < found[after]:
                        found[after], came[after] = way, state
    return _ranked(found), came


def _chained(blocks: DataFrame) -> DataFrame:
    """Per block where each state came from; the last one of a conversation has its last state, cost and illegal neighbours."""
    schema = "_conv string, block bigint, came array<int>, last int, cost bigint, illegal bigint"
    names = ["_conv", "block", "came", "last", "cost", "illegal"]
    types = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64()]
    edge = blocks.select("_conv", "block", "costs", "ranks", "illegal", F.element_at("initials", 1).alias("first"), F.element_at("initials", -1).alias("final"))
    dealt = edge.repartition(partitions_of(blocks), "_conv").sortWithinPartitions("_conv", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, vector, illegal, final = None, None, 0, ""
        for batch in batches:
            done = []
            for conv, block, costs, ranks, bad, first, end in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held is not None and held[0] == conv:
                    done.append((*held, None, None, None))
                    illegal += bad + (final + first not in ("su", "ua", "au"))
                else:
                    if held is not None:
                        done.append((*held, *closing(vector), illegal))
                    vector, illegal = begin(NOTHING), bad
                vector, came = joined_vector(vector, costs, ranks)
                held, final = (conv, block, came), end
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*held, *closing(vector), illegal), types, strict=True)], names)

    return dealt.mapInArrow(run, schema)


def _ends(chained: DataFrame) -> DataFrame:
    """Per block the states before and after it, followed back from the last one."""
    dealt = chained.select("_conv", "block", "came", "last").repartition(partitions_of(chained), "_conv").sortWithinPartitions("_conv", F.desc("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            done = []
            for conv, block, came, last in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                after = before if last is None else last
                before = came[after]
                done.append((conv, block, before, after, last is not None))
            if done:
                columns = list(zip(*done, strict=True))
                types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["_conv", "block", "before", "after", "ends"])

    return dealt.mapInArrow(run, "_conv string, block bigint, before int, after int, ends boolean")


def _edits(blocks: DataFrame, ends: DataFrame, block_rows: int) -> DataFrame:
    """Per row: its initials, the roles inserted before it, its fate, and the roles inserted after the last one."""
    both = blocks.select("_conv", "block", "initials", "faults").join(ends, ["_conv", "block"])
    names = ["_conv", "pos", "edit", "inserted", "fate", "appended"]
    types = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for conv, block, initials, faults, before, after, ends in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                state, pos = before, block * block_rows
                found = solve(list(zip(initials, faults, strict=True)), before, after)
                for k, letters in enumerate(found):
                    inserted, fate, state = written(letters, state)
                    if fate == "keep":
                        state = KEPT[state, initials[k]]
                    tail = ENDING[after] if ends and k == len(found) - 1 else ""
                    done.append((conv, pos + k, letters + tail, inserted, fate, written(tail, state)[0]))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    return both.mapInArrow(run, "_conv string, pos bigint, edit string, inserted array<string>, fate string, appended array<string>")


class Repair:
    """A repair of all conversations of (conv_id, turn, role, text). Its tables are written once and read by what asks for them."""

    def __init__(self, turns: DataFrame, block_rows: int = BLOCK_ROWS):
        self.ids = turns.select("conv_id").distinct().withColumn("_conv", _key(F.col("conv_id")))
        self.rows = cut(numbered(turns), "numbered")
        blocks = cut(_blocks(self.rows, block_rows), "blocks")
        self.chained = cut(_chained(blocks), "chained")
        self.edits = cut(_edits(blocks, _ends(self.chained), block_rows), "edits")

    def _lines(self) -> DataFrame:
        """Each row with the turns written in its place."""
        added = "transform({}, r -> struct(r AS role, '' AS text))"
        own = "IF(fate IS NULL, array(), array(struct(IF(fate = 'keep', role, fate) AS role, text AS text)))"
        written_turns = F.expr(f"concat({added.format('inserted')}, {own}, {added.format('appended')})")
        return self.rows.join(self.edits, ["_conv", "pos"]).withColumn("lines", written_turns)

    def turns(self) -> DataFrame:
        """The repaired conversations: conv_id, pos (of the row that a turn comes from or stands beside), line, role, text."""
        lines = self._lines().select("_conv", "pos", F.posexplode("lines").alias("line", "made"))
        return lines.join(self.ids, "_conv").select("conv_id", "pos", "line", "made.role", "made.text")

    def faults(self) -> DataFrame:
        """Per conversation: _conv, gaps in its turn numbers, blank, duplicate and truncated rows."""
        kinds = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": CUT_OFF}
        counts = [F.count_if(F.col("fault") == k).cast("bigint").alias(name) for name, k in kinds.items()]
        per_turn = self.rows.groupBy("_conv", "turn").agg(*counts)
        span = F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), F.lit(1) - F.count("turn"))
        gaps = F.when(F.count("turn") == 0, 0).otherwise(span).cast("bigint")
        return per_turn.groupBy("_conv").agg(gaps.alias("gaps"), *[F.sum(k).alias(k) for k in kinds])

    def digests(self) -> DataFrame:
        """Per conversation: _conv, audit (all initials), repaired_sha256 of the lines ``role:text``. Streams each conversation in order."""
        dealt = self._lines().select("_conv", "pos", "edit", F.expr("transform(lines, l -> concat(l.role, ':', l.text))").alias("lines"))
        dealt = dealt.repartition(partitions_of(self.rows), "_conv").sortWithinPartitions("_conv", "pos")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, audit, digest, first = None, [], hashlib.sha256(), True
            for batch in batches:
                done = []
                for conv, _, edit, lines in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if conv != current:
                        if current is not None:
                            done.append((current, "".join(audit), digest.hexdigest()))
                        current, audit, digest, first = conv, [], hashlib.sha256(), True
                    audit.append(edit)
                    for line in lines:
                        digest.update((line if first else "\n" + line).encode())
                        first = False
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], ["_conv", "audit", "repaired_sha256"])
            if current is not None:
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (current, "".join(audit), digest.hexdigest())], ["_conv", "audit", "repaired_sha256"])

        return dealt.mapInArrow(run, "_conv string, audit string, repaired_sha256 string")

    def report(self, ids: DataFrame) -> DataFrame:
        """Per conversation of ``ids`` (conv_id), those without rows too: faults, illegal neighbours, cost, audit and digest."""
        asked = ids.select("conv_id").distinct().withColumn("_conv", _key(F.col("conv_id")))
        costs = self.chained.filter("last IS NOT NULL").select("_conv", "illegal", "cost")
        found = asked.join(self.faults(), "_conv", "left").join(costs, "_conv", "left").join(self.digests(), "_conv", "left")
        # A conversation with rows has an audit; its gaps may be null.
        none = F.col("audit").isNull()
        whole = [F.when(none, F.lit(0)).otherwise(F.col(c)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        digest = F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))
        return found.select("conv_id", *whole, F.coalesce("audit", F.lit("")).alias("audit"), digest.alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows damaged by a checksum of their conversation and turn: dropped, emptied, without sentence ends, repeated, or said by the user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = (F.crc32(key) % 20).cast("int")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    hurt = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.expr("explode(sequence(1, IF(_kind = 3, 2, 1)))")
    return (
        turns.withColumn("_kind", kind)
        .filter("_kind <> 0")
        .select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(role).alias("role"), hurt.alias("text"), copies.alias("_copy"))
        .drop("_copy")
    )
