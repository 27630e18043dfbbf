"""Conversation repair against a search over all edits, on hard rows and with small blocks."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import pytest

from tunnelscope.llm import repair

ROLES = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos string, block int"


def cheapest(rows):
    """(cost, audit, lines) of (role, text, fault) rows: uniform-cost search, ties by the audit so far."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        if at == len(rows) and ROLES.match(roles):
            return cost, audit, list(lines)
        # What follows depends on the place and on the last role alone.
        if (at, roles[-1:]) in seen:
            continue
        seen.add((at, roles[-1:]))
        grown = []
        if at < len(rows):
            role, text, fault = rows[at]
            grown.append((cost + 4, audit + "D", at + 1, roles, lines))
            if fault not in (1, 2):
                extra = 3 * (fault == 3)
                if role[:1]:
                    grown.append((cost + extra, audit + "K", at + 1, roles + role[0], (*lines, f"{role}:{text}")))
                grown += [(cost + 3 + extra, audit + "R", at + 1, roles + r[0], (*lines, f"{r}:{text}")) for r in ("user", "assistant")]
        grown += [(cost + 3, audit + "I", at, roles + r[0], (*lines, f"{r}:")) for r in ("user", "assistant")]
        for g in grown:
            if re.match(r"(s?(ua)*u?)?\Z", g[3]):
                heapq.heappush(heap, g)
    raise AssertionError


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(rows):
    """Report of one conversation of (turn, role, text) rows in order."""
    empty = hashlib.sha256().hexdigest()
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", empty
    full = faults_of([r[1:] for r in rows])
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    kinds = [sum(f == k for *_, f in full) for k in (1, 2, 3)]
    initials = [r[:1] for r, *_ in full]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, lines = cheapest(full)
    return gaps, *kinds, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.md5(f"{r[1]}\n{r[2]}".encode()).hexdigest()))


def random_rows(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", ""]
    texts = ["a.", "b!", "c?", "open", "", " ", "d. \n", "e.\x0b", "f"]
    return [(rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{k}.") for k in range(n)]


def test_solve_is_the_first_of_the_cheapest():
    rng = random.Random(1)
    for _ in range(600):
        rows = [(rng.choice("suat"), rng.choice([0, 0, 0, 1, 3])) for _ in range(rng.randint(1, 9))]
        vector = repair.forward(repair.begin(repair.NOTHING), rows)
        last, cost = repair.closing(vector)
        audit = "".join(repair.solve(rows, repair.NOTHING, last)) + repair.ENDING[last]
        assert (cost, audit) == cheapest([(r, "", f) for r, f in rows])[:2]


def test_blocks_join_to_the_whole():
    rng = random.Random(2)
    for _ in range(200):
        rows = [(rng.choice("suat"), rng.choice([0, 0, 1, 3])) for _ in range(12)]
        vector = repair.begin(repair.NOTHING)
        for at in range(0, 12, 4):
            ends = [v for s in repair.STATES for v in repair.forward(repair.begin(s), rows[at : at + 4])]
            vector, _ = repair.joined_vector(vector, [v[0] if v else -1 for v in ends], [v[1] if v else -1 for v in ends])
        assert vector == repair.forward(repair.begin(repair.NOTHING), rows)


@pytest.mark.parametrize("block_rows", [1, 3, 4096])
def test_report(spark, block_rows):
    rng = random.Random(block_rows)
    talks = {c: random_rows(rng, rng.randint(1, 14)) for c in [None, *range(60)]}
    talks[100] = random_rows(rng, 40)
    talks[101] = [(0, "user", "same."), (0, "user", "same."), (0, "user", "same.")]
    rows = [(c, t, r, x, "x", 1) for c, own in talks.items() for t, r, x in own]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, SCHEMA)
    ids = spark.createDataFrame([(c,) for c in [*talks, 999, 999]], "conv_id bigint")
    got = {r[0]: tuple(r)[1:] for r in repair.Repair(table, block_rows).report(ids).collect()}
    assert got == {c: expected(order(talks.get(c, []))) for c in [*talks, 999]}


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "hi."), (1, 1, "user", "more."), (1, 2, "tool", "x."), (2, 0, "assistant", "only."), (3, 0, "user", " ")]
    done = repair.Repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), 2)
    out = {}
    for r in done.turns().orderBy("conv_id", "pos", "line").collect():
        out.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert all(out.get(c, []) == cheapest(faults_of([r[2:] for r in rows if r[0] == c]))[2] for c in (1, 2, 3))


def test_nulls_and_long_texts(spark):
    rows = [(1, None, None, None), (1, 0, None, "x" * 1_000_000), (1, 1, "assistant", None), (None, None, "user", "hi."), (2, -(2**63), "user", "a."), (2, 2**63 - 1, "assistant", "b.")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in repair.Repair(table).report(table).collect()}
    assert (got[1]["blank"], got[1]["truncated"], got[2]["gaps"], got[2]["audit"], got[None]["audit"]) == (2, 1, None, "KK", "KI")


def damage(rows):
    """Rows by conversation after damage, by hand."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: order(own) for c, own in out.items()}


def test_query_on_a_table(spark, tmp_path):
    rng = random.Random(9)
    rows = [(c, t, r, x) for c in [None, *range(150)] for t, r, x in random_rows(rng, rng.randint(1, 7))]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    from tunnelscope.llm import queries

    got = {r[0]: tuple(r)[1:] for r in queries.op13_repair(spark, str(tmp_path)).collect()}
    assert got == {c: expected(own) for c, own in damage(rows).items()}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.Repair(none).report(none).count() == 0
    assert repair.Repair(none).turns().count() == 0


def test_all_short_conversations():
    for n in (1, 2, 3):
        for rows in product(product("suat", (0, 1, 3)), repeat=n):
            vector = repair.forward(repair.begin(repair.NOTHING), list(rows))
            last, cost = repair.closing(vector)
            audit = "".join(repair.solve(list(rows), repair.NOTHING, last)) + repair.ENDING[last]
            assert (cost, audit) == cheapest([(r, "", f) for r, f in rows])[:2]
