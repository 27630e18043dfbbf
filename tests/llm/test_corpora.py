"""Operators on whole tables against brute force, on hard rows, groups of copies and empty tables."""

import hashlib
import heapq
import random
from collections import Counter

import pytest
from corpus import SCHEMA, copied_rows, hard_rows, table
from pyspark.sql import functions as F

from tunnelscope.llm import jaccard, mixture, repeats, sharding, topk
from tunnelscope.llm.components import components

SPACE = b" \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def rows():
    return hard_rows() + copied_rows()


def size_of(text):
    return len((text or "").encode().split())


def brute_targets(sizes: dict, share=1.5, most=2, weights=(3, 1, 2)) -> dict:
    """Deals the share by weight, and what is above a source's limit again among the others, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if per * weight[s] >= most * sizes[s]}
        if not above:
            return target | {s: per * weight[s] for s in open_}
        for s in above:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= above
    return target


def test_mix(spark, rows):
    docs = table(spark, rows)
    out = mixture.mix(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"]) for r in out) == sorted((i is None, i, size_of(t)) for i, t, *_ in rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += size_of(t)
    for s, target in brute_targets(sizes).items():
        own = [r for r in out if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(target) and 0 <= r["taken"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= 0.5
    again = mixture.mix(docs.repartition(5)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_mixed_documents_hold_the_words_taken(spark, rows):
    docs = table(spark, rows)
    out = mixture.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = Counter()
    for r in mixture.mix(docs).collect():
        taken[r["source"]] += r["taken"]
    got = Counter()
    texts = {t for _, t, *_ in rows}
    for r in out.collect():
        got[r["source"]] += size_of(r["text"])
        assert r["n_chars"] == len(r["text"])
        assert any(t and t.startswith(r["text"]) for t in texts)
    assert got == +taken


def test_shards(spark, rows):
    out = sharding.shard_documents(table(spark, rows), shards=4, parts_per_shard=5).collect()
    of: dict = {}
    load, slots = Counter(), {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
    for (_, t, *_) in rows:
        found = {r["shard"] for r in out if r["size"] == len((t or "").encode()) + 1 and any(i == r["doc_id"] and x == t for i, x, *_ in rows)}
        of.setdefault(t, set()).update(found)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = Counter(t for _, t, *_ in rows)
    for t, n in texts.items():
        ids = {i for i, x, *_ in rows if x == t}
        if n > 1 and t:
            assert len({r["shard"] for r in out if r["doc_id"] in ids and r["size"] == len(t.encode()) + 1}) == 1
    largest = max(len(t.encode()) + 1 for t in texts if t)
    assert max(load.values()) <= sum(load.values()) / 4 + largest
    assert sum(load.values()) == sum(len((t or "").encode()) + 1 for _, t, *_ in rows)


def test_schedule_is_longest_first():
    rng = random.Random(1)
    items = [(f"i{k}", rng.randint(1, 100)) for k in range(200)]
    heap = [(0, s) for s in range(8)]
    want = {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        want[name] = s
        heapq.heappush(heap, (load + size, s))
    assert sharding.schedule(items, 8) == want


def shingle_set(text, k):
    w = bytes((text or "").encode()).translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}


def brute_components(sets: dict, num, den) -> dict:
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            common = len(a & b)
            if common and den * common >= num * (len(a) + len(b) - common):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("words", "num", "leaf"), [(3, 90, 24), (3, 90, 3), (5, 80, 3), (1, 50, 24)])
def test_jaccard_components(spark, rows, monkeypatch, words, num, leaf):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    sets = {i: shingle_set(t, words) for i, t, *_ in rows if i is not None}
    want = brute_components(sets, num, 100)
    out = jaccard.components_of(table(spark, rows), words, num, 100).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out} == {(i, len(sets[i]), want[i]) for i in sets}
    assert len(out) == sum(i is not None for i, *_ in rows)


def test_one_of_each_component_stays(spark, rows):
    docs = table(spark, rows)
    want = brute_components({i: shingle_set(t, 5) for i, t, *_ in rows if i is not None}, 80, 100)
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {*want.values(), None}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(50)] + [(rng.randint(2000, 2040), rng.randint(2000, 2040)) for _ in range(25)]
    rng.shuffle(links)
    sets = {n: set() for pair in links for n in pair if pair[0] != pair[1]}
    parent = {n: n for n in sets}
    for _ in range(70):
        for a, b in links:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {(r["node"], r["component"]) for r in got} == set(parent.items())
    assert len(got) == len(parent)


def brute_spans(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    counts = Counter(t[q : q + length] for t in texts for q in range(len(t) - length + 1))
    out = []
    for t in texts:
        spans: list[tuple[int, int]] = []
        for q in range(len(t) - length + 1):
            if counts[t[q : q + length]] > 1:
                if spans and q <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], q + length)
                else:
                    spans.append((q, q + length))
        out.append(spans)
    return out


@pytest.mark.parametrize(("length", "group"), [(400, 128), (60, 128), (60, 3), (33, 128)])
def test_repeated_bytes(spark, rows, monkeypatch, length, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = [*rows, (900, "ab" * 700, "en", "a"), (901, "abc" + "ab" * 300, "en", "a"), (902, "é" * 500, "en", "a")]
    texts = [(t or "").encode() for _, t, *_ in rows]
    want = []
    for (i, *_), t, spans in zip(rows, texts, brute_spans(texts, length), strict=True):
        kept = b"".join(t[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(t)], strict=True))
        want.append((i, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    out = repeats.repeat_digests(table(spark, rows), length).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_texts_without_repeats(spark, rows):
    docs = table(spark, [*rows, (900, "é" * 500, "en", "a"), (901, "xé" + "é" * 450 + "!", "en", "a")])
    out = {r["doc_id"]: r for r in repeats.without_repeats(docs, 99).collect()}
    assert out[0]["text"] == "one two" and out[1]["text"] is None and 900 not in out
    assert out[901]["text"] == "x!" and out[901]["n_chars"] == 2
    assert repeats.without_repeats(docs, 99).columns == docs.columns


VECTORS = [(i, [random.Random(i).uniform(-1, 1) for _ in range(5)], i % 3) for i in range(150)]
ODD_VECTORS = [(200, None, 0), (300, [1.0, None, 0.0, 0.0, 0.0], 0), (400, [float("nan")] * 5, 0), (500, [float("inf")] * 5, 0), (600, [0.5, 0.5], 0), (601, [0.5, 0.5], 0), (700, [], 0), (800, [1e12] * 5, 0), (None, [0.1] * 5, 0), (50, [0.1] * 5, 0), (160, VECTORS[7][1], 0)]


@pytest.mark.parametrize(("tile", "block"), [(2048, 256), (7, 2)])
def test_top_k(spark, tile, block):
    import math

    vectors = VECTORS + ODD_VECTORS
    df = spark.createDataFrame([(i, v, n, 1) for i, v, n in vectors], "vec_id bigint, embedding array<double>, label int, rank int")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 10, tile, block).collect()]
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, x in good:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), c) for c, y in good if c != q and len(y) == len(x))
            want += [(q, -s, c) for s, c in scores[:10]]
    # The id 50 is there twice: its lists are merged, as they are one query.
    assert {(q, s, c) for q, _, c, s in got if q != 50} == {w for w in want if w[0] != 50}
    assert all(r[1] == k + 1 for q in {g[0] for g in got} for k, r in enumerate(sorted(g for g in got if g[0] == q)))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixture.mix(none).count() == 0 and mixture.mixed_documents(none).count() == 0
    assert sharding.shard_documents(none).count() == 0
    assert jaccard.components_of(none).count() == 0 and jaccard.one_of_each(none).count() == 0
    assert repeats.repeat_digests(none).count() == 0 and repeats.without_repeats(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert topk.top_k(vectors, F.col("vec_id") % 100 == 0).count() == 0
