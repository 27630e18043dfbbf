"""Alignment of two tokenisers against the libraries and a plain loop."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from corpus import SCHEMA, copied_rows, hard_rows, table
from tokenizers import Tokenizer as Library

from tunnelscope.llm import crossalign, queries
from tunnelscope.llm.bpe import Encoder, Tokenizer, byte_characters
from tunnelscope.llm.buffers import distinct_spans

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    " ", "  two  blanks ", "x <|endoftext|>y <s> z </s>", "a▁b", "ﬁ ½ İstanbul émile", "\n\n  x\n", "tab\tand\x00nul", "日本語 テキスト 🙂 é",
    "a" * 3000, "a b " * 200, "1234567 8,9.10", "x y　z", "word line \x85", "<0x41> A", "trail   ",
]
ROWS = hard_rows() + copied_rows(2, 4) + [(500 + i, t, "en", "a") for i, t in enumerate(ODD)]


def brute(rows):
    a = Library.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    at = {c: i for i, c in enumerate(byte_characters())}
    spell_a = {i: bytes(at[c] for c in t) for t, i in a.get_vocab().items() if all(c in at for c in t)}

    def spell_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    out, pairs = [], []
    for doc, text, *_ in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(spell_a[i] for i in ids_a) != raw or b"".join(map(spell_b, ids_b)) != raw:
            out.append((doc, 0, 0, 0, 0, ""))
            pairs.append(Counter())
            continue
        ends_a, ends_b = np.cumsum([len(spell_a[i]) for i in ids_a]).tolist(), np.cumsum([len(spell_b(i)) for i in ids_b]).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        groups, x, y = [], 0, 0
        for e in both:
            u, v = ends_a.index(e, x) + 1, ends_b.index(e, y) + 1
            groups.append(f"{','.join(map(str, ids_a[x:u]))}|{','.join(map(str, ids_b[y:v]))}")
            x, y = u, v
        links, j0 = Counter(), 0
        for i, e in enumerate(ends_a):
            begin = ends_a[i - 1] if i else 0
            while ends_b[j0] <= begin:
                j0 += 1
            j = j0
            while j < len(ids_b) and (ends_b[j - 1] if j else 0) < e:
                links[ids_a[i], ids_b[j]] += 1
                j += 1
        out.append((doc, len(ids_a), len(ids_b), len(groups), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        pairs.append(links)
    held = Counter(p for links in pairs for p in links)
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    sums = [(sum(n for p, n in links.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in links.items())) for links in pairs]
    return sorted(repr((*o[:6], *s)) for o, s in zip(out, sums, strict=True))


@pytest.mark.parametrize("block_bytes, memo", [(1 << 21, 200_000), (3000, 20)])
def test_query_equals_a_plain_loop(spark, tmp_path, monkeypatch, block_bytes, memo):
    monkeypatch.setattr(crossalign, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(crossalign, "MEMO_WINDOWS", memo)
    table(spark, ROWS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_alignment(spark, str(tmp_path)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(ROWS)


def test_small_blocks_in_one_process():
    """The same windows, whatever the block: no Spark, so that the small block really holds."""
    import pyarrow as pa

    spec, model = queries.tokenizer_file("byte_bpe_50k.json"), open(B, "rb").read()
    texts = [" " + (r[1] or "") for r in ROWS]
    seen = []
    for size in (200, 1 << 20):
        a, b = Tokenizer(spec, special=False), crossalign.Pieces(model)
        ea, eb, memo = Encoder(a), Encoder(b), crossalign.Windows(crossalign.Spelling(a.bytes_of()), crossalign.Spelling(b.bytes_of()))
        groups = []
        for part in crossalign.text_slices(pa.array(texts), size):
            groups += crossalign.Aligned(part, ea.encode(part), eb.encode(part), memo).groups
            if len(memo.texts) > 50:
                memo.clear()
        seen.append(groups)
    assert seen[0] == seen[1]


def test_pieces_equal_the_library():
    model = open(B, "rb").read()
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), Encoder(crossalign.Pieces(model))
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "the", " ", "  ", "\n", "é", ".", "▁", "日", "\t", "12"]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    for part in crossalign.text_slices(pa.array([" " + t for t in texts]), 500):
        ids, rows = own.encode(part)
        for k in range(len(part)):
            assert not texts[part.lo + k] or ids[rows[k] : rows[k + 1]].tolist() == library.encode(texts[part.lo + k])


def twins(n):
    """Two texts whose polynomial hashes modulo a power of two are equal."""
    first = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return first, first.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_with_equal_polynomials(name):
    import pyarrow as pa

    spec = queries.tokenizer_file(name)
    library, encoder = Library.from_str(spec), Encoder(Tokenizer(spec))
    texts = [t for n in (1024, 2048, 4096) for t in twins(n)]
    for column in (texts, texts[::-1], [x for t in texts for x in (t, "between " + t)]):
        for part in crossalign.text_slices(pa.array(column), 1 << 20):
            ids, rows = encoder.encode(part)
            for k in range(len(part)):
                assert ids[rows[k] : rows[k + 1]].tolist() == library.encode(column[part.lo + k], add_special_tokens=False).ids


def test_spans_with_equal_hashes_are_told_apart(monkeypatch):
    from tunnelscope.llm import buffers

    monkeypatch.setattr(buffers.Rolling, "spans", lambda self, a, b: (b - a).astype(np.uint64))
    data = np.frombuffer(b"abcabdabcxyzab", np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 12]), np.array([3, 6, 9, 12, 14])
    _, sample, which = distinct_spans(data, starts, ends)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert [words[sample[k]] for k in which] == words and len(sample) == 4
    spec = queries.tokenizer_file("byte_bpe_50k.json")
    library, encoder = Library.from_str(spec), Encoder(Tokenizer(spec))
    import pyarrow as pa

    for text in ["one two six ten", "six ten one two", "two one"]:
        part = next(crossalign.text_slices(pa.array([text])))
        assert encoder.encode(part)[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_shingles_of_texts_with_equal_polynomials(spark):
    from tunnelscope.llm import jaccard

    docs = table(spark, [(1, twins(1024)[0], "en", "a"), (2, twins(1024)[1], "en", "a")])
    assert {r["doc_id"]: r["component_id"] for r in jaccard.components_of(docs, words=3, num=90, den=100).collect()} == {1: 1, 2: 2}


def test_empty_table(spark):
    aligned = crossalign.align_documents(spark.createDataFrame([], SCHEMA), queries.tokenizer_file("byte_bpe_50k.json"), open(B, "rb").read())
    assert crossalign.with_counts(aligned, ["doc_id", "n_a"]).count() == 0
