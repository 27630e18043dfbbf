"""Operators on single texts against libraries and brute force, on hard rows and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from corpus import SCHEMA, copied_rows, hard_rows, table, words
from tokenizers import Tokenizer as Library

from tunnelscope.llm import chat, imatch, language, lexicon, tokenfiles
from tunnelscope.llm.bpe import Tokenizer

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    "", " ", "a\n\nb  c\t d", "x <|endoftext|>y <|startoftext|> z", "émile É ÇA İ ﬁ", "don't I'LL 's 12345 3.14 a" + "b" * 500,
    "\n\n\n", "  lead", "trail  ", "a \n b", "x\x1cy \x85 z", "“quoted” ½ ² µ ×÷", "é ok",
]


def spec(path: str) -> str:
    with open(path) as f:
        return f.read()


@pytest.fixture(scope="module")
def rows():
    return hard_rows() + copied_rows(2, 4) + [(500 + i, t, "en", "a") for i, t in enumerate(ODD)]


def test_encoding_and_decoding_equal_the_library(spark, rows):
    out = lexicon.round_trip_digests(table(spark, rows), spec(BYTES), share=200).collect()
    library = Library.from_file(BYTES)
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_encoded_column_decodes_to_the_text(spark, rows):
    docs = table(spark, rows)
    tokens = lexicon.encode_documents(docs, spec(BYTES), share=50)
    assert tokens.columns == [*docs.columns, "token_ids"]
    assert all(r["decoded"] == (r["text"] or "") for r in lexicon.decode_documents(tokens, spec(BYTES)).collect())


def test_bytes_that_are_no_character_decode_as_the_library_does():
    library, own = Library.from_file(BYTES), Tokenizer(spec(BYTES))
    rng = random.Random(3)
    for _ in range(50):
        ids = [rng.randrange(50_257) for _ in range(20)]
        assert lexicon.decode(own, np.array(ids)).decode() == library.decode(ids, skip_special_tokens=False)


def test_transducer_finds_its_words_and_no_others():
    rng = random.Random(1)
    known = sorted({words(rng, 1).encode() for _ in range(400)})
    ids = [np.array([k, k + 1][: 1 + k % 2]) for k in range(len(known))]
    t = lexicon.Transducer(lexicon.compile_transducer(known, ids))
    asked = known + [w + b"x" for w in known] + [w[:-1] for w in known if w[:-1] and w[:-1] not in known]
    data = np.frombuffer(b"".join(asked), np.uint8)
    ends = np.cumsum([len(w) for w in asked])
    count, where, pool = t.find(data, ends - [len(w) for w in asked], ends)
    assert [pool[a : a + n].tolist() for a, n in zip(where[: len(known)], count, strict=False)] == [x.tolist() for x in ids]
    assert (count[len(known) :] == -1).all()
    states = len(t.final)
    assert states < sum(len(w) for w in known) / 2  # suffixes are shared


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1000, dtype=np.uint64)
    packed = memoryview(tokenfiles.pack(ids, bits))
    assert len(packed) <= 8 * bits * 16
    for a, b in [(0, 1000), (63, 65), (500, 501), (7, 7), (999, 1000)]:
        assert (tokenfiles.unpack(packed, bits, a, b) == ids[a:b]).all()


def test_token_files(spark, rows, tmp_path):
    path = str(tmp_path / "files")
    tokenfiles.write_token_files(table(spark, rows), spec(WORDS), path, end_id=1)
    blocks = tokenfiles.read_token_files(spark, path)
    got = [tuple(r) for r in tokenfiles.document_digests(blocks).orderBy("start").collect()]
    library, want = Library.from_file(WORDS), []
    for i, text, *_ in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((r[0] if r[0] is not None else -1, *r[2:]) for r in got) == sorted((w[0] if w[0] is not None else -1, *w[1:]) for w in want)
    assert [r[0] for r in got] == sorted((r[0] for r in got), key=lambda x: -1 if x is None else x)
    assert [r[1] for r in got] == np.append(0, np.cumsum([r[2] for r in got]))[:-1].tolist()
    first = blocks.filter("n_ids > 3").first()
    block = tokenfiles.Block(bytes(first["data"]))
    assert (block.ids(1, 3) == block.ids()[1:3]).all() and block.bits == 16


def test_languages(spark):
    rng = random.Random(4)
    alphabets = {"xx": "abcdef", "yy": "mnopqr", "zz": "éèàùçê"}
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(n))
    rows = [(i, make(letters, rng.randint(1, 60)), lang, "a") for lang, letters in alphabets.items() for i in rng.sample(range(5000), 80)]
    hard = [(9000, None, "xx", "a"), (9001, "", None, "a"), (9002, "12 %%", "yy", "a"), (9003, "ⰀⰁⰂ ⰃⰄ", None, "a"), (9003, "ⰀⰁⰂ ⰃⰄ", None, "a")]
    out = {(r["doc_id"], r["text"]): r for r in language.learn_and_identify(table(spark, rows + hard)).collect()}
    good = [out[i, t]["lang_pred"] == lang and not out[i, t]["rejected"] for i, t, lang, _ in rows]
    assert sum(good) >= 0.99 * len(good)
    assert all(out[i, t]["lang_pred"] == "und" and out[i, t]["score"] == 0 for i, t, *_ in hard[:3])
    assert out[9003, "ⰀⰁⰂ ⰃⰄ"]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_nothing_labelled_is_unknown(spark):
    out = language.learn_and_identify(table(spark, [(1, "some text", None, "a")])).collect()
    assert [r["lang_pred"] for r in out] == ["und"]


def test_fingerprints(spark, rows):
    docs = table(spark, rows)
    out = imatch.fingerprints_of_edits(docs, lowest=0.02, highest=0.5).collect()
    ordered = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    want = []
    for k, (i, text, *_) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        q = len(text) // 4
        want.append((i, len(text), hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()))
    assert sorted(repr(tuple(r)[:3]) for r in out) == sorted(map(repr, want))
    of: dict[str, set[str]] = {}
    for r in out:
        text = next(t or "" for i, t, *_ in rows if i == r["doc_id"])
        of.setdefault(text, set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in of.values())
    whole = [r for r in out if r["n_chars"] > 300 and r["near_next"] < 1]  # not beside its own copy
    assert sum(r["near_edited"] for r in whole) > 2 * sum(r["near_next"] for r in whole)


def test_likeness_counts_equal_subsets(spark):
    df = spark.createDataFrame([("a--b-c-", "a-x-b--"), ("---", "---"), ("a---", "-b--")], "x string, y string")
    got = [r[0] for r in df.select(imatch.likeness(df["x"], df["y"])).collect()]
    assert got == [0.5, 1.0, 0.0]


TURNS = [
    (1, 0, "user", "plain"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "\\### Assistant: </turn> ok"),
    (2, 1, None, None), (2, 0, "assistant", "</turn>\n### user: x</turn>\n"), (None, 0, "odd: role\n### ", "back\\slash\\"), (3, None, "assistant", ""),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id bigint, turn bigint, role string, text string, part string")
    got = {r["conv_id"]: r for r in chat.round_trip(turns).collect()}
    for conv in {t[0] for t in TURNS}:
        own = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (-1 if t[1] is None else t[1], t[2] or "", t[3] or ""))
        spoken = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(spoken), hashlib.sha256(spoken.encode()).hexdigest())
    assert len(got) == 4


def test_every_turn_reads_back():
    rng = random.Random(0)
    pick = lambda n: "".join(rng.choice(["\\", "### ", "</turn>", "\n", ":", " ", "a", "#"]) for _ in range(rng.randint(0, n)))
    for _ in range(3000):
        role, text = pick(4), pick(8)
        out = chat.render_turn(role, text) + chat.render_turn("next", "x")
        got = chat.parse_turn(out, 0)
        assert got[:2] == (role, text) and chat.parse_turn(out, got[2])[:2] == ("next", "x")


def test_long_conversations_are_written_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 40)
    turns = spark.createDataFrame([(1, i, "user", "text " * 5) for i in range(9)], "conv_id bigint, turn bigint, role string, text string")
    parts = chat.format_conversations(turns)
    assert parts.count() > 3
    assert chat.read_conversations(parts).first()["n_turns"] == 9


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    path = str(tmp_path / "none")
    tokenfiles.write_token_files(none, spec(WORDS), path, end_id=1)
    assert tokenfiles.document_digests(tokenfiles.read_token_files(spark, path)).count() == 0
    assert lexicon.round_trip_digests(none, spec(BYTES)).count() == 0
    assert imatch.fingerprints_of_edits(none).count() == 0
    assert language.learn_and_identify(none).count() == 0
    assert chat.round_trip(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
