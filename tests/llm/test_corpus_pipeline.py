"""Each stage of the pipeline on its own input, against brute force."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from corpus import copied_rows, hard_rows, table, words
from test_corpora import brute_components, brute_spans, brute_targets, shingle_set, size_of
from tokenizers import Tokenizer as Library

import corpus_pipeline as P


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """What each stage gets, and what it makes of it, over documents and hard rows."""
    folder = tmp_path_factory.mktemp("pipeline")
    extra = table(spark, hard_rows() + copied_rows(3, 6)).select("doc_id", "text", "lang", "source", "n_chars")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 10000 AS doc_id", "text", "lang", "source", "n_chars")
    docs.unionByName(extra).write.parquet(str(folder / "documents.parquet"))
    found, docs = {}, spark.read.parquet(str(folder / "documents.parquet"))
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(folder))
        out.write.parquet(str(folder / name))
        out = spark.read.parquet(str(folder / name))
        found[name] = (docs.collect(), out.collect(), docs.columns, out.columns)
        docs = out
    return found


def rows_of(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_columns(outputs):
    for name, _ in P.STAGES[:-1]:
        assert outputs[name][2] == outputs[name][3]


def test_language_stage_keeps_texts_of_the_languages(outputs):
    before, after, *_ = outputs["language_id"]
    gone = rows_of(before) - rows_of(after)
    assert all(t is None or not any(map(str.isalpha, t)) or i == 8 for i, t in gone)
    assert not any(r["text"] is None or not any(map(str.isalpha, r["text"])) for r in after)
    assert not any(r["lang"] is None for r in after)


def test_near_duplicate_stage(outputs):
    before, after, *_ = outputs["near_duplicates"]
    sets = {r["doc_id"]: shingle_set(r["text"], P.SHINGLE_WORDS) for r in before if r["doc_id"] is not None}
    assert {r["doc_id"] for r in after} == set(brute_components(sets, P.SIMILARITY, 100).values()) | ({None} & {r["doc_id"] for r in before})


@pytest.mark.parametrize("ids", [(7, 7), (None, None), (7, None), (7, None, None, 7, 9)])
def test_one_copy_of_a_document_leaves_the_stages(spark, tmp_path, ids):
    rng = random.Random(8)
    text, other = words(rng, 90), words(rng, 90)
    assert len(text) >= P.PASSAGE_BYTES
    rows = [(i, text, "en", "a") for i in ids] + [(20, other, "en", "a"), (None, "one two", "en", "a"), (None, "one two", "en", "b")]
    docs = table(spark, rows)
    single = P.near_duplicates(spark, docs, "")
    want = Counter({(min(ids, key=lambda i: (i is not None, i)), text): 1, (20, other): 1, (None, "one two"): 1})
    assert rows_of(single.collect()) == want and single.columns == docs.columns
    single.write.parquet(str(tmp_path / "single"))
    assert rows_of(P.repeated_passages(spark, spark.read.parquet(str(tmp_path / "single")), "").collect()) == want


def test_one_row_stays_where_an_id_has_several_texts(spark):
    rng = random.Random(9)
    first, second = words(rng, 90), words(rng, 90)
    near = f"{second} end"
    rows = [(3, first, "en", "a"), (3, second, "en", "a"), (2, near, "en", "a"), (3, near, "en", "a"), (5, first, "en", "a")]
    assert rows_of(P.near_duplicates(spark, table(spark, rows), "").collect()) == Counter({(3, first): 1, (2, near): 1})


def test_repeat_stage(outputs):
    before, after, *_ = outputs["repeated_passages"]
    texts = [r["text"].encode() for r in before]
    want = Counter()
    for r, raw, spans in zip(before, texts, brute_spans(texts, P.PASSAGE_BYTES), strict=True):
        kept, at = b"", 0
        for s, e in spans:
            while s < e and raw[s] & 0xC0 == 0x80:
                s += 1
            while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
                e -= 1
            kept, at = kept + raw[at:s], e
        text = (kept + raw[at:]).decode()
        if text.strip() or not spans:
            want[r["doc_id"], text] += 1
    assert rows_of(after) == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_mixing_stage(outputs):
    before, after, *_ = outputs["mixing"]
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += size_of(r["text"])
    for r in after:
        taken[r["source"]] += size_of(r["text"])
    for source, target in brute_targets(sizes).items():
        assert abs(taken[source] - target) <= 0.5


def test_encoding_stage(outputs):
    before, after, *_ = outputs["encoding"]
    library = Library.from_file(public_tokenizers.path(P.TOKENIZER))
    assert rows_of(before) == rows_of(after)
    for r in after:
        ids = np.frombuffer(bytes(r["token_ids"]), "<u4").tolist()
        assert ids == library.encode(r["text"], add_special_tokens=False).ids and r["n_tokens"] == len(ids)
