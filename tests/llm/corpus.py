"""Small tables for the tests of this folder: hard rows, and groups of copies that share words and passages."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n int, size double"


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows (doc_id, text, lang, source); the last columns have names that operators use themselves."""
    full = [(i, t, lang, source, None if t is None else len(t), "k", 7, 0.5) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def hard_rows() -> list[tuple]:
    """Nulls, empty and blank texts, ties, repeated rows, one long text, odd characters."""
    rng = random.Random(5)
    long_text = words(rng, 9000)
    twice = "Érer été ÇA " + words(rng, 90)
    return [
        (0, "one two", "en", "a"),
        (1, None, None, None),
        (2, "", "en", ""),
        (3, " \n\t ", "fr", "a"),
        (4, twice, "fr", "b"),
        (5, twice, "fr", "b"),
        (5, twice, "fr", "b"),
        (6, long_text, "en", "c"),
        (7, "1234 $$$", "en", None),
        (8, "日本語 テキスト <|endoftext|> ½", None, "c"),
        (9, "a\n\nb  c\x1cd e", "en", "c"),
        (10, words(rng, 100) + " " + long_text[2000:2800], "en", "c"),
        (None, "no id here", "en", "a"),
    ]


def copied_rows(groups: int = 6, members: int = 12, seed: int = 2) -> list[tuple]:
    """Groups of texts that differ in a few words, chains of them, and a passage that many texts share."""
    rng = random.Random(seed)
    passage, out = words(rng, 80), []
    for g in range(groups):
        base = words(rng, rng.choice([30, 120, 200])).split()
        for m in range(members):
            own = list(base)
            if g % 2:
                base = own  # each member is a change of the one before
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = words(rng, 1)
            out.append(" ".join(own))
        out += [words(rng, 60) + " " + passage + " " + words(rng, 60), words(rng, 50)]
    rng.shuffle(out)
    return [(100 + i, t, "en", f"s{i % 3}") for i, t in enumerate(out)]
