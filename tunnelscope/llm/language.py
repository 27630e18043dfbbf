"""Language identification by nearest centroid.

A text is its counts of hashed three-byte grams of letters, damped, weighted by inverse document frequency and brought to length
one. Each language has a few centroids, found by clustering a bounded sample of its labelled texts; the language of the nearest
centroid by cosine is predicted. A text that is much farther from it than any text of the sample is rejected.

Document frequencies count all labelled texts. The sample holds ``SAMPLE_PER_LANGUAGE`` texts of each language on average, chosen by a
hash of the id; that is the one bound, and it is a parameter.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and rejected; without labelled texts all are; labels of null
are not learned; rows that repeat count each; an empty table gives an empty result; other columns are kept by ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buffers import text_slices

DIMENSIONS = 1 << 12
CENTROIDS = 4
SAMPLE_PER_LANGUAGE = 600
# A text is rejected below this part of the lowest similarity in the sample.
REJECT_PART = 0.25
UNKNOWN = "und"

# ASCII bytes that are no letters count as blanks.
_AS_LETTER = np.arange(256, dtype=np.uint32)
_AS_LETTER[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
_GRAM = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # inverse document frequency per dimension
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    lowest: np.ndarray  # similarity below which the centroid's language is rejected

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each row of damped counts, and the cosine."""
        x = normalised(counts * self.weights)
        cosine = x @ self.centroids.T
        best = cosine.argmax(axis=1)
        return best, np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0)


def normalised(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """First row and damped gram counts (one row each) of slices of a text column."""
    lowered = pa.array([(" " + t.lower() + " ") if t is not None else " " for t in texts.to_pylist()], pa.string())
    for part in text_slices(lowered):
        b = _AS_LETTER[part.data]
        with np.errstate(over="ignore"):
            gram = (b[:-2] * _GRAM[0] ^ b[1:-1] * _GRAM[1] ^ b[2:] * _GRAM[2]) * np.uint32(0x27D4EB2F) >> np.uint32(32 - 12) if len(b) > 2 else np.zeros(0, np.uint32)
        # Grams of blanks alone, and those that reach into the next row, don't count.
        row = np.repeat(np.arange(len(part)), np.diff(part.offsets))
        good = (row[:-2] == row[2:]) & ((b[:-2] != 0x20) | (b[1:-1] != 0x20)) if len(b) > 2 else np.zeros(0, bool)
        at = row[:-2][good] * DIMENSIONS + gram[good] if len(b) > 2 else np.zeros(0, np.int64)
        counts = np.bincount(at, minlength=len(part) * DIMENSIONS).reshape(len(part), DIMENSIONS)
        yield part.lo, np.log1p(counts).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of rows of length one, begun with rows far from each other."""
    centres = [normalised(x.mean(axis=0, keepdims=True))[0]]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[np.stack(centres).dot(x.T).max(axis=0).argmin()])
    c = np.stack(centres)
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(axis=1)
        c = np.stack([normalised(x[nearest == j].mean(axis=0, keepdims=True))[0] if (nearest == j).any() else c[j] for j in range(len(c))])
    return c


def train(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learns from rows (doc_id, text, lang) with a label."""
    rows = labelled.filter(F.col("lang").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            for _, counts in counts_of(batch.column(0)):
                total[:-1] += (counts > 0).sum(axis=0)
                total[-1] += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1, dtype=np.int32)), pa.array(total)], ["dim", "df"])

    summed = rows.select("text").mapInArrow(frequencies, "dim int, df bigint").groupBy("dim").agg(F.sum("df").alias("df"))
    df = np.zeros(DIMENSIONS + 1)
    for r in summed.collect():  # one row per dimension
        df[r["dim"]] = r["df"]
    weights = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + np.float32(0.1)

    # One row per language. A language's share of the sample is a part of its rows, chosen by hash.
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    part = F.lit(0.0)
    for lang, n in sizes.items():
        part = F.when(F.col("lang") == F.lit(lang), F.lit(min(1.0, sample / n))).otherwise(part)
    uniform = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, counts in counts_of(batch.column(2)):
                own = batch.slice(lo, len(counts))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([c.tobytes() for c in counts], pa.binary())], ["lang", "doc_id", "x"])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        x = normalised(np.stack([np.frombuffer(v, np.float32) for v in group["x"]]) * weights)
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "lowest": []})
        c = cluster(x)
        lowest = float((x @ c.T).max(axis=1).min())
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [v.astype(np.float32).tobytes() for v in c], "lowest": lowest})

    sampled = rows.filter(uniform < part).select("lang", "doc_id", "text").mapInArrow(features, T.StructType([labelled.schema["lang"], labelled.schema["doc_id"], T.StructField("x", T.BinaryType())]))
    fitted = sampled.groupBy("lang").applyInPandas(fit, "lang string, centroid binary, lowest double").orderBy("lang", "centroid").collect()
    centroids = np.stack([np.frombuffer(r["centroid"], np.float32) for r in fitted]) if fitted else np.zeros((0, DIMENSIONS), np.float32)
    return Model(weights, [r["lang"] for r in fitted], centroids, REJECT_PART * np.array([r["lowest"] for r in fitted]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score (cosine to the nearest centroid) and rejected; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["lang_pred", "score", "rejected"]
    kept = [c for c in docs.columns if c not in added]
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(at)
            for lo, counts in counts_of(texts):
                own = batch.slice(lo, len(counts))
                known = np.array([has_letter(t) for t in own.column(at).to_pylist()], dtype=bool) & (len(m.languages) > 0)
                best, score = m.predict(counts) if len(m.languages) else (np.zeros(len(counts), int), np.zeros(len(counts)))
                names = [m.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                low = m.lowest[best] if len(m.languages) else np.ones(len(counts))
                columns = [pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0).astype(np.float64)), pa.array(~known | (score < low))]
                yield pa.RecordBatch.from_arrays([*own.columns, *columns], [*kept, *added])

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return docs.select(*kept).mapInArrow(run, T.StructType([*docs.select(*kept).schema.fields, *fields]))


def learn_and_identify(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Learns from the rows that are not held out and identifies all."""
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), sample)
    return identify(docs, model)
