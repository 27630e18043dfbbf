"""Byte-pair encoding through a minimal acyclic transducer of frequent words, and decoding.

The words that occur most often in the whole corpus are compiled into an automaton that shares prefixes and suffixes. Numbers on
its arcs add up, along the path of a word, to the word's place in the lexicon, and that place tells its ids.
The arrays are one byte string that workers map into memory. A lookup walks many words in step. Words
outside the lexicon are merged by the tokenizer's rules, so the result never depends on the lexicon.

Defined cases: a null or empty text has no ids and decodes to an empty text; rows that repeat are encoded each; an empty table
gives an empty result; other columns are kept.
"""

from __future__ import annotations

import hashlib
import mmap
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .bpe import Encoder, Tokenizer, encoded
from .buffers import Rolling, spans_of, text_slices

# A word is in the lexicon if at least one of this many words of the corpus is that word. So there are at most as many words in
# it, whatever the corpus; all others are merged.
LEXICON_SHARE = 1 << 18
# Bytes of text whose words are counted at once.
COUNT_BYTES = 1 << 21
# Longer words are left to the rules; the walk takes as many steps as its longest word.
LEXICON_BYTES = 40


def compile_transducer(words: Iterable[bytes], ids: list[np.ndarray]) -> bytes:
    """The automaton of sorted, distinct, non-empty ``words`` with the ids of each.

    Words are added in order; what the last word shares with no later one is replaced by an equal state that exists already.
    """
    register: dict[tuple, int] = {}
    arcs: list[list[tuple[int, int]]] = []  # per finished state, (byte, state)
    final: list[bool] = []
    size: list[int] = []  # words from each finished state on

    def finished(node: list) -> int:
        key = (node[0], tuple(node[1]))
        state = register.get(key)
        if state is None:
            state = register[key] = len(arcs)
            arcs.append(node[1])
            final.append(node[0])
            size.append(node[0] + sum(size[t] for _, t in node[1]))
        return state

    path: list[list] = [[False, []]]  # unfinished states along the last word
    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        for depth in range(len(last), common, -1):
            node = path.pop()
            path[-1][1].append((last[depth - 1], finished(node)))
        path.extend([False, []] for _ in range(len(word) - common))
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        node = path.pop()
        path[-1][1].append((last[depth - 1], finished(node)))
    root = finished(path[0])
    keys, to, out = [], [], []
    for state, own in enumerate(arcs):
        before = int(final[state])
        for byte, target in own:
            keys.append(state << 8 | byte)
            to.append(target)
            out.append(before)
            before += size[target]
    counts = np.array([len(x) for x in ids], dtype="<i8")
    parts = [
        np.array([root, len(keys), len(final), len(ids), counts.sum()], dtype="<i8"),
        np.array(keys, dtype="<i8"),
        np.array(to, dtype="<i8"),
        np.array(out, dtype="<i8"),
        np.array(final, dtype="<i8"),
        counts,
        np.concatenate([np.zeros(0, np.int64), *ids]).astype("<i8"),
    ]
    return b"".join(p.tobytes() for p in parts)


class Transducer:
    """A compiled lexicon, mapped from a file of the worker that goes with it."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:  # has no name: nothing stays behind
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = np.frombuffer(self.map, dtype="<i8")
        self.root, n_arcs, n_states, n_words, n_ids = (int(x) for x in view[:5])
        cuts = np.cumsum([5, n_arcs, n_arcs, n_arcs, n_states, n_words, n_ids])
        self.keys, self.to, self.out, self.final, self.counts, ids = (view[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        self.ids = ids.astype(np.int32)
        self.where = np.cumsum(self.counts) - self.counts

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each span its number of ids (-1: not in the lexicon), where they begin, and all ids."""
        count, where = np.full(len(starts), -1, np.int64), np.zeros(len(starts), np.int64)
        live = np.flatnonzero(ends - starts <= LEXICON_BYTES)
        state, word, at = np.full(len(live), self.root), np.zeros(len(live), np.int64), starts[live].copy()
        while len(live) and len(self.keys):
            key = state << 8 | data[at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[arc] == key
            live, arc, word, at = live[on], arc[on], word[on], at[on] + 1
            state, word = self.to[arc], word + self.out[arc]
            over = at == ends[live]
            known = over & (self.final[state] > 0)
            count[live[known]], where[live[known]] = self.counts[word[known]], self.where[word[known]]
            live, state, word, at = live[~over], state[~over], word[~over], at[~over]
        return count, where, self.ids


def frequent_words(docs: DataFrame, spec: str, share: int = LEXICON_SHARE) -> list[bytes]:
    """The chunks that are at least one of ``share`` chunks of the column ``text`` in the whole table, in byte order.

    Each task adds up its own chunks first. At most ``share`` rows reach the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(shared.value)
        for batch in batches:
            for part in text_slices(batch.column(0), COUNT_BYTES):
                starts, ends, _ = tokenizer.chunks(part)
                if not len(starts):
                    continue
                _, sample, n = np.unique(Rolling(part.data).spans(starts, ends), return_index=True, return_counts=True)
                short = ends[sample] - starts[sample] <= LEXICON_BYTES
                sample, n = sample[short], n[short]
                # No chunk is empty: the empty one carries the number of all chunks.
                a, lengths = starts[sample], np.append(ends[sample] - starts[sample], 0)
                flat = part.data[spans_of(a, lengths[:-1])]
                offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([column, pa.array(np.append(n, len(starts)))], ["word", "n"])

    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "word binary, n bigint")
    # A word met once is in no lexicon: neither is it in the table of counts.
    counts = cut(counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1 OR octet_length(word) = 0"), "word-counts")
    total = counts.filter("octet_length(word) = 0").agg(F.sum("n")).first()[0] or 0
    found = counts.filter((F.octet_length("word") > 0) & (F.col("n") >= max(2.0, total / share)))
    return sorted(bytes(r["word"]) for r in found.select("word").collect())


def compiled_lexicon(docs: DataFrame, spec: str, share: int = LEXICON_SHARE) -> bytes:
    found = frequent_words(docs, spec, share)
    if not found:
        return compile_transducer([], [])
    lengths = np.array([len(w) for w in found], dtype=np.int64)
    data = np.frombuffer(b"".join(found), dtype=np.uint8)
    starts = np.cumsum(lengths) - lengths
    ids, where, count = Tokenizer(spec).encode_chunks(data, starts, starts + lengths)
    return compile_transducer(found, [ids[a : a + n] for a, n in zip(where, count, strict=True)])


def encode_documents(docs: DataFrame, spec: str, share: int = LEXICON_SHARE, into: str = "token_ids") -> DataFrame:
    """``docs`` with a column ``into``: the ids of ``text`` as little-endian unsigned 32-bit integers."""
    context = docs.sparkSession.sparkContext
    shared, compiled = context.broadcast(spec), context.broadcast(compiled_lexicon(docs, spec, share))
    kept = [c for c in docs.columns if c != into]
    at = kept.index("text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Tokenizer(shared.value), Transducer(compiled.value))
        for batch in batches:
            for part, ids, rows in encoded(encoder, batch.column(at)):
                offsets = (4 * rows).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([*batch.slice(part.lo, len(part)).columns, column], [*kept, into])

    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(into, T.BinaryType())])
    return docs.select(*kept).mapInArrow(encode, schema)


def decode(tokenizer: Tokenizer, ids: np.ndarray) -> bytes:
    """The UTF-8 text of ids, bytes that are no character replaced, as the library decodes."""
    of = tokenizer.bytes_of()
    raw = b"".join([of[i] for i in ids.tolist()])
    return raw.decode("utf-8", "replace").encode()


def decode_documents(tokens: DataFrame, spec: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``tokens`` with a column ``into``: the text of the ids."""
    shared = tokens.sparkSession.sparkContext.broadcast(spec)
    kept = [c for c in tokens.columns if c != into]
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(shared.value)
        for batch in batches:
            texts = [decode(tokenizer, np.frombuffer(x.as_buffer() or b"", "<u4")).decode() for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, into])

    schema = T.StructType([*tokens.select(*kept).schema.fields, T.StructField(into, T.StringType())])
    return tokens.select(*kept).mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, spec: str, share: int = LEXICON_SHARE) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the text that the ids decode to).

    Encoding and decoding share a worker, so no second one stands beside it with the ids of a batch.
    """
    context = docs.sparkSession.sparkContext
    shared, compiled = context.broadcast(spec), context.broadcast(compiled_lexicon(docs, spec, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(shared.value)
        encoder = Encoder(tokenizer, Transducer(compiled.value))
        for batch in batches:
            for part, ids, rows in encoded(encoder, batch.column(1)):
                raw = memoryview(ids.astype("<u4")).cast("B")
                spans = list(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True))
                columns = [
                    batch.column(0).slice(part.lo, len(part)),
                    pa.array(np.diff(rows)),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans], pa.string()),
                    pa.array([hashlib.sha256(decode(tokenizer, ids[a:b])).hexdigest() for a, b in spans], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *fields]))
