"""Byte-pair encoding of whole text columns in numpy, equal to what the tokenizers library gives.

A text falls into chunks at white space that always is a token boundary. Equal chunks of a slice are encoded once. A chunk
goes, in this order, to a lexicon of frequent words if there is one, to a memo of chunks this worker
has met, and to the merge rules, which run on all remaining words side by side. Chunks with
characters whose classes could depend on a Unicode version, with control strings, or with very long words go to the library.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import regex

from .buffers import IS_SPACE, TextSlice, distinct_spans, same_bytes, spans_of, text_slices

# Bytes of text encoded at once.
SLICE_BYTES = 1 << 20
# Chunks a worker keeps the ids of; beyond that, chunks are encoded anew in each slice.
MEMO_CHUNKS = 600_000
# Longer words are merged by the library, whose work doesn't grow with the square of the length.
LONG_WORD = 200

# Fixed value: how byte-level vocabularies split a text before the merges.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NO_RANK = np.int32(2**31 - 1)
# Bytes of characters that are left to the library: other than ASCII and U+00C0 to U+00FF, and file separators.
_ODD = np.zeros(256, dtype=bool)
_ODD[0x1C:0x20] = True
_ODD[0xC0:0xC3] = True
_ODD[0xC4:] = True
# Classes of bytes whose runs are words: letters, digits, others; from _HARD on no such rule holds.
_LETTER, _DIGIT, _OTHER, _HARD = 1, 2, 3, 4
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x27] = _HARD
_CLASS[IS_SPACE | _ODD] = _HARD


class Lexicon(Protocol):
    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each span its number of ids (-1: unknown), where they begin, and the array they are in."""


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


class Tokenizer:
    """The parts of a tokenizer file that encoding and decoding need. ``spec`` is the file's content.

    Without ``special``, control strings inside a text are plain text.
    """

    def __init__(self, spec: str, special: bool = True):
        self.spec = spec
        file = json.loads(spec)
        model = file["model"]
        vocab: dict[str, int] = model["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in file["added_tokens"])]) + 1
        end = model["end_of_word_suffix"] or ""
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int32)
        self.last = np.array([vocab[c + end] for c in chars], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + (b if not end else b)] for a, b in pairs], dtype=np.int32)
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank, self.pair_made = keys[order], order.astype(np.int32), made[order]
        self.drops_space = file["normalizer"] is not None
        self.pattern = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if self.drops_space else BYTE_LEVEL_PATTERN)
        self.special = [t["content"].encode() for t in file["added_tokens"]] if special else []
        self._bytes_of: list[bytes] | None = None
        self._vocab, self._chars, self._added = vocab, chars, file["added_tokens"]
        self._library = None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer as Library

            self._library = Library.from_str(self.spec)
            self._library.no_truncation()
            self._library.no_padding()
            self._library.encode_special_tokens = not self.special
        return self._library

    def bytes_of(self) -> list[bytes]:
        """The bytes each id stands for (byte-level vocabularies)."""
        if self._bytes_of is None:
            at = {c: b for b, c in enumerate(self._chars)}
            out = [b""] * self.size
            for token, i in [*self._vocab.items(), *((t["content"], t["id"]) for t in self._added)]:
                out[i] = bytes(at[c] for c in token) if all(c in at for c in token) else token.encode()
            self._bytes_of = out
        return self._bytes_of

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_rank[at], _NO_RANK), np.where(hit, self.pair_made[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of non-empty words: all ids, where each word's begin, and how many they are.

        The pair of lowest rank, leftmost first, is merged until none is left.
        """
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        where, count, pools, filled, low = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.int32)], 0, 0
        for high in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, LONG_WORD):
            chosen = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            for some in np.array_split(chosen, max(1, len(chosen) * high // 400_000)):
                if not len(some):
                    continue
                ids = self._merge_block([words[i] for i in some], lengths[some], high)
                kept = ids >= 0
                count[some] = kept.sum(axis=1)
                where[some] = filled + np.cumsum(count[some]) - count[some]
                pools.append(ids[kept])
                filled += len(pools[-1])
        return np.concatenate(pools).astype(np.int32), where, count

    def _merge_block(self, words: list[bytes], n: np.ndarray, width: int) -> np.ndarray:
        """Ids of words of at most ``width`` bytes, one row each, -1 after the last."""
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)
        column = np.arange(width)
        ids = np.where(column < n[:, None] - 1, self.inner[raw], np.where(column == n[:, None] - 1, self.last[raw], -1))
        live = np.arange(len(words))
        if width > 1:
            rank, made = self._ranked(ids[:, :-1], ids[:, 1:])
        done_ids = ids
        while width > 1 and len(live):
            best = rank.argmin(axis=1)
            k = np.arange(len(live))
            going = rank[k, best] != _NO_RANK
            if not going.all():
                done_ids[live[~going]] = ids[~going]
                live, ids, rank, made, best = live[going], ids[going], rank[going], made[going], best[going]
                k = np.arange(len(live))
                if not len(live):
                    break
            new = made[k, best]
            after = column[None, :] > best[:, None]
            shifted = np.concatenate([ids[:, 1:], np.full((len(live), 1), -1, ids.dtype)], axis=1)
            ids = np.where(after, shifted, ids)
            ids[k, best] = new
            pad_r, pad_m = np.full((len(live), 1), _NO_RANK, rank.dtype), np.full((len(live), 1), -1, made.dtype)
            rank = np.where(after[:, :-1], np.concatenate([rank[:, 1:], pad_r], axis=1), rank)
            made = np.where(after[:, :-1], np.concatenate([made[:, 1:], pad_m], axis=1), made)
            right = np.minimum(best, width - 2)
            inside = best <= width - 2
            r, m = self._ranked(ids[k, right], np.where(inside, ids[k, np.minimum(right + 1, width - 1)], -1))
            rank[k[inside], right[inside]], made[k[inside], right[inside]] = r[inside], m[inside]
            left = np.maximum(best - 1, 0)
            has = best > 0
            r, m = self._ranked(ids[k, left], ids[k, best])
            rank[k[has], left[has]], made[k[has], left[has]] = r[has], m[has]
        if len(live):
            done_ids[live] = ids
        return done_ids

    def chunks(self, part: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the chunks of a slice, and the first chunk of each row (one entry more than rows)."""
        if self.drops_space:
            return part.words()
        data, n = part.data, len(part.data)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(part) + 1, np.int64)
        space = IS_SPACE[data]
        alone = space.copy()  # one white-space byte between others, inside a row
        alone[1:] &= ~space[:-1]
        alone[:-1] &= ~space[1:]
        alone[part.offsets[:-1][part.offsets[:-1] < n]] = False
        alone[part.offsets[1:][part.offsets[1:] > 0] - 1] = False
        begin = np.zeros(n + 1, dtype=bool)
        blank = data == 0x20
        begin[:n] = alone & (blank | (data == 0x0A))
        begin[1:] |= alone & (data == 0x0A)
        begin[part.offsets] = True
        starts = np.flatnonzero(begin[:n])
        return starts, np.append(starts[1:], n), np.searchsorted(starts, part.offsets)

    def encode_chunks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the chunks of ``data``: all ids, where each chunk's begin, and how many they are."""
        lengths = ends - starts
        flat = data[spans_of(starts, lengths)]
        at = np.cumsum(lengths) - lengths
        kind = _CLASS[flat]
        # Hard for the class rule below: odd characters, apostrophes, white space but for a leading blank, possible control strings.
        hard = kind >= _HARD
        hard[1:] |= (flat[:-1] == 0xC3) & ((flat[1:] == 0x97) | (flat[1:] == 0xB7))
        hard[1:] |= (flat[:-1] == 0x3C) & (flat[1:] == 0x7C)
        blank = flat[at] == 0x20
        hard[at] = np.where(blank & (lengths > 1), False, hard[at])
        bad = np.add.reduceat(hard, at, dtype=np.int64) > 0
        bad |= lengths > LONG_WORD
        easy = np.flatnonzero(~bad)
        ids, where, count = self._by_class(flat, kind, at[easy], lengths[easy], blank[easy])
        out_where, out_count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        out_where[easy], out_count[easy] = where, count
        pools, filled = [ids], len(ids)
        raw = flat.tobytes()
        for i in np.flatnonzero(bad):
            chunk = raw[at[i] : at[i] + lengths[i]]
            if len(chunk) > LONG_WORD or _ODD[flat[at[i] : at[i] + lengths[i]]].any() or any(s in chunk for s in self.special):
                # A slice of text ends at a character, so a chunk does too.
                own = np.array(self.library.encode(chunk.decode(), add_special_tokens=False).ids, dtype=np.int32)
            else:
                own = self._in_order(chunk)
            out_where[i], out_count[i] = filled, len(own)
            pools.append(own)
            filled += len(own)
        return np.concatenate(pools), out_where, out_count

    def _in_order(self, chunk: bytes) -> np.ndarray:
        text = chunk.decode()
        words = [p.encode() for p in self.pattern.findall(text.lower() if self.drops_space else text)]
        ids, where, count = self.merge(words)
        return ids[spans_of(where, count)]

    def _by_class(self, flat: np.ndarray, kind: np.ndarray, at: np.ndarray, lengths: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks whose words are their runs of letters, digits or other characters, a leading blank with the first run."""
        if not len(at):
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.int32), none, none
        own = spans_of(at, lengths)
        flat, kind = flat[own], kind[own].copy()
        at = np.cumsum(lengths) - lengths
        kind[at[blank]] = kind[at[blank] + 1]
        if self.drops_space:
            flat = flat.copy()
            upper = (flat >= 0x41) & (flat <= 0x5A)
            upper[1:] |= (flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] <= 0x9E)
            flat[upper] += 0x20
        begins = np.ones(len(flat), dtype=bool)
        begins[1:] = kind[1:] != kind[:-1]
        if self.drops_space:
            begins |= kind == _DIGIT
        begins[at] = True
        a = np.flatnonzero(begins)
        b = np.append(a[1:], len(flat))
        _, sample, which = distinct_spans(flat, a, b)
        raw = flat.tobytes()
        ids, where, count = self.merge([raw[x:y] for x, y in zip(a[sample].tolist(), b[sample].tolist(), strict=True)])
        per_piece = count[which]
        out = ids[spans_of(where[which], per_piece)]
        pieces_before = np.append(np.searchsorted(a, at), len(a))
        before = np.append(0, np.cumsum(per_piece))[pieces_before]
        return out, before[:-1], np.diff(before)


class Encoder:
    """Encodes slices of text, remembering chunks. One per worker and tokenizer."""

    def __init__(self, tokenizer: Tokenizer, lexicon: Lexicon | None = None):
        self.tokenizer, self.lexicon = tokenizer, lexicon
        # Remembered chunks in the order of their hashes: bytes and ids.
        self.keys = np.zeros(0, np.uint64)
        self.raw = np.zeros(0, np.uint8)
        self.raw_at = np.zeros(0, np.int64)
        self.raw_length = np.zeros(0, np.int64)
        self.where = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def encode(self, part: TextSlice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another (unsigned 32-bit), and where each row begins (one entry more than rows)."""
        starts, ends, first = self.tokenizer.chunks(part)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(part) + 1, np.int64)
        hashes, sample, which = distinct_spans(part.data, starts, ends)
        a, b = starts[sample], ends[sample]
        count, where, pool = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.zeros(0, np.int32)
        if self.lexicon is not None:
            count, where, pool = self.lexicon.find(part.data, a, b)
        base = len(pool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = np.flatnonzero((count < 0) & (self.keys[at] == hashes))
            held = at[hit]
            same = same_bytes(part.data, a[hit], b[hit], self.raw, self.raw_at[held], self.raw_at[held] + self.raw_length[held])
            hit, held = hit[same], held[same]
            count[hit], where[hit] = self.count[held], base + self.where[held]
        rest = np.flatnonzero(count < 0)
        new, at, sizes = self.tokenizer.encode_chunks(part.data, a[rest], b[rest]) if len(rest) else (np.zeros(0, np.int32),) * 3
        count[rest], where[rest] = sizes, base + len(self.pool) + at
        pool = np.concatenate([pool, self.pool, new])
        per_chunk = count[which]
        out = pool[spans_of(where[which], per_chunk)].astype(np.uint32)
        rows = np.append(0, np.cumsum(per_chunk))[first]
        self._remember(hashes[rest], part.data, a[rest], b[rest], len(self.pool) + at, sizes, new)
        return out, rows

    def _remember(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, where: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Keeps new chunks that are not long, one for each hash. ``ids`` go behind the pool, where ``where`` points."""
        own, one = np.unique(hashes, return_index=True)
        new = np.ones(len(one), bool)
        if len(self.keys):
            new = self.keys[np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)] != own
        short = one[new & (ends[one] - starts[one] <= LONG_WORD)]
        if not len(short) or len(self.keys) + len(short) > MEMO_CHUNKS:
            return
        lengths, sizes = ends[short] - starts[short], count[short]
        own = ids[spans_of(where[short] - len(self.pool), sizes)]
        keys = np.concatenate([self.keys, hashes[short]])
        order = np.argsort(keys, kind="stable")
        self.raw_at = np.concatenate([self.raw_at, len(self.raw) + np.cumsum(lengths) - lengths])[order]
        self.raw_length = np.concatenate([self.raw_length, lengths])[order]
        self.raw = np.concatenate([self.raw, data[spans_of(starts[short], lengths)]])
        self.where = np.concatenate([self.where, len(self.pool) + np.cumsum(sizes) - sizes])[order]
        self.count = np.concatenate([self.count, sizes])[order]
        self.keys, self.pool = keys[order], np.concatenate([self.pool, own])


def encoded(encoder: Encoder, texts: pa.Array) -> Iterator[tuple[TextSlice, np.ndarray, np.ndarray]]:
    """Slices of a text column with their ids and row starts."""
    for part in text_slices(texts, SLICE_BYTES):
        ids, rows = encoder.encode(part)
        yield part, ids, rows
