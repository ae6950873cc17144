"""Vectorised word splitting and word-window hashing over Arrow text columns.

Both word classes of this subpackage are unions of whole byte values (every byte of a
multi-byte UTF-8 character is a word byte in both), so words are found on the UTF-8 buffer of
a batch without decoding it. Hashes are fixed functions of the words' bytes: they are the same
in every task, run and process.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
#: Word bytes of ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after A-Z are lower-cased.
PLAIN = np.zeros(256, bool)
PLAIN[48:58] = PLAIN[97:123] = PLAIN[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_C1, _C2, _C3 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=U)
#: Longer words are hashed one by one.
_LONG = 256


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(33))
    h *= _C1
    h ^= h >> U(29)
    h *= _C2
    h ^= h >> U(32)
    return h


class Words:
    """The words of a batch of texts: byte spans, and each text's range of words.

    ``first[i]:first[i + 1]`` are the words of text i. Null texts have none.
    """

    def __init__(self, texts, kind: np.ndarray = SPACED, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        texts = texts.fill_null("").cast(pa.large_string())
        n = len(texts)
        if n:
            at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        else:
            at = np.zeros(1, np.int64)
        size = int(at[-1] - at[0])
        data = np.zeros(size + 8, np.uint8)
        if size:
            data[:size] = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
        if lower:
            data = _LOWER[data]
        self.data, self.at = data, at - at[0]
        is_word = kind[data[:size]]
        edge = np.zeros(size + 1, bool)
        edge[self.at] = True
        before = np.empty(size, bool)
        after = np.empty(size, bool)
        if size:
            before[0], before[1:] = False, is_word[:-1]
            after[-1], after[:-1] = False, is_word[1:]
            before &= ~edge[:-1]
            after &= ~edge[1:]
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(is_word & ~after) + 1
        self.first = np.searchsorted(self.start, self.at)

    def __len__(self) -> int:
        return len(self.start)

    @functools.cached_property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @functools.cached_property
    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    @functools.cached_property
    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self))

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.start, self.end)

    def windows(self, n: int, seed: int = 0) -> np.ndarray:
        """A hash of the n words from each word on, or of those to the text's end."""
        return window_hash(mix(self.hashes + U(seed) * _C3) if seed else self.hashes, np.minimum(n, self.left))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; data has 8 more bytes than the spans reach."""
    size = end - start
    lanes = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = mix((lanes[start] & _MASKS[np.minimum(size, 8)]) + size.astype(U) * _C3)
    more = np.flatnonzero(size > 8)
    for i in more[size[more] > _LONG]:
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    more = more[size[more] <= _LONG]
    done = 8
    while len(more):
        h[more] = mix((h[more] * _C3) ^ (lanes[start[more] + done] & _MASKS[np.minimum(size[more] - done, 8)]))
        done += 8
        more = more[size[more] > done]
    return h


_Q = 0xD6E8FEB86659FD93
_powers = (np.ones(1, U), np.ones(1, U))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers = tuple(np.cumprod(np.concatenate([[U(1)], np.full(size - 1, q, U)]), dtype=U) for q in (U(_Q), U(pow(_Q, -1, 1 << 64))))
    return _powers[0][:n], _powers[1][:n]


def window_hash(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of the run of n values from each place on."""
    if not len(h):
        return h.copy()
    up, down = _power(len(h))
    total = np.concatenate([[U(0)], np.cumsum(h * up, dtype=U)])
    return mix((total[np.arange(len(h)) + n] - total[:-1]) * down)


def spread(marks: np.ndarray, back: int, ahead: int) -> np.ndarray:
    """True from ``back`` places before each true mark to ``ahead`` after it."""
    n = len(marks)
    at = np.flatnonzero(marks)
    step = np.bincount(np.maximum(at - back, 0), minlength=n + 1) - np.bincount(np.minimum(at + ahead + 1, n), minlength=n + 1)
    return np.cumsum(step[:-1]) > 0


def strings(arrays: list[bytes]) -> pa.Array:
    return pa.array(arrays, pa.binary())
