"""Operator 12: order-preserving packing of documents into windows by dynamic programming.

The documents of a partition, in the table's order, are one stream of tokens. A window is a
stretch of it of at most ``capacity`` tokens and costs its padding (none if its length is a power
of two, of SHORTEST or more but at the stream's end, else what it lacks to ``capacity``) and
WINDOW_PRICE, so that a short window is made only where it spares more. A cut costs nothing at a document's end, SENTENCE_PRICE at a sentence's end,
and INSIDE_PRICE within one. The plan with the least sum is found over these cuts: every document and sentence end, the end of a full window that begins at
one of them, and, in stretches of STRETCH tokens without any, every STRETCH-th token. The cheapest
padded window that ends at a place begins where cost + place is least among the ``capacity`` places
before it, so starts wait in a queue that ascends in that sum: its head is the answer, and a start
that a later one undercuts leaves it.

A plan is made for HORIZON tokens at a time; its last windows are planned again with what follows,
so memory is bounded by the horizon and one encoded document, and only a partition's last window
is cut for want of tokens. Nothing is shuffled, so neither hot keys nor copies matter, and a lost
task is done again alone.

Defined cases: null or empty text is its end token alone; rows that repeat a doc_id (null too) are
packed each; a text longer than a window, or than the horizon, is cut as often as it needs, and
nothing of it is dropped; equal costs go to the earlier start; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._spark import pick
from .token_counts import ADDED, encoder, vocabulary_path

CAPACITY, END_ID = 1024, 0
#: What a cut costs, in tokens of padding, at a sentence's end and within a sentence, and what each window does.
SENTENCE_PRICE, INSIDE_PRICE, WINDOW_PRICE = 2, 8, 16
#: The shortest window before the stream's end that counts as one of a power of two: shorter ones would hardly be worth their price.
SHORTEST = 32
#: Tokens without a sentence's end after which a place to cut is offered all the same.
STRETCH = 256
#: Tokens planned at a time, and those of its end that are planned again.
HORIZON, AGAIN = 131_072, 8_192
#: How many full windows in a row may end within sentences.
CHAIN = 4
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """How many bytes of text each id of the vocabulary stands for."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            sizes = {int(b): len(base64.b64decode(a)) for a, b in map(bytes.split, f)} | {i: len(t) for t, i in ADDED.items()}
    else:  # a character of a byte-level token is a byte
        with open(path) as f:
            told = json.load(f)
        sizes = {i: len(t) for t, i in told["model"]["vocab"].items()} | {x["id"]: len(x["content"].encode()) for x in told["added_tokens"]}
    out = np.zeros(max(sizes) + 1, np.int64)
    out[list(sizes)] = list(sizes.values())
    return out


def _bytes_of(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_STOPS, _CLOSERS, _SPACES = _bytes_of(".!?"), _bytes_of("\"')]"), _bytes_of(" \t\n\r\f\v")


def sentence_ends(text: bytes) -> np.ndarray:
    """True at n where a sentence ends after n bytes: after a stop, with one closing mark or without, before a space, and before a line break."""
    out = np.zeros(len(text) + 1, bool)
    if len(text) > 1:
        b = np.frombuffer(text, np.uint8)
        stop = _STOPS[b]
        ended = stop.copy()
        ended[1:] |= stop[:-1] & _CLOSERS[b[1:]]
        out[1:-1] = ended[:-1] & _SPACES[b[1:]] | (b[1:] == 10) & (b[:-1] != 10)
    return out


def prices(ids: np.ndarray, text: bytes, sizes: np.ndarray) -> np.ndarray:
    """What a cut after each token of a document costs, its end token (the last of ids) included."""
    out = np.full(len(ids), INSIDE_PRICE, np.uint8)
    at = np.cumsum(sizes[ids[:-1]])
    if len(at) and at[-1] == len(text):  # else the vocabulary normalises: its sentences' ends aren't known
        out[:-1][sentence_ends(text)[at]] = SENTENCE_PRICE
    out[-1] = 0
    return out


def offered(price: np.ndarray, capacity: int = CAPACITY, stretch: int = STRETCH) -> tuple[list[int], list[int]]:
    """The places (tokens before the cut) where a stream may be cut, its end last, and their prices."""
    at = np.flatnonzero(price < INSIDE_PRICE) + 1
    if not len(at) or at[-1] != len(price):
        at = np.append(at, len(price))
    stretch = min(stretch, capacity)
    before = np.concatenate([[0], at[:-1]])
    wide = np.flatnonzero(at - before > stretch)
    more = [np.arange(before[k] + stretch, at[k], stretch) for k in wide]
    at = np.sort(np.concatenate([at, *more])) if more else at
    return at.tolist(), price[at - 1].tolist()


def plan(places: list[int], price: list[int], capacity: int = CAPACITY, chain: int = CHAIN, shortest: int = SHORTEST) -> tuple[list[int], int]:
    """Ends of the windows of the cheapest plan, and its cost. The last place, the stream's end, is free."""
    every = [s for k in range(64) if (s := 1 << k) <= capacity]
    free = [s for s in every if shortest <= s < capacity]  # full windows have no padding as it is
    end = places[-1]
    at, cost, came = [0], [0], [-1]
    known = {0: 0}
    queue: deque[int] = deque([0])  # states by place, ascending in cost + place
    full: deque[tuple[int, int, int]] = deque([(capacity, 0, 1)] if chain else [])  # place, state before, full windows in a row: ascending in place
    n, k = len(places), 0
    while k < n:
        here = places[k]
        if full and full[0][0] < here:
            here, before, row = full.popleft()
            if here in known:
                continue
            paid = cost[before] + WINDOW_PRICE + INSIDE_PRICE
        else:
            paid = WINDOW_PRICE + (price[k] if here < end else 0)
            k, row = k + 1, 0
            while at[queue[0]] < here - capacity:
                queue.popleft()
            before = queue[0]
            least = cost[before] + at[before] + capacity - here
            for size in free if here < end else every:
                j = known.get(here - size)
                if j is not None and (cost[j] < least or cost[j] == least and j < before):
                    before, least = j, cost[j]
            paid += least
        state = len(at)
        known[here] = state
        at.append(here)
        cost.append(paid)
        came.append(before)
        while queue and cost[queue[-1]] + at[queue[-1]] > paid + here:
            queue.pop()
        queue.append(state)
        if row < chain:
            full.append((here + capacity, state, row + 1))
    ends, state = [], len(at) - 1
    while state:
        ends.append(at[state])
        state = came[state]
    return ends[::-1], cost[-1]


class _Stream:
    """The tokens of consecutive documents that are not in a window yet."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.docs: deque = deque()  # doc_id, all its ids, how many of them are in windows
        self.price: list[np.ndarray] = []
        self.size = 0

    def add(self, doc, ids: np.ndarray, price: np.ndarray) -> None:
        self.docs.append([doc, ids, 0])
        self.price.append(price)
        self.size += len(ids)

    def pieces(self, upto: int, again: int) -> Iterator[tuple]:
        """Pieces of the windows of the next ``upto`` tokens, but for those that end among their last ``again``."""
        price = np.concatenate(self.price)
        ends, _ = plan(*offered(price[:upto], self.capacity), self.capacity)
        kept = [x for x in ends if x <= upto - again] if again else ends
        done = 0
        for end in kept:
            offset = 0
            while done < end:
                doc, ids, used = self.docs[0]
                n = min(end - done, len(ids) - used)
                yield doc, used, n, zlib.crc32(ids[used : used + n]), len(ids), self.sequence, offset
                done, offset = done + n, offset + n
                self.docs[0][2] += n
                if used + n == len(ids):
                    self.docs.popleft()
            self.sequence += 1
        self.price = [price[done:]]
        self.size -= done


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, horizon: int = HORIZON, again: int = AGAIN) -> DataFrame:
    """Every piece of every document with its sequence_id and offset; sequences of a partition are numbered in the table's order."""
    if not 2 * capacity <= again <= horizon // 2:
        raise ValueError("the part that is planned again must hold two windows, and be at most half of the horizon")
    path = vocabulary or vocabulary_path()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, sizes = encoder(path), token_bytes(path)
        stream = _Stream(capacity, TaskContext.get().partitionId() << 40)
        kinds = [pa.int64()] * 7
        names = [x.split()[0] for x in _PIECES.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                text = text.as_py() or ""
                ids = np.append(ids_of(text), end_id).astype("<u4")
                stream.add(doc, ids, prices(ids, text.encode(), sizes))
                while stream.size >= horizon:
                    yield batch(list(stream.pieces(horizon, again)))
        if stream.size:
            yield batch(list(stream.pieces(stream.size, 0)))

    return pick(docs, doc_id="long", text="string").mapInArrow(windows, _PIECES)
