"""Operator 5: best-fit packing of documents into sequences by bin completion.

Documents are encoded and, where longer than a sequence, cut into full pieces (the first piece
takes the remainder). Only the histogram of piece lengths, with at most as many rows as a
sequence has tokens, goes to the driver. There bin completion fills sequences around the largest
piece left: it branches on undominated fillings, applies one as often as the counts allow, and
prunes branches that waste more than a better plan could. A best-fit-decreasing plan is the first
incumbent; the plan with fewer sequences is kept, and the search ends when the incumbent meets
the lower bound, or after a bounded number of nodes. The plan says for each length which ranks
go to which sequences; pieces are ranked within their length in salted chunks and joined with it.

Defined cases: null or empty text is its end token alone; rows that repeat a doc_id are packed
each; ties in length are ranked by doc_id and piece; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import cut, partitions, pick
from .token_counts import encoder, vocabulary_path

CAPACITY, END_ID = 1024, 2
#: Fillings tried around one piece before the best one found is taken.
FILLINGS = 20_000
#: Fillings that are branched on, and nodes of the search, before the best plan found is kept.
BRANCHES, NODES = 3, 5_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece of each document."""
    path = vocabulary or vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                ids = np.append(ids_of(text.as_py() or ""), end_id).astype("<u4")
                edge = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                rows += [(doc, k, a, z - a, zlib.crc32(ids[a:z])) for k, (a, z) in enumerate(zip(edge, edge[1:]))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 5, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return pick(docs, doc_id="long", text="string").mapInArrow(encode, _PIECES)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any plan needs: by tokens, and by pieces that can't share one with each other."""
    best = -(-sum(x * n for x, n in counts.items()) // capacity)
    for small in {0, *(x for x in counts if x <= capacity // 2)}:
        big = sum(n for x, n in counts.items() if x > capacity - small)
        half = [(x, n) for x, n in counts.items() if capacity // 2 < x <= capacity - small]
        rest = sum(x * n for x, n in counts.items() if small <= x <= capacity // 2)
        room = sum((capacity - x) * n for x, n in half)
        best = max(best, big + sum(n for _, n in half) + max(0, -(-(rest - room) // capacity)))
    for k in range(1, 20):  # dual feasible functions: at most k pieces longer than capacity / (k + 1) share a sequence
        weighed = sum(n * (Fraction(x, capacity) if x * (k + 1) % capacity == 0 else Fraction(x * (k + 1) // capacity, k)) for x, n in counts.items())
        best = max(best, math.ceil(weighed))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths, how many sequences hold just these)."""
    left: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for x in sorted(counts, reverse=True):
        todo = counts[x]
        while todo:
            room = min((r for r in left if r >= x), default=None)
            if room is None:
                each = capacity // x
                full, more = divmod(todo, each)
                for fill, n in ((each, full), (more, 1)):
                    if fill and n:
                        left.setdefault(capacity - fill * x, []).append(((x,) * fill, n))
                break
            held, n = left[room].pop()
            if not left[room]:
                del left[room]
            fill = min(room // x, todo)
            times = min(n, todo // fill)
            if n > times:
                left.setdefault(room, []).append((held, n - times))
            left.setdefault(room - fill * x, []).append((held + (x,) * fill, times))
            todo -= fill * times
    return [p for same in left.values() for p in same]


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of filling b can be dealt onto those of a, none over its piece: then a is at least as good.

    Fillings of many small pieces are not compared; they are only branched on once more than needed."""
    if sum(b) > sum(a) or len(b) > 10:
        return False
    room = list(a)

    def deal(k: int) -> bool:
        if k == len(b):
            return True
        for i in range(len(room)):
            if room[i] >= b[k] and room[i] not in room[:i]:
                room[i] -= b[k]
                if deal(k + 1):
                    return True
                room[i] += b[k]
        return False

    return deal(0)


def _fillings(gap: int, lengths: list[int], counts: dict[int, int], tries: int, branches: int | None = BRANCHES) -> list[tuple[int, ...]]:
    """Undominated fillings of the gap, least waste first; large pieces come first.

    With ``branches``, a full one ends the search and so many are given; without, all are."""
    found: list[tuple[int, tuple[int, ...]]] = []
    left = [tries]

    def search(room: int, at: int, used: tuple[int, ...]) -> bool:
        left[0] -= 1
        if counts.get(room, 0) > used.count(room) and (not used or room <= used[-1]):
            found.append((0, (*used, room)))
            if branches is not None or not used:  # one piece that fills the gap dominates all else
                return True
        fits = False
        for i in range(at, len(lengths)):
            x = lengths[i]
            if x <= room and used.count(x) < counts[x]:
                fits = True
                if x < room and search(room - x, i, (*used, x)) or branches is not None and left[0] <= 0:
                    return True
        if not fits:
            found.append((room, used))
            if branches is not None and len(found) > 4 * branches:
                found[:] = sorted(found, key=lambda f: f[0])[:branches]
        return False

    search(gap, 0, ())
    every = [used for _, used in sorted(found, key=lambda f: f[0])]
    best = [b for k, b in enumerate(every) if not any(_dominates(a, b) for j, a in enumerate(every) if j != k)]
    return best[:branches] or [()]


def complete(counts: dict[int, int], capacity: int, most: int, tries: int = FILLINGS, nodes: int = NODES, exact: bool = False) -> list[tuple[tuple[int, ...], int]] | None:
    """Bin completion: the plan with fewest sequences found, fewer than ``most``, or None.

    Branches are the fillings around the largest piece left; one ends when its waste is more than
    a better plan could have, and all end at the lower bound or after so many nodes. The exact
    search tries every undominated filling, one sequence at a time, without such an end: it is for
    few pieces, as its time is not bounded."""
    total, least = sum(x * n for x, n in counts.items()), lower_bound(counts, capacity)
    best = None
    stack = [(dict(counts), (), 0, None)]
    while stack and (nodes or exact) and most > least:
        left, held, times, above = stack.pop()
        nodes -= 1
        waste, size = (above[1], above[2]) if above else (0, 0)
        if times:
            left = dict(left)
            for y in set(held):
                left[y] -= times * held.count(y)
                if not left[y]:
                    del left[y]
            waste, size = waste + times * (capacity - sum(held)), size + times
        if waste > (most - 1) * capacity - total:
            continue
        here = (above, waste, size, held, times)
        if not left:
            best, most = here, size
            continue
        x = max(left)
        rest = left | {x: left[x] - 1}
        for fill in reversed(_fillings(capacity - x, sorted((y for y in rest if y <= capacity - x and rest[y]), reverse=True), rest, tries, None if exact else BRANCHES)):
            held = (x, *fill)
            stack.append((left, held, 1 if exact else min(left[y] // held.count(y) for y in set(held)), here))
    plan = []
    while best:
        if best[4]:
            plan.append((best[3], best[4]))
        best = best[0]
    return plan or None


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY, exact: bool = False) -> list[tuple[tuple[int, ...], int]]:
    """The best plan found; with ``exact`` one that no plan has fewer sequences than."""
    plan = best_fit(counts, capacity)
    size = sum(n for _, n in plan)
    if size > lower_bound(counts, capacity):
        plan = complete(counts, capacity, size, exact=exact) or plan
    return plan


def gap(plan: list[tuple[tuple[int, ...], int]], counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """How many sequences the plan has beyond the lower bound: 0 proves that none has fewer."""
    return sum(n for _, n in plan) - lower_bound(counts, capacity)


def _places(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """length, first and last rank + 1, sequences, the first's id, offset: equal lengths lie side by side."""
    rows, ranked, first = [], {}, 0
    for held, times in plan:
        offset = 0
        for x in dict.fromkeys(held):
            k, at = held.count(x), ranked.get(x, 0)
            rows.append((x, at, at + k * times, times, first, offset))
            ranked[x] = at + k * times
            offset += k * x
        first += times
    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    spark = docs.sparkSession
    cuts = cut(pieces(docs, capacity, end_id, vocabulary))
    counts = {r.length: r.n for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    places = spark.createDataFrame(_places(packing_plan(counts, capacity)), "length long, low long, high long, times long, first long, base long")
    chunked = cuts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * partitions(spark))))
    sizes = chunked.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "chunk", (F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = chunked.withColumn("nth", nth).join(before, ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("nth"))
    into = F.col("rank") - F.col("low")
    placed = ranked.join(F.broadcast(places), (ranked.length == places.length) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select(
        "doc_id", "piece", "start", ranked.length, "ids_crc32",
        (F.col("first") + into % F.col("times")).alias("sequence_id"),
        (F.col("base") + F.floor(into / F.col("times")) * ranked.length).cast("long").alias("offset"),
    )
