"""Operator 9: exact n-gram Jaccard join over prefix trees.

Each document is its set of distinct 4-word shingles (hashed to 64 bits); equal sets are one node,
named by 64 bits of a hash whose rare collisions are found by another 64 and named anew. In a
global order, shingles that are frequent in the corpus last, two sets can only be similar enough if
they share a shingle of their prefixes. Batches send (shingle, node) packed by hash range, a shingle
once for each batch with a star over the nodes that share it there, so a common shingle weighs no
more than the number of batches. Nodes that share prefix shingles, even through others, form
candidate components, and their sets are gathered in blocks of bounded size.

A component beyond a block is joined in two rounds. First its nodes meet in small groups of equal
least hashes (``KEYS`` of them), which links nearly all true copies. Then only nodes that are not
linked yet are held against the others: the parts of a component that are one already are dealt
into packs, and two packs share a block unless they are of one part or of sizes too far apart. So
every pair that can be similar and isn't linked through others meets, and a large group of copies
is not compared with itself again and again.

In a block the sets are stored in a trie, frequent shingles first. It is gone through once for all
sets together: each of its nodes adds its shingles to the partial overlaps that its branch has so
far, and goes on with those sets alone whose overlap and remaining lengths can still reach the
bound; without any, the branch is cut. Similar pairs are returned as a spanning forest of each
block: no link between different texts is lost to the components, and no group is expanded into all
pairs.

Defined cases: a text with fewer than ``n`` words is one shingle; null, empty or wordless texts
have none and are linked with nothing; rows that repeat a doc_id are documents of their own; a
null doc_id counts after all others as component id and is linked like any other; a very long text is
one set; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import by_key, cut, partitions, pick, text_bytes
from ._words import U, Words, mix
from .graph import connected

N, PERCENT = 4, 85
#: Shingles whose order is refined by their frequency; the others come first, by hash.
FREQUENT = 1 << 18
#: A shingle is reported as frequent by a batch, of about BATCH_SHINGLES, that has it in so many sets.
LOCAL, BATCH_SHINGLES = 3, 2_000_000
#: Nodes that share a shingle are held against each other's bounds up to so many; more are taken as they are.
RUN = 256
#: Bounds of a block: nodes, and shingles.
BLOCK_NODES, BLOCK_SHINGLES = 512, 300_000
#: Least hashes of a set that the first round of large components groups by.
KEYS = 4
#: Bytes of text per hash range.
RANGE_BYTES = 8 << 20
#: Largest list of candidate documents that is broadcast (16 bytes each); beyond, they are joined by shuffle.
BROADCAST_ROWS = 2_000_000
_SEED = U(0xA0761D6478BD642F)
_POST = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<i4"), ("at", "<i4")])


def shingle_sets(texts, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts, lower=True)
    keep = w.left >= n
    short = w.first[:-1][(w.count > 0) & (w.count < n)]
    keep[short] = True
    hashes = w.windows(n)
    edge = np.concatenate([[0], np.cumsum(keep)])[w.first]
    hashes = hashes[keep]
    return [np.unique(hashes[a:z]) for a, z in zip(edge[:-1], edge[1:])]


def _node(s: np.ndarray, renamed: frozenset[int] = frozenset()) -> int:
    """The name of a set: 64 bits of a hash, or other 64 where different sets are known to share the first."""
    name = _hash(s, 0)
    return _hash(s, 1) if name in renamed else name


def _hash(s: np.ndarray, seed: int) -> int:
    return int(_hashes(s, np.array([0, len(s)]), seed)[0])


def _hashes(flat: np.ndarray, edge: np.ndarray, seed: int) -> np.ndarray:
    """Of the sets that lie one after the other between the edges; 0 of empty ones."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(flat + U(seed) * _SEED), dtype=U)])
    size = np.diff(edge)
    return np.where(size > 0, (total[edge[1:]] - total[edge[:-1]]) ^ mix(size.astype(U) + U(seed)), U(0)).astype(np.int64)


def _least(flat: np.ndarray, edge: np.ndarray) -> pa.Array:
    """For each set the least of each of KEYS hashes of its shingles: sets of similarity x share each of them with about that chance."""
    full = np.flatnonzero(np.diff(edge))
    least = np.stack([np.minimum.reduceat(mix(flat + U(k + 2) * _SEED), edge[:-1][full]) if len(full) else np.zeros(0, U) for k in range(KEYS)], 1)
    ends = np.cumsum(np.concatenate([[0], np.where(np.diff(edge) > 0, KEYS, 0)]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(least.ravel().astype(np.int64)))


def _sets_of(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            yield part, shingle_sets(part["text"], n)


def _held(batches: Iterator[pa.RecordBatch], n: int, renamed: frozenset[int] = frozenset()) -> Iterator[dict[int, np.ndarray]]:
    """The distinct sets, by node, of as many texts as are held at once."""
    held, size = {}, 0
    for _, sets in _sets_of(batches, n):
        flat, edge = np.concatenate([np.zeros(0, U), *sets]), np.cumsum([0, *map(len, sets)])
        names = _hashes(flat, edge, 0).tolist()
        held |= {_hash(s, 1) if name in renamed else name: s for name, s in zip(names, sets) if len(s)}
        size += sum(map(len, sets))
        if size > BATCH_SHINGLES:
            yield held
            held, size = {}, 0
    yield held


def _parity(s: np.ndarray) -> np.ndarray:
    """Bits, as many as the set has shingles (in powers of two), that tell whether an odd number of its shingles falls on them.

    Two sets' bits differ in no more places than the sets differ in shingles; halves laid over each other give the next smaller size."""
    size = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s >> U(20)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def classes(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, text_hash, n_shingles, node and second (two names of the set, 0 without shingles), parity and least of every row."""

    def make(batches):
        for b, sets in _sets_of(batches, n):
            flat, edge = np.concatenate([np.zeros(0, U), *sets]), np.cumsum([0, *map(len, sets)])
            parities = pa.array([_parity(s) for s in sets], pa.list_(pa.int64()))
            columns = [b["doc_id"], b["text_hash"], pa.array(np.diff(edge)), pa.array(_hashes(flat, edge, 0)), pa.array(_hashes(flat, edge, 1)), parities, _least(flat, edge)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "node", "second", "parity", "least"])

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(make, "doc_id long, text_hash long, n_shingles long, node long, second long, parity array<long>, least array<long>")


def told_apart(known: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """classes() with different sets under different nodes, and the names that had to be given up.

    Of m different sets about m * m / 2**65 share a name: a few at 10**10, so they fit the driver."""
    shared = known.filter("n_shingles > 0").groupBy("node").agg(F.min("second").alias("a"), F.max("second").alias("b")).filter("a <> b")
    renamed = frozenset(r.node for r in shared.select("node").collect())
    node = F.when(F.col("node").isin(*renamed), F.col("second")).otherwise(F.col("node")) if renamed else F.col("node")
    return known.withColumn("node", node).drop("second"), renamed


def frequent_shingles(docs: DataFrame, n: int = N, most: int = FREQUENT) -> np.ndarray:
    """The most frequent shingles, from batches' counts, sorted by hash, with their place in the order of frequency.

    At most ``most`` rows reach the driver. This only sets the order of shingles: any order gives the same links."""

    def count(batches):
        for sets in _held(batches, n):
            h, c = np.unique(np.concatenate([np.zeros(0, U), *sets.values()]), return_counts=True)
            often = c >= LOCAL
            yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(c[often].astype(np.int64))], ["h", "c"])

    rows = docs.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(most).toPandas()
    found = np.zeros(len(rows), [("h", "<u8"), ("at", "<u8")])
    found["h"] = rows["h"].to_numpy(np.int64).view(U)
    found["at"] = np.arange(len(rows), 0, -1)
    return np.sort(found, order="h")


def _prefix(s: np.ndarray, order: np.ndarray, percent: int) -> np.ndarray:
    size = len(s) - -(-percent * len(s) // 100) + 1
    at = np.minimum(np.searchsorted(order["h"], s), max(len(order) - 1, 0))
    late = np.where(order["h"][at] == s, order["at"][at], U(0)) if len(order) else np.zeros(len(s), U)
    return s[np.lexsort([s, late])[:size]]


def _send_prefixes(order: np.ndarray, n: int, percent: int, buckets: int, renamed: frozenset[int]):
    def pack(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        prefixes = [_prefix(s, order, percent) for s in sets.values()]
        lengths = [len(p) for p in prefixes]
        post = np.zeros(sum(lengths), _POST)
        if len(post):
            post["token"] = np.concatenate(prefixes)
            post["at"] = np.concatenate([np.arange(k) for k in lengths])
            post["node"], post["n"] = np.repeat(np.array(list(sets)), lengths), np.repeat([len(s) for s in sets.values()], lengths)
            post = post[np.lexsort([post["node"], post["token"]])]
            new = np.ones(len(post), bool)
            new[1:] = post["token"][1:] != post["token"][:-1]
            first = np.append(np.flatnonzero(new), len(post))
            many = np.repeat(np.diff(first) > RUN, np.diff(first))  # common here: one goes on, with a star to the others
            lead = np.maximum.accumulate(np.where(new, np.arange(len(post)), 0))
            far = many & ~new
            star = np.concatenate([post[far], post[lead[far]]])
            star["token"] = mix(np.concatenate([post["node"][lead[far]]] * 2).view(U) ^ U(0x5DEECE66D))  # apart from shingles' hashes
            star["at"] = -1
            post["at"][many] = -1
            post = np.concatenate([post[~far], np.unique(star)])
        bucket = (mix(post["token"]) >> U(32)) * U(buckets) >> U(32)  # mixed: prefixes hold the least hashes of their sets
        by = np.argsort(bucket, kind="stable")
        post, bucket = post[by], bucket[by]
        full, at = np.unique(bucket, return_index=True)
        at = [*at, len(post)]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array([post[a:z].tobytes() for a, z in zip(at, at[1:])], pa.binary())], ["bucket", "packed"])

    return lambda batches: map(pack, _held(batches, n, renamed))


def _meet(percent: int):
    """A forest over the nodes that share a token and, by the token's place in both, can be similar."""

    def meet(table: pa.Table) -> pa.Table:
        post = np.concatenate([np.frombuffer(x, _POST) for x in table["packed"].to_pylist()])
        post = post[np.lexsort([post["node"], post["token"]])]
        new = np.ones(len(post), bool)
        new[1:] = post["token"][1:] != post["token"][:-1]
        first = np.append(np.flatnonzero(new), len(post))
        size = np.diff(first)
        pairs, tested = [np.zeros((0, 2), np.int64)], 0
        for k in np.unique(size[(size > 1) & (size <= RUN)]):  # all runs of one length at once
            at = first[:-1][size == k]
            x, y = np.triu_indices(k, 1)
            for part in np.array_split(at, max(1, len(at) * len(x) // 1_000_000)):
                a, b = (part[:, None] + x).ravel(), (part[:, None] + y).ravel()
                na, nb, pa_, pb = post["n"][a], post["n"][b], post["at"][a], post["at"][b]
                need = -(-percent * (na + nb) // (100 + percent))
                good = (pa_ < 0) | (pb < 0) | (np.minimum(na - pa_, nb - pb) >= need) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
                good &= post["node"][a] != post["node"][b]
                pairs.append(np.stack([a[good], b[good]], 1))
        tested = sum(map(len, pairs))
        for a, z in zip(first[:-1][size > RUN], first[1:][size > RUN]):
            by_size = a + np.argsort(post["n"][a:z], kind="stable")
            x, y = by_size[:-1], by_size[1:]
            # in order of size, a chain; it breaks where no set before can be similar to one after
            near = 100 * post["n"][x] >= percent * post["n"][y] if (post["at"][a:z] >= 0).all() else np.ones(len(x), bool)
            pairs.append(np.stack([x[near], y[near]], 1))
        a, b = np.concatenate(pairs).T
        edges = np.zeros(len(a), [("a", "<i8"), ("an", "<i4"), ("b", "<i8"), ("bn", "<i4"), ("star", "?")])
        edges["star"] = (np.arange(len(a)) >= tested) | (post["at"][a] < 0) | (post["at"][b] < 0)
        edges["a"], edges["an"], edges["b"], edges["bn"] = post["node"][a], post["n"][a], post["node"][b], post["n"][b]
        edges = np.unique(edges)
        edges = edges[edges["a"] != edges["b"]]
        return pa.table({k: pa.array(np.ascontiguousarray(edges[k])) for k in edges.dtype.names})

    return meet


def candidates(docs: DataFrame, known: DataFrame, n: int = N, percent: int = PERCENT, renamed: frozenset[int] = frozenset()) -> DataFrame:
    """a, an, b, bn: a graph whose components hold every similar pair, with the sets' sizes.

    Pairs whose parities differ in more bits than similar sets can are left out; known: classes(), a row each node."""
    order = frequent_shingles(docs, n)
    buckets = max(2 * partitions(docs.sparkSession), -(-text_bytes(docs) // RANGE_BYTES))
    packed = docs.mapInArrow(_send_prefixes(order, n, percent, buckets, renamed), "bucket long, packed binary")
    edges = by_key(packed, "bucket", buckets).groupBy("bucket").applyInArrow(_meet(percent), "a long, an int, b long, bn int, star boolean").distinct()
    for end in "ab":
        edges = edges.join(known.select(F.col("node").alias(end), F.col("parity").alias(f"{end}_parity")), end)
    halved = lambda c, m: F.zip_with(F.slice(c, 1, m), F.slice(c, m + 1, m), lambda x, y: x.bitwiseXOR(y))
    size = F.least(F.size("a_parity"), F.size("b_parity"))
    a, b = (F.when(F.size(c) > size, halved(c, size)).otherwise(F.col(c)) for c in ("a_parity", "b_parity"))  # sizes of near enough sets differ by one step at most
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = (100 + percent) * apart <= (100 - percent) * (F.col("an") + F.col("bn"))
    return edges.filter(F.col("star") | near).select("a", "an", "b", "bn")


def _paths(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Each set's shared shingles as places in a common order, those of most sets first, and how many there are."""
    every, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.full(len(every), -1, np.int64)
    shared = np.flatnonzero(counts > 1)
    place[shared[np.argsort(-counts[shared], kind="stable")]] = np.arange(len(shared))
    parts = np.split(place[inverse], np.cumsum([len(s) for s in sets])[:-1])
    return [np.sort(x[x >= 0]) for x in parts], len(shared)


def _trie(paths: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """The nodes of the compressed trie over sorted paths, parents first: parent, depth above and below its edge, first path and last + 1."""

    def common(x: np.ndarray, y: np.ndarray) -> int:
        k = min(len(x), len(y))
        differ = np.flatnonzero(x[:k] != y[:k])
        return int(differ[0]) if len(differ) else k

    shares = np.array([common(x, y) for x, y in zip(paths, paths[1:])], np.int64)
    nodes: list[tuple[int, int, int, int, int]] = []
    todo = [(-1, 0, 0, len(paths))]
    while todo:
        parent, depth, lo, hi = todo.pop()
        below = int(shares[lo : hi - 1].min()) if hi - lo > 1 else len(paths[lo])
        nodes.append((parent, depth, below, lo, hi))
        if hi - lo > 1:
            edges = [lo, *(lo + 1 + np.flatnonzero(shares[lo : hi - 1] == below)).tolist(), hi]
            todo += [(len(nodes) - 1, below, a, z) for a, z in zip(edges, edges[1:])][::-1]
    return nodes


def tree_join(sets: list[np.ndarray], percent: int = PERCENT, parts: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with 100 * intersection >= percent * union; sets of equal ``parts`` count as linked."""
    m = len(sets)
    unsorted, shared = _paths(sets)
    by_path = sorted(range(m), key=lambda k: unsorted[k].astype(">u4").tobytes())
    paths, sizes = [unsorted[k] for k in by_path], np.array([len(sets[k]) for k in by_path])
    lengths = np.array([len(p) for p in paths])
    holds = np.zeros((shared, m), np.uint8)
    for k, p in enumerate(paths):
        holds[p, k] = 1
    group = np.arange(m) if parts is None else np.unique(np.array(parts)[by_path], return_inverse=True)[1]
    forest = []
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {-1: (np.arange(m), np.zeros(m, np.int64))}
    for k, (parent, depth, below, lo, hi) in enumerate(_trie(paths)):
        alive, overlap = held[parent]
        # a pair is met in the branch of its first set; a branch that is linked throughout needs no more of its own
        stay = alive > lo
        if (group[lo:hi] == group[lo]).all():
            stay &= group[alive] != group[lo]
        alive, overlap = alive[stay], overlap[stay]
        if below > depth and len(alive):
            rows = holds[paths[lo][depth:below]]
            overlap = overlap + (rows[:, alive] if len(alive) < m // 2 else rows).sum(axis=0, dtype=np.int64)[slice(None) if len(alive) < m // 2 else alive]
        ahead = np.minimum(int(lengths[lo:hi].max()) - below, lengths[alive] - overlap)
        need = -(-percent * (sizes[alive] + int(sizes[lo:hi].min())) // (100 + percent))
        reach = overlap + ahead >= need
        alive, overlap = alive[reach], overlap[reach]
        held[k] = alive, overlap
        if hi - lo == 1:
            for j in alive[100 * overlap >= percent * (sizes[lo] + sizes[alive] - overlap)]:
                if group[j] != group[lo]:
                    forest.append((by_path[lo], by_path[j]))
                    group[group == group[j]] = group[lo]
    return forest


def _join_block(n: int, percent: int, renamed: frozenset[int]):
    def join(table: pa.Table) -> pa.Table:
        sets = shingle_sets(table["text"], n)
        nodes, groups, parts = (table[c].to_numpy() for c in ("node", "group", "part"))
        own = {}
        for k, s in enumerate(sets):
            if _node(s, renamed) == nodes[k]:  # else another text of the same hash
                own.setdefault(groups[k], {})[nodes[k]] = (s, parts[k])
        edges = []
        for held in own.values():
            names, pairs = list(held), list(held.values())
            if len(held) > 1:
                edges += [(names[x], names[y]) for x, y in tree_join([s for s, _ in pairs], percent, [p for _, p in pairs])]
        a, b = zip(*edges) if edges else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return join


def _fill(nodes: Column, shingles: Column, share: int = 1) -> Column:
    """How many blocks, or shares of one, so many nodes and shingles fill."""
    return F.greatest(F.ceil(share * nodes / BLOCK_NODES), F.ceil(share * shingles / BLOCK_SHINGLES), F.lit(1)).cast("long")


def _key(df: DataFrame, *columns: str) -> DataFrame:
    """df with its columns renamed by expressions, to be joined with what they came from."""
    return df.select(*((F.col(c) + F.lit(0).cast("long")).alias(f"_{c}") for c in columns), *(c for c in df.columns if c not in columns))


def _first_groups(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, group, part of the small components and of the first round of large ones; and the large ones' nodes.

    nodes: node, n, label, least. A part of 0 or the node itself: none is linked yet."""
    sizes = nodes.groupBy("label").agg(_fill(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    nodes = nodes.join(_key(sizes, "label"), F.col("label") == F.col("_label"))
    small = nodes.filter("blocks <= 1").select("node", "n", F.col("label").alias("group"), F.col("node").alias("part"))
    large = cut(nodes.filter("blocks > 1").select("node", "n", "label", "least"))
    each = large.select("node", "n", F.posexplode("least").alias("k", "least")).withColumn("same", F.xxhash64("k", "least"))
    salts = each.groupBy("same").agg(_fill(F.count(F.lit(1)), F.sum("n")).alias("salts"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    each = each.join(_key(salts, "same"), F.col("same") == F.col("_same"))
    met = each.select("node", "n", F.xxhash64("same", F.pmod(F.xxhash64("node", "k"), F.col("salts"))).alias("group"), F.col("node").alias("part"))
    return small.unionByName(met), large


def _second_groups(large: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """node, n, group, part of the second round: packs of one component that are not of one part, and of near sizes, share a group."""
    linked = _key(connected(edges), "node").withColumnRenamed("label", "linked")
    df = large.drop("least").join(linked, F.col("node") == F.col("_node"), "left").withColumn("part", F.coalesce("linked", "node")).drop("_node", "linked")
    # near sizes are one band apart at most: bands are a little wider than the ratio, beyond what rounding can do
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100.0 / percent) + 1e-6)).cast("long")
    df = cut(df.withColumn("band", band))
    sizes = df.groupBy("label", "band", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")).withColumn("fills", _fill(F.col("rows"), F.col("shingles"), 2))
    sizes = sizes.withColumn("own", F.when(F.col("fills") > 1, F.col("part")).otherwise(F.lit(None).cast("long")))  # a part that fills packs of its own
    packs = sizes.groupBy("label", "band", "own").agg(_fill(F.sum("rows"), F.sum("shingles"), 2).alias("packs"))
    named = _key(sizes.select("label", "band", "part", "own"), "label", "band", "part")
    df = df.join(named, (F.col("label") == F.col("_label")) & (F.col("band") == F.col("_band")) & (F.col("part") == F.col("_part"))).drop("_label", "_band", "_part")
    p = F.col("p")
    counts = packs.select(F.col("label").alias("l"), F.col("band").alias("b"), F.col("own").alias("o"), F.col("packs").alias("p"))
    same = (F.col("label") == F.col("l")) & (F.col("band") == F.col("b")) & F.col("own").eqNullSafe(F.col("o"))
    at = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("part")).otherwise(F.col("node"))), p)
    df = cut(df.join(counts, same).select("node", "n", "label", "part", F.struct("band", "own", at.alias("at")).alias("pack")))
    every = cut(df.select("label", "pack").distinct())
    x, y = every.select("label", F.col("pack").alias("x")), every.select(F.col("label").alias("l"), F.col("pack").alias("y"))
    apart = ~F.col("x.own").eqNullSafe(F.col("y.own")) | F.col("x.own").isNull()
    pairs = x.join(y, (F.col("label") == F.col("l")) & F.col("y.band").between(F.col("x.band"), F.col("x.band") + 1)).filter(apart & ((F.col("x.band") < F.col("y.band")) | (F.col("x") <= F.col("y"))))
    group = F.xxhash64("label", "x", "y").alias("group")
    members = pairs.select("label", group, F.explode(F.array_distinct(F.array("x", "y"))).alias("pack"))
    members = members.select(F.col("label").alias("l"), "group", F.col("pack.band").alias("b"), F.col("pack.own").alias("o"), F.col("pack.at").alias("a"))
    return df.join(members, (F.col("label") == F.col("l")) & (F.col("pack.band") == F.col("b")) & F.col("pack.own").eqNullSafe(F.col("o")) & (F.col("pack.at") == F.col("a"))).select("node", "n", "group", "part")


def _join_groups(docs: DataFrame, first: DataFrame, placed: DataFrame, n: int, percent: int, renamed: frozenset[int]) -> DataFrame:
    """a, b: the forests of all groups of placed (node, n, group, part), whose texts are gathered in blocks."""
    placed = cut(placed)
    total = placed.agg(F.sum("n").alias("shingles")).first()
    spread = max(2 * partitions(docs.sparkSession), -(-(total.shingles or 0) // BLOCK_SHINGLES))
    named = cut(placed.select("node").distinct().join(first, "node"))
    asked = named.agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("rows")).first()
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_text"))
    if asked.n <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(named.select("of", "of_text").distinct()), same, "left_semi")
    if (asked.rows or 0) > 1:  # rows that repeat both doc_id and text
        texts = texts.groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))
    blocks = placed.select("node", "group", "part", F.pmod("group", F.lit(spread)).alias("block")).join(named.drop("rows"), "node")
    gathered = by_key(blocks.join(texts, same).select("block", "node", "group", "part", "text"), "block", spread, 8)
    return gathered.groupBy("block").applyInArrow(_join_block(n, percent, renamed), "a long, b long")


def links(docs: DataFrame, known: DataFrame, n: int = N, percent: int = PERCENT, renamed: frozenset[int] = frozenset()) -> DataFrame:
    """a, b: a forest over the nodes (classes of equal sets) with the components of all similar pairs."""
    # of each node one text, named by doc_id (null last) and text_hash, and how many rows have both
    each = known.groupBy("node", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"), F.first("parity").alias("parity"), F.first("least").alias("least"))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "rows")).alias("one")
    first = cut(each.groupBy("node").agg(one, F.first("parity").alias("parity"), F.first("least").alias("least")).select("node", F.col("one.doc_id").alias("of"), F.col("one.text_hash").alias("of_text"), "one.rows", "parity", "least"))
    near = cut(candidates(docs, first, n, percent, renamed))
    labels = connected(near)
    sizes = near.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("an").alias("n")), F.struct(F.col("b").alias("node"), F.col("bn").alias("n")))).alias("x")).select("x.node", "x.n").distinct()
    nodes = sizes.join(labels, "node").join(first.select(F.col("node").alias("_node"), "least"), F.col("node") == F.col("_node")).drop("_node")
    placed, large = _first_groups(cut(nodes))
    first = first.drop("parity", "least")
    edges = cut(_join_groups(docs, first, placed, n, percent, renamed))
    again = cut(_second_groups(large, edges, percent)) if not large.isEmpty() else None
    if again is None or again.isEmpty():
        return edges
    return edges.unionByName(_join_groups(docs, first, again, n, percent, renamed))


def labelled(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), text_hash, label (a number of the component, null without shingles)."""
    docs = pick(docs, doc_id="long", text="string")
    known, renamed = told_apart(cut(classes(docs, n)))
    full = known.filter("n_shingles > 0")
    labels = connected(cut(links(docs, full, n, percent, renamed)))
    first = full.groupBy("node").agg(F.min("doc_id").alias("first")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = first.groupBy("label").agg(F.min("first").alias("component_id")).select((F.col("label") + F.lit(0).cast("long")).alias("of"), "component_id")
    named = first.join(least, F.col("label") == F.col("of")).select((F.col("node") + F.lit(0).cast("long")).alias("class"), "component_id", "label")
    out = known.join(named, (F.col("node") == F.col("class")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "label")


def components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """labelled() without the label."""
    return labelled(docs, n, percent).drop("label")
