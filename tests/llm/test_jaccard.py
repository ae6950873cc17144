"""The Jaccard join's trie, rounds and names against plain versions."""

import itertools
import random

import numpy as np
import pytest

from gleaner.llm import jaccard_join
from tests.llm import brute


def _components(m, edges):
    up = list(range(m))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in edges:
        up[top(i)] = top(j)
    return [top(i) for i in range(m)]


def _same(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def _sets(r, m):
    base = [r.choice(60, r.integers(5, 40), replace=False) for _ in range(3)]
    out = []
    for _ in range(m):
        x = base[r.integers(3)]
        out.append(np.unique(np.concatenate([x[r.random(len(x)) < r.choice([1, 0.9, 0.5])], r.integers(100, 160, r.integers(1, 4))])).astype(np.uint64))
    return out


def test_trie_nodes_cover_all_paths():
    r = np.random.default_rng(3)
    paths = sorted((np.sort(r.choice(8, r.integers(0, 6), replace=False)) for _ in range(60)), key=lambda p: p.astype(">u4").tobytes())
    nodes = jaccard_join._trie(paths)
    assert [n for n in nodes if n[4] - n[3] == 1 and not any(m[0] == nodes.index(n) for m in nodes)] and len(nodes) <= 2 * len(paths)
    for parent, above, below, lo, hi in nodes:
        assert all(tuple(paths[k][:below]) == tuple(paths[lo][:below]) for k in range(lo, hi))
        assert parent == -1 or (nodes[parent][2] == above and nodes[parent][3] <= lo < hi <= nodes[parent][4])
    assert sorted(n[3] for n in nodes if n[4] - n[3] == 1) == list(range(len(paths)))


@pytest.mark.parametrize("percent", [50, 60, 80, 85, 100])
def test_tree_join_equals_all_pairs(percent):
    r = np.random.default_rng(percent)
    for m in (1, 2, 40, 90):
        sets = _sets(r, m)
        pairs = [(i, j) for i, j in itertools.combinations(range(m), 2) for both in [len(np.intersect1d(sets[i], sets[j]))] if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)]
        forest = jaccard_join.tree_join(sets, percent)
        assert set(map(tuple, map(sorted, forest))) <= set(pairs) and len(forest) < max(m, 1)
        assert _same(_components(m, pairs), _components(m, forest))
        parts = [int(x) for x in r.integers(0, 5, m)]
        linked = [(i, j) for i, j in itertools.combinations(range(m), 2) if parts[i] == parts[j]]
        assert _same(_components(m, pairs + linked), _components(m, jaccard_join.tree_join(sets, percent, parts) + linked))


def _families(r):
    words = lambda n, tag: [f"{tag}{r.randrange(10**6)}" for _ in range(n)]
    docs = []
    for f in range(3):
        base = words(60, f"f{f}")
        for _ in range(40):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = words(1, "e")[0]
            docs.append(" ".join(w[: r.choice([60, 60, 58, 52, 45])]))
    shared = words(30, "s")  # a common passage in otherwise different texts
    docs += [" ".join(words(r.randint(5, 40), "u") + shared) for _ in range(40)]
    docs += [" ".join(words(r.randint(1, 50), "o")) for _ in range(20)] + ["", "uno dos"]
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("nodes, run", [(8, 3), (20, 1000)])
def test_large_components_in_two_rounds(spark, monkeypatch, nodes, run):
    docs = _families(random.Random(nodes))
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", nodes)
    monkeypatch.setattr(jaccard_join, "RUN", run)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for n, percent in ((4, 85), (2, 60)):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.components(df, n, percent).collect())
        assert got == brute.components(docs, n, percent)


def test_sets_that_share_a_name_are_told_apart(spark, monkeypatch):
    whole = jaccard_join._hash
    monkeypatch.setattr(jaccard_join, "_hash", lambda s, seed: whole(s, seed) % 7 + 1 if seed == 0 and len(s) else whole(s, seed))
    known = spark.createDataFrame([(k, k % 3, k * 11) for k in range(1, 7)] + [(7, 9, 5), (8, 9, 5)], "n_shingles long, node long, second long")
    apart, renamed = jaccard_join.told_apart(known)
    assert renamed == {0, 1, 2} and {r.n_shingles: r.node for r in apart.collect()} == {**{k: k * 11 for k in range(1, 7)}, 7: 9, 8: 9}
    s = [np.array([k, k + 1], np.uint64) for k in range(30)]
    names = {jaccard_join._node(x) for x in s}
    assert len(names) < 8 and len({jaccard_join._node(x, frozenset(names)) for x in s}) == 30
