"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def kept(docs, n=20):
    first = {}
    words = [(i, SPACED.findall(t or "")) for i, t in docs]
    for i, w in words:
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < (i, s):
                gone[s : s + n] = [True] * n
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out)


def contaminated(docs, items, n=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = PLAIN.findall((t or "").translate(LOW))
        for s in range(max(len(w) - n + 1, 1) if w else 0):
            windows[tuple(w[s : s + n])].add(str(i))
    out = []
    for i, t in docs:
        w = PLAIN.findall((t or "").translate(LOW))
        hit, found = [False] * len(w), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                got = windows.get(tuple(w[s : s + k]))
                if got:
                    hit[s : s + k] = [True] * k
                    found |= got
        out.append((i, len(w), sum(hit), len(found), sha(",".join(sorted(found))), any(hit)))
    return sorted(out)


def measures(text):
    text = text or ""
    w = SPACED.findall(text)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = [False] * len(w)
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            again[i : i + 3] = [True] * 3
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    failed = len(w) < 50 or 100 * sum(again) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), sum(again), failed


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate((("assign", ASSIGN, 2, 12), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16))):
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    n = collections.Counter(k for _, _, k, _ in out)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(out)))


def components(docs, n=4, percent=85):
    sets = []
    for _, t in docs:
        w = SPACED.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs))
