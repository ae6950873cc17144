"""Operator 8: licence scan with a generalised suffix automaton over template words.

All templates' word sequences go into one suffix automaton. Files are streamed through it: each
word's matching statistic is the length of the longest sequence ending there that occurs in a
template; its suffix links tell the shorter ones that other templates have. Only stretches of a
file whose word triples all occur in a template can have a statistic of MATCH or more, so the
others are passed over by their hashes. Matches of a template that can't be longer are chained in
order of both texts, with at most GAP words between neighbours, so that most of the template is
covered; a template that is covered enough gives its label, and the best coverage is the score.
Phrases that name a licence outright are located exactly and always give their labels.

Defined cases: null, empty or wordless text has no places, labels or score; rows that repeat a
doc_id are each returned; chains that cover equally much give the same score; without templates
there are only phrases; a very long text is streamed through the automaton whole; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import pick
from ._words import PLAIN, Words

#: Least length of a match, the most words between matches of a chain, and the covered share that gives a label.
MATCH, GAP, COVERED = 3, 40, 0.6

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices and opening passages of public licences, by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    (
        "mit",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the
        software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
        and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including
        but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be
        liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the
        use or other dealings in the software""",
    ),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    (
        "apache-2.0",
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
        http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as
        is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations
        under the license""",
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    (
        "gpl",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software
        foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any
        warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should
        have received a copy of the gnu general public license along with this program if not see https www gnu org licenses""",
    ),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd",
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of
        source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above
        copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the
        name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
        written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to
        the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable
        for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of
        use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or
        otherwise arising in any way out of the use of this software even if advised of the possibility of such damage""",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (
        "mpl-2.0",
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at
        https mozilla org mpl 2 0""",
    ),
    ("reserved", "all rights reserved"),
)


class Automaton:
    """A generalised suffix automaton of word sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.size, self.link = [0], [-1]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for which, words in enumerate(sequences):
            last = 0
            for k, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].add((which, k))
        for state in sorted(range(len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, size: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.size.append(size)
        self.link.append(link)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A state for the sequences of ``target`` that are no longer than one beyond ``state``."""
        if self.size[target] == self.size[state] + 1:
            return target
        twin = self._state(self.size[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = twin
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # another sequence has been here
            return self._split(last, word, self.next[last][word])
        new = self._state(self.size[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.next[state][word])
        return new

    def statistics(self, words) -> Iterator[tuple[int, int]]:
        """For each word, the length of the longest match that ends there, and its state."""
        state = size = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            yield size, state


class _Scanner:
    def __init__(self, templates, phrases):
        of = lambda texts: Words(pa.array(list(texts), pa.string()), PLAIN, lower=True)
        w = of(t for _, t in templates)
        self.labels = [label for label, _ in templates]
        self.templates = [w.hashes[a:z].tolist() for a, z in zip(w.first[:-1], w.first[1:])]
        self.automaton = Automaton(self.templates)
        self.grams = np.unique(w.windows(MATCH)[w.left >= MATCH])
        p = of(phrases)
        self.phrases = [(label, int(n), p.windows(int(n))[a]) for label, n, a in zip(phrases.values(), p.count, p.first[:-1])]

    def known(self, grams: np.ndarray) -> np.ndarray:
        """Which word triples a template has."""
        if not len(self.grams):
            return np.zeros(len(grams), bool)
        return self.grams[np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)] == grams

    def matches(self, start: int, words: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """Template, its first word, the text's first word and length of every match of MATCH words or more that is not part of a longer one there."""
        automaton = self.automaton
        for k, (size, state) in enumerate(automaton.statistics(words)):
            following = words[k + 1] if k + 1 < len(words) else None
            told: set[tuple[int, int]] = set()
            while size >= MATCH:
                for which, end in automaton.ends[state] - told:
                    template = self.templates[which]
                    if end + 1 == len(template) or template[end + 1] != following:
                        yield which, end - size + 1, start + k - size + 1, size
                told |= automaton.ends[state]
                state = automaton.link[state]
                size = automaton.size[state]

    def covered(self, matches: list[tuple[int, int, int, int]]) -> dict[int, float]:
        """The largest share of each template that one chain of its matches covers.

        A chain goes forward in template and text, with at most GAP words of the text between
        neighbours; what a match shares with the one before it counts once."""
        of: dict[int, list[tuple[int, int, int]]] = {}
        for which, begin, at, size in sorted(matches, key=lambda m: (m[0], m[2], m[1])):
            of.setdefault(which, []).append((begin, at, size))
        shares = {}
        for which, chain in of.items():
            reached: list[int] = []  # words that the best chain up to each match covers
            longest, first = max(size for _, _, size in chain), 0
            for begin, at, size in chain:
                while chain[first][1] + longest + GAP < at:
                    first += 1
                best = 0
                for (b, a, n), words in zip(chain[first:], reached[first:]):
                    if b < begin and a < at and at - (a + n) <= GAP:
                        best = max(best, words - max(0, b + n - begin, a + n - at))
                reached.append(best + size)
            shares[which] = max(reached) / len(self.templates[which])
        return shares


@functools.lru_cache(maxsize=4)
def _scanner(templates: tuple, phrases: tuple) -> _Scanner:
    return _Scanner(templates, dict(phrases))


def scan_texts(texts, templates=TEMPLATES, phrases=PHRASES) -> list[tuple]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of each text."""
    scanner = _scanner(tuple(templates), tuple(phrases.items()))
    w = Words(texts, PLAIN, lower=True)
    n = len(w.count)
    text_of = w.text_of
    places = [[] for _ in range(n)]
    for label, size, name in scanner.phrases:
        for at in np.flatnonzero((w.windows(size) == name) & (w.left >= size)):
            places[text_of[at]].append((int(at - w.first[text_of[at]]), label))
    gram = w.windows(MATCH)
    inside = np.flatnonzero(scanner.known(gram) & (w.left >= MATCH))
    matches: dict[int, list] = {}
    for run in np.split(inside, np.flatnonzero((np.diff(inside) > 1) | (np.diff(text_of[inside]) > 0)) + 1):
        if len(run):
            matches.setdefault(text_of[run[0]], []).extend(scanner.matches(int(run[0]), w.hashes[run[0] : run[-1] + MATCH].tolist()))
    out = []
    for i in range(n):
        base = {label for _, label in places[i]}
        covered = scanner.covered(matches[i]) if i in matches else {}
        found = {scanner.labels[k] for k, share in covered.items() if share >= COVERED}
        starts = [at for at, _ in places[i]]
        out.append((int(w.count[i]), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), float(min(1.0, max(covered.values(), default=0.0)))))
    return out


_OUT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""

    def apply(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows = [(doc, *x) for doc, x in zip(part["doc_id"].to_pylist(), scan_texts(part["text"], templates, phrases))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _OUT.values())], list(_OUT))

    schema = ", ".join(f"{k} {'double' if v == pa.float64() else 'string' if v == pa.string() else 'long'}" for k, v in _OUT.items())
    return pick(docs, doc_id="long", text="string").mapInArrow(apply, schema)
