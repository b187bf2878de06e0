"""Licence scan with a generalised suffix automaton of licence tokens.

The automaton holds the tokens of all templates and base phrases. A text is streamed through it; at each word
the matching statistic is the longest suffix that occurs in some template. Places where a base phrase ends are
read off the automaton's suffix links. Right-maximal matches of ``MIN_MATCH`` words or more are chained, in
order in both text and template, into spans; a span that covers ``COVER`` of its template's words labels the
text. The score is the best covered share, 1 where a base phrase stands.

A match is a run of word pairs that stand together in some template. That is tested first, for all words at once, and
only such runs, of as many words as the shortest base phrase has (a chained match has ``MIN_MATCH``), are streamed.

A match extends the chain of its template that gives the most covered words, or starts one where that gives as many;
a chain stays open for later matches, so a stray fragment neither ends a chain nor spoils the notice after it. Of
chains of a template that overlap, the best is kept.

Defined cases: a null text has no words (null positions, empty labels, score 0); a null or repeated id is passed
on; rows are independent, so ties and repeated rows are equal; an empty table gives an empty result; other
columns aren't read.
"""

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import ALNUM, Vocabulary, WordHasher, slices, texts_of

MIN_MATCH, COVER, GAP = 4, 0.75, 8

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Wording of public licence notices, by label.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd-2", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at"),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1", "boost software license version 1 0"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
]


class Automaton:
    """Generalised suffix automaton over token lists. Per state: next states, suffix link, longest length, the
    (template, end) places of its strings, and the phrases that are suffixes of its strings."""

    def __init__(self, texts: list[list[int]], phrases: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set] = [set()]
        for t, words in enumerate(texts):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w, ends)
                ends[last].add((t, i))
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:
            ends[self.link[s]] |= ends[s]
        ends[0] = set()
        self.ends = [sorted(e) for e in ends]
        at_state: dict[int, list] = {}
        for p in phrases:
            s = 0
            for w in texts[p]:
                s = self.next[s][w]
            at_state.setdefault(s, []).append((p, len(texts[p])))
        self.phrases: list[tuple] = [()] * len(self.next)
        for s in reversed(order):
            self.phrases[s] = (*self.phrases[self.link[s]], *at_state.get(s, ()))

    def _new(self, length: int, ends: list, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else 0)
        self.length.append(length)
        ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int, ends: list) -> int:
        clone = self._new(self.length[p] + 1, ends, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int, ends: list) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w, ends)
        state, p = self._new(self.length[last] + 1, ends), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w, ends)
        return state

    def stream(self, words):
        """(state, length) after each word: the matching statistics."""
        s, n = 0, 0
        for w in words:
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            s, n = (self.next[s][w], n + 1) if w in self.next[s] else (0, 0)
            yield s, n


class Scanner:
    def __init__(self, templates=None, base=None):
        base = BASE if base is None else base
        self.labels = [x for x, _ in (templates or TEMPLATES)] + list(base.values())
        texts = [t for _, t in (templates or TEMPLATES)] + list(base)
        self.hasher = WordHasher(ALNUM)
        hashed = [self.hasher.words(t.encode())[2] for t in texts]
        self.vocabulary = Vocabulary(np.concatenate(hashed))
        words = [self.vocabulary.tokens(h).tolist() for h in hashed]
        self.sizes = [len(w) for w in words]
        self.first_base = len(texts) - len(base)
        self.automaton = Automaton(words, list(range(self.first_base, len(texts))))
        self.least = min([MIN_MATCH, *self.sizes[self.first_base :]])
        n = len(self.vocabulary)
        self.known = np.arange(n + 1) < n
        self.pair = np.zeros((n + 1, n + 1), dtype=bool)
        for w in words:
            self.pair[w[:-1], w[1:]] = True

    def runs(self, tokens: np.ndarray) -> list[tuple[int, int]]:
        """[first, last + 1) of the runs of ``least`` words or more whose neighbours all occur in templates."""
        if not len(tokens):
            return []
        # a run ends where two neighbours occur in no template; unknown words are no run
        joined = np.concatenate([[False], self.pair[tokens[:-1], tokens[1:]], [False]])
        begins, ends = np.flatnonzero(~joined[:-1]), np.flatnonzero(~joined[1:]) + 1
        keep = (ends - begins >= self.least) & self.known[tokens[begins]]
        return list(zip(begins[keep].tolist(), ends[keep].tolist(), strict=True))

    def scan(self, tokens: np.ndarray) -> dict:
        starts, named, matches = [], set(), []
        for a, b in self.runs(tokens):
            stats = list(self.automaton.stream(tokens[a:b].tolist()))
            for i, (state, n) in enumerate(stats):
                for p, size in self.automaton.phrases[state]:
                    if size <= n:
                        starts.append(a + i - size + 1)
                        named.add(self.labels[p])
                if n >= MIN_MATCH and (i + 1 == len(stats) or stats[i + 1][1] != n + 1):
                    matches.append((a + i - n + 1, n, state))
        spans = self.chain(matches)
        return {"n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base": named, "spans": spans, "score": 1.0 if named else max((s[3] for s in spans), default=0.0)}

    def chain(self, matches: list) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, covered share) of the chains, best first for each template."""
        done, open_ = [], {}
        for start, n, state in matches:
            for t, last in self.automaton.ends[state]:
                if t >= self.first_base:
                    continue
                at, best, base = last - n + 1, n, None
                # only chains that end at most GAP before this match are left: a bounded number
                near = [c for c in open_.get(t, ()) if start - c["end"] <= GAP]
                for c in near:
                    cut = max(0, c["end"] - start, c["at"] - at)
                    if at - c["at"] <= GAP and cut < n and c["covered"] + n - cut > best:
                        best, base = c["covered"] + n - cut, c
                chain = {"first": base["first"] if base else start, "end": start + n, "at": at + n, "covered": best}
                open_[t] = [*near, chain]
                done.append((t, chain["first"], chain["end"] - 1, best / self.sizes[t]))
        done.sort(key=lambda x: (x[0], -x[3], x[1]))
        kept: dict[int, list] = {}
        for x in done:
            own = kept.setdefault(x[0], [])
            k = bisect_left(own, x[1:])
            if (k == 0 or own[k - 1][1] < x[1]) and (k == len(own) or own[k][0] > x[2]):
                own.insert(k, x[1:])
        done = [(t, *x) for t, own in kept.items() for x in own]
        return sorted(((self.labels[t], a, b, s) for t, a, b, s in done), key=lambda x: (-x[3], x[1], x[0]))


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label: string, first_word: bigint, last_word: bigint, covered: double>>"


def scanner(templates=None, base=None):
    def run(batches):
        import pyarrow as pa

        s = Scanner(templates, base)
        span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())]))
        for batch in slices(batches):
            rows = []
            for _, hashes, bounds in s.hasher.documents(texts_of(batch)):
                tokens = s.vocabulary.tokens(hashes)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    r = s.scan(tokens[a:b])
                    good = [x for x in r["spans"] if x[3] >= COVER]
                    rows.append((b - a, r["n_base"], r["first_word"], r["last_word"], ",".join(sorted(r["base"])), ",".join(sorted(r["base"] | {x[0] for x in good})), r["score"], [dict(zip(("label", "first_word", "last_word", "covered"), x, strict=True)) for x in good]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, base=None) -> DataFrame:
    """One row per document, with the spans that the chains cover."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scanner(templates, base), SCHEMA)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
