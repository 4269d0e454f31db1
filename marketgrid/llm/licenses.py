"""License scans: winnowed fingerprints of license templates in an inverted index pick candidates, and a banded
alignment of the template with the text around them reports matched coverage and spans.

How densely a template is winnowed, and how many words a fingerprint has, follow from its length and the coverage that
counts: a text in which words of the template are missing or changed keeps a run of unchanged ones, and every run of
that length holds a fingerprint of the index. Short templates keep all their fingerprints, the shortest those of two words.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrid.llm.common import arrow_map

#: Words of a fingerprint, and neighbouring fingerprints of which the least is kept in the index, at most.
GRAM, WINNOW = 3, 3
#: Words that text and template may be shifted against each other inside one match.
BAND = 8
COVERAGE = 0.8
#: Words of the text inside a match that the template doesn't have there, as a share of the template's words, at most.
STRAY = 0.5
WORD = re.compile(r"\w+")

# Short public license notices, as they stand at the head of files and documents.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at"),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
}


def words(text: str | None) -> list[str]:
    return [w.lower() for w in WORD.findall(text or "")]


def density(size: int, least: float) -> tuple[int, int]:
    """(words of a fingerprint, winnowing window) for a template of `size` words.

    Where `need` of its words are matched in order, the others cut them into size - need + 1 runs at most; the longest
    has at least the even share, and a run of gram + window - 1 words always holds a winnowed fingerprint.
    """
    need = max(1, math.ceil(least * size - 1e-9))
    run = -(-need // (size - need + 1))
    gram = min(GRAM, run)
    return gram, min(WINNOW, run - gram + 1)


def fingerprints(found: list[str], gram: int = GRAM) -> list[int]:
    """A hash for each run of `gram` words (of all words, if there are fewer)."""
    if not found:
        return []
    n = max(1, len(found) - gram + 1)
    return [xxhash.xxh64_intdigest(" ".join(found[k:k + gram]).encode("utf-8", "surrogatepass")) for k in range(n)]


def winnow(hashes: list[int], window: int = WINNOW) -> list[tuple[int, int]]:
    """(place, hash) of the least of every `window` neighbouring hashes, the last one among equals."""
    kept = set()
    for k in range(max(1, len(hashes) - window + 1)):
        part = hashes[k:k + window]
        least = min(part)
        kept.add((k + max(j for j, h in enumerate(part) if h == least), least))
    return sorted(kept)


@dataclass
class Index:
    names: list[str]
    templates: list[list[str]]
    postings: dict[int, list[tuple[int, int]]]
    vocabulary: dict[str, int]
    grams: frozenset
    words: list[Counter]
    #: Places of each template whose fingerprint stands there only (all its places, where none is so).
    once: list[frozenset]

    @classmethod
    def build(cls, templates: dict[str, str], least: float = COVERAGE) -> Index:
        """An index that loses no match of coverage `least` in which the template's words are changed or left out."""
        names = sorted(n for n in templates if words(templates[n]))
        texts = [words(templates[n]) for n in names]
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        grams, once = set(), []
        for k, text in enumerate(texts):
            gram, window = density(len(text), least)
            kept = winnow(fingerprints(text, gram), window)
            for place, h in kept:
                postings[h].append((k, place))
                grams.add(tuple(text[place:place + gram]))
            often = Counter(h for _, h in kept)
            once.append(frozenset(p for p, h in kept if often[h] == 1) or frozenset(p for p, _ in kept))
        vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for g in grams for w in g}))}
        return cls(names, texts, dict(postings), vocabulary, frozenset(grams), [Counter(t) for t in texts], once)

    def candidates(self, found: list[str]) -> dict[tuple[int, int], list[int]]:
        """(template, number of a run) -> shifts of text against template at which fingerprints meet.

        Neighbouring shifts are a run as long as no place of the template comes twice: a second notice starts there.
        """
        sizes = sorted({len(g) for g in self.grams})
        if not sizes or len(found) < sizes[0]:
            return {}
        known = np.fromiter((w in self.vocabulary for w in found), bool, len(found))
        hits: dict[int, set[tuple[int, int]]] = defaultdict(set)
        runs = known.copy()
        for j in range(1, sizes[0]):
            runs[:-j] &= known[j:]
            runs[-j:] = False
        for at in np.flatnonzero(runs).tolist():
            for size in sizes:
                gram = tuple(found[at:at + size])
                if gram in self.grams:
                    h = xxhash.xxh64_intdigest(" ".join(gram).encode("utf-8", "surrogatepass"))
                    for template, place in self.postings.get(h, ()):
                        hits[template].add((at - place, place))
        out: dict[tuple[int, int], list[int]] = {}
        for template, pairs in hits.items():
            runs_so_far, seen, last = 0, set(), None
            once = self.once[template]
            for shift, place in sorted(pairs):
                if last is not None and (shift - last > BAND or place in seen):
                    runs_so_far += 1
                    seen = set()
                if place in once:
                    seen.add(place)
                out.setdefault((template, runs_so_far), []).append(shift)
                last = shift
        return out

    def matches(self, text: str | None, least: float = COVERAGE) -> list[tuple[str, float, int, int]]:
        """(license, coverage, start, end) of matches, in code points; a weaker match inside another one is left out.

        The best match is taken first; runs that it touches are aligned again with the words that are left.
        """
        found = words(text)
        left: list[str | None] = list(found)
        waiting: list[tuple] = []
        tried: set[tuple[int, int, int]] = set()

        def add(template: int, low: int, high: int, start: int, stop: int) -> None:
            """Align with each stretch of words from `start` to `stop` that no reported span interrupts."""
            own = self.templates[template]
            need, vocabulary = least * len(own), self.words[template]
            while start < stop:
                end = start
                while end < stop and left[end] is not None:
                    end += 1
                part = left[start:end]
                if part and sum(min(n, vocabulary[w]) for w, n in Counter(part).items() if w in vocabulary) >= need:
                    covered, first, last = align(own, part, low - start, high - start)
                    if covered and covered >= need and last - first + 1 - covered > STRAY * len(own):
                        # too scattered: a closer match may lie on either side
                        for cut in ((start + first + 1, end), (start, start + last)):
                            if (template, *cut) not in tried:
                                tried.add((template, *cut))
                                add(template, low, high, *cut)
                    elif covered and covered >= need:
                        heapq.heappush(waiting, (
                            -covered, -covered / len(own), start + first, self.names[template], start + last, template,
                            low, high, start, end))
                start = end + 1

        for (template, _), shifts in self.candidates(found).items() if found else ():
            low, high = min(shifts) - BAND, max(shifts) + BAND
            add(template, low, high, max(0, low), min(len(found), high + len(self.templates[template])))
        kept = []
        while waiting:
            _, share, first, name, last, *rest = heapq.heappop(waiting)
            if all(left[k] is not None for k in range(first, last + 1)):
                kept.append((name, -share, first, last))
                left[first:last + 1] = [None] * (last + 1 - first)
            add(*rest)
        if not kept:
            return []
        places = [m.span() for m in WORD.finditer(text)]
        return [(name, share, places[first][0], places[last][1]) for name, share, first, last in sorted(kept, key=lambda m: m[2])]


def align(template: list[str], text: list[str | None], low: int, high: int) -> tuple[int, int, int]:
    """(matched words, first, last word of the text) of the best alignment whose shift stays within [low, high].

    Longest common subsequence on the band of the dynamic programme; among equals the one that starts last.
    """
    width = high - low + 1
    # cell j of row i: template[:i] against text up to place i + low + j; (matches, start)
    count = np.zeros(width, np.int64)
    start = np.full(width, -1, np.int64)
    end = np.full(width, -1, np.int64)
    n = len(text)
    for i, word in enumerate(template):
        new, begin, stop = count.copy(), start.copy(), end.copy()
        # from the row above, the same text place is one cell further right
        new[:-1], begin[:-1], stop[:-1] = count[1:], start[1:], end[1:]
        new[-1], begin[-1], stop[-1] = 0, -1, -1
        for j in range(width):
            at = i + low + j
            if 0 <= at < n and text[at] == word:
                value = count[j] + 1
                if value > new[j] or value == new[j] and (start[j] if count[j] else at) > begin[j]:
                    new[j], begin[j], stop[j] = value, (start[j] if count[j] else at), at
            if j and new[j - 1] >= new[j]:
                if new[j - 1] > new[j] or begin[j - 1] > begin[j]:
                    new[j], begin[j], stop[j] = new[j - 1], begin[j - 1], stop[j - 1]
        count, start, end = new, begin, stop
    best = max(range(width), key=lambda j: (count[j], start[j], -end[j]))
    return int(count[best]), int(start[best]), int(end[best])


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, start, end (code points, end exclusive), one row per match.

    coverage is the share of the template's words in the alignment; matches below `least` are left out, as are those with
    strange words of more than half the template's number inside, and of matches that overlap only the one with most
    words stays. Null and empty texts match nothing; rows with null ids and
    repeated rows are scanned like any other; an empty table gives no rows; further columns are ignored.
    """
    index = Index.build(TEMPLATES if templates is None else templates, least)

    def each(columns: list[list]) -> list[list]:
        out: list[list] = [[] for _ in range(5)]
        for doc_id, text in zip(*columns):
            for match in index.matches(text, least):
                for column, value in zip(out, (doc_id, *match)):
                    column.append(value)
        return out

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"),
                     "doc_id long, license string, coverage double, start long, `end` long", each)
