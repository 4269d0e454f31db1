"""Benchmark decontamination: a BM25 inverted index of the test items, searched by block-max WAND with every training
passage as the query; what is retrieved above the threshold is verified by question and answer overlap.

Passages are windows of words so long and so close that every item lies whole in one of them. Scores are divided by
the score of the item against itself, so the threshold means the same for every item.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrid.llm.common import arrow_filter, arrow_map, stage

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach to be retrieved.
RETRIEVE = 0.6
#: Share of the word pairs of question and of answer that a passage must hold.
OVERLAP = 0.8
#: Items in one index, about; a larger benchmark is searched index by index.
ITEMS_PER_INDEX = 20_000
BLOCK_ITEMS = 4
#: (passage, block) cells that are bounded at a time.
CELLS = 1 << 20
WORD = re.compile(r"\w+")
ANSWER = re.compile(r"(?i)\banswer\s*:|(?m:^a:)")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Words before and after an answer mark; else the last sentence is the answer; else the last third of the words."""
    text = text or ""
    mark = ANSWER.search(text)
    if mark and words(text[:mark.start()]) and words(text[mark.end():]):
        return words(text[:mark.start()]), words(text[mark.end():])
    parts = [w for w in map(words, SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    every = parts[0] if parts else []
    at = len(every) - len(every) // 3
    return every[:at], every[at:]


def overlap(part: list[str], pairs: set[tuple[str, str]], single: set[str]) -> float:
    """Share of the neighbouring word pairs of `part` (of its words, if it has one) that the passage holds."""
    if len(part) < 2:
        return float(all(w in single for w in part))
    return sum(p in pairs for p in zip(part, part[1:])) / (len(part) - 1)


@dataclass
class Index:
    """Flat arrays: postings of term t are [first[t], first[t + 1]), by item; impacts are shares of the item's score."""

    terms: dict[str, int]
    first: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    most: np.ndarray            # term -> largest impact
    block_first: np.ndarray     # term -> its blocks in the next two
    block: np.ndarray
    block_most: np.ndarray
    ids: list[int | None]
    parts: list[tuple[list[str], list[str]]]
    longest: int

    @cached_property
    def lists(self) -> tuple[list, ...]:
        """Arrays as lists: single values are read much faster from these."""
        return tuple(x.tolist() for x in (self.item, self.impact, self.block, self.block_most))

    @property
    def blocks(self) -> int:
        return len(self.ids) // BLOCK_ITEMS + 1

    @classmethod
    def build(cls, postings: list[tuple[int, str, float]], items: list[tuple[int | None, str]]) -> Index:
        names = sorted({t for _, t, _ in postings})
        terms = {t: k for k, t in enumerate(names)}
        item = np.array([i for i, _, _ in postings], np.int64)
        term = np.array([terms[t] for _, t, _ in postings], np.int64)
        impact = np.array([w for _, _, w in postings], np.float64)
        impact = impact / np.maximum(np.bincount(item, impact, len(items)), 1e-12)[item] if len(item) else impact
        order = np.lexsort((item, term))
        item, term, impact = item[order], term[order], impact[order]
        first = np.searchsorted(term, np.arange(len(names) + 1))
        most = np.maximum.reduceat(impact, first[:-1]) if len(names) else np.empty(0)
        cell = term * (len(items) // BLOCK_ITEMS + 1) + item // BLOCK_ITEMS
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        block_most = np.maximum.reduceat(impact, starts) if len(starts) else np.empty(0)
        return cls(terms, first, item, impact, most, np.searchsorted(term[starts], np.arange(len(names) + 1)),
                   item[starts] // BLOCK_ITEMS, block_most, [i for i, _ in items],
                   [question_and_answer(t) for _, t in items], max([len(words(t)) for _, t in items], default=0))

    def search(self, query: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items with a score of `threshold` or more, by block-max WAND; `query`: distinct terms."""
        item, impact, block, block_most = self.lists
        # next posting, end, next block, end of blocks, largest impact, next item
        lists = [[int(self.first[t]), int(self.first[t + 1]), int(self.block_first[t]), int(self.block_first[t + 1]),
                  float(self.most[t]), item[self.first[t]]] for t in query.tolist()]
        out, least = [], threshold - 1e-9
        while lists:
            lists.sort(key=itemgetter(5))
            bound, pivot = 0.0, -1
            for k, c in enumerate(lists):
                bound += c[4]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            at = lists[pivot][5]
            while pivot + 1 < len(lists) and lists[pivot + 1][5] == at:
                pivot += 1
            own, reach = at // BLOCK_ITEMS, 0.0
            for c in lists[:pivot + 1]:  # the best that the pivot's block can give
                c[2] = bisect_left(block, own, c[2], c[3])
                if c[2] < c[3] and block[c[2]] == own:
                    reach += block_most[c[2]]
            if reach < least:
                # nothing in this block before the next list starts can reach the threshold
                target = (own + 1) * BLOCK_ITEMS
                if pivot + 1 < len(lists):
                    target = min(target, lists[pivot + 1][5])
                target = max(target, at + 1)
            elif lists[0][5] == at:
                score = sum(impact[c[0]] for c in lists[:pivot + 1])
                if score >= least:
                    out.append((at, score))
                target = at + 1
            else:
                target = at
            ended = False
            for c in lists[:pivot + 1]:
                if c[5] < target:
                    c[0] = bisect_left(item, target, c[0], c[1])
                    if c[0] < c[1]:
                        c[5] = item[c[0]]
                    else:
                        ended = True
            if ended:
                lists = [c for c in lists if c[0] < c[1]]
        return out

    def passages(self, at: np.ndarray, threshold: float) -> list[tuple[int, int, np.ndarray]]:
        """(first word, last word, distinct terms) of the passages for which some block can reach the threshold.

        `at` holds the term of every word, -1 for none. The bound of a block is the sum of its block maxima over the
        passage's terms: what WAND would skip anyway is left out for all passages of a text in one sweep.
        """
        stride, n, terms = self.longest, len(at), len(self.terms)
        count = max(1, -(-n // stride) - 1)
        place = np.flatnonzero(at >= 0)
        half = place // stride
        # a word stands in the passage that starts in its own stride and in the one before
        passage = np.concatenate([half, half - 1])
        term = np.concatenate([at[place], at[place]])
        inside = (passage >= 0) & (passage < count)
        code = np.unique(passage[inside] * terms + term[inside])
        passage, term = code // terms, code % terms
        out, edges = [], np.searchsorted(passage, np.arange(count + 1))
        sizes = self.block_first[1:] - self.block_first[:-1]
        step = max(1, CELLS // self.blocks)
        for low in range(0, count, step):
            high = min(count, low + step)
            p, t = passage[edges[low]:edges[high]] - low, term[edges[low]:edges[high]]
            reps = sizes[t]
            where = np.repeat(self.block_first[t] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
            bound = np.bincount(np.repeat(p, reps) * self.blocks + self.block[where], self.block_most[where],
                                (high - low) * self.blocks).reshape(high - low, self.blocks).max(axis=1)
            for k in np.flatnonzero(bound >= threshold - 1e-9) + low:
                out.append((int(k) * stride, min(n, (int(k) + 2) * stride), term[edges[k]:edges[k + 1]]))
        return out

    def matches(self, text: str | None, threshold: float = RETRIEVE, least: float = OVERLAP) -> list[tuple]:
        """(item_id, score, question overlap, answer overlap, first word, last word) of verified items, best passage each."""
        found = words(text) if self.longest else []
        at = np.fromiter((self.terms.get(w, -1) for w in found), np.int64, len(found))
        best: dict[int, tuple] = {}
        for start, end, query in self.passages(at, threshold) if len(at) else ():
            hits = self.search(query, threshold)
            passage = found[start:end] if hits else []
            pairs, single = set(zip(passage, passage[1:])), set(passage)
            for item, score in hits:
                q, a = (overlap(p, pairs, single) for p in self.parts[item])
                if q >= least and a >= least and (item not in best or score > best[item][1]):
                    best[item] = (self.ids[item], score, q, a, start, end)
        return [best[i] for i in sorted(best)]


def indexes(benchmark: DataFrame, items_per_index: int = ITEMS_PER_INDEX):
    """Yield the indexes of a benchmark (item_id, text): statistics over all items, each index of bounded size.

    Items with equal id and text count once; items without words are in no index.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    parts = max(1, -(-items.count() // items_per_index))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))).withColumn(
        "key", F.xxhash64("item_id", "text"))

    def count_terms(columns: list[list]) -> list[list]:
        out: list[list] = [[], [], [], [], []]
        for part, key, text in zip(*columns):
            found = words(text)
            for term in sorted(set(found)):
                for column, value in zip(out, (part, key, term, found.count(term), len(found))):
                    column.append(value)
        return out

    counted = stage(arrow_map(items.select("part", "key", "text"),
                              "part long, key long, term string, tf int, n int", count_terms), "terms")
    total, mean = counted.select("key", "n").distinct().agg(F.count("*"), F.avg("n")).first()
    frequency = counted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("n") / float(mean or 1))
    weighed = stage(counted.join(frequency, "term").select(
        "part", "key", "term", (idf * F.col("tf") * (K1 + 1) / norm).alias("w")), "postings")
    for part in range(parts):
        own = {r["key"]: (r["item_id"], r["text"]) for r in items.filter(F.col("part") == part).orderBy("key").collect()}
        rows = weighed.filter(F.col("part") == part).select("key", "term", "w").toArrow()
        postings = [(k, t, w) for k, t, w in zip(*(rows[c].to_pylist() for c in ("key", "term", "w")))]
        place = {key: k for k, key in enumerate(_alike_together(postings, list(own)))}
        yield Index.build([(place[k], t, w) for k, t, w in postings], [own[k] for k in place])


def _alike_together(postings: list[tuple[int, str, float]], keys: list[int]) -> list[int]:
    """Item keys so ordered that items with the same frequent terms share blocks, which keeps block maxima low."""
    count = Counter(t for _, t, _ in postings)
    rank = {t: k for k, t in enumerate(sorted(count, key=lambda t: (-count[t], t)))}
    held: dict[int, list[int]] = {k: [] for k in keys}
    for key, term, _ in postings:
        held[key].append(rank[term])
    return sorted(keys, key=lambda k: (sorted(held[k])[:8], k))


def contaminated(docs: DataFrame, benchmark: DataFrame, items_per_index: int = ITEMS_PER_INDEX) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, first_word, last_word (exclusive) of the best passage.

    One row per document row and item that it holds. Null or empty texts and items match nothing; rows with null ids
    and repeated rows are searched like any other; an empty table gives no rows; further columns are ignored.
    """
    out = None
    for index in indexes(benchmark, items_per_index):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def each(columns: list[list], shared=shared) -> list[list]:
            rows: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(*columns):
                for match in shared.value.matches(text):
                    for column, value in zip(rows, (doc_id, *match)):
                        column.append(value)
            return rows

        found = arrow_map(
            docs.select(F.col("doc_id").cast("long"), "text"),
            "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, "
            "first_word int, last_word int", each)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, items_per_index: int = ITEMS_PER_INDEX) -> DataFrame:
    """The documents that hold no benchmark item, columns as they are."""
    for index in indexes(benchmark, items_per_index):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = arrow_filter(docs, "text", lambda texts, s=shared: [not s.value.matches(t) for t in texts])
    return docs
