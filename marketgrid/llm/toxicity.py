"""Toxicity by a factorization machine over hashed terms.

Terms are lower-case words and their prefixes of four and five letters, hashed into TERMS buckets. The machine learns
a weight for a term and a product of factors for a pair of terms that stand in one document, so a pair can count more
(or less) than its two words do.
"""

from __future__ import annotations

import io
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrid.llm.common import arrow_filter, arrow_map, fit_in_one_task, fold, labelled_sample

TERMS = 1 << 18
FACTORS = 8
#: Labelled training rows used of either class, at most; terms kept for the machine, at most.
PER_CLASS = 8_000
SELECTED = 8_192
THRESHOLD = 0.5
WORD = re.compile(r"\w+")
CACHE = 300_000


def word_terms(word: str) -> set[int]:
    """Buckets of one word."""
    forms = {word, "4" + word[:4], "5" + word[:5]} if len(word) > 3 else {word}
    return {zlib.crc32(x.encode("utf-8", "surrogatepass")) % TERMS for x in forms}


def text_terms(text: str | None) -> np.ndarray:
    """Distinct buckets of a whole text, ascending."""
    found: set[int] = set()
    for word in set(WORD.findall((text or "").lower())):
        found |= word_terms(word)
    return np.array(sorted(found), np.int32)


def select_terms(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Terms that stand in five sample rows or more and whose share differs most between the classes."""
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    each = [np.bincount(np.concatenate([r for r, v in zip(rows, y) if v == k] or [np.empty(0, np.int32)]),
                        minlength=TERMS) for k in (0, 1)]
    share = (each[0] + each[1] + 1.0) / (n0 + n1 + 2.0)
    z = (each[1] / n1 - each[0] / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    z[each[0] + each[1] < 5] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:SELECTED]
    return np.sort(best[np.abs(z[best]) >= 3.0])


class Machine:
    """w0 + sum of w + sum over pairs of <v_i, v_j>, through a sigmoid; inputs are 0/1."""

    def __init__(self, terms: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.terms, self.w0, self.w, self.v = terms, w0, w, v
        self.place = np.full(TERMS, -1, np.int32)
        self.place[terms] = np.arange(len(terms))

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, terms=self.terms, w0=self.w0, w=self.w, v=self.v)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Machine:
        x = np.load(io.BytesIO(data))
        return cls(x["terms"], float(x["w0"]), x["w"], x["v"])

    def score_index(self, at: np.ndarray) -> float:
        s = self.v[at].sum(axis=0)
        pairs = 0.5 * float((s * s).sum() - (self.v[at] ** 2).sum())
        return float(1 / (1 + np.exp(-np.clip(self.w0 + self.w[at].sum() + pairs, -30, 30))))

    def score(self, text: str | None) -> float:
        at = self.place[text_terms(text)]
        return self.score_index(at[at >= 0])

    def scorer(self):
        """A function of texts that looks each known word up once."""
        known: dict[str, tuple[int, ...]] = {}

        def places(word: str) -> tuple[int, ...]:
            if len(known) >= CACHE:
                known.clear()
            known[word] = got = tuple(int(p) for p in self.place[list(word_terms(word))] if p >= 0)
            return got

        def score(text: str | None) -> float:
            found: set[int] = set()
            for word in set(WORD.findall((text or "").lower())):
                got = known.get(word)
                found.update(places(word) if got is None else got)
            return self.score_index(np.array(sorted(found), np.int64))

        return score


def train(labels: list[int], features: list[bytes], sizes: dict[int, int], epochs: int = 20, batch: int = 256) -> Machine:
    """Weighted logistic loss by Adagrad; row weights restore the class shares of all labelled rows."""
    y = np.array(labels, np.float64)
    rows = [np.frombuffer(f, "<i4") for f in features]
    if len(set(labels)) < 2:
        w0 = 30.0 if labels and labels[0] else -30.0
        return Machine(np.empty(0, np.int64), w0, np.empty(0), np.empty((0, FACTORS)))
    terms = select_terms(rows, y)
    place = np.full(TERMS, -1, np.int64)
    place[terms] = np.arange(len(terms))
    rows = [p[p >= 0] for p in (place[r] for r in rows)]
    have = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    total = sum(sizes.values())
    weight = np.where(y == 1, sizes[1] / total / have[1], sizes[0] / total / have[0]) * len(y)
    rng = np.random.default_rng(7)
    w, v, w0 = np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), FACTORS)), 0.0
    gw, gv, g0, rate = np.full(len(terms), 1e-6), np.full(v.shape, 1e-6), 1e-6, 0.1
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            index = np.concatenate([rows[i] for i in pick])
            owner = np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick])
            vi = v[index]
            s = np.zeros((len(pick), FACTORS))
            np.add.at(s, owner, vi)
            square = np.bincount(owner, (vi * vi).sum(axis=1), len(pick))
            margin = w0 + np.bincount(owner, w[index], len(pick)) + 0.5 * ((s * s).sum(axis=1) - square)
            p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            d = (p - y[pick]) * weight[pick] / len(pick)
            used, where = np.unique(index, return_inverse=True)
            dw = np.bincount(where, d[owner], len(used)) + 1e-5 * w[used]
            dv = np.zeros((len(used), FACTORS))
            np.add.at(dv, where, d[owner, None] * (s[owner] - vi))
            dv += 1e-4 * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += d.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.5 * rate * dv / np.sqrt(gv[used])
            w0 -= rate * d.sum() / np.sqrt(g0)
    return Machine(terms, float(w0), w, v)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine:
    """Train on a bounded sample of the labelled rows outside fold 0 of 5, in one task."""
    sample, sizes = labelled_sample(docs, labels, "toxic", per_class)

    def each(columns: list[list]) -> list[list]:
        ids, marks, texts = columns
        return [ids, marks, [text_terms(t).tobytes() for t in texts]]

    rows = arrow_map(sample, "doc_id long, label int, features binary", each)
    return Machine.unpack(fit_in_one_task(rows, lambda y, x: train(y, x, sizes).pack()))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out (fold 0 of 5), score, predicted (score >= 0.5), one row per document row.

    Null and empty texts get the score of a text without terms. Rows with null ids and repeated rows stay; an empty
    table gives no rows. Without labels of both classes the score is near 0, or near 1 where only toxic ones are known.
    Source, language, id and other columns are never inputs.
    """
    model = fit(docs, labels, per_class).pack()

    def each(columns: list[list]) -> list[list]:
        ids, held, texts = columns
        score = _scorer(model)
        got = [score(t) for t in texts]
        return [ids, held, got, [int(s >= THRESHOLD) for s in got]]

    rows = docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return arrow_map(rows, "doc_id long, held_out boolean, score double, predicted int", each)


_SCORERS: dict[bytes, object] = {}


def _scorer(model: bytes):
    """One scorer for all batches of a task."""
    if model not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model] = Machine.unpack(model).scorer()
    return _SCORERS[model]


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents whose score is below 0.5, columns as they are."""
    model = fit(docs, labels, per_class).pack()
    return arrow_filter(docs, "text", lambda texts: [s < THRESHOLD for s in map(_scorer(model), texts)])
