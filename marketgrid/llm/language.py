"""Language identification by multilingual mixture inference.

A language is a distribution over hashed letter trigrams, counted over all training documents. A document is taken as
a mixture of languages: expectation-maximisation estimates the proportions, and languages are dropped from the
mixture as long as the penalised likelihood gains by it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrid.llm.common import arrow_map, fold, slices

BUCKETS = 1 << 16
ROUNDS = 12
UNKNOWN = "und"
ASTRAL_LETTER = 0xFFFF
#: Trigrams times languages that are worked on at a time.
BLOCK = 1 << 22
#: Neighbouring trigrams share letters, so a document holds about a third as many independent observations.
INDEPENDENT = 1 / 3
SMOOTHING = 0.5


def letter_table() -> np.ndarray:
    """Code point -> lower-case code point of a letter (first one), or a space; one entry for all astral letters."""
    table = np.full(0x10000, 32, np.uint32)
    for code in range(0x10000):
        if unicodedata.category(chr(code))[0] == "L":
            table[code] = ord(chr(code).lower()[0])
    return table


_TABLE: list[np.ndarray] = []


def letters(text: str | None) -> np.ndarray:
    """Lower-case letters of a text; each stretch of anything else is one space."""
    if not _TABLE:
        _TABLE.append(letter_table())
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _TABLE[0][np.minimum(raw, 0xFFFF)]
    for at in np.flatnonzero(raw > 0xFFFF):
        codes[at] = ASTRAL_LETTER if unicodedata.category(chr(raw[at]))[0] == "L" else 32
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]])
    space = codes == 32
    return codes[~(space & np.concatenate([[False], space[:-1]]))]


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the trigrams of the letters, blanks at word ends included; empty without letters."""
    c = letters(text).astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, np.int64)
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)


def counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of `docs` (lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if lang not in total:
                        total[lang] = np.zeros(BUCKETS, np.int64)
                    found = trigrams(text)
                    if len(found):
                        total[lang] += np.bincount(found, minlength=BUCKETS)
        for lang, n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(n[used])],
                ["lang", "bucket", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Language names and BUCKETS x languages log probabilities, from rows outside fold 2 of 4 with a language.

    The table has BUCKETS rows and a column for each language, whatever the corpus holds.
    """
    known = docs.filter(F.col("lang").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
    table = counts(known).toArrow()
    lang, bucket, n = (table[c].to_numpy(zero_copy_only=False) for c in ("lang", "bucket", "n"))
    names = sorted(set(lang))
    out = np.full((BUCKETS, len(names)), SMOOTHING)
    place = {name: k for k, name in enumerate(names)}
    if len(lang):
        np.add.at(out, (bucket, np.array([place[x] for x in lang])), n)
    return names, np.log(out / out.sum(axis=0)).astype(np.float32)


def mixtures(docs: list[np.ndarray], log_p: np.ndarray) -> np.ndarray:
    """Documents x languages: proportions, zero outside the selected set, which starts as all languages; `docs` hold trigram buckets, none empty."""
    unique = [np.unique(d, return_counts=True) for d in docs]
    sizes = np.array([len(u) for u, _ in unique])
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(docs)), sizes)
    n = np.concatenate([c for _, c in unique]).astype(np.float64)
    rows = log_p[np.concatenate([u for u, _ in unique])].astype(np.float64)
    total = np.add.reduceat(n, start)
    p = np.exp(rows)
    active = np.ones((len(docs), log_p.shape[1]), bool)
    observations = np.maximum(total * INDEPENDENT, 2)

    def estimate(active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = active / active.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            joint = share[owner] * p
            joint *= (n / joint.sum(axis=1))[:, None]
            share = np.add.reduceat(joint, start, axis=0) / total[:, None]
        fit = np.add.reduceat(n * np.log((share[owner] * p).sum(axis=1)), start) * INDEPENDENT
        return share, fit - 0.5 * active.sum(axis=1) * np.log(observations)

    share, worth = estimate(active)
    going = np.ones(len(docs), bool)
    for _ in range(log_p.shape[1] - 1):
        least = np.where(active, share, 2).argmin(axis=1)
        fewer = active.copy()
        fewer[np.arange(len(docs))[going], least[going]] = False
        less, value = estimate(fewer)
        going &= value >= worth
        share, worth = np.where(going[:, None], less, share), np.where(going, value, worth)
        active = np.where(going[:, None], fewer, active)
        if not going.any():
            break
    return np.where(active, share, 0)


def predict(texts: list[str | None], names: list[str], log_p: np.ndarray) -> list[tuple[str, float, str]]:
    """(language, proportion, all languages with proportions) of each text."""
    out: list[tuple[str, float, str]] = [(UNKNOWN, 0.0, "")] * len(texts)
    waiting: list[tuple[int, np.ndarray]] = []

    def settle() -> None:
        for (k, _), share in zip(waiting, mixtures([w for _, w in waiting], log_p)):
            order = np.argsort(-share, kind="stable")
            listed = ",".join(f"{names[j]}:{share[j]:.3f}" for j in order if share[j] > 0)
            out[k] = (names[order[0]], float(min(1.0, share[order[0]])), listed)
        waiting.clear()

    size = 0
    for k, text in enumerate(texts):
        found = trigrams(text) if names else ()
        if len(found):
            waiting.append((k, found))
            size += len(found)
        if size * len(names) >= BLOCK:
            settle()
            size = 0
    if waiting:
        settle()
    return out


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out (fold 2 of 4), lang_pred, score, mixture, one row per document row.

    lang_pred is the language with the largest proportion, score that proportion; mixture lists all selected ones. A
    null text or one without a letter gives `und`, 0 and an empty list, and so does every text where no language
    could be learned. Equal proportions go to the name that sorts first. Rows with null ids or languages and repeated
    rows stay; an empty table gives no rows. The table's own lang is used to learn only, source and id never.
    """
    names, log_p = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(log_p)

    def each(columns: list[list]) -> list[list]:
        ids, held, texts = columns
        got = predict(texts, names, shared.value)
        return [ids, held, *map(list, zip(*got))]

    rows = docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return arrow_map(rows, "doc_id long, held_out boolean, lang_pred string, score double, mixture string", each)
