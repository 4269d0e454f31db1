"""Substring deduplication by level-wise doubling: windows of words that are repeated at one length alone are extended
to twice that length, until no candidates survive.

One level goes from half a window (7 words for 13) to the whole window, and the next one to its double. A window is
represented by the half-window in it that has the least hash, so every window that is repeated has a repeated
representative, and neighbouring windows share theirs: only about a quarter of the positions are shuffled. Windows
whose representative stands in one document alone are out. The rest is extended: first the stretch of all windows that
share a representative is compared as a whole; only where stretches differ (at the ends of a repeat) are their windows
compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketgrid.llm.common import arrow_map, stage

WINDOW = 13
WORDS_KEPT = 200_000
BLOCK = 1 << 17
LAST = (1 << 63) - 1


def split(text: str | None) -> list[bytes]:
    """Words: runs of anything but blank and the white space from tab to carriage return."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit factors."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def spans_hash(x: np.ndarray, start: np.ndarray | int, length: int, seed: int) -> np.ndarray:
    """Hash of the `length` word numbers from each start; from the first `start` places, if that is a number."""
    n = start if isinstance(start, int) else len(start)
    h = np.full(n, np.uint64(length))
    for j, c in enumerate(constants(length, seed)):
        h += (x[j:j + n] if isinstance(start, int) else x[start + j]) * c
    return mix(h)


class Numbers:
    """64-bit hash of every word of a text; words seen before are looked up."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_NUMBERS: list[Numbers] = []


def numbers(words: list[bytes]) -> np.ndarray:
    if not _NUMBERS:
        _NUMBERS.append(Numbers())
    return _NUMBERS[0](words)


def stretches(x: np.ndarray, window: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(representative, stretch hash, first window, last window) of the runs of windows that share a representative.

    `starts` restricts the windows to these positions (ascending); a run never leaps over a position left out.
    """
    half = (window + 1) // 2
    inside = window - half + 1
    if len(x) < window or starts is not None and not len(starts):
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty
    grams = spans_hash(x, len(x) - half + 1, half, 1)
    # the first of the least half-windows in each window
    n = len(x) - window + 1
    least, pick = grams[:n].copy(), np.arange(n)
    for k in range(1, inside):
        lower = grams[k:k + n] < least
        np.copyto(least, grams[k:k + n], where=lower)
        pick[lower] = np.flatnonzero(lower) + k
    p = np.arange(len(pick)) if starts is None else starts
    q = pick[p]
    new = np.flatnonzero((np.diff(q, prepend=-1) != 0) | (np.diff(p, prepend=-2) != 1))
    first, last = p[new], p[np.append(new[1:], len(p)) - 1]
    whole = np.empty(len(new), np.uint64)
    length = last - first + window
    for n in np.unique(length):
        those = length == n
        whole[those] = spans_hash(x, first[those], int(n), 2) + (q[new][those] - first[those]).astype(np.uint64)
    return grams[q[new]].view(np.int64), mix(whole).view(np.int64), first, last


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, ord (the id; null comes last) and key, which tells rows of one id apart where ids repeat."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeats = not rows.groupBy("doc_id").count().filter("count > 1").isEmpty()
    return rows.withColumns({"ord": F.coalesce("doc_id", F.lit(LAST)),
                             "key": F.xxhash64("text") if repeats else F.lit(0).cast("long")})


def _packed(rows: DataFrame) -> DataFrame:
    """The texts compressed, for joins that shuffle them."""
    def each(columns: list[list]) -> list[list]:
        press = zstandard.ZstdCompressor(level=1)
        return [*columns[:3], [None if t is None else press.compress(t.encode("utf-8", "surrogatepass")) for t in columns[3]]]

    return arrow_map(rows.select("doc_id", "ord", "key", "text"), "doc_id long, ord long, key long, packed binary", each)


def _unpack(packed: bytes | None) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split() if packed else []


def _positions(starts: list[int] | None, runs: list[int] | None, window: int) -> np.ndarray:
    """Ascending positions of single windows and of runs coded as first * window + (last - first)."""
    coded = np.array(runs or [], np.int64)
    sizes = coded % window + 1
    spread = np.repeat(coded // window, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = [np.array(starts or [], np.int64), spread]
    return np.unique(np.concatenate(out))


def repeated_windows(
    rows: DataFrame, window: int, within: DataFrame | None = None, half_only: int = 0, first_too: bool = False,
) -> DataFrame:
    """(ord, key, runs, starts): per row the windows whose words also start in a row with a smaller ord.

    With `first_too`, the windows of the smallest ord that stand in another row as well are listed like the others.

    `rows` come from _keyed. runs are coded as first * window + (last - first), starts are single windows. `within`,
    (ord, key, starts, runs) of windows of `half_only` words, restricts the windows to those whose two halves are
    listed there.
    """
    if within is None:
        def each(columns: list[list]) -> list[list]:
            rows = enumerate(zip(*columns))
            return _runs((((ord_, key, k), split(text)) for k, (ord_, key, text) in rows), window)

        found = arrow_map(rows.select("ord", "key", "text"), RUNS, each)
    else:
        def each(columns: list[list]) -> list[list]:
            lists = (_positions(s, r, half_only) for s, r in zip(columns[3], columns[4]))
            chosen = [np.intersect1d(p, p - (window - half_only)) for p in lists]
            rows = enumerate(zip(*columns[:3]))
            return _runs((((ord_, key, k), _unpack(packed)) for k, (ord_, key, packed) in rows), window, chosen)

        joined = _packed(rows).join(within, ["ord", "key"])
        found = arrow_map(joined.select("ord", "key", "packed", "starts", "runs"), RUNS, each)
    by_half, by_stretch = W.partitionBy("half", "settled"), W.partitionBy("half", "settled", "stretch")
    hits = found.withColumns({"least": F.min("ord").over(by_half), "most": F.max("far").over(by_half)})
    hits = hits.filter("settled or least < most").withColumns(
        {"same": F.min("ord").over(by_stretch), "last": F.max("far").over(by_stretch)})
    hits = hits.withColumn("top", F.max("same").over(by_half))
    # a stretch that an earlier row has as well is settled; the first row of each stretch is compared window by window
    # where another stretch with this representative starts in a different row
    sure = F.col("settled") | (F.col("same") < F.col("last" if first_too else "ord"))
    unclear = ~F.col("settled") & (F.col("same") == F.col("ord")) & (F.col("top") > F.col("least"))
    hits = hits.select("ord", "key", "run", sure.alias("sure"), unclear.alias("unclear")).filter("sure or unclear")
    hits = stage(hits, "hits")
    open_runs = hits.filter("unclear").groupBy("ord", "key").agg(F.collect_list("run").alias("runs"))

    def single(columns: list[list]) -> list[list]:
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(5)]
        documents = (((ord_, key, runs), _unpack(packed)) for ord_, key, packed, runs in zip(*columns))
        for found, x, offsets in _blocks(documents):
            lists = [_positions(None, runs, window) for _, _, runs in found]
            sizes = [len(p) for p in lists]
            p = np.concatenate([p + a for p, a in zip(lists, offsets)])
            ids = np.repeat(np.array([(o, k) for o, k, _ in found], np.int64).reshape(-1, 2), sizes, axis=0)
            ends = spans_hash(x, p, window, 3).view(np.int64), spans_hash(mix(x), p, window, 4).view(np.int64)
            for column, value in zip(out, (ids[:, 0], ids[:, 1], np.concatenate(lists), *ends)):
                column.append(value)
        return [np.concatenate(c) for c in out]

    joined = _packed(rows).join(open_runs, ["ord", "key"])
    windows = arrow_map(joined.select("ord", "key", "packed", "runs"), "ord long, key long, at long, a long, b long", single)
    same_words = W.partitionBy("a", "b")
    later = windows.withColumns({"least": F.min("ord").over(same_words), "most": F.max("ord").over(same_words)}).filter(
        "least < most" if first_too else "least < ord")
    none = F.lit(None).cast("long")
    both = hits.filter("sure").select("ord", "key", "run", none.alias("at")).unionByName(
        later.select("ord", "key", none.alias("run"), "at"))
    return both.groupBy("ord", "key").agg(F.collect_list("run").alias("runs"), F.collect_list("at").alias("starts"))


RUNS = "half long, stretch long, ord long, key long, run long, far long, settled boolean"


def _blocks(documents) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(rows, word numbers, offsets) of stretches of documents with about BLOCK words; `documents` yields (row, words)."""
    rows, words, offsets = [], [], [0]
    for row, own in documents:
        rows.append(row)
        words += own
        offsets.append(len(words))
        if len(words) >= BLOCK:
            yield rows, numbers(words), np.array(offsets)
            rows, words, offsets = [], [], [0]
    if rows:
        yield rows, numbers(words), np.array(offsets)


def _runs(documents, window: int, chosen=None) -> list[list]:
    """Columns of RUNS for documents ((ord, key, number), words); `chosen` gives the windows of a row, all if it is None.

    A stretch that a row with a smaller ord holds in the same block of documents is settled at once: it goes under a
    half of its own, so a passage that very many documents share sends one row per block to the task of its half. far
    is the largest ord of the block that holds the stretch.
    """
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(6)] + [[np.empty(0, bool)]]
    for rows, x, offsets in _blocks(documents):
        starts = [np.arange(b - a - window + 1) if chosen is None else chosen[k]
                  for k, (a, b) in zip((r[2] for r in rows), zip(offsets, offsets[1:]))]
        places = np.concatenate([s[s >= 0] + a for s, a in zip(starts, offsets)])
        half, whole, first, last = stretches(x, window, places)
        owner = np.searchsorted(offsets, first, side="right") - 1
        ids = np.array([(o, k) for o, k, _ in rows], np.int64).reshape(-1, 2)
        ord_, key, run = ids[owner, 0], ids[owner, 1], (first - offsets[owner]) * window + (last - first)
        order = np.lexsort((ord_, whole, half))
        new = (np.diff(half[order], prepend=0) != 0) | (np.diff(whole[order], prepend=0) != 0)
        new[:1] = True
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(order)))
        least, far = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        least[order], far[order] = np.repeat(ord_[order][begin], size), np.repeat(ord_[order][begin + size - 1], size)
        settled = ord_ > least
        spread = mix(mix(ord_.view(np.uint64)) + run.view(np.uint64)).view(np.int64)
        for column, value in zip(out, (np.where(settled, spread, half), whole, ord_, key, run, far, settled)):
            column.append(value)
    return [np.concatenate(c) for c in out]


def levels(docs: DataFrame, window: int = WINDOW) -> list[tuple[int, DataFrame]]:
    """(length, windows that stand in two documents or more) for `window`, its double and so on, until none is left.

    Only windows whose two halves are repeated are extended. Windows are listed as by `repeated_windows`.
    """
    rows, out, length, within = _keyed(docs), [], window, None
    while True:
        found = stage(repeated_windows(rows, length, within, length // 2, first_too=True), "level")
        if found.isEmpty():
            return out
        out.append((length, found))
        within, length = found, 2 * length


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row per document row.

    A word goes if a window of `window` words covers it that also starts in a document with a smaller doc_id; windows
    are judged on the input. Null texts have no words; texts shorter than a window lose none. Rows that share an id
    don't take words from each other. A null id counts as larger than all others. An empty table gives no rows;
    further columns are ignored.
    """
    def each(columns: list[list]) -> list[list]:
        out: list[list] = [[], [], [], []]
        for doc_id, packed, runs, starts in zip(*columns):
            words = _unpack(packed)
            gone = np.zeros(len(words) + 1, np.int64)
            p = _positions(starts, runs, window)
            np.add.at(gone, p, 1)
            np.add.at(gone, p + window, -1)
            keep = np.cumsum(gone)[:-1] == 0
            kept = [w for w, k in zip(words, keep) if k] if len(p) else words
            values = doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()
            for column, value in zip(out, values):
                column.append(value)
        return out

    rows = _keyed(docs)
    found = repeated_windows(rows, window)
    joined = _packed(rows).join(found, ["ord", "key"], "left")
    return arrow_map(joined.select("doc_id", "packed", "runs", "starts"),
                     "doc_id long, n_words long, n_removed long, kept_sha256 string", each)
