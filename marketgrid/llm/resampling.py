"""Importance resampling towards a target: documents drawn by how much likelier their words are in the target texts.

Features are runs of one to `longest` words, counted by the bucket crc32(feature) % BUCKETS. The most frequent words
and pairs (the head, of proven size) travel to the workers as tables of finished CRC states; a state is continued with
a blank and the next word, as CRC32 allows. Words and runs outside the head (the tail) take the CRC of their bytes.
Both give the same numbers, so the head changes cost alone. Bucket totals are exact, over all documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from marketgrid.llm.common import fresh, slices, stage

BUCKETS = 10_000
#: Entries of the head, for words and pairs each, and bytes of one entry at most: 12 MB together at the very most.
HEAD, HEAD_BYTES = 65_536, 48
#: Distinct words a worker counts before it hands them on.
HELD = 1 << 18
SEED, LEAST_WORDS, DRAWN_PERCENT = 2024, 20, 10
#: Byte to byte: A-Z become a-z, what belongs to no word becomes a blank; bytes from 0x80 are parts of words.
PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """UTF-8 bytes of the words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()


def texts_of(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for part in slices(batch):
            yield part, part.column(at).to_pylist()


class Hasher:
    """Buckets of features: the head from tables, the tail by CRC."""

    def __init__(self, states: dict[bytes, int], pairs: dict[tuple[bytes, bytes], int], longest: int):
        self.states, self.pairs, self.longest = states, pairs, longest
        self.heads = {w: c % BUCKETS for w, c in states.items()}

    def buckets(self, found: list[bytes]) -> Iterator[int]:
        """Bucket of every feature of a text."""
        heads, crc = self.heads, zlib.crc32
        runs = [(heads[w] if w in heads else crc(w) % BUCKETS for w in found)]
        if self.longest > 1:
            runs.append(self.longer(found))
        return chain(*runs)

    def longer(self, found: list[bytes]) -> Iterator[int]:
        states, pairs, crc = self.states, self.pairs, zlib.crc32
        for k, word in enumerate(found):
            state = None
            for end in range(k + 1, min(k + self.longest, len(found))):
                if end == k + 1 and self.longest == 2 and (word, found[end]) in pairs:
                    yield pairs[word, found[end]]
                    continue
                if state is None:
                    state = states[word] if word in states else crc(word)
                state = crc(found[end], crc(b" ", state))
                yield state % BUCKETS


def count_table(docs: DataFrame, longest: int) -> DataFrame:
    """(feature, n): exact counts of all words, and of all pairs if runs may be longer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.record_batch({"feature": pa.array(list(held), pa.binary()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return made

        for _, texts in texts_of(batches, 0):
            for text in texts:
                found = words(text)
                held.update(w for w in found if len(w) <= HEAD_BYTES)
                if longest > 1:
                    held.update(p for p in (a + b" " + b for a, b in zip(found, found[1:])) if len(p) <= HEAD_BYTES)
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    parts = docs.select("text").mapInArrow(run, "feature binary, n long")
    return parts.groupBy("feature").agg(F.sum("n").alias("n"))


def level(n: Column) -> Column:
    """Counts in falling detail: exact below 1024, then 64 steps for each doubling; at most some 4,500 values."""
    return F.when(n < 1024, n).otherwise(1024 + F.floor(64 * F.log2(n / 1024.0)))


def most_frequent(counts: DataFrame, size: int) -> list[bytes]:
    """The features of the highest levels, as many whole levels as hold at most `size` of them together."""
    levels = counts.groupBy(level(F.col("n")).alias("level")).agg(F.count("*").alias("features")).collect()
    cut, held = None, 0
    for row in sorted(levels, reverse=True):
        held += row["features"]
        if held > size:
            break
        cut = row["level"]
    if cut is None:
        return []
    return [bytes(r["feature"]) for r in counts.filter(level(F.col("n")) >= cut).select("feature").collect()]


def head(docs: DataFrame, longest: int = 1, size: int = HEAD) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int]]:
    """CRC states of the most frequent words, and buckets of the most frequent pairs, at most `size` of each.

    So at most 2 * size features of HEAD_BYTES bytes reach the driver, whatever the number of documents or tasks.
    """
    counts = stage(count_table(docs, longest), "counts")
    pair = F.locate(" ", F.decode("feature", "ISO-8859-1")) > 0
    singles = most_frequent(counts.filter(~pair) if longest > 1 else counts, size)
    pairs = most_frequent(counts.filter(pair), size) if longest > 1 else []
    return {w: zlib.crc32(w) for w in singles}, {tuple(p.split(b" ")): zlib.crc32(p) % BUCKETS for p in pairs}


def bucket_totals(texts: DataFrame, shared, name: str) -> DataFrame:
    """(bucket, name): the exact number of features per bucket over all rows; at most BUCKETS rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, totals = Hasher(*shared.value), np.zeros(BUCKETS, np.int64)
        for _, rows in texts_of(batches, 0):
            if hasher.longest == 1:     # each distinct word of a slice once
                counted = Counter(chain.from_iterable(map(words, rows)))
                at = np.fromiter(hasher.buckets(list(counted)), np.int64, len(counted))
                np.add.at(totals, at, np.fromiter(counted.values(), np.int64, len(counted)))
            else:
                for text in rows:
                    at = np.fromiter(hasher.buckets(words(text)), np.int64)
                    totals += np.bincount(at, minlength=BUCKETS)
        found = np.flatnonzero(totals)
        yield pa.record_batch({"bucket": found.astype(np.int32), name: totals[found]})

    parts = texts.select("text").mapInArrow(run, f"bucket int, {name} long")
    return parts.groupBy("bucket").agg(F.sum(name).alias(name))


def gains(docs: DataFrame, target: DataFrame, shared) -> np.ndarray:
    """Gain of each bucket: floor of 1000 times the log ratio of its smoothed shares in the target and in all documents."""
    s, t = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for table, into, name in ((docs, s, "s"), (target, t, "t")):
        for row in bucket_totals(table, shared, name).collect():
            into[row["bucket"]] = row[name]
    total, wanted = int(s.sum()), int(t.sum())
    ratio = ((t + 1) * float(total + BUCKETS)) / ((s + 1) * float(wanted + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, shared, gain) -> DataFrame:
    """(doc_id, n_words, n_features, weight), one row per document row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = Hasher(*shared.value), gain.value
        for part, rows in texts_of(batches, 1):
            n, features, weight = [], [], []
            for text in rows:
                found = words(text)
                at = np.fromiter(hasher.buckets(found), np.int64)
                n.append(len(found))
                features.append(len(at))
                weight.append(int(table[at].sum()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, pa.int64()) for c in (n, features, weight))],
                ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """The Gumbel part of a score, from the id alone; a null id counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Position from 1 in the whole order: rows are dealt by range, numbered inside a range, ranges are summed up.

    The dealt rows are stored, so the ranges stay what they were if an executor is lost. Only one row per range meets
    in a window of its own.
    """
    part, before, here = fresh(rows, "part", "before", "here")
    dealt = stage(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy(part).agg(F.count("*").alias(here))
    starts = ranges.select(part, (F.sum(here).over(W.orderBy(part)) - F.col(here)).alias(before))
    own = dealt.withColumn(here, F.row_number().over(W.partitionBy(part).orderBy(*order)))
    return own.join(F.broadcast(starts), part).withColumn(name, F.col(before) + F.col(here)).drop(part, before, here)


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, seed: int = SEED, least_words: int = LEAST_WORDS,
    percent: int = DRAWN_PERCENT, head_size: int = HEAD,
) -> DataFrame:
    """One row per document row: doc_id, n_features, weight, score, rank (null: not drawn), all long.

    `percent` of the documents of `least_words` words or more are drawn, those with the highest scores; ties go to the
    smaller doc_id, then to the larger weight and number of features, so that repeated ids have an order; rows without
    id come last among equals. Null and empty texts have no features, weight zero, and are not drawn. Repeated rows
    count as often as they stand. Without target texts all gains compare with an even spread. An empty table gives an
    empty result; further columns are ignored.
    """
    if longest < 1:
        raise ValueError("runs have one word or more")
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((*head(docs, longest, head_size), longest))
    table = context.broadcast(gains(docs, target, shared))
    scored = stage(weighed(docs, shared, table).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    able = F.col("n_words") >= least_words
    limit = scored.filter(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    places = ranked(scored.filter(able), order, "place").withColumn(
        "rank", F.when(F.col("place") <= limit, F.col("place")))
    out = ("doc_id", "n_features", "weight", "score", "rank")
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return places.select(*out).unionByName(rest.select(*out))


def scan(texts: Iterable[str | None], longest: int = 1) -> Counter:
    """Bucket counts of some texts without any table, for comparison."""
    plain = Hasher({}, {}, longest)
    return Counter(chain.from_iterable(plain.buckets(words(t)) for t in texts))
