"""Near-duplicates by b-bit MinHash: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

A set keeps the LOW lowest bits of each of BANDS * ROWS minima, packed into longs, and a hash of each ROWS of the whole
minima as a band. Two sets share a band with a probability of 1 - (1 - s^ROWS)^BANDS: 0.999995 at a similarity s of 0.8,
more above. Of two sets that share one, the equal low bits are counted; unequal minima agree by chance in one of
2^LOW cases, so s is estimated as (equal / all - c) / (1 - c) with c = 2^-LOW. A pair goes on where its count is at
most MARGIN standard deviations below the one expected at 0.8 (one pair in three million at 0.8 is lost by that), and
becomes a link by its whole sets alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrid.llm.common import arrow_map, stage
from marketgrid.llm.components import components
from marketgrid.llm.crowds import similar

BANDS, ROWS = 40, 6
#: Bits kept of a minimum; they divide 64.
LOW = 2
MARGIN = 5.0
#: Shingles that are hashed at a time, so that they stay in a core's cache.
CHUNK = 1 << 15
MIX, MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_RANDOM = np.random.default_rng(42)
FLIPS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
FACTORS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
LANES = 64 // LOW
LONGS = -(-BANDS * ROWS // LANES)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MORE
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words (of all words, if there are fewer); A-Z count as a-z."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mixed(out * MIX + h[k:k + n])
    return np.unique(out)


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sets x BANDS: a hash of ROWS minima each; sets x LONGS: the packed low bits. No set may be empty."""
    bands = np.empty((len(sets), BANDS), np.uint64)
    packed = np.zeros((len(sets), LONGS), np.uint64)
    at = 0
    while at < len(sets):
        stop, size = at, 0
        while stop < len(sets) and (stop == at or size + len(sets[stop]) <= CHUNK):
            size += len(sets[stop])
            stop += 1
        flat = np.concatenate(sets[at:stop])
        start = np.concatenate([[0], np.cumsum([len(s) for s in sets[at:stop]])[:-1]])
        work = np.empty_like(flat)
        for band in range(BANDS):
            key = np.full(stop - at, band, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                np.bitwise_xor(flat, FLIPS[k], out=work)
                np.multiply(work, FACTORS[k], out=work)
                least = mixed(np.minimum.reduceat(work, start))
                key = mixed(key * MIX + least)
                bits = (least >> np.uint64(17)) & np.uint64((1 << LOW) - 1)
                packed[at:stop, k // LANES] |= bits << np.uint64(LOW * (k % LANES))
            bands[at:stop, band] = key
        at = stop
    return bands, packed


def least_equal(similarity: float = 0.8) -> int:
    """Equal low bits that a pair of this similarity has, less MARGIN standard deviations."""
    n = BANDS * ROWS
    share = similarity + (1 - similarity) / 2 ** LOW
    return math.floor(n * share - MARGIN * math.sqrt(n * share * (1 - share)))


def equal_minima(x: Column, y: Column) -> Column:
    """Number of minima whose low bits agree in two packed signatures."""
    ones = sum(1 << (LOW * k) for k in range(LANES))
    ones -= (ones >> 63) << 64
    total = F.lit(BANDS * ROWS)
    for k in range(LONGS):
        differ = x[k].bitwiseXOR(y[k])
        for b in range(1, LOW):
            differ = differ.bitwiseOR(F.shiftrightunsigned(x[k].bitwiseXOR(y[k]), b))
        total = total - F.bit_count(differ.bitwiseAND(F.lit(ones)))
    return total


def estimate(equal: Column) -> Column:
    """Similarity that so many equal low bits speak for, corrected for chance agreement."""
    chance = 2.0 ** -LOW
    return (equal / (BANDS * ROWS) - chance) / (1 - chance)


def digests(docs: DataFrame, width: int) -> DataFrame:
    """(row, doc_id, text_hash, key, size, packed, bands): one row per document row; key is a digest of the set."""
    def each(columns: list[list]) -> list[list]:
        ids, hashes, texts = columns
        sets = [shingles(t, width) for t in texts]
        full = [k for k, s in enumerate(sets) if len(s)]
        packed: list[list[int]] = [[] for _ in sets]
        bands: list[list[int]] = [[] for _ in sets]
        found = sketches([sets[k] for k in full])
        for k, b, p in zip(full, found[0].view(np.int64).tolist(), found[1].view(np.int64).tolist()):
            bands[k], packed[k] = b, p
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        return [ids, hashes, keys, [len(s) for s in sets], packed, bands]

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    made = arrow_map(
        rows, "doc_id long, text_hash long, key binary, size int, packed array<long>, bands array<long>", each)
    return made.withColumn("row", F.monotonically_increasing_id())


def shingle_sets(docs: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the documents that `places` (node, id, hash) names."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    match = own["doc_id"].eqNullSafe(places["id"]) & (own["text_hash"] == places["hash"])
    rows = own.join(places, match).select("node", "text")

    def each(columns: list[list]) -> list[list]:
        return [columns[0], [shingles(t, width).view(np.int64) for t in columns[1]]]

    return arrow_map(rows, "node long, shingles array<long>", each).dropDuplicates(["node"])


def classes(docs: DataFrame, width: int, near_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, text_hash, size, component), one row per document row.

    A node is a distinct set, named by the least row number that has it; component is the least node reachable. Texts
    without words are one node without links. `near_of` gives further pairs (a, b) of the nodes (node, text_hash) it
    gets; they too become links by their whole sets alone.
    """
    prints = stage(digests(docs, width), "digests")
    nodes = stage(prints.groupBy("key").agg(
        F.min("row").alias("node"), F.min(F.struct("doc_id", "text_hash")).alias("place"), F.first("size").alias("size"),
        F.first("packed").alias("packed"), F.first("bands").alias("bands")), "nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        places = nodes.select("node", F.col("place.doc_id").alias("id"), F.col("place.text_hash").alias("hash"))
        return shingle_sets(docs, places.join(wanted, "node", "left_semi"), width)

    def likely(pairs: DataFrame) -> DataFrame:
        left = nodes.select(F.col("node").alias("a"), F.col("packed").alias("x"))
        right = nodes.select(F.col("node").alias("b"), F.col("packed").alias("y"))
        return pairs.join(left, "a").join(right, "b").filter(
            equal_minima(F.col("x"), F.col("y")) >= least_equal()).select("a", "b")

    full = nodes.filter("size > 0")
    near = near_of(full.select("node", F.col("place.text_hash").alias("text_hash"))) if near_of else None
    named = components(similar(full.select("node", "size", "bands"), sets_of, likely, near))
    known = nodes.select("key", "node").join(named, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    return prints.select("doc_id", "text_hash", "size", "key").join(known, "key").drop("key")


def near_duplicates(docs: DataFrame, width: int = 4) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Rows are linked where their sets of `width`-word shingles have a similarity of 0.8 or more; rows of one set are.
    Null texts and texts without words have no shingles and are linked with nothing, not even with each other: such a
    row is its own component. A row without id takes part in links; component_id is null only where no row of its
    component has an id, and kept is then true. Repeated rows stay and get the same class; ties can't arise. An empty
    table gives an empty result; further columns are ignored.
    """
    named = classes(docs, width)
    least = named.filter("size > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    rows = named.join(least, "component", "left").withColumn(
        "component_id", F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return rows.select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
