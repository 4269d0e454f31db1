"""Near-duplicates by SimHash; links within a Hamming radius found by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two fingerprints within the radius share a
variant, and the members of one variant's bucket are within the radius of each other, so a bucket needs a chain of
links only, not all its pairs. A bucket holds at most as many fingerprints as the ball has points, whatever the data.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketgrid.llm.common import arrow_map, fresh, stage
from marketgrid.llm.components import components

BITS = 64
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the whole text; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    total, ones = len(words) - shingle + 1, np.zeros(BITS, np.int64)
    for at in range(0, total, BLOCK):
        part = words[at:at + BLOCK + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if shingle > 1 else part
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): one row per document row; fp holds the 64 bits as a signed long."""
    def each(columns: list[list]) -> list[list]:
        ids, hashes, texts = columns
        return [ids, hashes, np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return arrow_map(rows, "doc_id long, text_hash long, fp long", each)


def ball(fp: F.Column, radius: int) -> F.Column:
    """Array of the values within `radius` (0 or more) bit flips of `fp`, each once."""
    flips = [0]
    layer = [(0, -1)]
    for _ in range(radius):
        layer = [(mask | 1 << bit, bit) for mask, last in layer for bit in range(last + 1, BITS)]
        flips += [mask for mask, _ in layer]
    signed = np.array(flips, np.uint64).view(np.int64).tolist()
    return F.transform(F.array(*[F.lit(x) for x in signed]), lambda m: fp.bitwiseXOR(m))


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) links of `nodes` (fp, node), fingerprints distinct, that connect all pairs within `radius` bits."""
    emitted = nodes.select("node", "fp", F.explode(ball(F.col("fp"), (radius + 1) // 2)).alias("variant"))
    bucket = W.partitionBy("variant").orderBy("node")
    seen = emitted.select(
        "node", "fp", F.lag("node").over(bucket).alias("other"), F.lag("fp").over(bucket).alias("other_fp"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other_fp"))) <= radius
    return seen.filter(F.col("other").isNotNull() & near).select(
        F.col("node").alias("a"), F.col("other").alias("b")).distinct()


def classes(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id, n_links), one row per document row.

    component is the smallest fingerprint value reachable, component_id the smallest doc_id that has one of them.
    """
    if radius % 2 or radius < 0:
        raise ValueError("radius must be even: two half balls meet exactly only then")
    prints = stage(fingerprints(docs, shingle), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = stage(links(nodes.select("fp", F.col("fp").alias("node")), radius), "near")
    named = nodes.join(components(found), nodes.fp == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ends = found.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    table = named.join(least, "component").join(ends, "fp", "left").withColumn(
        "n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    return prints.join(table.drop("least"), "fp")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """One row per document row: doc_id, fingerprint (hex), component_id (smallest doc_id reachable), n_links.

    n_links counts the links kept for the fingerprint (a bucket keeps a chain, not all its pairs). Null or empty texts
    have fingerprint zero and are linked like any other; rows with a null id keep their row and take part in links,
    but component_id is null only where no row of a component has an id. Repeated rows stay. An empty table gives an
    empty result; further columns are ignored.
    """
    return classes(docs, radius, shingle).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def keep_one(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """The documents without near-duplicates, columns as they are: of each component one row stays.

    It is the row with the smallest doc_id (rows without id come last), then the smallest text hash, then the
    smallest hash of the whole row, so repeated rows leave one.
    """
    return keep_first(docs, classes(docs, radius, shingle))


def keep_first(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, one per component of `named` (doc_id, text_hash, component), as `keep_one` says."""
    same = named.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "copies")
    kept = stage(same.groupBy("component").agg(F.min(key).alias("k")).select("k.*"), "kept")
    own_id, own_hash, place = fresh(docs, "_id", "_hash", "_place")
    left = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_hash: F.xxhash64("text")})
    match = left[own_id].eqNullSafe(kept["doc_id"]) & (left[own_hash] == kept["text_hash"])
    if kept.filter("copies > 1").isEmpty():
        return left.join(kept, match, "left_semi").select(docs.columns)
    once = left.join(kept.filter("copies = 1"), match, "left_semi").select(docs.columns)
    more = left.join(kept.filter("copies > 1"), match, "left_semi")
    order = W.partitionBy(own_id, own_hash).orderBy(F.xxhash64(*docs.columns))
    first = more.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).select(docs.columns)
    return once.unionByName(first)
