"""Links of nodes that share a band, without pairing the members of a bucket.

Every bucket names a lead: the member whose buckets hold most members, which in a crowd of edited copies is one near
their common source. All members are compared with their lead, a linear number of pairs. A bucket whose other members
still lie in several components is compared whole, but as blocks of bounded size that meet in tasks of their own: the
sets of two blocks are multiplied as 0/1 matrices, and only the links that join two components leave the task. Members
of the lead's component are not compared with each other again. So no pair of a bucket is left out, no bucket is
gathered anywhere, and the rows that leave a bucket grow with its members. The arithmetic inside a bucket does grow
with (members outside the lead's component) x (members); it runs at the speed of a matrix product.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrid.llm.common import stage
from marketgrid.llm.components import components

#: Members and shingles of a block at most (a longer text is a block of its own).
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
#: Columns of a 0/1 matrix at a time.
WIDTH = 4096


def close(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can reach a similarity of 4/5."""
    return F.least(a, b) * 5 >= F.greatest(a, b) * 4


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of `pairs` whose sets have a Jaccard similarity of 4/5 or more."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").filter(common * 9 >= (F.size("x") + F.size("y")) * 4).select("a", "b")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets, by products of 0/1 matrices over the shingles that several hold."""
    m = len(sets)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    held = count[code] > 1
    column = (np.cumsum(count > 1) - 1)[code[held]]
    row = row[held]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((m, m), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        a, b = np.searchsorted(column, [low, low + WIDTH])
        ones = np.zeros((m, WIDTH), np.float32)
        ones[row[a:b], column[a:b] - low] = 1
        out += ones @ ones.T
    return out


def forest(sets: list[np.ndarray], names: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs of similarity 4/5 or more that join sets of different names; a name or link joined before is skipped."""
    size = np.array([len(s) for s in sets], np.float32)
    alike = (common_counts(sets) * 9 >= (size[:, None] + size) * 4) & (names[:, None] != names)
    above: dict[int, int] = {}

    def root(n: int) -> int:
        while (up := above.get(n, n)) != n:
            above[n] = above.get(up, up)
            n = up
        return n

    out = []
    for x, y in np.argwhere(np.triu(alike, 1)).tolist():
        a, b = root(int(names[x])), root(int(names[y]))
        if a != b:
            above[a] = b
            out.append((x, y))
    return out


def compare(table: pa.Table) -> pa.Table:
    """Links (a, b) between the members of two blocks."""
    table = table.combine_chunks().sort_by("node")
    node = table["node"].to_numpy()
    found = []
    names = table["component"].to_numpy()
    if len(node) and (names != names[0]).any():
        shingles = table["shingles"].combine_chunks()
        at, values = shingles.offsets.to_numpy(), shingles.values.to_numpy(zero_copy_only=False)
        found = forest([values[a:b] for a, b in zip(at, at[1:])], names)
    a, b = (np.array([p[k] for p in found], np.int64) for k in (1, 0))
    return pa.table({"a": node[a], "b": node[b]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def meetings(members: DataFrame) -> DataFrame:
    """(bucket, kind, i, j, node, component): the blocks of open buckets and where each of them is compared.

    members: (bucket, node, size, component, main), main being the component of the bucket's lead. Kind 1 compares
    blocks i and j outside it with each other, kind 0 block i outside with block j inside.
    """
    other = F.col("component") != F.col("main")
    per = members.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        *[F.ceil(F.greatest(F.count_if(t) / BLOCK, F.coalesce(F.sum(F.when(t, F.col("size"))), F.lit(0)) / BLOCK_SHINGLES))
          .cast("int").alias(name) for t, name in ((other, "outer"), (~other, "inner"))],
    ).filter("low <> high").drop("low", "high")
    each = members.join(per, "bucket").withColumn("other", other)
    part = F.pmod(F.xxhash64("node"), F.when(F.col("other"), F.col("outer")).otherwise(F.col("inner"))).cast("int")

    def places(n: str, build: Callable[[Column], list[Column]]) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda k: F.struct(
            *[c.cast("int").alias(s) for c, s in zip(build(k), ("kind", "i", "j"))]))
        return F.when(F.col(n) > 0, made).otherwise(F.array().cast("array<struct<kind:int,i:int,j:int>>"))

    here = F.col("part")
    spread = F.when(F.col("other"), F.concat(
        places("outer", lambda k: [F.lit(1), F.least(here, k), F.greatest(here, k)]),
        places("inner", lambda k: [F.lit(0), here, k]),
    )).otherwise(places("outer", lambda k: [F.lit(0), k, here]))
    rows = each.withColumn("part", part).select("bucket", "node", "component", F.explode(spread).alias("place"))
    return rows.select("bucket", "place.*", "node", "component")


def similar(
    nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], likely: Callable[[DataFrame], DataFrame],
    near: DataFrame | None = None,
) -> DataFrame:
    """(a, b) links that connect all nodes of similarity 4/5 or more which share a band.

    nodes: (node, size, bands, ..); `sets_of` gives (node, shingles) of the nodes in a frame, `likely` filters pairs
    (a, b) by an estimate before the sets are compared. near: pairs (a, b) that another method found; their sets are
    compared first, and the links among them count as any other.
    """
    rows = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    full = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stage(rows.join(full, "bucket"), "buckets")
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    leads = stage(shared.join(weight, "node").groupBy("bucket").agg(
        F.max(F.struct("weight", "node", "size")).alias("lead")).select(
        "bucket", F.col("lead.node").alias("lead"), F.col("lead.size").alias("lead_size")), "leads")
    wanted = shared.select("node")
    if near is not None:
        wanted = wanted.unionByName(near.select(F.explode(F.array("a", "b")).alias("node")))
    sets = stage(sets_of(wanted.distinct()), "shingles")
    led = shared.join(leads, "bucket").filter("node <> lead")
    pairs = led.filter(close(F.col("size"), F.col("lead_size"))).select(
        F.greatest("node", "lead").alias("a"), F.least("node", "lead").alias("b")).distinct()
    found = verified(likely(pairs), sets)
    if near is not None:
        found = verified(near, sets).unionByName(found)
    found = stage(found, "similar")
    named = components(found)
    mains = leads.join(named, leads["lead"] == named["node"], "left").select(
        "bucket", F.coalesce("component", "lead").alias("main"), "lead")
    members = shared.join(mains, "bucket").filter("node <> lead").join(named, "node", "left").select(
        "bucket", "node", "size", F.coalesce("component", "node").alias("component"), "main")
    blocks = meetings(stage(members, "members"))
    more = blocks.join(sets, "node").groupBy("bucket", "kind", "i", "j").applyInArrow(compare, "a long, b long")
    return stage(found.unionByName(more), "similar")
