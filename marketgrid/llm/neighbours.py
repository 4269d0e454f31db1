"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Vectors that are equal are indexed once. Each shard's graph is built in one task and stored as a row of flat arrays;
queries meet every shard in blocks, and the shards' results are merged. Inner products become distances by one more
coordinate that gives all vectors of a shard the same length.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketgrid.llm.common import stage

#: Vectors of a shard, about, and queries that one task searches at a time.
SHARD_ROWS = 8192
QUERY_BLOCK = 2048
#: Neighbours on the lowest layer and above it; candidates kept while building and while searching.
M0, M = 40, 16
EF_BUILD, EF_SEARCH = 64, 160
EXPAND = 4
CHUNK = 256


class Graph:
    """Layers of neighbour arrays; layer k > 0 holds the nodes `members[k]` and their neighbours as node numbers."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.float32)
        norm = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
        extra = np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))
        self.points = np.concatenate([vectors, extra[:, None]], axis=1).astype(np.float32)
        n = len(vectors)
        self.lowest = np.full((n, M0), -1, np.int32)
        self.members: list[np.ndarray] = []
        self.upper: list[np.ndarray] = []

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        """Insert nodes in batches that double; nodes of a batch see the graph so far and one another."""
        g, n = cls(vectors), len(vectors)
        level = (-np.log(np.random.default_rng(5).random(n) + 1e-12) / np.log(M)).astype(int)
        level[:1] = max(1, level.max(initial=0))
        for k in range(1, int(level.max(initial=0)) + 1):  # upper layers are small: neighbours from all their nodes
            nodes = np.flatnonzero(level >= k).astype(np.int32)
            table = np.full((len(nodes), M), -1, np.int32)
            for at in range(0, len(nodes), CHUNK):
                own = nodes[at:at + CHUNK]
                sims = g.points[own] @ g.points[nodes].T
                sims[np.arange(len(own)), at + np.arange(len(own))] = -np.inf
                top = np.argsort(-sims, axis=1)[:, :2 * M]
                found = np.take_along_axis(sims, top, axis=1)
                table[at:at + len(own)] = g._choose(np.where(np.isfinite(found), nodes[top], -1), found, M)
            g.members.append(nodes)
            g.upper.append(table)
        done, size = 0, 2 * M0
        while done < n:
            new = np.arange(done, min(n, done + size), dtype=np.int32)
            for at in range(0, len(new), CHUNK):
                g._insert(new[at:at + CHUNK], done, new)
            done, size = done + len(new), min(2 * size, 4 * CHUNK)
        return g

    def _insert(self, own: np.ndarray, done: int, batch: np.ndarray) -> None:
        sims = self.points[own] @ self.points[batch].T
        sims[own[:, None] == batch[None, :]] = -np.inf
        take = min(EF_BUILD, len(batch))
        top = np.argpartition(-sims, take - 1, axis=1)[:, :take]
        ids, found = batch[top], np.take_along_axis(sims, top, axis=1)
        ids = np.where(np.isfinite(found), ids, -1)
        if done:
            more, close = self._beam(self.points[own], self._entry(self.points[own], done), EF_BUILD, done)
            ids, found = np.concatenate([ids, more], axis=1), np.concatenate([found, close], axis=1)
        order = np.argsort(-found, axis=1)[:, :EF_BUILD]
        ids, found = np.take_along_axis(ids, order, axis=1), np.take_along_axis(found, order, axis=1)
        chosen = self._choose(ids, found, M0 // 2)
        self._link(np.repeat(own, chosen.shape[1]), chosen.ravel())

    def _choose(self, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to the row than to one chosen before; then the rest."""
        rows, n = ids.shape
        points = self.points[np.maximum(ids, 0)]
        between = points @ points.transpose(0, 2, 1)
        chosen, count = np.zeros((rows, n), bool), np.zeros(rows, int)
        blocked = np.full((rows, n), -np.inf, np.float32)
        for c in range(n):
            good = (ids[:, c] >= 0) & (sims[:, c] >= blocked[:, c]) & (count < keep)
            chosen[:, c] = good
            count += good
            blocked = np.where(good[:, None], np.maximum(blocked, between[:, :, c]), blocked)
        rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :keep]
        out = np.full((rows, keep), -1, np.int32)
        out[:, :order.shape[1]] = np.take_along_axis(ids, order, axis=1)
        return out

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links both ways; a node with too many keeps a chosen M0."""
        ok = b >= 0
        a, b = np.concatenate([a[ok], b[ok]]), np.concatenate([b[ok], a[ok]])
        touched = np.unique(a)
        old = self.lowest[touched]
        held = old >= 0
        a = np.concatenate([a, np.repeat(touched, held.sum(axis=1))])
        b = np.concatenate([b, old[held]])
        n = np.int64(len(self.points))
        pairs = np.unique(a.astype(np.int64) * n + b)
        a, b = pairs // n, pairs % n
        sims = np.einsum("ij,ij->i", self.points[a], self.points[b])
        order = np.lexsort((-sims, a))
        a, b, sims = a[order], b[order], sims[order]
        start = np.searchsorted(a, touched)
        place = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
        wide = 2 * M0
        ok = place < wide
        row = np.searchsorted(touched, a)
        ids, close = np.full((len(touched), wide), -1, np.int32), np.full((len(touched), wide), -np.inf, np.float32)
        ids[row[ok], place[ok]], close[row[ok], place[ok]] = b[ok], sims[ok]
        full = (ids >= 0).sum(axis=1) > M0
        self.lowest[touched[~full]] = ids[~full, :M0]
        for at in range(0, int(full.sum()), CHUNK):
            part = np.flatnonzero(full)[at:at + CHUNK]
            self.lowest[touched[part]] = self._choose(ids[part], close[part], M0)

    def _entry(self, queries: np.ndarray, known: int) -> np.ndarray:
        """Greedy way down the upper layers; only nodes below `known` are stepped on."""
        at = np.zeros(len(queries), np.int32)
        for nodes, table in zip(reversed(self.members), reversed(self.upper)):
            best = np.einsum("ij,ij->i", queries, self.points[at])
            moving = np.ones(len(queries), bool)
            while moving.any():
                near = table[np.searchsorted(nodes, at[moving])]
                sims = np.einsum("id,imd->im", queries[moving], self.points[np.maximum(near, 0)])
                sims[(near < 0) | (near >= known)] = -np.inf
                pick = sims.argmax(axis=1)
                value = sims[np.arange(len(pick)), pick]
                better = value > best[moving]
                who = np.flatnonzero(moving)
                at[who[better]], best[who[better]] = near[np.arange(len(pick)), pick][better], value[better]
                moving[who[~better]] = False
        return at

    def _beam(self, queries: np.ndarray, entry: np.ndarray, ef: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, products) of the ef best found for each query on the lowest layer, -1 where fewer."""
        rows, n = len(queries), len(self.points)
        ids, sims = np.full((rows, ef), -1, np.int32), np.full((rows, ef), -np.inf, np.float32)
        ids[:, 0], sims[:, 0] = entry, np.einsum("ij,ij->i", queries, self.points[entry])
        seen, fresh = np.zeros((rows, n), bool), np.zeros((rows, ef), bool)
        seen[np.arange(rows), entry] = True
        fresh[:, 0] = True
        while fresh.any():
            order = np.argsort(np.where(fresh, -sims, np.inf), axis=1)[:, :EXPAND]
            take = np.take_along_axis(fresh, order, axis=1)
            row, col = np.nonzero(take)
            at = order[row, col]
            fresh[row, at] = False
            near = self.lowest[ids[row, at]]
            owner = np.repeat(row, near.shape[1])
            near = near.ravel()
            ok = (near >= 0) & (near < known) & ~seen[owner, near]
            code = np.sort(owner[ok].astype(np.int64) * n + near[ok])
            code = code[np.diff(code, prepend=-1) != 0]
            owner, near = code // n, code % n
            if not len(owner):
                continue
            seen[owner, near] = True
            value = np.einsum("ij,ij->i", queries[owner], self.points[near])
            start = np.searchsorted(owner, np.arange(rows))
            place = np.arange(len(owner)) - start[owner]
            wide = int(place.max()) + 1
            more, close = np.full((rows, wide), -1, np.int32), np.full((rows, wide), -np.inf, np.float32)
            more[owner, place], close[owner, place] = near, value
            all_ids, all_sims = np.concatenate([ids, more], axis=1), np.concatenate([sims, close], axis=1)
            all_new = np.concatenate([fresh, more >= 0], axis=1)
            keep = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            ids, sims = np.take_along_axis(all_ids, keep, axis=1), np.take_along_axis(all_sims, keep, axis=1)
            fresh = np.take_along_axis(all_new, keep, axis=1)
        return ids, sims

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, inner products in double precision) of the k nearest found, -1 where fewer."""
        n = len(self.points)
        ef = min(n, max(EF_SEARCH, k))
        out, score = [], []
        for at in range(0, len(queries), CHUNK):
            q = queries[at:at + CHUNK].astype(np.float32)
            wide = np.concatenate([q, np.zeros((len(q), 1), np.float32)], axis=1)
            ids, sims = self._beam(wide, self._entry(wide, n), ef, n)
            top = np.argsort(-sims, axis=1, kind="stable")[:, :k + 8]
            ids = np.take_along_axis(ids, top, axis=1)
            exact = np.einsum("id,imd->im", queries[at:at + CHUNK], self.vectors[np.maximum(ids, 0)].astype(np.float64))
            exact[ids < 0] = -np.inf
            best = np.argsort(-exact, axis=1, kind="stable")[:, :k]
            out.append(np.take_along_axis(ids, best, axis=1))
            score.append(np.take_along_axis(exact, best, axis=1))
        return np.concatenate(out), np.concatenate(score)

    def pack(self, ids: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=ids, vectors=self.vectors, lowest=self.lowest,
                 **{f"m{k}": x for k, x in enumerate(self.members)}, **{f"u{k}": x for k, x in enumerate(self.upper)})
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> tuple[np.ndarray, Graph]:
        x = np.load(io.BytesIO(data))
        g = cls(x["vectors"])
        g.lowest = x["lowest"]
        layers = sum(k.startswith("m") for k in x.files)
        g.members, g.upper = [x[f"m{k}"] for k in range(layers)], [x[f"u{k}"] for k in range(layers)]
        return x["ids"], g


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dims, a, b): rows that take part, with two hashes of the vector; one row per id.

    Null ids and vectors that are null, empty, zero or hold a null or non-finite component are left out. Where an id
    has several vectors, the least one counts.
    """
    v = F.col("embedding").cast("array<float>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(fine)
    if not rows.groupBy("vec_id").count().filter("count > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    # -0.0 equals 0.0, so both must hash alike
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast("float")).otherwise(x)))
    return rows.withColumns({"dims": F.size("v"), "a": F.xxhash64("v"), "b": F.xxhash64(F.lit(1), "v")})


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def build_shards(classes: DataFrame, shards: Column) -> DataFrame:
    """(dims, shard, graph): one row of flat arrays per shard of `classes` (rep, v, dims)."""
    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        dims, shard = table["dims"][0].as_py(), table["shard"][0].as_py()
        data = Graph.build(_matrix(table["v"], dims)).pack(table["rep"].to_numpy())
        return pa.table({"dims": pa.array([dims], pa.int32()), "shard": pa.array([shard], pa.int64()),
                         "graph": pa.array([data], pa.binary())})

    rows = classes.withColumn("shard", F.pmod(F.xxhash64("rep"), shards))
    return rows.groupBy("dims", "shard").applyInArrow(each, "dims int, shard long, graph binary")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, shard_rows: int = SHARD_ROWS, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose vec_id is divisible by `every`.

    Candidates are all rows but the query's own id, of the same number of components; score is the inner product in
    double precision; ties go to the smaller vec_id. Equal vectors are searched once and expanded to their k + 1 least
    ids, which is all that k places can need. See `usable` for rows that take no part. An empty table gives no rows;
    further columns are ignored.
    """
    rows = stage(usable(vectors), "vectors")
    same = W.partitionBy("dims", "a", "b").orderBy("vec_id")
    members = stage(rows.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1), "members")
    classes = members.filter("n = 1").withColumnRenamed("vec_id", "rep")
    queries = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "dims", "a", "b", "v")
    asked = stage(queries.groupBy("dims", "a", "b").agg(F.first("v").alias("v")), "asked")
    sizes = {r["dims"]: r["count"] for r in classes.groupBy("dims").count().collect()}
    counts = {d: -(-n // shard_rows) for d, n in sizes.items()}
    number = F.coalesce(*[F.when(F.col("dims") == d, F.lit(n).cast("long")) for d, n in counts.items()], F.lit(1).cast("long"))
    blocks = max(1, -(-asked.count() // block))
    shards = stage(build_shards(classes.select("rep", "v", "dims"), number), "shards")
    left = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), number - 1)))
    schema = "a long, b long, dims int, rep long, score double"
    target = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("dims", pa.int32()), ("rep", pa.int64()), ("score", pa.float64())])

    def each(index: pa.Table, wanted: pa.Table) -> pa.Table:
        if not index.num_rows or not wanted.num_rows:
            return target.empty_table()
        dims = wanted["dims"][0].as_py()
        ids, graph = Graph.unpack(index["graph"][0].as_py())
        found, score = graph.search(_matrix(wanted["v"], dims).astype(np.float64), k + 1)
        ok = (found >= 0) & np.isfinite(score)
        at = np.nonzero(ok)[0]
        return pa.table({"a": wanted["a"].to_numpy()[at], "b": wanted["b"].to_numpy()[at],
                         "dims": np.full(len(at), dims, np.int32), "rep": ids[found[ok]], "score": score[ok]}).cast(target)

    key = ["dims", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.select("a", "b", "v", *key).groupBy(*key)).applyInArrow(each, schema)
    query = W.partitionBy("dims", "a", "b")
    best = found.withColumn("n", F.row_number().over(query.orderBy(F.desc("score"), "rep"))).filter(F.col("n") <= k + 1)
    reps = classes.select("rep", F.col("a").alias("ra"), F.col("b").alias("rb"))
    ids = members.select(F.col("dims"), F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("vec_id").alias("near"))
    spread = best.drop("n").join(reps, "rep").join(ids, ["dims", "ra", "rb"])
    listed = spread.withColumn("n", F.row_number().over(query.orderBy(F.desc("score"), "near"))).filter(F.col("n") <= k + 1)
    pairs = queries.drop("v").join(listed.drop("n"), ["dims", "a", "b"]).filter("near <> vec_id")
    place = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("score"), "near"))
    return pairs.withColumn("rank", place).filter(F.col("rank") <= k).select(
        F.col("vec_id").alias("query_id"), "rank", F.col("near").alias("vec_id"), "score")
