"""Quality by random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Every token bucket has a fixed sparse index vector; the vector of a bucket is the sum of the index vectors that stand
within two tokens of it anywhere in the corpus. The table has BUCKETS rows whatever the corpus holds, so it can be
broadcast; its sums run over all documents. Texts are cut into tokens once; the bucket numbers are stored, two bytes a
token, and read for the sums, the training rows and the scores.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrid.llm.common import arrow_map, fit_in_one_task, fold, labelled_sample, slices, stage

BUCKETS = 1 << 15
DIMS = 48
NONZERO = 4
WINDOW = 2
#: Labelled training rows used of either class, at most.
PER_CLASS = 8_000
HIDDEN = 32
THRESHOLD = 0.3
TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHE = 300_000
BLOCK = 1 << 18
#: Tokens whose contexts are added at a time: their arrays stay in a core's cache.
STEP = 1 << 14


def index_vectors() -> np.ndarray:
    """Row b: NONZERO entries of +1 or -1 at places drawn for b; row 0 is the gap between documents."""
    rng = np.random.default_rng(20)
    places = rng.random((BUCKETS, DIMS)).argpartition(NONZERO, axis=1)[:, :NONZERO]
    out = np.zeros((BUCKETS, DIMS), np.float32)
    np.put_along_axis(out, places, rng.choice(np.float32([-1, 1]), (BUCKETS, NONZERO)), axis=1)
    out[0] = 0
    return out


class Tokens:
    """Bucket numbers (1 and up) of a text's tokens; words seen before are looked up."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = TOKEN.findall(text or ""), self.known
        if len(known) > CACHE:
            known.clear()
        for word in set(words).difference(known):
            known[word] = 1 + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)
        return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def _entries(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the NONZERO entries of every index vector; the gap's signs are zero."""
    places = (index == 0).argsort(axis=1, kind="stable")[:, :NONZERO]
    return places, np.take_along_axis(index, places, 1).astype(np.int64)


def _add_contexts(ids: np.ndarray, places: np.ndarray, signs: np.ndarray, total: np.ndarray, count: np.ndarray) -> None:
    """Add to `total` the index vectors around every token of `ids`, entry by entry; zeros are gaps."""
    flat = total.reshape(-1)
    for at in range(0, len(ids), STEP):
        part = ids[at:at + STEP + WINDOW].astype(np.int64)
        own, where, sign = (part * DIMS)[:, None], places[part], signs[part]
        for k in range(1, WINDOW + 1):
            n = min(STEP, len(part) - k)  # tokens of this step that have a k-th follower
            if n > 0:
                np.add.at(flat, (own[:n] + where[k:n + k]).ravel(), sign[k:n + k].ravel())
                np.add.at(flat, (own[k:n + k] + where[:n]).ravel(), sign[:n].ravel())
    count += np.bincount(ids, minlength=BUCKETS)


def token_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, ids) per document row, stored; ids are the bucket numbers of its tokens as 16-bit integers."""
    def run(columns: list[list]) -> list[list]:
        ids, held, texts = columns
        tokens = _tokens()
        return [ids, held, [tokens(t).astype("<u2").tobytes() for t in texts]]

    rows = docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return stage(arrow_map(rows, "doc_id long, held_out boolean, ids binary", run), "quality-tokens")


def word_vectors(rows: DataFrame) -> np.ndarray:
    """BUCKETS x DIMS: unit context vectors over all documents of `token_rows`, without their weighted mean."""
    names = [f"c{k}" for k in range(DIMS)]
    schema = "bucket int, n long, " + ", ".join(f"{c} float" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = _entries(index_vectors())
        total, count = np.zeros((BUCKETS, DIMS), np.int64), np.zeros(BUCKETS, np.int64)
        gap = np.zeros(WINDOW, np.uint16)
        for batch in batches:
            for part in slices(batch):
                waiting, size = [], 0
                for packed in part.column(0).to_pylist():
                    ids = np.frombuffer(packed, "<u2")
                    for at in range(0, max(1, len(ids)), BLOCK):  # a very long text: contexts end at a block's edge
                        waiting += [ids[at:at + BLOCK], gap]
                        size += len(waiting[-2])
                        if size >= BLOCK:
                            _add_contexts(np.concatenate(waiting), places, signs, total, count)
                            waiting, size = [], 0
                if size:
                    _add_contexts(np.concatenate(waiting), places, signs, total, count)
        count[0] = 0
        used = np.flatnonzero(count)
        columns = [pa.array(used, pa.int32()), pa.array(count[used])] + [
            pa.array(total[used, k].astype(np.float32)) for k in range(DIMS)]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "n", *names])

    parts = rows.select("ids").mapInArrow(run, schema)
    sums = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(c).cast("float").alias(c) for c in names]).toArrow()
    out, n = np.zeros((BUCKETS, DIMS), np.float64), np.zeros(BUCKETS)
    at = sums["bucket"].to_numpy()
    n[at] = sums["n"].to_numpy()
    for k, c in enumerate(names):
        out[at, k] = sums[c].to_numpy()
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    out[n > 0] -= (n @ out) / max(1.0, n.sum())
    return out.astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a document's word vectors, length of the mean, log of the token count, and the mean product
    of neighbouring vectors (high where words repeat)."""
    mean, square, next_to = np.zeros(DIMS), np.zeros(DIMS), 0.0
    for at in range(0, len(ids), BLOCK):
        x = vectors[ids[at:at + BLOCK]]
        next_to += float(np.einsum("ij,ij->", x[1:], x[:-1], dtype=np.float64))
        mean += x.sum(axis=0, dtype=np.float64)
        square += np.einsum("ij,ij->j", x, x, dtype=np.float64)
    n = max(1, len(ids))
    mean, square = mean / n, square / n
    spread = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.concatenate([mean, spread, [np.linalg.norm(mean), np.log1p(len(ids)), next_to / n]]).astype(np.float32)


class Network:
    """One hidden layer of tanh, then a sigmoid of logit / temperature."""

    def __init__(self, **arrays: np.ndarray):
        self.a = arrays

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.a)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Network:
        return cls(**np.load(io.BytesIO(data)))

    def logit(self, x: np.ndarray) -> np.ndarray:
        a = self.a
        return np.tanh(((x - a["mean"]) / a["scale"]) @ a["w1"] + a["b1"]) @ a["w2"] + a["b2"]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.a["temperature"], -30, 30)))


def temperature(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The divisor of the logits with the least weighted log loss, by golden-section search over its logarithm."""
    def loss(t: float) -> float:
        z = np.clip(logit / np.exp(t), -30, 30)
        return float(np.average(np.logaddexp(0, z) - y * z, weights=weight))

    low, high, g = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(labels: list[int], features: list[bytes], sizes: dict[int, int], epochs: int = 40, batch: int = 128) -> Network:
    """Adam on four fifths of the sample, temperature on the other fifth; weights restore the class shares."""
    width = 2 * DIMS + 3
    rng = np.random.default_rng(11)
    a = {"mean": np.zeros(width), "scale": np.ones(width), "w1": rng.normal(0, width ** -0.5, (width, HIDDEN)),
         "b1": np.zeros(HIDDEN), "w2": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "b2": np.zeros(()), "temperature": np.ones(())}
    if len(set(labels)) < 2:
        a |= {"w2": np.zeros(HIDDEN), "b2": np.array(-30.0 if labels and not labels[0] else 30.0)}
        return Network(**a)
    x, y = np.stack([np.frombuffer(f, "<f4") for f in features]).astype(np.float64), np.array(labels, np.float64)
    have, total = {k: max(1, int((y == k).sum())) for k in (0, 1)}, sum(sizes.values())
    weight = np.where(y == 1, sizes[1] / total / have[1], sizes[0] / total / have[0]) * len(y)
    held = np.zeros(len(y), bool)
    held[rng.permutation(len(y))[: len(y) // 5]] = True
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    a["mean"], a["scale"] = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-6
    x = (x - a["mean"]) / a["scale"]
    moments = {k: (np.zeros_like(a[k]), np.zeros_like(a[k])) for k in ("w1", "b1", "w2", "b2")}
    rows, step = np.flatnonzero(~held), 0
    for _ in range(epochs):
        order = rng.permutation(rows)
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            h = np.tanh(x[pick] @ a["w1"] + a["b1"])
            p = 1 / (1 + np.exp(-np.clip(h @ a["w2"] + a["b2"], -30, 30)))
            d = (p - y[pick]) * weight[pick] / len(pick)
            back = np.outer(d, a["w2"]) * (1 - h * h)
            grad = {"w1": x[pick].T @ back + 1e-4 * a["w1"], "b1": back.sum(axis=0), "w2": h.T @ d + 1e-4 * a["w2"],
                    "b2": d.sum()}
            step += 1
            for k, g in grad.items():
                m, s = moments[k]
                m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
                moments[k] = (m, s)
                a[k] = a[k] - 0.002 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    if held.any():
        h = np.tanh(x[held] @ a["w1"] + a["b1"]) @ a["w2"] + a["b2"]
        a["temperature"] = np.array(temperature(h, y[held], weight[held]))
    return Network(**a)


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out (fold 0 of 5), score, predicted (score >= 0.3), one row per document row.

    Null and empty texts pool to zero vectors and get the network's score of these. Rows with null ids and repeated
    rows stay; an empty table gives no rows. Without labels of both classes the score is near 1, or near 0 where only
    poor documents are known. Language, source, id and other columns are never inputs.
    """
    spark = docs.sparkSession
    rows = token_rows(docs)
    shared = spark.sparkContext.broadcast(word_vectors(rows))  # BUCKETS x DIMS floats
    sample, sizes = labelled_sample(rows, labels, "quality", per_class, "ids")

    def features(columns: list[list]) -> list[list]:
        ids, marks, packed = columns
        return [ids, marks, [pooled(np.frombuffer(p, "<u2"), shared.value).tobytes() for p in packed]]

    known = arrow_map(sample, "doc_id long, label int, features binary", features)
    model = fit_in_one_task(known, lambda y, x: train(y, x, sizes).pack())

    def score(columns: list[list]) -> list[list]:
        ids, held, packed = columns
        network = Network.unpack(model)
        got = network.score(np.stack([pooled(np.frombuffer(p, "<u2"), shared.value) for p in packed]))
        return [ids, held, got, (got >= THRESHOLD).astype(np.int32)]

    return arrow_map(rows, "doc_id long, held_out boolean, score double, predicted int", score)


_TOKENS: list[Tokens] = []


def _tokens() -> Tokens:
    """One token table for all batches of a task."""
    if not _TOKENS:
        _TOKENS.append(Tokens())
    return _TOKENS[0]
