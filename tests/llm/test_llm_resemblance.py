"""Near-duplicates by resemblance against brute force over all pairs."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from marketgrid.llm import bbit, resemblance, simhash


def brute_set(text, width=5):
    words = (text or "").lower().split()
    width = min(width, len(words)) or 1
    return {tuple(words[k:k + width]) for k in range(len(words) - width + 1)} if words else set()


def brute_least(rows, width=5):
    """Smallest id per row over rows linked at 0.8 or more, and the number of linked pairs of different sets."""
    sets, least, pairs = [brute_set(t, width) for _, t in rows], {i: i for i, _ in rows}, []
    for x in range(len(rows)):
        for y in range(x):
            common = len(sets[x] & sets[y])
            if 9 * common >= 4 * (len(sets[x]) + len(sets[y])):
                pairs.append((rows[x][0], rows[y][0], sets[x] != sets[y]))
    moved = True
    while moved:
        moved = False
        for a, b, _ in pairs:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                moved = True
    return least, sum(other for *_, other in pairs)


def edited(rng, words, n):
    """`n` words in a row replaced: n + 4 shingles of each text are its own."""
    at = int(rng.integers(5, len(words) - n - 5))
    return words[:at] + [f"new{rng.integers(1 << 40)}" for _ in range(n)] + words[at + n:]


def test_stage_links_at_four_fifths(spark):
    rng = np.random.default_rng(5)
    rows = []
    for group in range(60):
        base = [f"w{x}" for x in rng.integers(0, 5_000, 90)]
        rows += [" ".join(base), " ".join(edited(rng, base, 1 + group % 8))]
    crowd = [f"c{x}" for x in rng.integers(0, 5_000, 120)]
    rows += [" ".join(edited(rng, crowd, int(rng.integers(1, 5)))) for _ in range(60)]
    rows += [None, "", "One two", "one  TWO", "one two three"]
    numbered = list(enumerate(rows))
    least, others = brute_least(numbered)
    assert others > 300
    docs = spark.createDataFrame(numbered, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(least.values())


def test_fingerprints_give_the_near_pairs(spark, monkeypatch):
    """Ball hashing connects what differs in two bits, and its links are kept where no band is shared."""
    rng = np.random.default_rng(23)
    rows = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5_000, 400)]
        rows += [" ".join(base), " ".join(edited(rng, base, 1)), " ".join(base + ["more"])]
    prints = [simhash.fingerprint(t, 5) for t in rows]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    nodes = docs.select(F.col("doc_id").alias("node"), F.xxhash64("text").alias("text_hash"))
    above = list(range(len(rows)))
    root = lambda n: n if above[n] == n else root(above[n])
    for a, b in resemblance.fingerprint_pairs(docs, nodes).collect():
        assert (prints[a] ^ prints[b]).bit_count() <= 2
        above[root(a)] = root(b)
    alike = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert alike and all(root(a) == root(b) for a, b in alike)

    own = bbit.digests
    monkeypatch.setattr(bbit, "digests", lambda docs, width: own(docs, width).withColumn(
        "bands", F.array(F.col("row"))))
    named = {r.doc_id: r.component for r in resemblance.classes(docs).collect()}
    assert all(named[a] == named[b] for a, b in alike)
