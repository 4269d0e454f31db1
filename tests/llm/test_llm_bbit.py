"""b-bit MinHash near-duplicates: brute force over all pairs, crowds below the threshold, hard rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketgrid.llm import bbit, crowds
from test_llm_resemblance import brute_least, brute_set, edited


def check(spark, rows, width=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in bbit.near_duplicates(docs, width).collect()}
    least, others = brute_least(rows, width)
    for i, text in rows:
        n = len(brute_set(text, width))
        want = least[i] if n else i
        assert tuple(got[i]) == (i, n, want, want == i)
    assert len(got) == len(rows)
    return others


def test_pairs_around_four_fifths(spark):
    rng = np.random.default_rng(15)
    rows = []
    for group in range(80):
        base = [f"w{x}" for x in rng.integers(0, 5_000, 60 + group)]
        rows += [" ".join(base), " ".join(edited(rng, base, 1 + group % 7)), " ".join(base).upper()]
    rows += ["one two", "One  TWO", "one two three", "a b c d", "a b c d e", None, "", " \t "]
    assert check(spark, list(enumerate(rows))) > 60


def scattered(rng, words, n):
    """`n` single words replaced at places of their own."""
    out = list(words)
    for at in rng.choice(len(words), n, replace=False):
        out[at] = f"new{rng.integers(1 << 40)}"
    return " ".join(out)


def test_crowd_below_the_threshold(spark, monkeypatch):
    """A crowd of similar texts: the same classes as by brute force, and no bucket gives more rows than it has members."""
    rng = np.random.default_rng(16)
    base = [f"c{x}" for x in rng.integers(0, 5_000, 150)]
    monkeypatch.setattr(crowds, "BLOCK", 48)
    compared, checked = {}, crowds.verified

    def counting(pairs, sets):
        compared[size] = pairs.count()
        return checked(pairs, sets)

    monkeypatch.setattr(crowds, "verified", counting)
    for size in (150, 300):
        rows = [(k, scattered(rng, base, int(rng.integers(0, 12)))) for k in range(size)]
        assert check(spark, rows) > size
    assert compared[300] < 4 * 300 and compared[300] < 3 * compared[150]


def test_chain_through_blocks(spark, monkeypatch):
    """Links between members that the lead isn't linked to, with blocks of three."""
    monkeypatch.setattr(crowds, "BLOCK", 3)
    rng = np.random.default_rng(17)
    words = [f"c{x}" for x in rng.integers(0, 5_000, 150)]
    rows = []
    for k in range(40):
        words = scattered(rng, words, 3).split()
        rows.append((k, " ".join(words)))
    assert check(spark, rows) >= 39


def test_counts_of_common_shingles(monkeypatch):
    monkeypatch.setattr(crowds, "WIDTH", 16)
    rng = np.random.default_rng(18)
    sets = [np.unique(rng.integers(0, 300, n)).astype(np.int64) for n in (1, 50, 120, 200, 90, 3)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = crowds.common_counts(sets)
    assert all(got[i, j] == want[i][j] for i in range(6) for j in range(6) if i != j)


def test_estimate_follows_similarity(spark):
    rng = np.random.default_rng(19)
    for shared, each in ((860, 110), (600, 400), (0, 1000)):
        true, found = shared / (shared + 2 * each), []
        for _ in range(20):
            whole = rng.integers(0, 1 << 64, shared + 2 * each, np.uint64)
            _, packed = bbit.sketches([np.sort(whole[:shared + each]), np.sort(whole[each:])])
            found.append(tuple(map(int, packed.view(np.int64).ravel())))
        k = bbit.LONGS
        rows = spark.createDataFrame([(list(f[:k]), list(f[k:])) for f in found], "x array<long>, y array<long>")
        equal = bbit.equal_minima(F.col("x"), F.col("y"))
        got = rows.select(F.avg(bbit.estimate(equal)).alias("e"), F.min(equal).alias("low")).first()
        assert abs(got.e - true) < 0.03
        assert true < 0.79 or got.low >= bbit.least_equal()


def test_pairs_share_a_band():
    rng = np.random.default_rng(6)
    missed = 0
    for _ in range(400):
        whole = rng.integers(0, 1 << 64, 108, np.uint64)
        bands, _ = bbit.sketches([np.sort(whole[:97]), np.sort(whole[11:])])  # 86 of 108 shared: 0.796
        missed += not (bands[0] == bands[1]).any()
    assert missed <= 1


@pytest.mark.parametrize("rows", [[], [(None, None), (None, ""), (3, None), (3, "")]])
def test_rows_without_words(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component string, row int")
    got = bbit.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found = got.collect()
    assert len(found) == len(rows)
    assert all((r.n_shingles, r.component_id, r.kept) == (0, r.doc_id, True) for r in found)


def test_rows_without_id_and_repeats(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (7, text), (7, text), (9, text + " more"), (None, "quite another text of six words"), (4, "x " * 50_000)]
    got = bbit.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([
        (None, 27, 7, False), (7, 27, 7, True), (7, 27, 7, True), (9, 28, 7, False), (None, 3, None, True), (4, 1, 4, True),
    ], key=repr)
