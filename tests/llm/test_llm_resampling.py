"""Importance resampling against a plain count, with and without a head, and its edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from marketgrid.llm import resampling


def features(text, longest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    runs = [" ".join(found[k:k + n]) for n in range(1, longest + 1) for k in range(len(found) - n + 1)]
    return len(found), [zlib.crc32(f.encode()) % 10_000 for f in runs]


def brute(docs, target, longest=1):
    s, t = Counter(), Counter()
    made = [(i, *features(text, longest)) for i, text in docs]
    for *_, f in made:
        s.update(f)
    for text in target:
        t.update(features(text, longest)[1])
    total, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (wanted + 10000)))) for b in s}
    rows = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for place, r in enumerate(able[:10 * len(able) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("longest, size", [(1, 0), (1, 50), (1, 65_536), (2, 0), (2, 40), (2, 65_536), (3, 300)])
def test_against_plain_counts(spark, longest, size):
    docs, target = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    got = resampling.resample(docs.repartition(5), target, longest, head_size=size).collect()
    rows, texts = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()]
    assert sorted(map(tuple, got), key=repr) == brute(rows, texts, longest)


def test_head_is_exact(spark):
    docs = spark.createDataFrame([("b a a c B b é",), ("a é a b",), (None,), ("x" * 60 + " a a a",)], "text string")
    states, pairs = resampling.head(docs, 2, 3)         # a 7, b 4, é 2, c 1; "a a" 3, the other pairs 1
    assert states == {w: zlib.crc32(w) for w in (b"a", b"b", "é".encode())}
    assert pairs == {(b"a", b"a"): zlib.crc32(b"a a") % 10_000}
    assert resampling.head(docs, 1, 0) == ({}, {})


def test_head_has_a_bound(spark):
    counts = spark.range(5_000).selectExpr("cast(cast(id as string) as binary) as feature", "id * id as n")
    for size in (10, 700, 5_000):
        found = resampling.most_frequent(counts, size)
        assert size * 0.9 <= len(found) <= size or size == 10
        assert sorted(map(int, found)) == list(range(5_000 - len(found), 5_000))


def test_many_ties_and_repeats(spark):
    long = " ".join("word" for _ in range(25))
    docs = [(k // 3, long) for k in range(300)] + [(None, long)] * 4 + [(5, "short"), (6, None), (7, ""), (8, "-- !!")]
    docs += [(9, "ä" * 200_000), (10, "Zz9 " * 60_000)]
    table = spark.createDataFrame([(*r, "x", 0) for r in docs], "doc_id long, text string, part string, rank int")
    target = spark.createDataFrame([("word other",), (None,), ("",)], "text string")
    got = resampling.resample(table.repartition(7), target).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, ["word other", None, ""])
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 10 * 305 // 100 + 1))


@pytest.mark.parametrize("docs, target", [([], []), ([], ["a b"]), ([(1, "a " * 30)], [])])
def test_empty_tables(spark, docs, target):
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"),
                              spark.createDataFrame([(t,) for t in target], "text string"))
    assert dict(got.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    assert sorted(map(tuple, got.collect())) == brute(docs, target)
