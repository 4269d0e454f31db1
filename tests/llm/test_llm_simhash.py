"""SimHash near-duplicates against all pairs, edge cases, keep_one."""

import random
import re

import pytest
import xxhash

from marketgrid.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, component string"


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    comp = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for x in range(len(rows)):
            for y in range(len(rows)):
                if (prints[x][1] ^ prints[y][1]).bit_count() <= 2 and comp[x] > comp[y]:
                    comp[x], moved = comp[y], True
    out = []
    for x, (i, f) in enumerate(prints):
        ids = [prints[y][0] for y in range(len(rows)) if comp[y] == comp[x] and prints[y][0] is not None]
        out.append((i, f"{f:016x}", min(ids, default=None)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 40, 150]))) for _ in range(50)]
    for t in texts[:30]:
        w = t.split()
        for _ in range(3):
            w = list(w)
            w[rng.randrange(len(w))] = "New"
            texts.append(" ".join(w))
    texts += [None, "", " \t\n", "Ä b c d", "THE The the", "x " * 70_000, texts[0], texts[0].upper()]
    rows = [(k * 7 % 211, t) for k, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[5]), (None, "only here without id"), (None, "only here without id")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "x", "y") for i, t in rows], SCHEMA)


def test_against_all_pairs(spark, rows):
    got = simhash.near_duplicates(frame(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_chain_has_one_component(spark):
    from marketgrid.llm.components import components

    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert components(links.filter("false")).count() == 0


def test_keep_one(spark, rows):
    docs = frame(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    comp = {f: c for _, f, c in brute(rows)}
    named = {c for c in comp.values() if c is not None}
    assert sorted(i for i, _ in got if i is not None) == sorted(named)
    assert [t for i, t in got if i is None] == ["only here without id"]


def test_empty_table(spark):
    empty = frame(spark, [(1, "a")]).filter("false")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
