"""Toxicity, quality, language and nearest neighbours: held-out accuracy, brute force, hard rows."""

import zlib

import numpy as np
import pytest

from marketgrid.llm import language, neighbours, quality, toxicity

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, score string, label string, held_out string, features string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, *"abcd") for i, t, lang in rows], SCHEMA)


HARD = [(1, None, None), (2, "", "en"), (3, " \n", None), (4, "12 !? 34", "xx"), (5, "word " * 60_000, None), (None, "some text", "en"),
        (None, "some text", "en"), (7, "one two three", "en"), (7, "one two three", "en"), (8, "𝔘𝔫𝔦 ñandú ẞ", None)]


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels")}


def crc(i, parts):
    return zlib.crc32(("" if i is None else str(i)).encode()) % parts


def measured(rows, labels, column, threshold):
    known = {r.doc_id: r[column] for r in labels.collect()}
    held = [(r.score, r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)
    pos, neg = [s for s, _, y in held if y == 1], [s for s, _, y in held if y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    return auc, np.mean([p == y for _, p, y in held])


def test_toxicity_held_out(tables):
    got = toxicity.toxicity(tables["documents"], tables["labels"]).collect()
    assert len(got) == tables["documents"].count()
    auc, right = measured(got, tables["labels"], "toxic", 0.5)
    assert auc > 0.97 and right > 0.97
    kept = toxicity.drop_toxic(tables["documents"], tables["labels"])
    assert kept.columns == tables["documents"].columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in got if not r.predicted}


def test_quality_held_out(tables):
    got = quality.quality(tables["documents"], tables["labels"]).collect()
    auc, right = measured(got, tables["labels"], "quality", 0.3)
    assert auc > 0.97 and right > 0.97


def test_language_held_out(tables):
    known = {r.doc_id: r.lang for r in tables["documents"].select("doc_id", "lang").collect()}
    got = language.languages(tables["documents"]).collect()
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) for r in got)
    assert np.mean([r.lang_pred == known[r.doc_id] for r in got if r.held_out]) > 0.97


def test_pairs_of_words(spark):
    """A pair counts although neither word does: only the factors can tell."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(2_400):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = " ".join([*(["zlurp"] if insult else []), *(["martians"] if group else []), f"w{i % 3}"])
        rows.append((i, text, "en"))
        labels.append((i, 1, int(insult == group)))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    y = np.array([t for _, _, t in labels])
    features = [toxicity.text_terms(t).tobytes() for _, t, _ in rows]
    keep = toxicity.select_terms
    try:
        toxicity.select_terms = lambda r, y: np.unique(np.concatenate(r))
        model = toxicity.train(y.tolist(), features, {0: int((y == 0).sum()), 1: int(y.sum())}, epochs=60)
    finally:
        toxicity.select_terms = keep
    assert np.mean([(model.score(t) >= 0.5) == v for (_, t, _), v in zip(rows, y)]) > 0.95
    assert toxicity.toxicity(frame(spark, rows[:50]), marks).count() == 50


def test_scorer_equals_score():
    terms = np.unique(np.concatenate([toxicity.text_terms(t) for t in ("alpha beta", "gamma Beta delta")]))
    rng = np.random.default_rng(1)
    model = toxicity.Machine(terms, -0.3, rng.normal(size=len(terms)), rng.normal(size=(len(terms), 8)))
    fast = toxicity.Machine.unpack(model.pack()).scorer()
    for text in (None, "", "alpha", "Beta gamma alpha alpha", "unknown words"):
        assert abs(fast(text) - model.score(text)) < 1e-12


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_scores_of_hard_rows(spark, operator):
    docs = frame(spark, HARD)
    both = spark.createDataFrame([(1, 0, 1), (7, 1, 0), (7, 1, None), (None, 0, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (both, both.filter("false"), both.filter("doc_id = 7")):
        got = operator(docs, labels).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _, _ in HARD)
        assert all(0 <= r.score <= 1 for r in got)
    assert operator(docs.filter("false"), both).count() == 0


def test_language_of_hard_rows(spark):
    got = {(r.doc_id, r.lang_pred, r.score) for r in language.languages(frame(spark, HARD)).collect()}
    unknown = {i for i, p, _ in got if p == language.UNKNOWN}
    assert {1, 2, 3, 4} <= unknown and all(s == 0 for i, _, s in got if i in unknown)
    assert all(0 <= s <= 1 for _, _, s in got)
    assert language.languages(frame(spark, HARD).filter("false")).count() == 0
    assert {r.lang_pred for r in language.languages(frame(spark, [(3, "abc", None)])).collect()} == {"und"}


def test_mixture_of_languages():
    rng = np.random.default_rng(8)
    sets = [[f"{c}{v}" for c in cs for v in "aeiou"] for cs in ("bdg", "ptk", "mnl")]
    speak = lambda k, n: " ".join("".join(rng.choice(sets[k], 3)) for _ in range(n))
    counts = np.full((language.BUCKETS, 3), 0.5)
    for k in range(3):
        np.add.at(counts[:, k], language.trigrams(speak(k, 4_000)), 1)
    log_p = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    texts = [speak(0, 200), speak(1, 100) + " " + speak(2, 300), speak(2, 3)]
    got = language.mixtures([language.trigrams(t) for t in texts], log_p)
    assert got[0].argmax() == 0 and (got[0] > 0).sum() == 1
    assert abs(got[1][1] - 0.25) < 0.06 and abs(got[1][2] - 0.75) < 0.06 and got[1][0] == 0
    assert got[2].argmax() == 2


def test_temperature_mends_scale():
    rng = np.random.default_rng(2)
    logit = rng.normal(0, 2, 4_000)
    y = (rng.random(4_000) < 1 / (1 + np.exp(-logit))).astype(float)
    assert 2.6 < quality.temperature(3 * logit, y, np.ones(4_000)) < 3.4


# nearest neighbours

def brute(rows, k, every):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[i] = min(v, fine.get(i, v))
    out = {}
    for i, v in fine.items():
        if i % every == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), j) for j, w in fine.items() if j != i and len(w) == len(v)]
            out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def test_neighbours_of_hard_rows(spark):
    rng = np.random.default_rng(4)
    whole = lambda n: [float(x) for x in rng.integers(-4, 5, n)]  # noqa: E731  exact products, many ties
    rows = [(i, whole(4)) for i in range(300)] + [(i, [1.0, 2.0, 0.0, 1.0]) for i in range(300, 380)]
    rows += [(400, None), (420, []), (440, [0.0] * 4), (460, [1.0, None, 0.0, 0.0]), (480, [float("nan"), 1.0, 1.0, 1.0]),
             (500, [float("inf"), 0.0, 0.0, 0.0]), (520, [-0.0, 2.0, 0.0, 1.0]), (521, [0.0, 2.0, 0.0, 1.0]), (540, [1.0, 2.0]),
             (541, [3.0, 1.0]), (None, [1.0] * 4), rows[20], (40, [9.0, 9.0, 9.0, 9.0]), (560, [7.0])]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    want = brute(rows, 20, 20)
    for shard_rows, block in ((10_000, 1_000), (60, 7)):
        got = {}
        for r in neighbours.nearest(vectors, shard_rows=shard_rows, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
            assert r.rank == len(got[r.query_id])
        assert set(got) == {i for i, near in want.items() if near}
        for i, near in got.items():
            assert [s for _, s in near] == [s for _, s in want[i]]
            assert len(set(near) & set(want[i])) >= 0.9 * len(near)
    assert neighbours.nearest(vectors.filter("false")).count() == 0


def test_recall(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = vectors.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    got = {}
    for r in neighbours.nearest(vectors, shard_rows=2_000).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.argsort(-score)[:20]].tolist()))
    assert hits / (20 * len(got)) > 0.97


def test_contexts_equal_a_plain_loop():
    """Sums across the edges of a step, next to gaps and for a text shorter than the window, against index vectors."""
    index, rng = quality.index_vectors(), np.random.default_rng(4)
    places, signs = quality._entries(index)
    for n in (1, 2, 3, quality.STEP + 1, 2 * quality.STEP + 5):
        ids = rng.integers(0, 9, n).astype(np.uint16)
        total, count = np.zeros((quality.BUCKETS, quality.DIMS), np.int64), np.zeros(quality.BUCKETS, np.int64)
        quality._add_contexts(ids, places, signs, total, count)
        want = np.zeros((9, quality.DIMS))
        for k in range(1, quality.WINDOW + 1):
            for i in range(n - k):
                want[ids[i]] += index[ids[i + k]]
                want[ids[i + k]] += index[ids[i]]
        assert (total[1:9] == want[1:]).all() and not total[9:].any()
        assert (count[:9] == np.bincount(ids, minlength=9)).all()


def test_quality_cuts_texts_once(tables):
    """Sums, training rows and scores read stored token numbers; the scores' plan does not open the texts again."""
    docs = tables["documents"].limit(300)
    plan = quality.quality(docs, tables["labels"])._jdf.queryExecution().optimizedPlan().toString()
    assert "ids#" in plan and "text#" not in plan
    got = {r.doc_id: (r.held_out, np.frombuffer(r.ids, "<u2").tolist()) for r in quality.token_rows(docs).collect()}
    cut = quality.Tokens()
    assert got == {r.doc_id: (crc(r.doc_id, 5) == 0, cut(r.text).tolist()) for r in docs.collect()}
