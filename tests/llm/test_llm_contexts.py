"""Unseen identifiers by their contexts, at all shares of seeds, and contexts that must stay silent."""

import random

import pytest

from marketgrid.llm import pii

SCHEMA = "doc_id long, text string"


def luhn_number(rng):
    head = "4" + "".join(rng.choices("0123456789", k=14))
    return next(head + c for c in "0123456789" if pii.luhn(head + c))


def seed_of(kind, rng):
    if kind == "phone":
        return f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    if kind == "email":
        return f"user{rng.randrange(10**6)}@mail{rng.randrange(100)}.org"
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    return luhn_number(rng)


def unseen_of(kind, rng):
    if kind == "phone":
        return f"{rng.randrange(200, 999)}-555-{rng.randrange(1000, 9999)}"
    if kind == "email":
        return f"user{rng.randrange(10**6)} [at] mail{rng.randrange(100)} dot org"
    if kind == "ip":
        return rng.choice(["[.]".join(str(rng.randrange(256)) for _ in range(4)), f"fe80::{rng.randrange(1, 9999):x}:{rng.randrange(1, 9999):x}",
                           " dot ".join(str(rng.randrange(256)) for _ in range(4))])
    n = luhn_number(rng)
    return "/".join(n[k:k + 4] for k in range(0, 16, 4))


CONTEXT = {"phone": "please call us at", "email": "kindly write me via", "ip": "login came from", "card": "paid with card"}


@pytest.mark.parametrize("unseen", [10, 50, 90])
def test_unseen_at_all_shares(spark, unseen):
    """Every unseen identifier of every kind is found whole, be it one in ten or nine in ten; silence where it should be."""
    rng, rows, want = random.Random(unseen), [], {}
    for kind, context in CONTEXT.items():
        for k in range(100):
            token = (unseen_of if k < unseen else seed_of)(kind, rng)
            text = f"Some words first, {context} {token} today"
            if k < unseen:
                want[len(rows)] = (kind, text.index(token), text.index(token) + len(token))
            rows.append((len(rows), text))
    texts = [f"our order number is {rng.randrange(10**7, 10**8)} today" for _ in range(30)]      # never a seed
    texts += [f"the mixed context holds {seed_of(kind, rng)} here" for _ in range(20) for kind in ("phone", "card")]
    texts += [f"the mixed context holds {unseen_of('phone', rng)} here" for _ in range(20)]
    texts += [f"the dated context holds {seed_of('phone', rng)} now" for _ in range(10)]
    texts += [f"the dated context holds 2024-0{1 + k % 9}-1{k % 9} now" for k in range(20)]
    rows += list(enumerate(texts, len(rows)))
    got = pii.personal_data(spark.createDataFrame(rows, SCHEMA)).collect()
    base = {i: {(k, s, e) for s, e, k, ok in pii.base_matches(t) if ok} for i, t in rows}
    added = {}
    for r in got:
        spans = {(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)}
        assert base[r.doc_id] <= spans
        if spans - base[r.doc_id]:
            added.setdefault(r.doc_id, set()).update(spans - base[r.doc_id])
    assert added == {i: {x} for i, x in want.items()}


def test_scores_against_plain_sums(spark):
    """Pattern scores of all rounds as a plain loop over the edges gives them."""
    rng, edges = random.Random(5), {}
    for p in range(30):
        for _ in range(rng.randrange(3, 14)):
            i = rng.randrange(60)
            kinds, seed = ([["phone"], ["card"], ["phone", "card"], []][i % 4], None) if i % 3 else ([["phone", "card"][i % 2]], ["phone", "card"][i % 2])
            edges[p, i] = (seed, kinds, rng.randrange(1, 5))
    rows = [(p, i, seed, k, at == 0, n) for (p, i), (seed, kinds, n) in edges.items() for at, k in enumerate(kinds or [None])]
    frame = spark.createDataFrame(rows, "pattern long, instance long, seed string, kind string, lead boolean, n long")
    want = {}
    for p in range(30):
        own = [(i, *e) for (q, i), e in edges.items() if q == p]
        for kind in pii.KINDS:
            mass, seeds = sum(n for _, s, _, n in own if s == kind), sum(s == kind for _, s, _, _ in own)
            if seeds >= 2:
                want[p, kind] = mass / (mass + sum(n for _, _, ks, n in own if kind not in ks) + 1)
    for _ in range(2):
        worth = {}
        for (p, i), (seed, kinds, _) in edges.items():
            for kind in kinds:
                if seed is None and want.get((p, kind), 0) >= 0.5:
                    worth[i, kind] = max(worth.get((i, kind), 0), want[p, kind] * pii.DAMPING)
        new = dict(want)
        for p in range(30):
            own = [(i, *e) for (q, i), e in edges.items() if q == p]
            for kind in pii.KINDS:
                seeds = sum(s == kind for _, s, _, _ in own)
                found = [n * worth[i, kind] for i, s, ks, n in own if s is None and kind in ks and (i, kind) in worth]
                if found and seeds + len(found) >= 2:
                    share = (sum(n for _, s, _, n in own if s == kind) + sum(found)) / (sum(n for *_, n in own) + 1)
                    new[p, kind] = max(new.get((p, kind), 0), share)
        want = new
    got = {(r.pattern, r.kind): r.score for r in pii.pattern_scores(frame, 3, 2, 0.5).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 10


def test_shapes():
    """Long local parts are no address, version numbers and times no ip; base matches bar candidates."""
    def found(text):
        return [(text[o["start"]:o["end"]], o["kinds"]) for o in pii.occurrences(text, pii.base_matches(text)) if not o["seed"]]
    assert found("x" * 70 + " [at] mail dot org 1") == []
    assert found("at 12:30:45 fe80::1 and 1::2::3") == [("fe80::1", ["ip"])]
    assert found("10[.]0[.]0[.]7 or 300[.]1[.]1[.]1") == [("10[.]0[.]0[.]7", ["ip"])]
    assert found("1.2.3.4 and 2024-01-15") == [("2024-01-15", [])]
    assert found(" ." * 30_000 + "1") == [] and found("1 dot " * 20_000) != [] and found(":" * 50_000 + "7") == []
