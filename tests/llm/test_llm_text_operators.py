"""Personal data, decontamination, substrings, packing and licenses against brute force, with hard rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from marketgrid.llm import decontaminate, licenses, packing, pii, substring

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _id string, _hash string, row string, "
          "score string, key string, spans string, added string")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, *"abcdefg") for i, t in rows], SCHEMA)


def hard_rows():
    rng = random.Random(4)
    vocabulary = [f"wörd{k}" for k in range(400)] + ["the", "of", "x.y", "1,5"]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 12, 13, 14, 60, 200])))) for k in range(40)]
    passage = " ".join(rng.choices(vocabulary, k=55))
    for k in range(40, 60):
        head, tail = (" ".join(rng.choices(vocabulary, k=rng.randrange(30))) for _ in range(2))
        rows.append((k, f"{head}\n{passage}\t{tail}"))
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, "a b " * 9_000), (64, rows[3][1]), (65, rows[45][1]), (66, "one " * 30)]
    rng.shuffle(rows)
    return rows + [rows[0], (rows[1][0], "another text under the same id " * 4), (None, rows[2][1]), (None, passage), (-5, passage)]


ROWS = hard_rows()


# personal data

def brute_base(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(s, e, pii.KINDS[k]) for s, k, e in sorted(out)]


PII_TEXTS = [
    None, "", "no data", "a@b.c%x@d.e", "@b.c x@ y@@z.q a.b@c-d.e.f.", "ä.b@c.de", "1.2.3.4.5.6.7.8.9", "1.2.3.256 1.2.3", "0001.02.3.255",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (212) 555-0100 +49 30 1234567. +1 2", "+1234567890123456", "1" * 3_000,
    "+" * 50 + "1" + "2" * 11, "a" * 20_000 + "@x.y", "٣.٣.٣.٣ 5.5.5.5", "x@y.z.@a.b", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 +1 555 555 5555\n+2",
]


@pytest.mark.parametrize("text", PII_TEXTS)
def test_base_spans(text):
    assert [(s, e, k) for s, e, k, ok in pii.base_matches(text) if ok] == brute_base(text)


def test_base_spans_random():
    rng = random.Random(1)
    for _ in range(3_000):
        text = "".join(rng.choices("12509+.-@ ()aZ%é", k=rng.randrange(60)))
        assert [(s, e, k) for s, e, k, ok in pii.base_matches(text) if ok] == brute_base(text), text


def test_personal_data_query(spark):
    rng = random.Random(2)
    phones = [f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}" for _ in range(12)]
    rows = [(k, f"Some words. Please call us at {p} today") for k, p in enumerate(phones)]
    rows += [(50, "Now please call us at 555-0199 today"), (51, "the number 5550199 stands alone"), (52, "us at 77")]
    rows += [(100 + k, t) for k, t in enumerate(PII_TEXTS)] + [(None, "a@b.cd"), (None, "a@b.cd"), rows[0]]
    got = pii.personal_data(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text in rows:
        base = brute_base(text)
        r = by_id[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, _, k in base) for x in pii.KINDS)
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        if i != 50:
            assert r.spans == joined and r.n_added == 0
    assert by_id[50].spans == "phone:22:30"      # found by its context alone
    assert pii.personal_data(frame(spark, rows).filter("false")).count() == 0


def test_redact(spark):
    docs = frame(spark, [(1, "mail a@b.cd or 4111 1111 1111 1111!"), (2, None), (None, "plain"), (1, "mail a@b.cd or 4111 1111 1111 1111!")])
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text, r.n_chars, r._id) for r in got.collect()) == sorted(
        [("1", "mail [EMAIL] or [CARD]!", 23, "a")] * 2 + [("2", None, None, "a"), ("None", "plain", 5, "a")], key=str)
    assert pii.redact_text("0123456789", [(1, 4, "card"), (3, 6, "phone"), (8, 9, "ip")]) == "0[CARD]67[IP]9"


# decontamination

def test_decontamination(spark):
    rng = random.Random(5)
    vocabulary = [f"t{k}" for k in range(80)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(8, 40))) + ". " + " ".join(rng.choices(vocabulary, k=4)) + ".")
             for k in range(60)]
    items += [(60, "What is this? Answer: that"), (61, None), (62, ""), (63, "..."), (5, items[5][1]), (5, "other words entirely here " * 2), (None, items[7][1])]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(300)))) for k in range(60)]
    planted = {}
    for k in range(60, 100):
        item = items[rng.randrange(60)]
        planted[k] = item[0]
        rows.append((k, " ".join(rng.choices(vocabulary, k=rng.randrange(120))) + "\n" + item[1].upper() + " " + " ".join(rng.choices(vocabulary, k=9))))
    rows += [(200, None), (201, ""), (202, "t1 " * 30_000), rows[70], (None, rows[70][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)

    def brute(text):
        found, out = decontaminate.words(text), set()
        for i, t in items:
            want = decontaminate.words(t)
            if want and any(found[k:k + len(want)] == want for k in range(len(found) - len(want) + 1)):
                out.add(i)
        return out

    for per_index in (10_000, 20):
        got = decontaminate.contaminated(docs, benchmark, per_index).collect()
        pairs = {(r.doc_id, r.item_id) for r in got}
        want = {(i, j) for i, t in rows for j in brute(t)}
        assert want <= pairs
        assert all(r.question_overlap >= 0.8 and r.answer_overlap >= 0.8 for r in got)
        kept = decontaminate.drop_contaminated(docs, benchmark, per_index)
        assert kept.columns == docs.columns
        hit = {i for i, _ in pairs}
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in rows if i not in hit)
    empty = benchmark.filter("false")
    assert decontaminate.contaminated(docs, empty).count() == 0 and decontaminate.drop_contaminated(docs, empty).count() == len(rows)
    assert decontaminate.contaminated(docs.filter("false"), benchmark).count() == 0


def test_wand_equals_full_scores():
    rng = np.random.default_rng(2)
    postings = [(i, f"t{t}", float(rng.random() + 0.1)) for i in range(150) for t in sorted(rng.choice(60, 12, replace=False))]
    index = decontaminate.Index.build(postings, [(i, "x y z") for i in range(150)])
    own = {i: sum(w for j, _, w in postings if j == i) for i in range(150)}
    for _ in range(60):
        query = sorted(rng.choice(60, 18, replace=False))
        names = {f"t{t}" for t in query}
        score = {i: sum(w for j, t, w in postings if j == i and t in names) / own[i] for i in range(150)}
        got = dict(index.search(np.array(sorted(index.terms[t] for t in names if t in index.terms)), 0.45))
        assert sorted(got) == sorted(i for i, s in score.items() if s >= 0.45)
        assert all(abs(got[i] - score[i]) < 1e-9 for i in got)


# substrings

def brute_substring(rows, window):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, w in split:
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            first[k] = min(first.get(k, (2, 0)), order(i))
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < order(i):
                gone.update(range(p, p + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [13, 4])
def test_substrings(spark, window):
    got = substring.without_repeats(frame(spark, ROWS), window).collect()
    assert sorted(map(tuple, got), key=str) == brute_substring(ROWS, window)


def test_substring_levels(spark):
    rows = [(k, t) for k, (i, t) in enumerate(ROWS[:40])]
    split = [(t or "").split() for _, t in rows]
    got = substring.levels(frame(spark, rows))
    lengths = [n for n, _ in got]
    for n, found in [*got, ((lengths or [13])[-1] * 2, None)]:
        held = {}
        for i, w in enumerate(split):
            for p in range(len(w) - n + 1):
                held.setdefault(tuple(w[p:p + n]), set()).add((i, p))
        want = {x for places in held.values() if len({i for i, _ in places}) > 1 for x in places}
        have = {(r.ord, int(p)) for r in found.collect() for p in substring._positions(r.starts, r.runs, n)} if found else set()
        assert have == want
    assert substring.without_repeats(frame(spark, rows).filter("false")).count() == 0


# packing

def plain_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    return [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_tokenizer():
    encode = packing.Encoder(packing.default_tokenizer())
    assert encode.ranks
    rng = random.Random(6)
    texts = ["", " ", "  ", "a  b", "a ", "a\n b", "a\n\n b", "a \n b", "it's d'or", "<|endoftext|> x", "a\x1c b", "a　 b  c", "é ñ 12,5 —"]
    texts += ["".join(rng.choices(" \n\tab'1.é<|>　\x85", k=rng.randrange(40))) for _ in range(800)] + [t or "" for _, t in ROWS]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2  {chr(c)} \n{chr(c)}." for c in range(1, 0xD800)]
    for text, ids in zip(texts, plain_ids(texts)):
        assert encode(text) == ids, repr(text)


def test_added_tokens_and_long_blanks():
    encode = packing.Encoder(packing.default_tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x" + " " * 2_000_000 + "y", "\n" * 1_500_000, " \n\t" * 700_000 + "z", "ab " * 400_000]
    for text, ids in zip(texts, plain_ids(texts)):
        assert encode(text) == ids


def test_search_ends_without_a_step():
    rng = np.random.default_rng(8)
    for _ in range(20):
        bins = packing.Bins(rng.integers(1, 60, 120), 100)
        bins.best_fit()
        bins.search()
        before = [list(i) for i in bins.items]
        left = [b for b in range(len(bins.items)) if bins.items[b] and bins.fill[b] < 100]
        assert not any(bins.fill_up(b, [o for o in left if o != b]) for b in left)
        assert [list(i) for i in bins.items] == before


@pytest.mark.parametrize("capacity,group", [(2048, 4096), (64, 16)])
def test_packing(spark, capacity, group):
    got = packing.pack_documents(frame(spark, ROWS), capacity=capacity, group=group).collect()
    want = []
    for (i, _), ids in zip(ROWS, plain_ids([t or "" for _, t in ROWS])):
        ids += b"\0\0\0\0"
        n = len(ids) // 4
        edges = [0] + [e for e in range(n % capacity or capacity, n + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(x[3] for x in want) // capacity)
    assert len(bins) <= least * 1.02 + 1
    assert packing.pack_documents(frame(spark, ROWS).filter("false")).count() == 0


def test_search_empties_bins():
    sizes = np.random.default_rng(1).integers(500, 1100, 400)
    plain = packing.Bins(sizes, 2048)
    plain.best_fit()
    where, offset = packing.pack(sizes, 2048)
    assert where.max() + 1 < len(plain.items)
    assert np.bincount(where, sizes).max() <= 2048


# licenses

def test_licenses(spark):
    own = licenses.TEMPLATES
    rows = [(k, f"Ärger davor. {t} Danach.") for k, t in enumerate(own.values())]
    near = own["MIT-text"].replace("free of charge", "for free").upper()
    rows += [(100, near), (101, "nothing about the license here"), (102, None), (103, ""), (104, "x " * 40_000 + own["MIT"]),
             (105, own["MIT"] + " and İ " + own["GPL-3.0"]), (None, own["MIT"]), rows[0], rows[0]]
    got = licenses.licenses(frame(spark, rows)).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.license, r.start, r.end, r.coverage))
    texts = dict(rows)
    for k, name in enumerate(own):
        assert found[k][0][0] == name and found[k][0][3] == 1.0
        part = texts[k][found[k][0][1]:found[k][0][2]]
        assert licenses.words(part) == licenses.words(own[name])
    assert found[100][0][0] == "MIT-text" and found[100][0][3] > 0.95
    assert found[104] == [("MIT", 80_000, 80_030, 1.0)]
    assert [texts[105][s:e] for _, s, e, _ in found[105]] == ["Released under the MIT License", own["GPL-3.0"][:-1]]
    assert not {101, 102, 103} & set(found) and len(found[None]) == 1
    assert len(found[0]) == 3
    assert licenses.licenses(frame(spark, rows).filter("false")).count() == 0
    assert licenses.licenses(frame(spark, rows), {}).count() == 0
