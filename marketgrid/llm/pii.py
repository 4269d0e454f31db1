"""Personal data: base patterns as seeds, and bootstrapped contextual extraction of what they miss.

Seeds induce lexical patterns: the two words before an entity, the last word before it together with the first one
after it, and the last word with its colon or equals sign. Pattern and instance scores flow over the pattern-instance
graph for a few rounds. A pattern is judged by its seeds against what speaks against it (entities of other kinds, tokens
whose shape fits none); identifier-like tokens that no base pattern knows are reported where a pattern of high confidence
stands around them, and count for the patterns of their other contexts in the next round.
"""

from __future__ import annotations

import bisect
import ipaddress
import re
from itertools import accumulate

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrid.llm.common import arrow_map, fresh, slices, stage

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern needs so many different seeds and this score before it may extract anything.
SUPPORT = 5
CONFIDENCE = 0.8
#: What an instance that is no seed passes on of its pattern's score.
DAMPING = 0.9

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
NUMBER = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
WRITTEN_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20|@)[A-Za-z0-9-]{1,63}"
    r"(?:(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}){0,8}")
WRITTEN_NUMBER = re.compile(r"(?<![\w+])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,18}(?!\w)")
WRITTEN_ADDRESS = re.compile(
    r"(?<![\w.])[0-9]{1,3}(?:(?:\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20|\x20\.\x20|\.)[0-9]{1,3}){3}(?![\w\[])")
LONG_ADDRESS = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
DATE = re.compile(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}")
STRIP = ".,;!?\"'()[]{}<>"


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, found from each @ outward: linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            out.append((start, match.end()))
            free = match.end()
        at = text.find("@", max(at + 1, free))
    return out


def _addresses(text: str) -> list[tuple[int, int, bool]]:
    """Four dotted numbers each, left to right; the flag says that all are at most 255."""
    out = []
    for run in DOTTED.finditer(text):
        parts = list(NUMBER.finditer(text, run.start(), run.end()))
        for k in range(0, len(parts) - 3, 4):
            small = all(len(p.group().lstrip("0")) <= 3 and int(p.group().lstrip("0") or 0) <= 255 for p in parts[k:k + 4])
            out.append((parts[k].start(), parts[k + 3].end(), small))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _is_long_address(text: str) -> bool:
    try:
        return len(text) > 2 and bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def _digits(text: str) -> str:
    return "".join(NUMBER.findall(text))


def _is_card(match: str) -> bool:
    digits = _digits(match)
    return 14 <= len(digits) <= 19 and luhn(digits)


def base_matches(text: str | None) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, valid) of all matches of the base patterns, by start, then kind."""
    if not text or not MARK.search(text):
        return []
    found = [(s, e, "email", True) for s, e in _emails(text)]
    found += [(s, e, "ip", ok) for s, e, ok in _addresses(text)]
    found += [(m.start(), m.end(), "card", _is_card(m.group())) for m in CARD.finditer(text)]
    found += [(m.start(), m.end(), "phone", 10 <= len(_digits(m.group())) <= 15) for m in PHONE.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _patterns(text: str, start: int, end: int) -> list[int]:
    """Hashes of the lexical patterns around a span."""
    before = text[max(0, start - 96):start].split()[-2:]
    after = (text[end:end + 48].split() or ["$"])[0].strip(STRIP).lower()
    words = ["^"] * (2 - len(before)) + [w.strip(STRIP).lower() for w in before]
    forms = [f"2|{words[0]}|{words[1]}", f"b|{words[1]}|{after}"]
    if before and before[-1][-1:] in ":=#":
        forms.append(f"k|{words[1]}")
    return [xxhash.xxh64_intdigest(f.encode("utf-8", "surrogatepass")) - (1 << 63) for f in forms]


def _instance(token: str) -> int:
    return xxhash.xxh64_intdigest("".join(token.lower().split()).encode("utf-8", "surrogatepass")) - (1 << 63)


def occurrences(text: str | None, base: list[tuple[int, int, str, bool]]) -> list[dict]:
    """Seeds and identifier-like candidates with their patterns; `kinds` are those that the shape allows."""
    if not text:
        return []
    out = [{"start": s, "end": e, "seed": k, "kinds": [k], "instance": _instance(text[s:e]), "patterns": _patterns(text, s, e)}
           for s, e, k, ok in base if ok]
    barred = [(s, e) for s, e, k, ok in base if ok or k != "card" or len(_digits(text[s:e])) >= 14]
    starts, ends = [s for s, _ in barred], list(accumulate((e for _, e in barred), max))

    def free(start: int, end: int) -> bool:
        """No base match, failed ones included, reaches into the span."""
        at = bisect.bisect_left(starts, end)
        return at == 0 or ends[at - 1] <= start

    if MARK.search(text) or " at " in text.lower() or "at]" in text or "at)" in text:
        for m in WRITTEN_EMAIL.finditer(text):
            if free(*m.span()) and ("@" in m.group() or re.search(r"[\[({ ]dot[\])} ]|\.", m.group())):
                out.append({"start": m.start(), "end": m.end(), "seed": None, "kinds": ["email"],
                            "instance": _instance(m.group()), "patterns": _patterns(text, *m.span())})
        written = []
        for m in WRITTEN_ADDRESS.finditer(text):
            if free(*m.span()) and all(int(x) <= 255 for x in NUMBER.findall(m.group())):
                written.append((*m.span(), ["ip"]))
        for m in LONG_ADDRESS.finditer(text) if "::" in text or text.count(":") >= 7 else ():
            if free(*m.span()) and _is_long_address(m.group()):
                written.append((*m.span(), ["ip"]))
        taken = [(s, e) for s, e, _ in sorted(written)]
        at = 0
        for m in WRITTEN_NUMBER.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at < len(taken) and taken[at][0] < m.end() or not free(*m.span()):
                continue
            n, date = len(_digits(m.group())), DATE.fullmatch(m.group()) is not None
            kinds = ["phone"] * (7 <= n <= 15 and not date) + ["card"] * (14 <= n <= 19 and luhn(_digits(m.group())))
            written.append((*m.span(), kinds))
        out += [{"start": s, "end": e, "seed": None, "kinds": kinds, "instance": _instance(text[s:e]),
                 "patterns": _patterns(text, s, e)} for s, e, kinds in written]
    return out


OCCURRENCE = "start: long, `end`: long, seed: string, kinds: array<string>, instance: long, patterns: array<long>"


def _hash_of(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"])


def base_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, counts, base spans (start, end, kind) and occurrences, one row per document row."""
    def each(columns: list[list]) -> list[list]:
        ids, hashes, texts = columns
        out: list[list] = [ids, hashes, *([] for _ in KINDS), [], []]
        for text in texts:
            base = base_matches(text)
            spans = [(s, e, k) for s, e, k, ok in base if ok]
            for column, kind in zip(out[2:6], KINDS):
                column.append(sum(k == kind for _, _, k in spans))
            out[6].append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
            out[7].append(occurrences(text, base))
        return out

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return arrow_map(
        docs.select(F.col("doc_id").cast("long"), _hash_of(docs), "text"),
        f"doc_id long, text_hash long, {counts}, base array<struct<start: long, `end`: long, kind: string>>, "
        f"found array<struct<{OCCURRENCE}>>", each)


def pattern_scores(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, kind, score) after `rounds` rounds over the pattern-instance graph.

    `edges` is (pattern, instance, seed, kind, lead, n), a row for each kind that the instance's shape allows (null for
    none); lead marks one of these rows. With `support` different seeds of a kind, a pattern scores the share of these
    seeds among them and what speaks against the kind: seeds of others and instances whose shape doesn't allow it.
    Instances that are merely unknown say nothing, so a context scores alike however many it holds.

    From the second round on, instances that a pattern of `confidence` has extracted count as well, with its score times
    DAMPING, for the patterns of their other contexts; as these were not seen with seeds enough, all their occurrences
    are in the divisor, unknown ones too. Scores never fall from round to round.
    """
    totals = {k: F.struct(
        F.lit(k).alias("kind"), F.count(F.when((F.col("seed") == k) & (F.col("kind") == k), 1)).alias("seeds"),
        F.coalesce(F.sum(F.when((F.col("seed") == k) & (F.col("kind") == k), F.col("n"))), F.lit(0)).alias("mass"),
        F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias("fitting"),
        F.sum(F.when(F.col("lead"), F.col("n"))).alias("total")) for k in KINDS}
    shape = stage(edges.groupBy("pattern").agg(F.array(*totals.values()).alias("all")).select(
        "pattern", F.inline("all")).filter("fitting > 0"), "shapes")
    first = shape.filter(F.col("seeds") >= support).select("pattern", "kind", (
        F.col("mass") / (F.col("mass") + F.col("total") - F.col("fitting") + 1)).alias("score"))
    scores = stage(first, "patterns")
    unknown = edges.filter("seed is null and kind is not null").select("pattern", "instance", "kind", "n")
    for _ in range(rounds - 1):
        got = unknown.join(scores.filter(F.col("score") >= confidence), ["pattern", "kind"]).groupBy("instance", "kind").agg(
            (F.max("score") * DAMPING).alias("worth"))
        gained = unknown.join(got, ["instance", "kind"]).groupBy("pattern", "kind").agg(
            F.sum(F.col("n") * F.col("worth")).alias("gained"), F.count("*").alias("found"))
        induced = shape.join(gained, ["pattern", "kind"]).filter(F.col("seeds") + F.col("found") >= support).select(
            "pattern", "kind", ((F.col("mass") + F.col("gained")) / (F.col("total") + 1)).alias("score"))
        scores = stage(scores.unionByName(induced).groupBy("pattern", "kind").agg(F.max("score").alias("score")), "patterns")
    return scores


def added_spans(table: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(doc_id, text_hash, added): spans that high-confidence patterns discover beside the base ones."""
    rows = table.select("doc_id", "text_hash", F.explode("found").alias("o")).select("doc_id", "text_hash", "o.*")
    rows = rows.select("*", F.posexplode_outer("kinds").alias("place", "kind")).withColumn(
        "lead", F.coalesce(F.col("place") == 0, F.lit(True))).withColumn("pattern", F.explode("patterns"))
    edges = stage(rows.groupBy("pattern", "instance", "seed", "kind", "lead").agg(F.count("*").alias("n")), "edges")
    sure = pattern_scores(edges, rounds, support, confidence).filter(F.col("score") >= confidence)
    new = rows.filter("seed is null and kind is not null").join(sure, ["pattern", "kind"])
    span = F.struct("start", "end", "kind")
    return new.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(span)).alias("added"))


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("place"), s["end"].alias("end"),
        s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _with_added(docs: DataFrame) -> DataFrame:
    table = stage(base_table(docs), "pii")
    added = added_spans(table).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "added")
    same = table["doc_id"].eqNullSafe(added["_id"]) & (table["text_hash"] == added["_hash"])
    return table.join(added, same, "left").drop("_id", "_hash", "found")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, one row per document row.

    Counts and digest are those of the base patterns over the whole text; spans also lists what contexts discovered
    (n_added of them), never overlapping a base match. Null and empty texts have no spans, the digest is then that of
    the empty string. Rows with null ids and repeated rows stay; an empty table gives no rows; further columns are
    ignored.
    """
    none = F.array().cast("array<struct<start: bigint, end: bigint, kind: string>>")
    rows = _with_added(docs).withColumn("added", F.coalesce("added", none))
    return rows.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.array_union("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap become one, of the first's kind."""
    out, at = [], 0
    merged: list[list] = []
    for start, end, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced; n_chars, if there, counts the new text. Columns stay.

    Null and empty texts stay as they are; rows with null ids and repeated rows are each redacted; an empty table gives no
    rows.
    """
    own_id, own_hash, more = fresh(docs, "_id", "_hash", "_added")
    added = added_spans(stage(base_table(docs), "pii")).toDF(own_id, own_hash, more)
    match = docs["doc_id"].cast("long").eqNullSafe(added[own_id]) & (_hash_of(docs) == added[own_hash])
    rows = docs.join(added, match, "left").select(*docs.columns, more)
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch):
                texts = []
                for text, also in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                    spans = [(s, e, k) for s, e, k, ok in base_matches(text) if ok]
                    spans += [(x["start"], x["end"], x["kind"]) for x in also or ()]
                    texts.append(redact_text(text, spans) if spans else text)
                columns = list(part.columns)[:-1]
                columns[at] = pa.array(texts, target.field(at).type)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    out = rows.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out
