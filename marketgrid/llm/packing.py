"""Pack tokenized documents into sequences: best fit, then local search by moves and swaps.

Pieces are dealt into groups of about GROUP pieces by a hash of a stored row number. In a group, best fit decreasing
comes first; then documents are moved or exchanged (one for one, two for one) between bins that are not full, each
step raising the sum of squared fills, until bins run empty. The thinly filled bins of all groups are then packed once
more, in groups again, so that grouping costs next to nothing.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrid.llm.common import arrow_map, stage

CAPACITY = 2048
GROUP = 4096
END = b"\0\0\0\0"
#: Bins below this share of the capacity are opened again in the second round.
THIN = 0.97
# Fixed value: the pattern at which byte-level tokenizers cut a text before merging
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids as little-endian 32-bit bytes, by a tokenizer file of the `tokenizers` library.

    A byte-level BPE whose merges make the ids in order is the same function as one over ranks, so its vocabulary is
    handed to `tiktoken`, which is several times as fast; any other file goes through `tokenizers` itself. So does a
    text that holds the string of an added token (the library gives it the token's id), and one whose blanks run on for
    longer than the faster library's pattern matcher can follow.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.slow = path, None
        self.added = [x["content"] for x in spec.get("added_tokens", ())]
        self.ranks = byte_ranks(spec)
        if self.ranks:
            self.fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=self.ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.ranks and not any(x in text for x in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:      # the matcher's stack is full
                pass
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """Ids by the `tokenizers` library."""
        from tokenizers import Tokenizer

        self.slow = self.slow or Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes -> id of a plain byte-level BPE, or None where the file describes anything else."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
             and not split.get("add_prefix_space") and not spec.get("normalizer") and not model.get("ignore_merges")
             and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")))
    special = {x["content"] for x in spec.get("added_tokens", ())}
    vocabulary = {k: v for k, v in model["vocab"].items() if k not in special}
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    if not plain or any(vocabulary.get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)):
        return None
    # the usual printable stand-ins: bytes that are no visible Latin-1 character stand from code point 256 on
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    return {bytes(byte_of[c] for c in k): v for k, v in vocabulary.items()}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for all batches of a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, length, crc32 of the ids) of the pieces of one document; only the first one may be shorter."""
    n = len(ids) // 4
    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
    return [(a, b - a, zlib.crc32(ids[4 * a:4 * b])) for a, b in zip(edges, edges[1:])]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row): the pieces of every document, and a number for each."""
    def each(columns: list[list]) -> list[list]:
        encode = encoder(tokenizer)
        out: list[list] = [[] for _ in range(5)]
        for doc_id, text in zip(*columns):
            for k, (start, length, crc) in enumerate(cut(encode(text or "") + END, capacity)):
                for column, value in zip(out, (doc_id, k, start, length, crc)):
                    column.append(value)
        return out

    rows = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"),
                     "doc_id long, piece int, start long, length long, ids_crc32 long", each)
    return rows.withColumn("row", F.monotonically_increasing_id())


class Bins:
    """Bins as lists of item numbers, with their fill."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that still takes it."""
        room: list[tuple[int, int]] = []  # (free, bin), ascending
        for item in np.argsort(-self.sizes, kind="stable"):
            size = int(self.sizes[item])
            at = bisect.bisect_left(room, (size, -1))
            if at < len(room):
                free, b = room.pop(at)
            else:
                free, b = self.capacity, len(self.items)
                self.items.append([])
                self.fill.append(0)
            self.items[b].append(int(item))
            self.fill[b] += size
            if free > size:
                bisect.insort(room, (free - size, b))

    def _change(self, out_of: int, into: int, leave: list[int], come: list[int]) -> None:
        for x in leave:
            self.items[out_of].remove(x)
            self.items[into].append(x)
        for x in come:
            self.items[into].remove(x)
            self.items[out_of].append(x)
        gain = sum(int(self.sizes[x]) for x in leave) - sum(int(self.sizes[x]) for x in come)
        self.fill[out_of] -= gain
        self.fill[into] += gain

    def _options(self, b: int) -> list[tuple[int, list[int]]]:
        """What can leave bin b together: nothing, one item, two items."""
        items = sorted(self.items[b], key=lambda x: int(self.sizes[x]))
        one = [(int(self.sizes[x]), [x]) for x in items]
        two = [(s + t, x + y) for k, (s, x) in enumerate(one) for t, y in one[k + 1:]]
        return [(0, []), *one, *two]

    def fill_up(self, into: int, others: list[int]) -> bool:
        """The best single step into bin `into` from a bin that is no fuller: a move or an exchange."""
        gap = self.capacity - self.fill[into]
        best: tuple[int, int, list[int], list[int]] | None = None
        mine = self._options(into)
        for b in others:
            if b == into or not self.items[b] or self.fill[b] > self.fill[into]:
                continue
            theirs = sorted(self._options(b)[1:], key=lambda o: o[0])
            sums = [s for s, _ in theirs]
            for size, come in mine:
                at = bisect.bisect_right(sums, size + gap) - 1
                while at >= 0 and sums[at] > size and len(come) + len(theirs[at][1]) > 3:
                    at -= 1  # two for two is no step of this search
                if at >= 0 and sums[at] > size and (best is None or sums[at] - size > best[0]):
                    best = (sums[at] - size, b, theirs[at][1], come)
            if best and best[0] == gap:
                break
        if best:
            self._change(best[1], into, best[2], best[3])
        return best is not None

    def search(self, partners: int = 48) -> None:
        """Fill the fuller bins from the emptiest ones until no step is left; every step raises the squared fills.

        A bin tries the `partners` emptiest bins first and all others only when none of these gives a step. Passes
        over the bins are repeated until one makes no step.
        """
        moved = True
        while moved:
            moved = False
            open_bins = sorted((b for b in range(len(self.items)) if self.items[b] and self.fill[b] < self.capacity), key=lambda b: -self.fill[b])
            for into in open_bins:
                while self.items[into] and self.fill[into] < self.capacity:
                    others = sorted((b for b in open_bins if self.items[b] and b != into), key=lambda b: (self.fill[b], b))
                    if not self.fill_up(into, others[:partners]) and not self.fill_up(into, others[partners:]):
                        break
                    moved = True


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item."""
    bins = Bins(sizes, capacity)
    bins.best_fit()
    bins.search()
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for number, items in enumerate(i for i in bins.items if i):
        at = 0
        for x in items:
            where[x], offset[x] = number, at
            at += int(sizes[x])
    return where, offset


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, fill long"


def pack_groups(rows: DataFrame, shift: int, capacity: int, group: int) -> DataFrame:
    """Pack `rows` (pieces with their row number) in groups; sequence numbers are (group << 20) + bin + shift."""
    count = rows.count()
    groups = max(1, -(-count // group))

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending")])
        sizes = table["length"].to_numpy()
        where, offset = pack(sizes, capacity)
        fill = np.bincount(where, sizes).astype(np.int64)
        base = int(table["_group"][0].as_py()) << 20
        return pa.table({c: table[c] for c in (*COLUMNS, "row")} | {
            "sequence_id": pa.array(base + where + shift), "offset": pa.array(offset), "fill": pa.array(fill[where])})

    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(each, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row per piece of every document row.

    A null text counts as empty; a document without text is the single id 0. Documents longer than the capacity are
    cut into pieces of it, the first of them shorter. Pieces of full length are sequences of their own. Rows with null
    ids and repeated rows are packed like any other; an empty table gives no rows; further columns are ignored.
    """
    all_pieces = stage(pieces(docs, tokenizer or default_tokenizer(), capacity), "pieces")
    full = all_pieces.filter(F.col("length") == capacity).select(
        *COLUMNS, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = stage(pack_groups(all_pieces.filter(F.col("length") < capacity), 0, capacity, group), "packed")
    thin = F.col("fill") < int(THIN * capacity)
    kept = first.filter(~thin).select(*COLUMNS, "sequence_id", "offset")
    again = pack_groups(first.filter(thin).select(*COLUMNS, "row"), 1 << 60, capacity, group)
    return full.unionByName(kept).unionByName(again.select(*COLUMNS, "sequence_id", "offset"))
