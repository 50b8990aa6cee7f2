"""Benchmark decontamination with suffix arrays over the training texts.

Each slice of training texts is a shard: its words become numbers (0 for words that no test item has), the suffixes
that can hold a whole window are sorted into the shard's suffix array, and every test suffix is searched in it by
bisection, all at once. The range that a suffix finds holds the locations of its verbatim matches; runs of matches
give the longest. Shards need nothing from one another, so no row is shuffled.

The test set goes out in blocks of at most `BLOCK_BYTES` of text, packed into arrays on the driver (about ten times
that) and broadcast; one pass over the training texts searches all blocks, one after the other, and a worker holds one
at a time. An item longer than a block is cut into pieces that share width - 1 words, so that no window is lost; its
longest match then ends with a block.

Words are maximal runs of characters other than ASCII non-alphanumerics, A-Z lower-cased. A window is `width`
consecutive words of an item, or the whole item where it has fewer.

Defined results: null texts have no words and are never hit; items with a null or empty text, or without words, have
no window; windows of an item with a null id are hit like any other, and only the list of items leaves them out; items
that share an id count once; texts of any length are searched whole; repeated rows are judged alike; an empty table
gives an empty result, an empty benchmark leaves all clean; input columns pass through, except those that are added.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

BLOCK_BYTES = 8 << 20

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Lower-cases A-Z and makes every other ASCII non-alphanumeric a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class TestSet:
    """The windows of a block of items, packed for bisection."""

    __test__ = False  # not a test class

    def __init__(self, items: list[tuple[str | None, bytes, int]], width: int):
        """items: id, text and the number of its first word within the item."""
        self.width = width
        cut = [(i, split_words(t), at) for i, t, at in items]
        cut = [x for x in cut if x[1]]
        words = [*dict.fromkeys(w for _, ws, _ in cut for w in ws)]
        self.words = b" ".join(words)
        self._number(words)
        bits = max(1, len(words).bit_length())
        self.bits, self.per = bits, max(1, 62 // bits)
        self.packs = -(-width // self.per)
        self.items = [*dict.fromkeys(i for i, _, _ in cut if i is not None)]
        number = {i: k for k, i in enumerate(self.items)} | {None: -1}
        rows, own, at = [], [], []
        for item, ws, first in cut:
            n = np.array([self.number[w] for w in ws], np.int64)
            size = min(width, len(n))
            part = np.zeros((len(n) - size + 1, width), np.int64)
            part[:, :size] = np.lib.stride_tricks.sliding_window_view(n, size)
            rows.append(part)
            own.append(np.full(len(part), number[item], np.int64))
            at.append(np.arange(first, first + len(part)))
        every = np.concatenate(rows) if rows else np.zeros((0, width), np.int64)
        keys = self.pack(every)
        order = np.lexsort(keys[::-1])
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        first = np.flatnonzero(new)
        #: distinct windows: their sizes, and the places where items have them, first[k] to first[k + 1]
        padded = every[order[first]]
        self.sizes = (padded > 0).sum(axis=1)
        self.first = np.append(first, len(order))
        self.own, self.at = (np.concatenate(x)[order] if x else np.zeros(0, np.int64) for x in (own, at))
        self.least = int(self.sizes.min()) if len(self.sizes) else 0
        self.low = [k[order[first]] for k in keys]
        #: starts of windows, by their first words, as far as the shortest window goes (two at most)
        self.head = min(2, self.least)
        self.heads = np.unique(padded[:, 0] if self.head < 2 else padded[:, 0] << bits | padded[:, 1])
        padded[np.arange(width) >= self.sizes[:, None]] = (1 << bits) - 1
        self.high = self.pack(padded)

    def _number(self, words: list[bytes]) -> None:
        self.number = {w: k + 1 for k, w in enumerate(words)}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "number"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._number(self.words.split(b" ") if self.words else [])

    def pack(self, rows: np.ndarray) -> list[np.ndarray]:
        """Columns of numbers as few integers that compare as the rows do."""
        out = []
        for a in range(0, self.packs * self.per, self.per):
            key = np.zeros(len(rows), np.int64)
            for c in range(a, a + self.per):
                key = key << self.bits | (rows[:, c] if c < rows.shape[1] else 0)
            out.append(key)
        return out


def suffix_array(ids: np.ndarray, test: TestSet) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts of the shard's suffixes in order, and their packed first words.

    Left out are suffixes that cannot hold a window: those that meet a word of no item, or the text's end (both 0),
    within the shortest window, and those whose first words start no window.
    """
    n = len(ids)
    padded = np.concatenate([ids, np.zeros(test.width + 1, np.int64)])
    start = ids > 0
    if test.head == 2:
        pair = padded[:n] << test.bits | padded[1 : n + 1]
        at = np.flatnonzero(start & (padded[1 : n + 1] > 0))
        key = pair[at]
    else:
        at = np.flatnonzero(start)
        key = ids[at]
    near = np.searchsorted(test.heads, key)
    at = at[test.heads[np.minimum(near, len(test.heads) - 1)] == key]
    for k in range(test.head, test.least):
        at = at[padded[at + k] > 0]
    rows = np.zeros((len(at), test.width), np.int64)
    alive = np.ones(len(at), bool)
    for k in range(test.width):
        own = padded[at + k]
        alive &= own > 0
        rows[:, k] = np.where(alive, own, 0)
    keys = test.pack(rows)
    order = np.lexsort(keys[::-1])
    return at[order], [k[order] for k in keys]


def bisect(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """For each wanted row, where it would go among the sorted rows of `keys`."""
    low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) >> 1
        before, level = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for k, w in zip(keys, wanted, strict=True):
            a, b = k[middle], w[open_]
            before |= level & (a < b)
            level &= a == b
        if right:
            before |= level
        low[open_] = np.where(before, middle + 1, low[open_])
        high[open_] = np.where(before, high[open_], middle)
    return low


def matches(ids: np.ndarray, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """Start and window number of every occurrence of a window in the shard, by start."""
    starts, keys = suffix_array(ids, test)
    if not len(starts):
        return starts, starts
    low, high = bisect(keys, test.low, False), bisect(keys, test.high, True)
    n = high - low
    window = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = starts[low[window] + offset]
    order = np.lexsort((window, at))
    return at[order], window[order]


def judge(texts: list[list[bytes]], test: TestSet, found: list) -> None:
    """Adds what the block has of the texts (their words) to `found`: spans, items and longest match of each text."""
    if not len(test.sizes):
        return
    look = test.number.get
    numbers: list[int] = []
    first, total = [], 0
    for ws in texts:
        first.append(total)
        numbers += [look(w, 0) for w in ws]
        numbers.append(0)
        total += len(ws) + 1
    at, window = matches(np.array(numbers, np.int64), test)
    bound = np.searchsorted(at, [*first, total])
    for d in np.flatnonzero(np.diff(bound)):
        spans, items, longest = found[d]
        items = {*items}
        runs: dict[tuple, int] = {}
        last = -2
        for p, w in zip((at[bound[d] : bound[d + 1]] - first[d]).tolist(), window[bound[d] : bound[d + 1]].tolist(), strict=True):
            if p > last:
                old, runs = (runs if p == last + 1 else {}), {}
                last = p
            size = int(test.sizes[w])
            for k in range(test.first[w], test.first[w + 1]):
                item, j = int(test.own[k]), int(test.at[k])
                runs[item, j] = max(runs.get((item, j), 0), old.get((item, j - 1), size - 1) + 1)
                longest = max(longest, runs[item, j])
                if item >= 0:
                    items.add(test.items[item])
            spans.append([p, p + size])
        found[d] = (_merged(spans), items, longest)


def _merged(spans: list) -> list:
    """Spans that touch or overlap as one, in order."""
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def test_blocks(benchmark: DataFrame, item: str, text: str, width: int, block_bytes: int):
    """The benchmark's rows in blocks of about `block_bytes`: (id, text, number of its first word); one at a time on the driver."""
    own = benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{text}`").cast("binary").alias("t")).filter("t is not null")
    held, size = [], 0
    for r in own.toLocalIterator():
        text_, at = bytes(r.t), 0
        if len(text_) > block_bytes:
            ws = split_words(text_)
            step = max(width, len(ws) * block_bytes // len(text_))
            parts = [(b" ".join(ws[a : a + step + width - 1]), a) for a in range(0, max(1, len(ws) - width + 1), step)]
        else:
            parts = [(text_, at)]
        for part, at in parts:
            if held and size + len(part) > block_bytes:
                yield held
                held, size = [], 0
            held.append((r.i, part, at))
            size += len(part) + len(r.i or "") + 64
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10, keep_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with n_words, spans, items, longest_match, n_hit, n_items and contaminated; reads the benchmark when called."""
    context = docs.sparkSession.sparkContext
    keep = [c for c in docs.columns if c != text or keep_text]
    added = {"n_words": "long", "spans": "array<struct<start:long,end:long>>", "items": "array<string>", "longest_match": "long"}
    blocks = [context.broadcast(TestSet(rows, width)) for rows in test_blocks(benchmark, item, item_text, width, block_bytes)]

    def start():
        def run(texts):
            cut = [split_words(t) for t in texts]
            found: list = [([], set(), 0) for _ in cut]
            for b in blocks:
                judge(cut, b.value, found)
                if len(blocks) > 1:
                    vars(b).pop("_value", None)  # read again for the next slice, so that one block at a time is held
            return [[len(ws) for ws in cut], [[{"start": a, "end": b} for a, b in f[0]] for f in found], [sorted(f[1]) for f in found], [f[2] for f in found]]

        return run

    inner = "_d_text"
    out = map_texts(docs.withColumn(inner, F.col(f"`{text}`")), inner, added, start, keep)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long"), "contaminated": F.size("spans") > 0})


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of `docs`, as they are, without the affected ones."""
    held = docs.select(*[F.col(f"`{c}`").alias(f"_k_{c}") for c in docs.columns])
    judged = contamination(held, benchmark, f"_k_{text}", keep_text=True, **how)
    return judged.filter("not contaminated").select(*[F.col(f"`_k_{c}`").alias(c) for c in docs.columns])
