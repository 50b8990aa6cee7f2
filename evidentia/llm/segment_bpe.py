"""BPE encoding and decoding: a segment tree over adjacent pair ranks.

A leaf holds rank * width + position of the pair that starts there (INFINITE where no merge exists), an inner node
the least of its two children. The root therefore names the leftmost pair of lowest rank. A merge changes three
leaves (the pair itself, its right neighbour's and its left neighbour's) and so three paths to the root; merging ends
when the root is INFINITE. Words of one length are merged side by side as rows of one matrix of trees; long words
have a tree each.

Vocabulary files are those of the tokenizers library with an inverted Split, byte-level symbols and an end-of-word
suffix; no truncation, padding or added tokens. Special strings inside a text become their own token, the library's
default.

Defined results: a null or empty text has no ids and decodes to the empty text; a text and a word of any length are
encoded whole (a long word in n log n steps); a file that asks for other steps is an error; repeated rows encode alike; an empty
table gives an empty result; input columns pass through, except ids, n_tokens and decoded, which are replaced.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
from pyspark.sql import DataFrame

from .common import Memo, map_texts

INFINITE = 1 << 62
#: Words beyond this length have a tree of their own.
SIDE_BY_SIDE = 32
#: Bytes of words, and of chunks, that a worker remembers in each of two generations.
CACHE_BYTES = 16 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for b in range(256):
        out.append(chr(b if b in printable else free))
        free += b not in printable
    return out


def _same_form(about: dict, model: dict) -> None:
    """Raises where a vocabulary file asks for other steps than this module takes."""
    steps = [x["type"] for x in (about.get("normalizer") or {}).get("normalizers", [])]
    before = (about.get("pre_tokenizer") or {}).get("pretokenizers", [{}, {}])
    split, raw = before[0], before[-1]
    plain = all(model.get(k) in (None, False, "", 0) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    cut = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert")
    bytes_ = raw.get("type") == "ByteLevel" and not raw.get("add_prefix_space") and not raw.get("use_regex", True)
    marks = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in about["added_tokens"])
    if steps != ["NFC", "Replace", "Lowercase"] or len(before) != 2 or not (cut and bytes_ and plain and marks) or model["type"] != "BPE" or about.get("decoder"):
        raise ValueError("the vocabulary file asks for another normalizer, cut, model or decoder than this operator has")


class Vocabulary:
    """Ids, merges and cutting rules of a vocabulary file."""

    def __init__(self, path: str):
        import regex

        about = json.loads(open(path, encoding="utf-8").read())
        model = about["model"]
        _same_form(about, model)
        ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in about["added_tokens"]}
        self.token = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.names = [self.token.get(i, "") for i in range(max(self.token) + 1)]
        pattern = about["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.hints = [s[:2].encode() for s in self.special]
        end = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = [ids.get(s, -1) for s in symbols]
        self.last = [ids.get(s + end, -1) for s in symbols]
        self.width = len(self.names)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = {}
        self.made = []
        for rank, (a, b) in enumerate(merges):
            self.pairs.setdefault(ids[a] * self.width + ids[b], rank)
            self.made.append(ids[a + b])
        self.made_of = np.array([*self.made, 0], np.int64)
        self._table()

    def _table(self) -> None:
        """An open-addressing table of the pairs, for whole arrays of lookups."""
        self.bits = max(4, (4 * len(self.pairs)).bit_length())
        keys, ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        for key, rank in self.pairs.items():
            at = self._slot(key)
            while keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            keys[at], ranks[at] = key, rank
        self.keys, self.ranks = keys, ranks

    def _slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no merge."""
        key = left * self.width + right
        with np.errstate(over="ignore"):
            at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(key), -1, np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out


def merge_word(v: Vocabulary, symbols: list[int]) -> list[int]:
    """One word, one tree."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << max(0, (n - 2).bit_length())
    pairs, width, sym = v.pairs, v.width, list(symbols)
    tree = [INFINITE] * (2 * size)
    for i in range(n - 1):
        rank = pairs.get(sym[i] * width + sym[i + 1])
        if rank is not None:
            tree[size + i] = rank * size + i
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n))

    def put(leaf: int, value: int) -> None:
        k = size + leaf
        tree[k] = value
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least

    def key(i: int, j: int) -> int:
        rank = pairs.get(sym[i] * width + sym[j])
        return INFINITE if rank is None else rank * size + i

    while tree[1] < INFINITE:
        rank, i = divmod(tree[1], size)
        gone = after[i]
        sym[i], after[i] = v.made[rank], after[gone]
        before[after[i]] = i
        sym[gone] = -1
        if gone < size:
            put(gone, INFINITE)
        put(i, key(i, after[i]) if after[i] < n else INFINITE)
        if before[i] >= 0:
            put(before[i], key(before[i], i))
    return [x for x in sym if x >= 0]


def merge_rows(v: Vocabulary, rows: np.ndarray) -> list[list[int]]:
    """Words of one length n >= 2, side by side: row r of the matrix `tree` is the tree of word r."""
    count, n = rows.shape
    size = 1 << max(0, (n - 2).bit_length())
    sym = np.concatenate([rows.astype(np.int64), np.full((count, 1), -1, np.int64)], axis=1)
    tree = np.full((count, 2 * size), INFINITE, np.int64)
    for i in range(n - 1):
        rank = v.rank_of(sym[:, i], sym[:, i + 1])
        tree[:, size + i] = np.where(rank >= 0, rank * size + i, INFINITE)
    for k in range(size - 1, 0, -1):
        tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
    after = np.tile(np.arange(1, n + 2), (count, 1))
    before = np.tile(np.arange(-1, n), (count, 1))

    def put(r: np.ndarray, leaf: np.ndarray, value) -> None:
        k = size + leaf
        tree[r, k] = value
        while size > 1:
            k = k >> 1
            if k[0] == 0:
                break
            tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

    def key(r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        rank = v.rank_of(sym[r, i], sym[r, j])
        return np.where(rank >= 0, rank * size + i, INFINITE)

    r = np.flatnonzero(tree[:, 1] < INFINITE)
    while len(r):
        root = tree[r, 1]
        rank, i = root // size, root % size
        gone = after[r, i]
        follow = after[r, gone]
        sym[r, i], sym[r, gone] = v.made_of[rank], -1
        after[r, i] = follow
        before[r, follow] = i
        inside = gone < n - 1
        if inside.any():
            put(r[inside], gone[inside], INFINITE)
        put(r, i, np.where(follow < n, key(r, i, np.minimum(follow, n)), INFINITE))
        left = before[r, i]
        has = left >= 0
        if has.any():
            put(r[has], left[has], key(r[has], left[has], i[has]))
        r = r[tree[r, 1] < INFINITE]
    return [[x for x in row if x >= 0] for row in sym.tolist()]


class Codec:
    """Encodes and decodes texts; ids are little-endian unsigned 32-bit integers, packed."""

    def __init__(self, path: str, cache: int = CACHE_BYTES):
        self.v = Vocabulary(path)
        self.chunks, self.words = Memo(cache), Memo(cache)

    def merge(self, words: list[str]) -> None:
        """Learns the ids of `words`."""
        by_length: dict[int, list] = {}
        for w in words:
            raw = w.encode()
            symbols = [*map(self.v.inner.__getitem__, raw[:-1]), self.v.last[raw[-1]]]
            if min(symbols) < 0:
                symbols = [s for s in symbols if s >= 0]  # without an unknown token the library leaves these out
            by_length.setdefault(len(symbols), []).append((w, symbols))
        for n, own in by_length.items():
            if n < 2:
                ids = [s for _, s in own]
            elif n > SIDE_BY_SIDE or len(own) < 8:
                ids = [merge_word(self.v, s) for _, s in own]
            else:
                ids = merge_rows(self.v, np.array([s for _, s in own], np.int64))
            for (w, _), x in zip(own, ids, strict=True):
                self.words.young[w] = np.array(x, "<u4").tobytes()

    def pieces(self, chunk: bytes) -> list:
        """The words of a chunk without ASCII white space; a special token is its id."""
        text = chunk.decode("utf-8", "replace")
        parts = [text]
        if self.v.cut_special and any(h in chunk for h in self.v.hints):
            parts = self.v.cut_special(text)
        out: list = []
        for p in parts:
            if p in self.v.special:
                out.append(self.v.special[p])
            elif p:
                # the library lower-cases character by character, so a final sigma is like any other
                out += self.v.words(unicodedata.normalize("NFC", p).replace("Σ", "σ").lower())
        return out

    def learn(self, chunks: list[bytes]) -> None:
        cut = [self.pieces(c) for c in chunks]
        self.merge(self.words.missing({w for p in cut for w in p if isinstance(w, str)}))
        known, learnt = self.words.young, self.chunks.young
        for c, p in zip(chunks, cut, strict=True):
            learnt[c] = b"".join([known[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in p])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # white space is dropped and no rule reaches across it, so chunks between ASCII white space are independent
        cut = [t.split() for t in texts]
        if missing := self.chunks.missing(set().union(*cut)):
            self.learn(missing)
        look = self.chunks.young.__getitem__
        return [b"".join(map(look, chunks)) for chunks in cut]

    def decode(self, packed: bytes) -> str:
        """As the library does without a decoder: token strings joined by spaces, special tokens kept."""
        return " ".join(map(self.v.names.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def encode(docs: DataFrame, vocabulary: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """`docs` without its text, with ids (binary: packed little-endian uint32), n_tokens and, if asked, decoded."""

    def start():
        codec = Codec(vocabulary)

        def run(texts):
            ids = codec.encode(texts)
            return [ids, [len(x) // 4 for x in ids], *([[codec.decode(x) for x in ids]] if decoded else [])]

        return run

    added = {"ids": "binary", "n_tokens": "long"} | ({"decoded": "string"} if decoded else {})
    return map_texts(docs, text, added, start, [c for c in docs.columns if c != text])
