"""Token counts: a tokenizer library's batch encoding inside Arrow functions that return lengths only.

Texts are cut at safe boundaries, places where the library itself always cuts before it merges, so that the count of
a text is the sum over its pieces. Distinct pieces go to the library in batches balanced by bytes, and a bounded
cache carries their lengths on. Where no safe boundary is known the whole text is one piece.

Defined results: a null or empty text has 0 bytes and 0 tokens; a text of any length is counted whole; repeated rows count alike; an empty table gives an
empty result; input columns pass through, except that n_bytes, n_tokens and over_limit are replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_texts

#: Bytes of pieces whose lengths a worker remembers, in each of two generations.
CACHE_BYTES = 48 << 20
ENCODE_BYTES = 1 << 20

#: Punctuation that, after letters alone, is always a piece of its own (no contraction and no special token has it).
_TAIL = (b",", b".", b";", b":", b"!", b"?")


def _letters(piece: bytes) -> bool:
    """Letters alone, also once lower-cased: U+0130 leaves a combining dot, which joins the mark that follows."""
    x = piece.decode("utf-8", "replace")
    return x.isalpha() and (x.isascii() or unicodedata.normalize("NFC", x).lower().isalpha())


class PieceCounter:
    """Token counts of texts for one vocabulary file (.json: tokenizers, .model: sentencepiece)."""

    def __init__(self, path: str, cache: int = CACHE_BYTES):
        self.lengths, self.tails, self.cut = Memo(cache), False, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        self.encode = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        about = json.loads(open(path, encoding="utf-8").read())
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) for x in about["added_tokens"]):
            return
        before = about.get("pre_tokenizer") or {}
        parts = before.get("pretokenizers", [before])
        if parts[0].get("type") == "Split" and parts[0].get("invert") and parts[0].get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in parts[0]["pattern"].get("Regex", ""):
            self.cut, self.tails = bytes.split, True
        elif parts[0].get("type") == "ByteLevel" and parts[0].get("use_regex", True) and not about.get("normalizer") and not parts[0].get("add_prefix_space"):
            self.cut = re.compile(rb"[ \t\n\r\v\f]*[^ \t\n\r\v\f]+|[ \t\n\r\v\f]+").findall

    def _learn(self, pieces: list[bytes]) -> None:
        batch: list[bytes] = []
        size = 0
        for i, p in enumerate(pieces):
            batch.append(p)
            size += len(p)
            if size >= ENCODE_BYTES or i + 1 == len(pieces):
                self.lengths.young.update(zip(batch, self.encode([x.decode("utf-8", "replace") for x in batch]), strict=True))
                batch, size = [], 0

    def counts(self, texts: list[bytes]) -> list[int]:
        if self.cut is None:
            return self.encode([x.decode("utf-8", "replace") for x in texts])
        cut = [self.cut(x) for x in texts]
        known = self.lengths.young
        if new := self.lengths.missing(set().union(*cut)):
            known = self.lengths.young
            tails = {p for p in new if p[-1:] in _TAIL and _letters(p[:-1])} if self.tails else set()
            parts = {*(x[:-1] for x in tails), *(x[-1:] for x in tails)}
            self.lengths.note([p for p in parts if p not in known])
            self._learn([p for p in {*(x for x in new if x not in tails), *parts} if p not in known])
            known.update({p: known[p[:-1]] + known[p[-1:]] for p in tails})
        look = known.__getitem__
        return [sum(map(look, pieces)) for pieces in cut]


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """`docs` without its text, with n_bytes, n_tokens and over_limit; `tokenizer` is a vocabulary file's path."""

    def start():
        counter = PieceCounter(tokenizer)
        return lambda texts: [[len(x) for x in texts], counter.counts(texts)]

    keep = [c for c in docs.columns if c not in (text, "over_limit")]
    out = map_texts(docs, text, {"n_bytes": "long", "n_tokens": "long"}, start, keep)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
