"""Line dedup by content-defined chunks of lines.

Lines are hashed, and a rolling hash over the last `WINDOW` line hashes ends a chunk where it is divisible by
`DIVISOR` and the chunk has `MIN_LINES`. Boundaries thus depend on nearby lines only, and text that is put in or taken
out elsewhere does not move them. A chunk counts if it has several lines with a word among them, or `min_words` words.
Chunks meet by digest and by their bytes: grouping by the bytes is the comparison. Of a chunk that occurs more
than once the first occurrence stays, by document and then by place; all others are removed.

Where a passage is cut depends on the lines before it, so its ends may differ from copy to copy. With `runs` all runs
of consecutive lines that reach `min_words` words are compared as well, from every start and to every end; longer runs
are unions of these, so every line of a repeated passage of `min_words` words goes. Runs overlap, and their bytes would
be many times the text's; they meet by 128 bits instead, polynomials over 128 bits of SHA-256 of each line, which sums
over the text give in one step a run. A line goes where any repeated chunk or run
holds it, and always has an earlier copy; of one document's overlapping copies the first stays. n_removed_chunks counts
chunks alone.

The passages are a table of their own, without their bytes; those whose digests repeat give the lines to remove, chunks
once their bytes, cut out of the texts again, have been compared.

Defined results: null and empty texts have no chunks and stay as they are; a document is a doc_id (null: last) with its
text, so rows that repeat both count as one whose first occurrence stays in each row; a text of any length is cut whole,
in memory and time that grow with its lines and bytes; an empty table gives an empty result; other columns pass through, except the
added ones. Calling the operator runs jobs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, byte_slices, map_texts, sifted, stored

WINDOW = 2
DIVISOR = 2
MIN_WORDS = 50
#: A chunk has so many lines at least, but for a text's end.
MIN_LINES = 2

_MASK = (1 << 64) - 1


def _turn(x: int, k: int) -> int:
    k %= 64
    return ((x << k) | (x >> (64 - k))) & _MASK if k else x


def boundaries(hashes: list[int]) -> list[int]:
    """Ends (exclusive) of the chunks."""
    ends, rolling, size = [], 0, 0
    for i, h in enumerate(hashes):
        rolling = _turn(rolling, 1) ^ h
        if i >= WINDOW:
            rolling ^= _turn(hashes[i - WINDOW], WINDOW)
        size += 1
        if size >= MIN_LINES and rolling % DIVISOR == 0:
            ends.append(i + 1)
            size = 0
    if size:
        ends.append(len(hashes))
    return ends


def run_bounds(words: list[int], min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First lines and ends of the runs of lines that reach `min_words` words: the shortest from each start and to each end."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    n = len(words)
    ends = np.searchsorted(total, total[:-1] + min_words)
    starts = np.searchsorted(total, total[1:] - min_words, "right") - 1
    first = np.concatenate([np.flatnonzero(ends <= n), starts[starts >= 0]])
    last = np.concatenate([ends[ends <= n], 1 + np.flatnonzero(starts >= 0)])
    return tuple(np.divmod(np.unique(first * (n + 1) + last), n + 1))


#: Odd multipliers of the two polynomials that a run's lines make, and their inverses.
_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_INVERSES = np.array([pow(int(b), -1, 1 << 64) for b in _BASES], np.uint64)


def run_digests(lines: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """16 bytes for each run of lines [first, last), from sums over the text: lines are two 64-bit words each."""
    with np.errstate(over="ignore"):
        powers = [np.cumprod(np.concatenate([np.ones((1, 2), np.uint64), np.tile(x, (len(lines), 1))]), axis=0, dtype=np.uint64) for x in (_INVERSES, _BASES)]
        sums = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(lines * powers[0][:-1], axis=0, dtype=np.uint64)])
        return (sums[last] - sums[first]) * powers[1][first] + (last - first).astype(np.uint64)[:, None]


def _cut(text: bytes, min_words: int, runs: bool) -> tuple[list[tuple], tuple]:
    """Chunks (first line, end, digest, bytes) and runs (first lines, ends, digests)."""
    import hashlib

    from xxhash import xxh64_intdigest

    none = np.array([], np.int64)
    lines = text.split(b"\n")
    words = [len(x.split()) for x in lines]
    total = sum(words)
    if not total:
        return [], (none, none, np.zeros((0, 2), np.uint64))
    # a chunk is a slice of the text, by where its lines begin
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    chunks, a = [], 0
    for b in boundaries([xxh64_intdigest(x) for x in lines]):
        n = sum(words[a:b])
        if n >= min_words or (b - a > 1 and n > 0):
            body = text[starts[a] : starts[b] - 1]
            chunks.append((a, b, hashlib.sha256(body).digest()[:16], body))
        a = b
    if not runs or total < min_words:
        return chunks, (none, none, np.zeros((0, 2), np.uint64))
    first, last = run_bounds(words, min_words)
    hashes = np.frombuffer(b"".join([hashlib.sha256(x).digest()[:16] for x in lines]), np.uint64).reshape(-1, 2)
    return chunks, (first, last, run_digests(hashes, first, last))


def passages(text: bytes, min_words: int = MIN_WORDS, runs: bool = False) -> list[tuple]:
    """(first line, end, digest, bytes, whether a chunk) of all chunks that count and, with `runs`, of the runs (bytes: None)."""
    chunks, (first, last, digests) = _cut(text, min_words, runs)
    return sorted([(*c, True) for c in chunks] + [(a, b, d.tobytes(), None, False) for a, b, d in zip(first.tolist(), last.tolist(), digests, strict=True)], key=lambda x: (x[0], x[1], x[4]))


def _document(doc_id: str, text: str) -> list:
    """What names a document: its id and a hash of its text."""
    return [F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_key")]


def spread(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, runs: bool = False, bodies: bool = False) -> DataFrame:
    """One row for each passage: doc_id, text_key, start and end (lines), chunk, digest, and with `bodies` (of chunks alone) body."""
    byte_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(*_document(doc_id, text), F.col(f"`{text}`").cast("binary").alias("text"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
            for a, b in byte_slices(sizes, 1 << 20):
                part = batch.slice(a, b - a)
                cut = [_cut(t or b"", min_words, runs) for t in part.column(2).to_pylist()]
                chunks = [(i, *c) for i, (own_chunks, _) in enumerate(cut) for c in own_chunks]
                whose = np.repeat(np.arange(len(cut)), [len(r[0]) for _, r in cut])
                first, last, digests = (np.concatenate([r[k] for _, r in cut]) for k in range(3))
                at = pa.concat_arrays([pa.array([c[0] for c in chunks], pa.int64()), pa.array(whose)])
                arrays = [pa.concat_arrays([pa.array([c[k] for c in chunks], pa.int32()), pa.array(x.astype(np.int32))]) for k, x in ((1, first), (2, last))]
                packed = pa.Array.from_buffers(pa.binary(16), len(first), [None, pa.py_buffer(np.ascontiguousarray(digests))]).cast(pa.binary())
                arrays += [pa.array(np.arange(len(at)) < len(chunks)), pa.concat_arrays([pa.array([c[3] for c in chunks], pa.binary()), packed])]
                arrays += [pa.array([c[4] for c in chunks], pa.binary())] if bodies else []
                made = pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *arrays], names=["doc_id", "text_key", "start", "end", "chunk", "digest", *["body"][: bodies]])
                for k in range(0, made.num_rows, 1 << 17):
                    yield made.slice(k, 1 << 17)

    return own.mapInArrow(run, f"doc_id {kind}, text_key long, start int, end int, chunk boolean, digest binary" + (", body binary" if bodies else ""))


def repeated(found: DataFrame) -> DataFrame:
    """(chunk, digest, first) of the passages that occur more than once; first: where the occurrence is that stays."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"), F.col("start"), F.col("end"))
    same = found.groupBy("chunk", "digest", *[c for c in found.columns if c == "body"]).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    return same.filter("n > 1").select("chunk", "digest", "first")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, runs: bool = False) -> DataFrame:
    """`docs` with its text without repeated chunks (and `runs`), and n_lines, n_removed_lines and n_removed_chunks (long)."""
    found = stored(spread(docs, doc_id, text, min_words, runs), "passages")
    same = stored(repeated(found), "repeated")
    key = F.xxhash64("digest")
    # only the chunks whose digests repeat are cut out of the texts again, and compared by their bytes
    chunks, _ = sifted(spread(docs, doc_id, text, min_words, bodies=True), key, same.filter("chunk").select(key.alias("k")))
    same = stored(repeated(chunks).unionByName(same.filter("not chunk")), "compared")
    # tables of their own, so that the join's sides are both plain exchanges and a hot passage's rows can be split
    wanted, _ = sifted(found, key, same.select(key.alias("k")))
    met = wanted.join(same, ["chunk", "digest"])
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    gone = met.filter(~own | (F.col("start") >= F.col("first.end")))
    gone = gone.groupBy(F.col("doc_id").alias("_l_id"), F.col("text_key").alias("_l_key")).agg(F.collect_set(F.struct("start", "end", "chunk")).alias("_l_gone"))
    gone = stored(gone, "gone")
    held = docs.select("*", *[c.alias(n) for c, n in zip(_document(doc_id, text), ("_l_doc", "_l_text_key"), strict=True)])
    # texts that lose nothing stay where they are
    some, none = sifted(held, F.col("_l_text_key"), gone.select("_l_key"))
    some = some.join(gone, some["_l_doc"].eqNullSafe(gone["_l_id"]) & (some["_l_text_key"] == gone["_l_key"]), "left").select(*[some[f"`{c}`"] for c in some.columns], "_l_gone")
    held = some.unionAll(none.withColumn("_l_gone", F.lit(None).cast(gone.schema["_l_gone"].dataType)))
    held = held.withColumn("_l_text", F.col(f"`{text}`"))

    def start():
        def strip(texts, found):
            out = [[], [], [], []]
            for t, g in zip(texts, found, strict=True):
                lines = t.split(b"\n") if t else []
                kept, cut = t, 0
                if g:
                    gone = bytearray(len(lines))
                    for x in g:
                        gone[x["start"] : x["end"]] = b"\1" * (x["end"] - x["start"])
                    kept, cut = b"\n".join(x for x, y in zip(lines, gone, strict=True) if not y), sum(gone)
                for column, value in zip(out, (kept.decode("utf-8", "replace"), len(lines), cut, sum(x["chunk"] for x in g or ())), strict=True):
                    column.append(value)
            return out

        return strip

    added = {"_l_new": "string", "n_lines": "long", "n_removed_lines": "long", "n_removed_chunks": "long"}
    keep = [c for c in docs.columns if c not in added and c != text]
    done = map_texts(held, "_l_text", added, start, keep, ("_l_gone",))
    order = [c for c in docs.columns if c not in added]
    return done.select(*[F.col("_l_new").alias(c) if c == text else F.col(f"`{c}`") for c in order], "n_lines", "n_removed_lines", "n_removed_chunks")
