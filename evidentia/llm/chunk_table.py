"""SentencePiece encoding and decoding with a table of distinct chunks.

Where no piece of a model reaches across a white-space marker, a text is cut before every run of markers, and before
every line feed where no piece of two characters or more holds one. Merges never cross such a cut, so the ids of a text
are those of its chunks in order. One pass counts all chunks of all texts; each distinct chunk that repeats is segmented
once, by the library, into a table of packed ids, and the ids of a text are joined back from the table by the chunks'
positions. The table that goes to every task has a proven bound: the most frequent chunks, by powers of two of their
counts, as long as they fit `TABLE_BYTES`. A chunk outside it (seen once, or too rare for the bound) is segmented where
it stands, in a task's own bounded cache, with the same result. Other models (pieces across markers, suffix markers,
normalizers, no dummy prefix, unigram) take a text as one chunk.

Decoding reads the ids alone: the surfaces of the pieces by id, bytes of byte pieces, nothing for control pieces, without
the marker that encoding put in front.

Defined results: a null or empty text has only the begin and end ids, if asked for, and decodes to the empty text; a text
and a chunk of any length are encoded whole; a marker character in a text is the same as a space, as the library has it;
repeated rows encode alike; an empty table gives an empty result; input columns pass through, except ids, n_tokens and
decoded, which are replaced. Running it starts jobs that count the chunks and write the table.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, byte_batches, map_texts, stored

MARK = "▁"
#: Bytes of chunks and ids in the table that every task holds.
TABLE_BYTES = 16 << 20
#: Bytes of chunks outside the table that a worker remembers, in each of two generations.
CACHE_BYTES = 24 << 20
#: A chunk: a run of markers, or a line feed, and all up to the next of either (texts are marked by spaces here).
CHUNK = " +[^ \n]*|\n[^ \n]*"


class Model:
    """A model file: what its pieces allow, ids of chunks, texts of ids."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as form

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        about = form.ModelProto()
        about.ParseFromString(open(path, "rb").read())
        rules, pieces = about.normalizer_spec, [p.piece for p in about.pieces]
        spaced = rules.add_dummy_prefix and rules.escape_whitespaces and not (rules.remove_extra_whitespaces or rules.precompiled_charsmap or about.trainer_spec.treat_whitespace_as_suffix)
        own = [p.piece for p in about.pieces if p.type == form.ModelProto.SentencePiece.USER_DEFINED]
        inside = any(MARK in p.lstrip(MARK) for p in pieces) or any("\n" in p and len(p) > 1 for p in pieces)
        marker = m.piece_to_id(MARK)
        self.separate = bool(spaced and about.trainer_spec.model_type == form.TrainerSpec.BPE and not own and not inside and marker != m.unk_id() and m.encode("\n")[:1] == [marker])
        self.marker = np.array([marker], "<u4").tobytes()
        self.prefix = bool(rules.add_dummy_prefix)
        surface = lambda i: bytes([int(pieces[i][3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else " ⁇ ".encode() if m.is_unknown(i) else pieces[i].replace(MARK, " ").encode()
        self.surfaces = [surface(i) for i in range(len(pieces))]
        self.find = re.compile(CHUNK).findall

    def cut(self, text: bytes) -> list[str]:
        """The chunks of a text, in order."""
        if not text:
            return []
        plain = text.decode("utf-8", "replace")
        return self.find(" " + plain.replace(MARK, " ")) if self.separate else [plain]

    def segment(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of chunks. The library puts a marker in front, which stands for the chunk's first space."""
        if not self.separate:
            return [np.array(x, "<u4").tobytes() for x in self.library.encode(chunks, num_threads=1)]
        made = [np.array(x, "<u4").tobytes() for x in self.library.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)]
        # of the empty text the library makes nothing; before a line feed its marker is one too many
        return [self.marker if c == " " else x if c[0] == " " else x[4:] for c, x in zip(chunks, made, strict=True)]

    def decode(self, packed: bytes) -> str:
        raw = b"".join(map(self.surfaces.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def chunk_counts(docs: DataFrame, text: str) -> DataFrame:
    """(chunk, n) of every chunk of every text."""
    marked = F.concat(F.lit(" "), F.translate(F.col(f"`{text}`"), MARK, " "))
    chunks = F.regexp_extract_all(marked, F.lit(CHUNK), F.lit(0))
    return docs.filter(F.length(F.col(f"`{text}`")) > 0).select(F.explode(chunks).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))


def frequent(counts: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """The chunks of the highest powers of two of `n` that together fit `limit` bytes, ids (4 bytes a character at most) included."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.sum(F.octet_length("chunk") * 5).alias("bytes")).orderBy(F.desc("level")).collect()  # at most 63 rows
    least, total = 64, 0
    for row in sizes:
        total += row["bytes"]
        if total > limit:
            break
        least = row["level"]
    return counts.filter(level >= least)


def segmented(chunks: DataFrame, model: str) -> DataFrame:
    """(chunk, ids): each distinct chunk segmented once."""

    def run(batches):
        import pyarrow as pa

        pieces = Model(model)
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces.segment(names), pa.binary())], names=["chunk", "ids"])

    return chunks.select("chunk").mapInArrow(run, "chunk string, ids binary")


def chunk_table(docs: DataFrame, model: str, text: str = "text", limit: int = TABLE_BYTES) -> DataFrame:
    """The stored table (chunk, ids) of the frequent chunks; empty where pieces may cross markers."""
    byte_batches(docs.sparkSession)
    if not Model(model).separate:
        return docs.sparkSession.createDataFrame([], "chunk string, ids binary")
    counts = stored(chunk_counts(docs, text).filter(F.col("n") > 1), "chunk-counts")
    return stored(segmented(frequent(counts, limit), model), "chunk-table")


def encode(docs: DataFrame, model: str, text: str = "text", begin: bool = False, end: bool = False, decoded: bool = True, table: DataFrame | None = None) -> DataFrame:
    """`docs` without its text, with ids (binary: packed little-endian uint32), n_tokens and, if asked, decoded."""
    table = chunk_table(docs, model, text) if table is None else table
    rows = table.toArrow()  # bounded by TABLE_BYTES
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(rows.column("chunk").to_pylist(), rows.column("ids").to_pylist(), strict=True)))

    def start():
        pieces, cache = Model(model), Memo(CACHE_BYTES)
        known = shared.value
        pack = lambda on, i: np.array([i], "<u4").tobytes() if on and i >= 0 else b""
        first, last = pack(begin, pieces.library.bos_id()), pack(end, pieces.library.eos_id())

        def run(texts):
            cut = [pieces.cut(t) for t in texts]
            rare = set().union(*cut).difference(known)
            if new := cache.missing(rare):
                cache.young.update(zip(new, pieces.segment(new), strict=True))
            here = cache.young
            ids = [first + b"".join([known[c] if c in known else here[c] for c in chunks]) + last for chunks in cut]
            return [ids, [len(x) // 4 for x in ids], *([[pieces.decode(x) for x in ids]] if decoded else [])]

        return run

    added = {"ids": "binary", "n_tokens": "long"} | ({"decoded": "string"} if decoded else {})
    return map_texts(docs, text, added, start, [c for c in docs.columns if c != text])
