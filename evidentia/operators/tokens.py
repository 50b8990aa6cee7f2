"""What needs a model's own tokens: passage windows by a tokenizer's offsets, and pooled token vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sequential

#: Tokens of a passage, those that it shares with the next, and the most that an encoder reads.
SIZE, OVERLAP, MOST = 384, 64, 512
#: Characters of text that a task tokenises at once.
SLICE = 1 << 20


def passage_windows(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ordinal, start, end (code points) and tokens of windows of `size` tokens, slices of the text that leave no gap.

    `tokenizer` is the path of a vocabulary file, no part of this library. Offsets are those of the text as it is, whatever
    the tokenizer normalises; tokens without a character do not count. A blank text has no window, and one without tokens
    is a window as a whole. Texts of any length are read whole.
    """
    key = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.no_truncation()
        model.no_padding()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end] or "") <= SLICE):
                    held += len(texts[end] or "")
                    end += 1
                rows: list[tuple] = []
                shown = [t or "" for t in texts[at:end]]
                for k, (t, found) in enumerate(zip(shown, model.encode_batch(shown, add_special_tokens=False), strict=True)):
                    starts = [a for a, b in found.offsets if b > a]
                    if t.strip():
                        windows = sequential.windows(starts, len(t), size, overlap) or [(0, len(t), 0)]
                        rows += [(at + k, n, *w) for n, w in enumerate(windows)]
                which, *columns = [*zip(*rows, strict=True)] or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "ordinal", "start", "end", "tokens"])
                at = end

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {key}, ordinal long, start long, end long, tokens long")


def pooled(rows: DataFrame, vectors: DataFrame, most: int = MOST) -> DataFrame:
    """row, pooled: the mean of a row's token vectors over its first `most` tokens, as a unit vector.

    rows: row, tokens (an array of ids, null: none); vectors: token, embedding, one for each id. The tokens beyond `most`
    and those without a vector are masked; a row that keeps none is the zero vector. A row's tokens are counted before
    they meet their vectors, so that each kind of token travels once.
    """
    kept = rows.select("row", F.explode(F.slice("tokens", 1, most)).alias("token")).groupBy("row", "token").agg(F.count("*").cast("double").alias("weight"))
    met = kept.join(vectors.select("token", array_to_vector(F.col("embedding").cast("array<double>")).alias("v")), "token")
    mean = met.groupBy("row").agg(vector_to_array(Summarizer.mean(F.col("v"), F.col("weight"))).alias("mean"))
    size = vectors.select(F.size("embedding").alias("size")).limit(1)
    zero = F.array_repeat(F.lit(0.0), F.col("size"))
    out = rows.select("row").distinct().join(mean, "row", "left").crossJoin(F.broadcast(size))  # one row
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, v: a + v * v))
    return out.select("row", F.coalesce(F.when(norm > 0, F.transform("mean", lambda v: v / norm)), zero).alias("pooled"))
