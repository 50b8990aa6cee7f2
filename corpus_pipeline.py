"""From raw documents to token ids: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, BPE.

Each stage takes what its predecessor kept. A document whose every line was removed as a repeat elsewhere has nothing
left and goes with its lines. SQL cannot express the fingerprints and merges, so the tests hold the stages against
brute force.

Defined results: null, empty and very short texts have fewer than ten words and go in the first stage; texts of any
length are worked on whole; of repeated rows, also of those that share a doc_id or have none, one stays (the smallest
doc_id, nulls last); ties within a group fall to the least hash of the row; an empty table gives an empty result, an
empty benchmark removes nothing; columns besides doc_id and text pass through all stages but the last, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import decontaminate, line_dedup, quality_rules, segment_bpe, simhash
from evidentia.llm.common import read, stored
from evidentia.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines and runs of 50 words go, and documents that held nothing else; n_chars follows the text."""
    # columns travel under names of their own, which the operator's added ones cannot clash with
    own = {c: f"k{i}" for i, c in enumerate(docs.columns)}
    out = line_dedup.dedup_lines(docs.toDF(*own.values()), own["doc_id"], own["text"], runs=True)
    text = F.col(own["text"])
    out = out.filter((F.col("n_removed_lines") == 0) | text.rlike(r"[^\x20\x09-\x0D]"))
    if n := own.get("n_chars"):
        out = out.withColumn(n, F.when(F.col("n_removed_lines") > 0, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return out.select(*own.values()).toDF(*own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents (five-word shingles, similarity 0.8 or more) only the one with the smallest doc_id stays."""
    return simhash.keep_similar(docs, shingle=5, similarity=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    out = segment_bpe.encode(docs.select("doc_id", "text"), vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", benchmark), ("byte pair encoding", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
