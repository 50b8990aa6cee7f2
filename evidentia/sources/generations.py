"""Sinks: immutable rows inserted once, generations swapped by a pointer, traces with their private columns left out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_missing(rows: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key does not exist yet, one for each key: what an insert-or-ignore appends."""
    return rows.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def conflicts(rows: DataFrame, existing: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Keys that come again with another content: content-addressed rows must never do so."""
    return rows.join(existing.select(*key, F.col(digest).alias("_old")), key).filter(F.col(digest) != F.col("_old")).select(*key)


def _pointers(spark: SparkSession, root: str) -> list:
    """(number, generation) of every publication; a root without any has none."""
    try:
        rows = spark.read.schema("number long, generation string").json(f"{root}/pointer").collect()  # one short row a publication
    except AnalysisException:
        return []
    return sorted((r.number, r.generation) for r in rows)


def publish(table: DataFrame, root: str, generation: str) -> str:
    """Writes a generation and then points to it; readers see the old one until the pointer's file is complete.

    A generation is written once: its name must be new. Pointers are numbered, so that the last one is known whatever the
    clock says; one writer publishes at a time. A table whose write failed has no pointer and is never seen.
    """
    spark, path = table.sparkSession, f"{root}/generation={generation}"
    number = max((n for n, _ in _pointers(spark, root)), default=0) + 1
    table.write.mode("errorifexists").parquet(path)
    spark.createDataFrame([(number, generation)], "number long, generation string").coalesce(1).write.mode("append").json(f"{root}/pointer")
    return path


def rolled_back(spark: SparkSession, root: str) -> str:
    """Points back to the generation before the current one, by a pointer of its own."""
    known = _pointers(spark, root)
    if len(known) < 2:
        raise ValueError("there is no generation to go back to")
    spark.createDataFrame([(known[-1][0] + 1, known[-2][1])], "number long, generation string").coalesce(1).write.mode("append").json(f"{root}/pointer")
    return known[-2][1]


def current(spark: SparkSession, root: str) -> DataFrame:
    """The generation that the last pointer names."""
    return spark.read.parquet(f"{root}/generation={_pointers(spark, root)[-1][1]}")


#: What each trace mode keeps.
TRACE_MODES = {"off": [], "metrics": ["run", "metrics"], "answer": ["run", "metrics", "answer"], "diagnostic": ["run", "metrics", "answer", "evidence"]}


def traced(rows: DataFrame, mode: str, most_chars: int = 4000) -> DataFrame:
    """The columns of a trace mode, long texts cut (the trace's own bound)."""
    keep = [c for c in TRACE_MODES[mode] if c in rows.columns]
    cut = [F.substring(c, 1, most_chars).alias(c) if dict(rows.dtypes)[c] == "string" else F.col(c) for c in keep]
    return rows.select(*cut)
