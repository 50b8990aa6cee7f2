"""Where queries are registered: name, callable, SQL for the oracle and the inventory ids that it covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


#: Tables of long texts, whose rows cost far more to work on than to move.
TEXTS = ("documents", "pages")


def spread(table: DataFrame) -> DataFrame:
    """`table` dealt out to the cores of a single machine, where a small file is one split; a cluster reads its splits as they are."""
    context = table.sparkSession.sparkContext
    return table.repartition(context.defaultParallelism) if context.master.startswith("local") and "cluster" not in context.master else table


def dealt(table: DataFrame) -> DataFrame:
    """`table` dealt out to all cores, for rows that cost far more to work on than to move and whose file may be one split."""
    spark = table.sparkSession
    return table.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


class Tables:
    """The parquet tables of one folder, read when first named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in TEXTS:
            # the columns that a query drops are pruned below the exchange
            table = spread(table)
        setattr(self, name, table)
        return table


def query(covers: str, sql: str | None = None):
    """Registers f(tables) under its name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        COVERS[f.__name__] = covers
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
