"""Reference graphs: closure over block-label-section edges with limits, and its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialized


def closure(spark, seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hop): the nodes reachable from each seed within `hops`, at their least distance.

    Runs jobs when called. Each step expands only the nodes found last. Steps are tables of their own, so that the plan does not double with
    each one, and an empty step ends the search.
    """
    frontier = materialized(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop")), "closure")
    seen, forward = frontier, edges.select(F.col("src").alias("node"), "dst")
    for h in range(1, hops + 1):
        step = frontier.select("seed", "node").join(forward, "node").select("seed", F.col("dst").alias("node")).distinct()
        fresh = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(h))
        frontier = materialized(fresh, "closure")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def missing(required: DataFrame, presented: DataFrame, key: list[str]) -> DataFrame:
    """What a closure requires and a packet lacks."""
    return required.join(presented, key, "left_anti")


def resolved_labels(labels: DataFrame, sections: DataFrame) -> DataFrame:
    """Labels joined to sections by key; only keys that exactly one section has resolve."""
    unique = sections.groupBy("key").agg(F.count("*").alias("n"), F.min("section").alias("section"))
    j = labels.join(unique, "key", "left")
    issue = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return j.withColumn("issue", issue).withColumn("section", F.when(F.col("n") == 1, F.col("section"))).drop("n")
