"""Policies learnt from trajectories: features, ridge regression by action, upper-confidence scores, states of policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fraction(part: Column, whole: Column) -> Column:
    """part / whole as a feature: the whole counts as one at least, the result lies between 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), part / F.greatest(whole.cast("double"), F.lit(1.0))))


def rounded(value: Column, places: int) -> Column:
    """A number that is not negative, rounded as the binary value that it is; F.round takes its shortest decimal form, which may be a half where the value is below one."""
    scaled = value * F.lit(10.0**places)
    return (F.floor(scaled) + F.when(scaled - F.floor(scaled) >= 0.5, 1).otherwise(0)) / F.lit(10.0**places)


def encoded(stage: Column, stages: list[str], fractions: list[Column]) -> Column:
    """A context as features: a constant, one of `stages` as ones and zeros, and fractions."""
    return F.array(F.lit(1.0), *[F.when(stage == s, 1.0).otherwise(0.0) for s in stages], *[f.cast("double") for f in fractions])


def valid_context(features: Column, size: int) -> Column:
    """Right size, finite, within [0, 1]."""
    return F.coalesce((F.size(features) == size) & F.forall(features, lambda v: (v >= 0) & (v <= 1)), F.lit(False))


def moments(rows: DataFrame, action: str, features: str, target: str, size: int, ridge: float = 1.0) -> DataFrame:
    """(action, n, a: array of arrays, b: array, yy): the normal equations of each action, ridge * I + sum x x', sum x y, and sum y y."""
    x = lambda i: F.get(features, F.lit(i))
    sums = [F.sum(x(i) * x(j)).alias(f"a{i}_{j}") for i in range(size) for j in range(i, size)] + [F.sum(x(i) * F.col(target)).alias(f"b{i}") for i in range(size)]
    g = rows.groupBy(action).agg(F.count("*").alias("n"), F.sum(F.col(target) * F.col(target)).alias("yy"), *sums)
    cell = lambda i, j: F.col(f"a{min(i, j)}_{max(i, j)}") + (ridge if i == j else 0.0)
    return g.select(action, "n", F.array(*[F.array(*[cell(i, j) for j in range(size)]) for i in range(size)]).alias("a"), F.array(*[F.col(f"b{i}") for i in range(size)]).alias("b"), "yy")


def solved(equations: DataFrame, action: str) -> DataFrame:
    """(action, weights, inverse, residual) of the normal equations; one small matrix a row, in Arrow batches."""
    kind = equations.schema[action].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row in batch.to_pylist():
                a, b = np.array(row["a"]), np.array(row["b"])
                inverse = np.linalg.inv(a)
                w = inverse @ b
                for column, value in zip(out, (row[action], w.tolist(), inverse.tolist(), float(row["yy"] - b @ w)), strict=True):
                    column.append(value)
            kinds = (batch.schema.field(action).type, pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64())), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=[action, "weights", "inverse", "residual"])

    return equations.select(action, "a", "b", "yy").mapInArrow(run, f"{action} {kind}, weights array<double>, inverse array<array<double>>, residual double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)


def upper_score(features: Column, weights: Column, spread: Column, alpha: float) -> Column:
    """w.x + alpha * sqrt(x' S x)."""
    return dot(weights, features) + alpha * F.sqrt(F.greatest(F.lit(0.0), dot(F.transform(spread, lambda row: dot(row, features)), features)))


def policy_states(events: DataFrame, policy: str, order: str, kind: str) -> DataFrame:
    """(policy, state, version): candidates become promoted, promoted ones rolled back; anything else changes nothing.

    Events of `kind` candidate, promote and rollback; a new candidate needs a policy that is not promoted. A policy's
    events, a handful, are one array.
    """
    packed = events.groupBy(policy).agg(F.sort_array(F.collect_list(F.struct(order, F.col(kind).alias("kind")))).alias("e"))
    start = F.struct(F.lit("none").alias("state"), F.lit(0).cast("long").alias("version"))

    def step(s: Column, e: Column) -> Column:
        k, state = e["kind"], s["state"]
        to = F.when((k == "candidate") & (state != "promoted"), "candidate").when((k == "promote") & (state == "candidate"), "promoted").when((k == "rollback") & (state == "promoted"), "rolled_back")
        return F.when(to.isNull(), s).otherwise(F.struct(to.alias("state"), (s["version"] + 1).alias("version")))

    return packed.select(policy, F.aggregate("e", start, step).alias("s")).select(policy, "s.state", "s.version")
