"""Embedding whitening: exact sums by digit-slice matrix products.

Components are scaled to integers, x = floor(scale * c). The fit list holds each distinct vector x once. Its moments are
exact: a task adds up its vectors, and multiplies y = n*x - S (n vectors of sum S, so y is centred and n times too long)
with itself digit by digit: y is split into balanced limbs of 20 bits, so that each product of two limbs, summed over a
block of 2^14 rows, stays below 2^53 and BLAS adds it up exactly in float64. The products of limb pairs are recombined
as integers of any length, cut into parts of 40 bits for Spark to add over all tasks, and put together again: C = sum of
y yᵀ, exactly. V = C / n³ is rounded once, and its eigenvectors are those of x's covariance. What reaches the driver are
sums by dimension and by pair of dimensions, a size that no number of rows changes.

Every row is then projected: whitened = (x - S/n)·w / sqrt(e) for each component w of eigenvalue e. `identity_error` is
measured, not derived: the covariance of the whitened fit list, centred, against the identity.

Defined results: rows whose vector is null or holds a null or a component that is not finite are left out; of vectors of
different lengths (the empty one among them) the shorter are filled up with zeros; repeated rows each have their result
and count once in the fit; components beyond the range of long after scaling are that range's end; an eigenvalue that is
zero (to rounding: 1e-12 of the largest) has no direction, so its components have null `whitened`, and identity_error
tells of the others (null where there are none); `explained` is null where nothing varies; deviations beyond 38 digits
are null; an empty table, or one without components, gives an empty result. Columns pass through, those of the result
replace columns of their names. Running it starts jobs that fit the model.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, stored

LIMB = 20
#: Rows of a block: the product of two balanced limbs is at most 2^38, so 2^14 of them stay within 2^53.
BLOCK = 1 << 14
PART = 40
LONG = 1 << 63


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * c) of each component as double."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def complete(vector: Column) -> Column:
    """Has a vector of finite components."""
    number = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, number), F.lit(False))


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Balanced limbs of LIMB bits as float64, least first: y = sum of limb k * 2^(LIMB k). `y` is int64 or holds Python's integers."""
    out, base = [], 1 << LIMB
    while True:
        low = y & (base - 1)
        high = low >= base // 2
        out.append((low - high * base).astype(np.float64))
        y = (y >> LIMB) + high
        if not (y != 0).any():
            return out


def gram(y: np.ndarray) -> np.ndarray:
    """Exact yᵀy as Python's integers."""
    d = y.shape[1]
    total = np.zeros((d, d), object)
    for a in range(0, len(y), BLOCK):
        parts = limbs(y[a : a + BLOCK])
        for i, left in enumerate(parts):
            for j in range(i + 1):
                product = (left.T @ parts[j]).astype(np.int64).astype(object)
                total += (product if i == j else product + product.T) << (LIMB * (i + j))
    return total


def times(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, in int64 where nothing can overflow."""
    most = max([1, *(abs(int(v)) for v in (x.min(initial=0), x.max(initial=0)))])
    if 2 * n * most + max(map(abs, sums), default=0) < LONG:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def parts_of(value: int) -> list[int]:
    """Signed parts of PART bits, least first."""
    out = []
    while value not in (0, -1) or not out:
        out.append(value & ((1 << PART) - 1))
        value >>= PART
    if value:
        out.append(-1)
    return out


def matrix(column, width: int) -> np.ndarray:
    """An Arrow list column as int64 rows, short ones filled up with zeros."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes] or [np.array([], np.int64)]).astype(np.int64)] = flat
    return out


class Model(NamedTuple):
    n: int
    sums: list[int]
    #: width x components: eigenvectors divided by the root of their eigenvalue, zero where that is zero
    project: np.ndarray
    has_direction: list[bool]
    explained: list[float | None]
    identity_error: float | None


def _moments(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """(n, S). Low and high parts are added up apart, so that no sum can leave its type."""
    low, high = F.col("v").bitwiseAND(F.lit((1 << 31) - 1)), F.shiftright("v", 31)
    rows = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(low.cast("decimal(20,0)")).alias("low"), F.sum(high.cast("decimal(20,0)")).alias("high")).collect()  # one row a dimension
    sums = [0] * width
    for r in rows:
        sums[r["at"]] = int(r["low"]) + (int(r["high"]) << 31)
    return fit.count(), sums


def _products(fit: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray:
    """C = sum of (n*x - S)(n*x - S)ᵀ."""

    def run(batches):
        import pyarrow as pa

        total, held, rows = np.zeros((width, width), object), [], 0
        for batch in batches:
            held.append(matrix(batch.column(0), width))
            rows += batch.num_rows
            if rows >= BLOCK:
                total, held, rows = total + gram(times(np.concatenate(held), n, sums)), [], 0
        if held:
            total = total + gram(times(np.concatenate(held), n, sums))
        cells = [(i, j, k, v) for i in range(width) for j in range(i + 1) for k, v in enumerate(parts_of(total[i, j])) if v]
        yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "k", "part"])

    cells = fit.select("x").mapInArrow(run, "i int, j int, k int, part long").groupBy("i", "j", "k").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("part"))
    out = np.zeros((width, width), object)
    for r in cells.toArrow().to_pylist():  # a few rows for each pair of dimensions
        out[r["i"], r["j"]] += int(r["part"]) << (PART * r["k"])
    return np.where(np.tri(width, dtype=bool), out, out.T)


def _projected(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n*x - S exactly, whitened)."""
    y = times(x, model.n, model.sums)
    centred = y.astype(np.float64) / model.n if y.dtype != object else np.array([v / model.n for v in y.ravel()], np.float64).reshape(y.shape)
    return y, centred @ model.project


def _identity_error(fit: DataFrame, width: int, model: Model) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    on = [k for k, has in enumerate(model.has_direction) if has]
    if not on:
        return None
    size = len(on)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            z = _projected(model, matrix(batch.column(0), width))[1][:, on]
            yield pa.RecordBatch.from_arrays([pa.array([z.sum(axis=0).tolist() + (z.T @ z).ravel().tolist()], pa.list_(pa.float64()))], names=["s"])

    added = fit.select("x").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    v = np.array([r["v"] for r in added.orderBy("at").collect()]) / model.n  # components and their pairs
    mean, square = v[:size], v[size:].reshape(size, size)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(size)).max())


def fit_model(vectors: DataFrame, components: int) -> Model | None:
    """The model of the distinct vectors in column `x` (array<bigint>); None where there is no component."""
    width = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return None
    full = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    fit = stored(vectors.select(full.alias("x")).distinct(), "fit-list")
    n, sums = _moments(fit, width)
    exact = _products(fit, width, n, sums)
    cube = n**3
    covariance = np.array([[exact[i, j] / cube for j in range(width)] for i in range(width)], np.float64)
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    values, axes = values[order], axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    spread = sum(exact[i, i] for i in range(width)) / cube
    has = [bool(v > 1e-12 * values[0]) and spread > 0 for v in values]
    project = axes * np.array([1 / np.sqrt(v) if ok else 0.0 for v, ok in zip(values, has, strict=True)])
    model = Model(n, sums, project, has, [float(max(v, 0.0)) / spread if spread else None for v in values], None)
    return model._replace(identity_error=_identity_error(fit, width, model))


def whiten(rows: DataFrame, vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """A row for each complete row and component (from 1): `rows` without the vector, with component, n, deviation, whitened, explained, identity_error.

    `deviation` (decimal) is the sum over dimensions of (n*x - S)².
    """
    byte_batches(rows.sparkSession)
    own = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    keep = [c for c in rows.columns if c != vector and c not in own]
    names = [f"c{i}" for i in range(len(keep))]
    v = F.col(f"`{vector}`")
    # columns travel under names of their own, so that no name can clash on the way
    whole = rows.filter(complete(v)).select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keep, names, strict=True)], scaled(v, scale).alias("x"))
    model = fit_model(whole.select("x"), components)
    kinds = ", ".join(f"{a} {whole.schema[a].dataType.simpleString()}" for a in names)
    schema = f"{kinds}{', ' if kinds else ''}deviation decimal(38,0), whitened array<double>"
    width = len(model.sums) if model else 0

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column(len(names)), width)
            y, z = _projected(model, x)
            if y.dtype != object and float(np.abs(y).max(initial=0)) ** 2 * width < 2.0**62:
                squares = (y * y).sum(axis=1).tolist()
            else:
                squares = [sum(v * v for v in row) for row in y.astype(object)]
            deviation = pa.array([str(s) if s < 10**38 else None for s in squares], pa.string()).cast(pa.decimal128(38, 0))
            flat = pa.array([w if has else None for row in z.tolist() for w, has in zip(row, model.has_direction, strict=True)], pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], deviation, lists], names=[*names, "deviation", "whitened"])

    if not model:
        done = whole.filter(F.lit(False)).select(*names, F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array(F.lit(None).cast("double")).alias("whitened"))
    else:
        done = whole.mapInArrow(run, schema)
    shares = F.array(*[F.lit(x).cast("double") for x in (model.explained if model else [None])])
    out = done.select(*names, "deviation", F.posexplode("whitened").alias("at", "w"))
    return out.select(
        *[F.col(a).alias(c) for c, a in zip(keep, names, strict=True)], (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else None).cast("long").alias("n"),
        "deviation", F.col("w").alias("whitened"), shares[F.col("at")].alias("explained"), F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )
