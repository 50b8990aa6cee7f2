"""Hard-negative mining with a vector-approximation file.

Components are scaled to integers; a score is the integer inner product of two vectors, higher first, ties by smaller id.
The approximation file holds, for every row, one byte a dimension: the cell of its component, between marks at the
dimension's quantiles over all rows. For a query, the least and the largest product with each cell of a dimension stand
in two tables; a row's lower and upper score bound is the sum of what its bytes look up there.

* Positives, the first `positives` rows of the anchor's label: a row is scored only where its upper bound reaches the
  fifth largest lower bound among the rows beside it.
* Negatives, for each positive the first rows of other labels with a score from `low` to `high` hundredths of the
  positive's: a row is scored only where its bounds meet such a window, and its upper bound reaches the fifth largest
  lower bound of rows that are surely in it.

What a task finds for a slab of rows is complete for that slab, and the first of all slabs' firsts are the result, so no
partner is ever lost. Anchors lie in blocks in the shared folder; each task reads one block after the other for a slab
of rows, so all rows are scanned once for any number of anchors, no anchor passes through the driver, and only a slab's
firsts are shuffled, by anchor.

Defined results: rows with a null label, a null vector or a component that is null or not finite take no part; of vectors
of different lengths the shorter are filled up with zeros; a row without an id is no anchor and comes last among equal
scores; repeated rows are rows of their own, also as each other's positives; an anchor without positives, and a positive
without negatives, gives no row; where a score could leave the range of long, components are held within the largest
bound with which none can; an empty table gives an empty result; other columns play no part, whatever their names.
Running it starts jobs that write the tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_batches, stored
from .warc import file_system
from .whitening import complete, matrix, scaled

CELLS = 256
#: Rows of a slab, anchors of a block: together the size of a task's matrices of bounds.
SLAB = 8192
BLOCK = 128
#: Candidates that are scored at once.
SCORED = 1 << 16
LAST = (1 << 63) - 1


def numbered(rows: DataFrame, vector: str, label: Column, scale: int) -> DataFrame:
    """The stored table (row, id, label, anchor, x) of the rows that take part, of one length."""
    v = F.col(f"`{vector}`")
    part = rows.filter(complete(v) & label.isNotNull())
    width = part.agg(F.max(F.size(v))).first()[0] or 1
    limit = int((LAST // width) ** 0.5) - 1
    x = F.transform(scaled(v, scale), lambda c: F.greatest(F.least(c, F.lit(limit).cast("long")), F.lit(-limit).cast("long")))
    x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(v)))
    return stored(part.select(F.monotonically_increasing_id().alias("row"), F.col("_id").alias("id"), label.cast("long").alias("label"), F.col("_anchor").alias("anchor"), x.alias("x")), "vectors")


def marks(rows: DataFrame, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(least, largest) component of each cell by dimension; quantiles and ends over all rows."""
    shares = F.array(*[F.lit(k / CELLS) for k in range(1, CELLS)])
    found = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", shares, F.lit(4 * CELLS)).alias("marks"))
    out = [(np.zeros(1, np.int64), np.zeros(1, np.int64))] * width
    for r in found.collect():  # one row of cell marks a dimension
        starts = np.unique([r["low"], *[m for m in r["marks"] if r["low"] < m <= r["high"]]])[:CELLS]
        out[r["at"]] = (starts, np.append(starts[1:] - 1, r["high"]))
    return out


def approximated(rows: DataFrame, edges: list) -> DataFrame:
    """The stored approximation file: (row, id, label, x, cells), a byte of cell number a dimension."""
    names = ["row", "id", "label", "x"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column(3), len(edges))
            cells = np.stack([np.searchsorted(starts, x[:, j], "right") - 1 for j, (starts, _) in enumerate(edges)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in cells], pa.binary())], names=[*names, "cells"])

    return stored(rows.select(*names).mapInArrow(run, "row long, id long, label long, x array<bigint>, cells binary"), "approximations")


class Slab:
    """Rows held by a task: exact vectors, cells by dimension, rows of each label."""

    def __init__(self, batches, edges):
        import pyarrow as pa

        table = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.row, self.label = (table.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        self.id = table.column(1)
        self.order = self.id.fill_null(LAST).to_numpy(zero_copy_only=False)
        self.x, self.edges = matrix(table.column(3), len(edges)), edges
        cells = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint8).reshape(len(self.row), len(edges))
        self.cells = np.ascontiguousarray(cells.T)
        by = np.argsort(self.label, kind="stable")
        names, starts = np.unique(self.label[by], return_index=True)
        self.of = dict(zip(names.tolist(), np.split(by, starts[1:]), strict=True))

    def ids(self, rows: np.ndarray):
        import pyarrow as pa

        return self.id.take(pa.array(rows, pa.int64()))

    def bounds(self, q: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of each row (or of `rows`) and query, from the tables of each query."""
        count = len(self.row) if rows is None else len(rows)
        most = max([1, *(int(max(abs(s[0]), abs(e[-1]))) for s, e in self.edges)]) * max(1, int(np.abs(q).max(initial=0))) * len(self.edges)
        kind = np.int32 if most < 1 << 31 else np.int64
        low, high = np.zeros((count, len(q)), kind), np.zeros((count, len(q)), kind)
        for j, (starts, ends) in enumerate(self.edges):
            cells = self.cells[j] if rows is None else self.cells[j][rows]
            a, b = starts[:, None] * q[:, j], ends[:, None] * q[:, j]
            low += np.minimum(a, b).astype(kind)[cells]
            high += np.maximum(a, b).astype(kind)[cells]
        return low, high

    def scores(self, q: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        for a in range(0, len(rows), SCORED):
            out[a : a + SCORED] = np.einsum("ij,ij->i", self.x[rows[a : a + SCORED]], q[queries[a : a + SCORED]])
        return out

    def firsts(self, queries: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the first k of each query: higher scores first, then smaller ids."""
        order = np.lexsort((self.row[rows], self.order[rows], -scores, queries))
        return order[place(queries[order]) < k]


def place(groups: np.ndarray) -> np.ndarray:
    """Number of each entry in its run of equal groups, from 0."""
    new = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1)) if len(groups) else np.array([], np.int64)
    return np.arange(len(groups)) - np.repeat(new, np.diff(np.append(new, len(groups))))


def kth(groups: np.ndarray, values: np.ndarray, count: int, k: int) -> np.ndarray:
    """The k-th largest value of each of `count` groups, the least long where there are fewer."""
    out = np.full(count, -LAST - 1, np.int64)
    order = np.lexsort((-values, groups))
    at = order[place(groups[order]) == k - 1]
    out[groups[at]] = values[at]
    return out


def positives_in(slab: Slab, block: dict, k: int):
    """(anchor, row) places and scores of the first k of each anchor's label in a slab."""
    for label in np.unique(block["label"]).tolist():
        rows = slab.of.get(label)
        if rows is None:
            continue
        of = np.flatnonzero(block["label"] == label)
        q = block["x"][of]
        low, high = slab.bounds(q, rows)
        others = slab.row[rows][:, None] != block["row"][of]
        low = np.where(others, low, np.iinfo(low.dtype).min)
        if len(rows) > k:
            least = np.partition(low, len(rows) - k, axis=0)[len(rows) - k]
            others &= high >= least
        r, a = np.nonzero(others)
        scores = slab.scores(q, rows[r], a)
        first = slab.firsts(a, rows[r], scores, k)
        yield of[a[first]], rows[r[first]], scores[first]


def negatives_in(slab: Slab, block: dict, k: int, low_share: int, high_share: int):
    """(anchor, positive, row) places and scores of the first k rows of other labels in each window of a slab."""
    q, windows = block["x"], block["windows"]
    low, high = slab.bounds(q)
    # a window holds the integers from low_share/100 to high_share/100 of a positive's score
    edges = [[(-(-low_share * w // 100), high_share * w // 100) for w in own] for own in windows]
    begin = np.array([min((a for a, b in own if a <= b), default=LAST) for own in edges])
    end = np.array([max((b for a, b in own if a <= b), default=-LAST) for own in edges])
    r, a = np.nonzero((high >= begin) & (low <= end) & (slab.label[:, None] != block["label"]))
    low, high = low[r, a].astype(np.int64), high[r, a].astype(np.int64)
    most = max(map(len, windows), default=0)
    inside, may = [], np.zeros(len(r), bool)
    for p in range(most):
        x = np.array([own[p][0] if p < len(own) else LAST for own in edges])[a]
        y = np.array([own[p][1] if p < len(own) else -LAST for own in edges])[a]
        sure = (low >= x) & (high <= y)
        reach = (high >= x) & (low <= y) & (high >= kth(a[sure], low[sure], len(q), k)[a])
        inside.append((x, y))
        may |= reach
    kept = np.flatnonzero(may)
    scores = slab.scores(q, r[kept], a[kept])
    for p, (x, y) in enumerate(inside):
        hit = np.flatnonzero((scores >= x[kept]) & (scores <= y[kept]))
        first = hit[slab.firsts(a[kept[hit]], r[kept[hit]], scores[hit], k)]
        yield a[kept[first]], p, r[kept[first]], scores[first]


def _over_blocks(rows: DataFrame, blocks: DataFrame, edges: list, schema: str, search) -> DataFrame:
    """Runs search(slab, block) -> arrays in the order of `schema`, for every slab of rows and every stored block of anchors."""
    files, width = blocks.inputFiles(), len(edges)

    def anchors():
        import pyarrow.parquet as pq

        for file in files:
            fs, path = file_system(file)
            with fs.open_input_file(path) as f:
                for part in pq.ParquetFile(f).iter_batches(BLOCK):
                    if part.num_rows:
                        at = {n: part.column(k) for k, n in enumerate(part.schema.names)}
                        block = {n: at[n].to_numpy(zero_copy_only=False) for n in ("row", "id", "label")} | {"x": matrix(at["x"], width)}
                        if "windows" in at:
                            found = at["windows"].to_pylist()
                            block |= {"windows": [[w["score"] for w in own] for own in found], "ids": [[w["id"] for w in own] for own in found]}
                        yield block

    def run(batches):
        import pyarrow as pa

        kinds = pa.schema([(n, pa.int64() if kind == "long" else pa.int32()) for n, kind in map(str.split, schema.split(", "))])
        held, count = [], 0

        def found():
            slab = Slab(held, edges)
            for block in anchors():
                for columns in search(slab, block):
                    if len(columns[0]):
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, kinds, strict=True)], schema=kinds)

        for batch in batches:
            for a in range(0, batch.num_rows, SLAB):
                part = batch.slice(a, SLAB)
                if count and count + part.num_rows > SLAB:
                    yield from found()
                    held, count = [], 0
                held.append(part)
                count += part.num_rows
        if count:
            yield from found()

    return rows.mapInArrow(run, schema)


def mine(
    rows: DataFrame, anchors: Column, id: str = "vec_id", vector: str = "embedding", label: Column | None = None,
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score).

    `anchors` is the condition that makes a row an anchor, `label` an expression over the columns of `rows` (default: label);
    a negative's score lies between `low` and `high` hundredths of its positive's.
    """
    byte_batches(rows.sparkSession)
    label = F.col("label") if label is None else label
    own = rows.withColumns({"_id": F.col(f"`{id}`").cast("long"), "_anchor": F.coalesce(anchors & F.col(f"`{id}`").isNotNull(), F.lit(False))})
    table = numbered(own, vector, label, scale)
    width = table.agg(F.max(F.size("x"))).first()[0] or 1
    edges = marks(table, width)
    file = approximated(table, edges)
    blocks = stored(table.filter("anchor").select("row", "id", "label", "x"), "anchors")

    def near(slab, block):
        for a, r, s in positives_in(slab, block, positives):
            yield block["row"][a], slab.row[r], slab.ids(r), s

    order = lambda *by: Window.partitionBy(*by)
    found = _over_blocks(file, blocks, edges, "anchor long, row long, id long, score long", near)
    rank = F.row_number().over(order("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= positives)
    windows = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda w: F.struct(w["id"].alias("id"), w["score"].alias("score")))
    known = stored(blocks.join(best.groupBy(F.col("anchor").alias("row")).agg(windows.alias("windows")), "row"), "positives")

    def hard(slab, block):
        for a, p, r, s in negatives_in(slab, block, negatives, low, high):
            yield block["row"][a], block["id"][a], [p + 1] * len(a), [block["ids"][i][p] for i in a.tolist()], [block["windows"][i][p] for i in a.tolist()], slab.row[r], slab.ids(r), s

    found = _over_blocks(file, known, edges, "anchor long, anchor_id long, positive_rank int, positive_id long, positive_score long, row long, negative_id long, negative_score long", hard)
    rank = F.row_number().over(order("anchor", "positive_rank").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "row"))
    out = found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score")
