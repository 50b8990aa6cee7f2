"""What the operators of this subpackage share: reading tables, shared storage, byte-bounded Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step of an Arrow function handles at once.
BATCH_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session one of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = getattr(spark, "_evidentia_shared", None) or tempfile.mkdtemp(prefix="evidentia-")
        spark._evidentia_shared = path
    return path.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df`, written once to the shared folder and read back: lineage ends there and survives lost executors.

    This runs a job at once, so operators that store tables do work when their DataFrame is made.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a sieve; its table has at most a row for 64 of them, a million rows of 16 bytes.
SIEVE_BITS = 1 << 26


def sifted(rows: DataFrame, key: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(may be wanted, are not): `rows` parted by whether their `key` (long) may be among the only column of `wanted`.

    The wanted keys set bits of a table of bounded size, which is broadcast, so that rows that nobody wants, with their long
    texts, need not be shuffled to find that out. A bit that another key has set costs a row its exact join and no more;
    with far more keys than bits all rows take that way.
    """
    at = F.pmod(wanted[wanted.columns[0]], F.lit(SIEVE_BITS))
    bit = F.expr("shiftleft(1L, CAST(_s_at & 63 AS INT))")
    words = wanted.select(at.alias("_s_at")).groupBy(F.shiftright("_s_at", 6).alias("_s_word")).agg(F.bit_or(bit).alias("_s_bits"))
    words = stored(words, "sieve")
    flagged = rows.withColumn("_s_at", F.pmod(key, F.lit(SIEVE_BITS))).withColumn("_s_word", F.shiftright("_s_at", 6)).join(F.broadcast(words), "_s_word", "left")
    hit = F.coalesce(F.col("_s_bits").bitwiseAND(bit) != 0, F.lit(False))
    return tuple(flagged.filter(c).select(*[F.col(f"`{x}`") for x in rows.columns]) for c in (hit, ~hit))


def let(value: Column, body) -> Column:
    """Bind `value` to a lambda variable, so that `body` evaluates it once."""
    return F.transform(F.array(value), body)[0]


#: Bytes of a batch that Spark sends to a Python worker; JVM and worker each hold a few at once.
ARROW_BYTES = 4 << 20


def byte_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch to `ARROW_BYTES`, so that long texts fit small executors.

    The setting has no effect on results; Spark reads it when a plan runs, so it cannot be set for one plan alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"([0-9]+)([a-z]*)", spark.conf.get(name).strip().lower()).groups()
    if int(number) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20}.get(unit, 30) > ARROW_BYTES:
        spark.conf.set(name, f"{ARROW_BYTES}b")


def byte_slices(sizes: list[int], limit: int = BATCH_BYTES):
    """(start, end) runs of about `limit` bytes each; a longer row is a run of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(docs: DataFrame, text: str, added: dict[str, str], start, keep: list[str] | None = None, also: tuple = ()) -> DataFrame:
    """Adds the columns `added` (name: SQL type), made from whole texts in byte-bounded slices by an Arrow function.

    `start()` runs once in each task and returns f(texts: list[bytes]) -> one list for each added column; a null text
    reaches it as b"". `keep` names the columns that go on (default: all but those that `added` replaces); the columns
    `also` reach f as further lists.
    """
    byte_batches(docs.sparkSession)
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in added]
    names, at = [f"c{i}" for i in range(len(keep))], len(keep)
    # columns travel under names of their own, so that no name can clash on the way
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text}`").cast("binary").alias("t"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(also)])
    kinds = [f.dataType for f in plain.schema.fields[:at]]
    out = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)] + [T.StructField(f"a{i}", T._parse_datatype_string(k)) for i, k in enumerate(added.values())])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        f = start()
        new = [x.type for x in to_arrow_schema(out)][at:]
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
            for a, b in byte_slices(sizes):
                part = batch.slice(a, b - a)
                made = f([x or b"" for x in part.column(at).to_pylist()], *[c.to_pylist() for c in part.columns[at + 1 :]])
                arrays = [pa.array(v, k) for v, k in zip(made, new, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *arrays], names=[*names, *[f"a{i}" for i in range(len(arrays))]])

    done = plain.mapInArrow(run, out)
    return done.toDF(*keep, *added)


class Memo:
    """A cache in two generations, bounded by bytes: what was used since the last turn survives the next one.

    A turn comes where the keys of one generation reach `size` bytes, and happens in `missing` only, so that all that a
    slice needs stays until its next call. Keys beyond `LONG` characters are kept for that call alone.
    """

    LONG = 64

    def __init__(self, size: int):
        self.size, self.young, self.old, self.used, self.seen, self.long = size, {}, {}, 0, 0, []

    def missing(self, keys) -> list:
        """The keys that must be learnt; the others are in `young` afterwards."""
        for k in self.long:
            self.young.pop(k, None)
        if self.used > self.size:
            self.old, self.young, self.used = self.young, {}, 0
        young, old, out = self.young, self.old, []
        moved = []
        for k in keys:
            if k not in young:
                if (v := old.get(k)) is None:
                    out.append(k)
                else:
                    young[k] = v
                    moved.append(k)
        self.long = []
        self.note(moved)
        self.note(out)
        return out

    def note(self, keys) -> None:
        """Counts keys that go into `young`."""
        for k in keys:
            if len(k) > self.LONG:
                self.long.append(k)
            else:
                # an entry's value and its place in the table weigh about 150 bytes besides its key
                self.used += len(k) + 150
