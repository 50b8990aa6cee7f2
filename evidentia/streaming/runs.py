"""Structured Streaming forms of the run ledger: state of runs, idle sessions, leases, finished jobs, recent questions.

Sources are handed in, so the same functions serve files, Kafka or tests. Aggregations need a watermark to bound their
state; rows later than it are dropped by Spark, as documented there. Sinks are Parquet tables under a shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: When the row that ends a stream happens: later than any watermark that a real event could need.
END = "2200-01-01 00:00:00"


def event_stream(spark: SparkSession, folder: str, schema, **options) -> DataFrame:
    """Parquet files of `folder` as a stream, timestamps with a zone so that watermarks accept them."""
    return spark.readStream.schema(schema).options(**options).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def run_states(events: DataFrame, run: str = "user_id", delay: str = "1 hour") -> DataFrame:
    """Latest event of each run and hour: the projection that an append-only log feeds. Event types are cut down to known codes."""
    known = F.when(F.col("event_type").rlike(r"^[a-z][a-z0-9_.]{0,39}$"), F.col("event_type")).otherwise("other")
    e = events.withColumn("event_type", known).withWatermark("ts", delay)
    g = e.groupBy(F.window("ts", "1 hour"), run).agg(F.max_by("event_type", "event_id").alias("state"), F.max("event_id").alias("last_event"), F.count("*").alias("n_events"))
    return g.select(F.col("window.start").alias("hour"), run, "state", "last_event", "n_events")


def idle_sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions that end after `gap` without an event; in append mode a session shows once the watermark has passed it."""
    s = events.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("s.start").alias("began"), F.col("s.end").alias("ended"), "n")


def unique_events(events: DataFrame, key: list[str], delay: str = "1 hour") -> DataFrame:
    """Idempotent append: one row for each key within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def leases(events: DataFrame, seconds: int = 900, delay: str = "1 hour") -> DataFrame:
    """Claims of work items with a lease: a claim holds until it is done or runs out, later claims meanwhile are refused.

    events: user_id (the item), event_id, ts and event_type (`done` ends a lease, anything else claims). A lease that the
    watermark has passed is forgotten: no event that could still come would be refused by it.
    """
    import pandas as pd

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if pd.isna(key[0]):
            return
        until = state.get[0] if state.exists else 0
        out = []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        for event, kind, at in zip(rows["event_id"], rows["event_type"], rows["at"], strict=True):
            if kind == "done":
                until, verdict = 0, "released"
            elif at >= until:
                until, verdict = at + seconds, "claimed"
            else:
                verdict = "refused"
            out.append((key[0], event, verdict))
        if until:
            state.update((int(until),))
            state.setTimeoutTimestamp(max(int(until) * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "event_id", "verdict"])

    keyed = events.withWatermark("ts", delay).select("user_id", "event_id", "event_type", "ts", F.unix_seconds("ts").alias("at"))
    return keyed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, verdict string", "until long", "append", "EventTimeTimeout")


def recent(events: DataFrame, most: int = 6) -> DataFrame:
    """Memory of a session: its latest `most` events, forgotten where an event clears it (`event_type` = error); a row for each event."""
    import pandas as pd

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):
            return
        held = list(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        for event, kind in zip(rows["event_id"], rows["event_type"], strict=True):
            held = [] if kind == "error" else [*held, int(event)][-most:]
            out.append((key[0], event, len(held), held[0] if held else None))
        state.update((held,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "remembered", "oldest"]).astype({"oldest": "Int64"})

    keyed = events.select("user_id", "event_id", "event_type", F.unix_seconds("ts").alias("at"))
    return keyed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, remembered long, oldest long", "held array<long>", "append", "NoTimeout")


def expired_jobs(events: DataFrame, ttl: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Finished jobs (event_type `purchase`) and when they may go: `ttl` after the window in which they last finished."""
    # a filter before the aggregation would hold back the watermark until the next finished job
    done = F.col("event_type") == "purchase"
    g = events.withWatermark("ts", delay).groupBy("user_id", F.window("ts", ttl)).agg(F.count_if(done).alias("n_jobs"), F.max(F.when(done, F.col("event_id"))).alias("last_job"))
    return g.filter("n_jobs > 0").select("user_id", F.col("window.start").alias("hour"), (F.col("window.end") + F.expr(f"INTERVAL {ttl}")).alias("expires"), "n_jobs", "last_job")


def swept(traces: DataFrame, base: str, group: str, key: str, days: int, most_bytes: int) -> DataFrame:
    """What a retention sweep after every batch of a stream leaves (group, key, ts, size): not older than `days` before the
    newest trace so far, and of each group the newest that fit `most_bytes`.

    A sweep is a table of its own below `base`, named by its batch, with what is kept and, for each group, the newest trace
    that size has driven out: a trace that comes late and is older than that one is not kept either, as if all had come at
    once. A batch that is run again reads the table before its own and overwrites its own, so a restart changes nothing.
    """
    spark = traces.sparkSession
    schema = f"{group} {traces.schema[group].dataType.simpleString()}, {key} {traces.schema[key].dataType.simpleString()}, ts timestamp, size long, kept boolean"
    order = F.struct("ts", key)

    def sweep(batch: DataFrame, number: int) -> None:
        new = batch.select(group, key, "ts", F.col("size").cast("long").alias("size"), F.lit(True).alias("kept"))
        own = new if number == 0 else new.unionByName(spark.read.schema(schema).parquet(f"{base}/sweep={number - 1}"))
        last = own.agg((F.max("ts") - F.expr(f"INTERVAL {int(days)} DAYS")).alias("since"))
        own = own.crossJoin(F.broadcast(last))  # one row
        of = Window.partitionBy(group)
        own = own.withColumn("floor", F.max(F.when(~F.col("kept"), order)).over(of))
        # what was driven out stays as a mark only, and counts no bytes
        own = own.filter(~F.col("kept") | ((F.col("ts") >= F.col("since")) & (F.col("floor").isNull() | (order > F.col("floor")))))
        running = F.sum(F.when(F.col("kept"), F.col("size")).otherwise(0)).over(of.orderBy(F.desc("ts"), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0))
        own = own.withColumn("kept", F.col("kept") & (running <= most_bytes))
        marks = F.row_number().over(Window.partitionBy(group, "kept").orderBy(F.desc("ts"), F.desc(key)))
        left = own.withColumn("n", marks).filter(F.col("kept") | (F.col("n") == 1)).select(group, key, "ts", "size", "kept")
        left.write.mode("overwrite").parquet(f"{base}/sweep={number}")

    q = traces.writeStream.foreachBatch(sweep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    done = q.lastProgress
    if done is None:
        return spark.createDataFrame([], schema).drop("kept")
    return spark.read.schema(schema).parquet(f"{base}/sweep={done['batchId']}").filter("kept").drop("kept")


def drained(events: DataFrame, make: Callable[[DataFrame], DataFrame], base: str) -> DataFrame:
    """What `make(events)` gives for the events that there are, as a Parquet table below `base`, a shared folder.

    The stream runs twice over one checkpoint: over the events, and over a row far in the future that lets the watermark
    pass every window, so that all of them close. What the last row itself leads to is left out.
    """
    spark = events.sparkSession
    # a field must be free of notes for the two streams to agree
    last = f"{base}/last"
    plain = events.schema
    spark.createDataFrame([], plain).write.mode("overwrite").parquet(last)
    ended = events.unionByName(spark.readStream.schema(plain).parquet(last))
    out = make(ended)

    def run() -> None:
        q = out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        finally:
            q.stop()

    run()
    blank = [F.lit(END).cast("timestamp").alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in plain]
    spark.range(1).select(*blank).write.mode("append").parquet(last)
    run()
    done = spark.read.schema(out.schema).parquet(f"{base}/out")
    return done.filter(F.col(out.columns[0 if out.columns[0] != "hour" else 1]).isNotNull())
