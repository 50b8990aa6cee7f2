"""A session for tests, benchmarks and single machines; clusters bring their own."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "12g", partitions: int | None = None) -> SparkSession:
    s = (
        SparkSession.builder.master(f"local[{cpus}]").appName("evidentia").config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or (8 if cpus == "*" else cpus))).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local session may go without and gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = getattr(spark, "_evidentia_folder", None) or tempfile.mkdtemp(prefix="evidentia-")
        spark._evidentia_folder = path
    return path.rstrip("/")


def materialized(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared folder and read back, for plans that grow step by step. Runs a job at once."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(file system, path) of a file or folder in the shared folder, for tasks that read it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9]+:", uri) else (fs.LocalFileSystem(), uri)
