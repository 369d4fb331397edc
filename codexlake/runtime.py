"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, as spark.checkpoint.dir names it.

    Where it is unset, a session on one machine gets a temporary folder; a cluster's executors could not read that, so
    there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="codexlake-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path, as the JVM's objects."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    settings = context._jsc.hadoopConfiguration() if context._jsc else context._jvm.org.apache.hadoop.conf.Configuration()
    return target.getFileSystem(settings), target


_STAGED: dict[DataFrame, str] = {}


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files, which else stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def staged(df: DataFrame, label: str, *, free: bool = False) -> DataFrame:
    """df written once as a table in the shared folder and read back: cuts the lineage and survives lost executors.

    The table stays until discarded() or release(), or until Python ends. free: its shuffle files go once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _shuffles_freed(spark) if free else contextlib.nullcontext():
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _STAGED[back] = path
    return back


def discarded(df: DataFrame) -> None:
    """Delete a staged table that no later step reads."""
    path = _STAGED.pop(df, None)
    if path is not None:
        system, target = file_system(df.sparkSession, path)
        system.delete(target, True)


def release(spark: SparkSession) -> int:
    """Delete all tables staged by this session, whose results must have been taken; returns how many."""
    own = [df for df in _STAGED if df.sparkSession.sparkContext is spark.sparkContext]
    for df in own:
        discarded(df)
    return len(own)


@atexit.register
def _release_all() -> None:
    for df in list(_STAGED):
        try:
            discarded(df)
        except Exception:  # noqa: BLE001  the session may be gone, and its folder with it
            _STAGED.pop(df, None)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table just read, dealt out by its key if its files give fewer partitions than the cluster has cores.

    For tables of few files before work in Python; tables of many files pass unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def bounded_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About `rows` of `total` rows, chosen by a hash of their key, so that the same rows give the same sample anywhere;
    never more than twice as many, however often a key is repeated."""
    if total <= rows:
        return df
    chosen = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(key)), 1) < F.lit(int(rows / total * 2**63))
    return df.filter(chosen).limit(2 * rows)


def local_session(cpus: int = 8, partitions: int | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.driver.memory", os.environ.get("CODEXLAKE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
