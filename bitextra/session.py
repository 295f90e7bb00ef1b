"""Session helpers for local runs and for the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Fixed value: the setting by which a query removes its shuffle files when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int = 8, app: str = "bitextra") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can see: ``spark.checkpoint.dir``.

    Where a local session names none, a temporary folder is set once and used
    by both ``checkpoint()`` and the scratch tables. On a cluster every executor
    would write to a disk of its own, so there the folder must be named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if not current:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not current:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = spark.sparkContext.getCheckpointDir()
    return current


# Scratch paths of this driver, by the session's application.
_STEPS: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, so a retried job is safe."""
    path = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _STEPS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_steps(spark: SparkSession) -> int:
    """Delete the scratch paths that this driver has made; how many there were.

    To be called when all results have been written: frames that still read
    from a step cannot be computed any more.
    """
    return drop_folders(spark, _STEPS.pop(spark.sparkContext.applicationId, []))


def drop_folders(spark: SparkSession, paths: list[str]) -> int:
    """Delete folders of steps that nothing reads any more; how many there were."""
    there = 0
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        there += where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return there


@contextmanager
def shuffles_go(spark: SparkSession):
    """Queries run within remove their shuffle files as they end, not when the driver next collects garbage."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder once and read it back.

    The rows survive lost executors, later plans start from the files, and -
    unlike ``checkpoint()`` on an unpersisted frame - nothing is computed twice.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_parts(df: DataFrame, part: str) -> dict[str, list[str]]:
    """Write the frame to the shared folder once; the folder of each value of ``part`` that has rows.

    A part can be dropped as soon as the steps made from it are written, while
    the others go on being read. Read one by ``read_parts``.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "step")
    with shuffles_go(spark):
        df.write.option("compression", "zstd").partitionBy(part).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    names = [f.getPath().getName() for f in found if f.isDirectory()]
    return {n.split("=", 1)[1]: [f"{path}/{n}"] for n in names if n.startswith(f"{part}=")}


def read_parts(spark: SparkSession, folders: list[str], schema: str) -> DataFrame:
    """The rows of parts written by ``cut_parts``; none for no folder."""
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
