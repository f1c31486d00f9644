"""Session helpers: a local session for tests and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_SCRATCH: set[str] = set()
_TABLES: set[str] = set()


def local_session(app: str = "gridcast", cores: str = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A folder of our own is made only on a local master, where the driver is
    the one executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="gridcast-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; :func:`release` deletes what is there."""
    path = f"{shared_dir(spark)}/gridcast-{name}-{uuid.uuid4().hex}"
    _SCRATCH.add(path)
    return path


def scratch_table(spark: SparkSession, name: str) -> tuple[str, str]:
    """A fresh name for a table and a path for its files; :func:`release` drops both."""
    path = scratch_path(spark, name)
    table = f"{name}_{path.rsplit('-', 1)[-1]}"
    _TABLES.add(table)
    return table, path


def stored(df: DataFrame, name: str = "rows", by: str | None = None) -> DataFrame:
    """Write a table as Parquet below the shared folder and read it from there.

    For intermediate tables as long as the data: reads keep column pruning,
    pushed filters and size statistics, and need no lost executor's work. The
    files go with :func:`release`, at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    _SCRATCH.discard(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete all scratch paths given out so far; results that read them must be done."""
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _SCRATCH:
        discard(spark, next(iter(_SCRATCH)))


@atexit.register
def _release_at_end() -> None:
    spark = SparkSession.getActiveSession() if _SCRATCH else None
    if spark is not None:
        with contextlib.suppress(Exception):  # the JVM may have gone first
            release(spark)


def frozen(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there.

    Later reads see exactly these rows even after executors are lost, and the
    plan starts anew.
    """
    spark = df.sparkSession
    root = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
