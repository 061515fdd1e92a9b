"""Session defaults and the shared folder in which jobs keep their intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def is_local(spark: SparkSession) -> bool:
    """Whether everything runs in one process; ``local-cluster`` has several."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session (one machine, as in tests) may go without the setting; it gets a temporary folder.
    On a cluster a machine-local folder would be lost with its executor, so the missing setting is an error.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not is_local(spark):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set(CHECKPOINT_CONF, root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; row order and partitioning of ``df`` become fixed."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job that is started within are deleted at its end, and not when its plan is collected.

    For jobs whose result is stored: nothing asks for these files again.
    """
    before = spark.conf.get(_CLEANUP_CONF, None)
    spark.conf.set(_CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP_CONF) if before is None else spark.conf.set(_CLEANUP_CONF, before)


class Workspace:
    """Named parquet tables of one run, in a folder of its own below the shared folder."""

    def __init__(self, spark: SparkSession, name: str = "run", root: str | None = None):
        self.spark = spark
        self.path = root.rstrip("/") if root else f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table_path(self, table: str) -> str:
        return f"{self.path}/{table}"

    def write(self, df: DataFrame, table: str, **options: str) -> DataFrame:
        """Write ``df`` and return the table read back, so that its lineage starts at the files. ``options`` of the writer."""
        path = self.table_path(table)
        with shuffles_dropped(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.table_path(table))

    def remove(self, *tables: str) -> None:
        """Deletes tables that nothing reads any more; those that were never written are passed over."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.table_path(table))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def local_rows(df: DataFrame, max_rows: int) -> list | None:
    """The rows of ``df`` if there are at most ``max_rows`` of them, else None. Never fetches more than that."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` as a broadcast table when it has at most ``max_rows`` rows; otherwise ``df`` without a hint.

    The rows are fetched once, under a limit, and the broadcast side is rebuilt from them, so ``df`` is not
    computed a second time. Beyond the bound the planner is left to shuffle.
    """
    rows = local_rows(df, max_rows)
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def one_value(df: DataFrame, value: Column) -> Column:
    """A single-row aggregate as a scalar subquery: evaluated once, no join and no driver round trip."""
    return df.select(value).scalar()


def broadcast_if_light(df: DataFrame, max_rows: int, max_bytes: int, size_of: Column) -> tuple[DataFrame, bool]:
    """(``df`` with a broadcast hint, True) when both bounds hold, else (``df``, False).

    For tables too large to fetch but perhaps small enough to send to every executor; ``df`` should be a stored
    table, as measuring it reads it once.
    """
    size = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size_of), F.lit(0)).alias("b")).first()
    light = size["n"] <= max_rows and size["b"] <= max_bytes
    return (F.broadcast(df) if light else df), light
