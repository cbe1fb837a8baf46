"""Session settings and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "codeloom", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **SESSION_CONF,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session may
    fall back to a temporary folder: on a cluster a machine-local folder would
    be lost together with its machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="codeloom-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back from there.

    Used where a result is read more than once or where a loop would otherwise
    grow its lineage; the files outlive any executor.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store_table(df: DataFrame, *partition_by: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a compressed table in the checkpoint folder: (table, location).

    For wide intermediate rows of which each reader needs a few columns.
    """
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(at)
    return spark.read.schema(df.schema).parquet(at), at


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Each query that runs inside leaves no shuffle files; so later ones read what it wrote, and not its plan."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    now = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, now)


def drop_files(spark: SparkSession, at: str) -> None:
    """Remove what a job wrote at a location and does not read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize_by(df: DataFrame, *keys: str, grouped: bool = False) -> DataFrame:
    """Store ``df`` partitioned and sorted by ``keys``, and let later joins know.

    A plan that adapts at run time does not promise its partitioning, so the
    promise would be lost with the checkpoint.  The last step is therefore
    planned ahead; joins on ``keys`` then neither shuffle nor sort the table
    again.  ``grouped`` says that ``df`` ends in a grouping by ``keys`` over
    evenly spread keys, which needs no adapting and no second shuffle.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    last = df if grouped else materialize(df).repartition(parts, *keys)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return last.sortWithinPartitions(*keys).checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


# Rows per partition of a loop over stored links.
LOOP_ROWS = 250_000


@contextmanager
def partitions_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Use no more shuffle partitions than ``rows`` fill, while a loop is planned.

    Inside a loop the stored side fixes the number of partitions, so it cannot
    shrink at run time.  The session's own setting is the upper bound.
    """
    key = "spark.sql.shuffle.partitions"
    now = spark.conf.get(key)
    wanted = max(spark.sparkContext.defaultParallelism, rows // LOOP_ROWS + 1)
    spark.conf.set(key, str(min(int(now), wanted)))
    try:
        yield
    finally:
        spark.conf.set(key, now)


# Rows that a task takes in where the number of tasks follows the rows.
TASK_ROWS = 200_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for ``rows``: their number grows with the rows, and not what a task holds."""
    return max(spark.sparkContext.defaultParallelism, rows // TASK_ROWS + 1)


def spread_by(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over ``parts`` partitions; without ``parts`` Spark decides."""
    return df.repartition(parts, *keys) if parts else df


# Rows up to which a table may be sent whole to every executor.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a table for broadcast only once its row count is known to be small.

    Beyond ``limit`` the plain table is returned and Spark shuffles the join.
    """
    kept = materialize(df)
    small = kept.limit(limit + 1).count() <= limit
    return F.broadcast(kept) if small else kept
