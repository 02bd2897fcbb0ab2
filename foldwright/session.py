"""Session settings, scratch space and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators rely on at scale. A cluster session should carry them.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "foldwright", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    It is chosen here only when the session names none and runs on one machine;
    on a cluster a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
        root = context.getCheckpointDir()
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the length of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialise(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once as a parquet table and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, label)
    if partition_by:
        # rebalance splits hot partition values over several tasks and merges tiny ones
        df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Broadcast ``df`` if it really has at most ``max_rows`` rows, else return it unchanged.

    The rows are fetched once, so a small aggregate is not computed a second time by the
    join. A larger side is left to a shuffle join.
    """
    fetched = df.limit(max_rows + 1).toArrow()
    if fetched.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(fetched, df.schema))


def small_sides(frames: list[DataFrame], max_rows: int = 20_000) -> list[DataFrame]:
    """``small_side`` of several frames, fetched side by side."""
    wrap = inheritable_thread_target(frames[0].sparkSession)
    with ThreadPool(len(frames)) as pool:
        return pool.map(wrap(lambda df: small_side(df, max_rows)), frames)


def range_buckets(spark: SparkSession) -> int:
    """Buckets used to split an ordering: several times the shuffle width, so that no task gets one whole
    group and tasks come out even."""
    return min(max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 2), 10_000)
