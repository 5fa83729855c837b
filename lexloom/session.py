"""Session helpers: lineage cuts in the shared folder, small-table guards, partition counts."""

from __future__ import annotations

import atexit
import pickle
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a few narrow columns is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediates: ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder, remembered in the session; a cluster has none that all
    of its machines see, so nothing is run there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def remove_later(spark: SparkSession, path: str) -> None:
    """Delete a folder when the interpreter ends."""
    atexit.register(_remove, spark, path)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and an executor's
    loss costs nothing. The files are deleted when the interpreter ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the jobs inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def by_value(spark: SparkSession, thing) -> Callable[[], Any]:
    """A broadcast whose workers need not be able to import this package: objects travel with their classes."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(sent.value)  # noqa: S301


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is read in fewer parts than there are: a table of one small file. Larger ones stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has no more than ``rows`` rows; counting stops there. Otherwise left as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
