"""Sinks. ``once`` refuses to overwrite earlier artifacts."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession


def _mode(once: bool) -> str:
    return "errorifexists" if once else "overwrite"


def write_csv(df: DataFrame, path: str, sep: str = ",", compression: str = "none", once: bool = True) -> None:
    df.write.mode(_mode(once)).csv(path, header=True, sep=sep, compression=compression, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str, once: bool = True) -> None:
    df.write.mode(_mode(once)).json(path)


def write_text(df: DataFrame, column: str, path: str, once: bool = True) -> None:
    df.select(df[column].cast("string").alias("value")).write.mode(_mode(once)).text(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, once: bool = True) -> None:
    df.write.mode(_mode(once)).partitionBy(*(partition_by or [])).parquet(path)


def fingerprint(config: dict) -> str:
    """SHA-256 of a configuration, keys in order."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def cached_table(spark: SparkSession, root: str, config: dict, build) -> DataFrame:
    """The table built from ``config``: reused where one with the same fingerprint was written, else built and written."""
    path = f"{root.rstrip('/')}/{fingerprint(config)[:32]}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        write_table(build(), path, once=False)
    return spark.read.parquet(path)
