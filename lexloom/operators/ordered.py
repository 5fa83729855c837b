"""Globally ordered scans without a global task.

A total order is laid down by range partitioning on (key, tie): a key that holds a third of all rows is split over
many partitions, because the tie column is part of the range. Each partition is scanned once; what crosses a
partition border (an unfinished run, a running sum) is carried over in a table of one row per partition, the only
thing the driver sees, bounded by the number of shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut, partitions

_RUNS = "part int, first boolean, id bigint, head bigint, head_key string, tail_key string, runs bigint"


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    key = first_key = None
    head = None
    runs = 0
    schema = pa.schema([("part", pa.int32()), ("first", pa.bool_()), ("id", pa.int64()), ("head", pa.int64()), ("head_key", pa.string()), ("tail_key", pa.string()), ("runs", pa.int64())])
    for b in batches:
        if not b.num_rows:
            continue
        keys, ids = b.column(0), b.column(1).to_numpy()
        n = b.num_rows
        new = np.ones(n, bool)
        if n > 1:  # full keys of neighbours are compared, never digests
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        opening = keys[0].as_py()
        new[0] = opening != key
        if key is None:
            first_key = opening
        where = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        heads = np.where(where >= 0, ids[np.maximum(where, 0)], head if head is not None else 0)
        number = runs + np.cumsum(new)
        runs, key, head = int(number[-1]), keys[n - 1].as_py(), int(heads[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(number == 1), pa.array(ids), pa.array(heads), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], schema=schema)
    if runs:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([False]), pa.array([None], pa.int64()), pa.array([head], pa.int64()), pa.array([first_key]), pa.array([key]), pa.array([runs], pa.int64())], schema=schema)


def adjacent_runs(df: DataFrame, key: str, id: str) -> DataFrame:
    """(id, head): for each row the smallest id among the rows with an equal key.

    ``key`` is a string, ``id`` a bigint; rows with a null key or id are left out. Range partition, sort, compare
    neighbours; runs that cross partitions are joined through the border table.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(id).cast("bigint").alias("id")).where("key is not null and id is not null")
    ordered = rows.repartitionByRange(partitions(spark), "key", "id").sortWithinPartitions("key", "id")
    scanned = cut(ordered.mapInArrow(_scan_runs, _RUNS), "runs")
    borders = scanned.where("id is null").select("part", "head", "head_key", "tail_key", "runs").orderBy("part").collect()
    carried, tail, head = [], None, None
    for b in borders:  # one row per shuffle partition
        same = tail is not None and b.head_key == tail
        if same:
            carried.append((b.part, head))
        if not same or b.runs > 1:
            head = b.head
        tail = b.tail_key
    found = scanned.where("id is not null")
    if not carried:
        return found.select("id", "head")
    over = F.broadcast(spark.createDataFrame(carried, "part int, carried bigint"))
    return found.join(over, "part", "left").select("id", F.expr("if(first, coalesce(carried, head), head)").alias("head"))


_SUMS = "part int, grp string, id bigint, size bigint, upto bigint, total bigint, what string"


def _scan_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    grp, run = None, 0
    totals: list[tuple[str, int]] = []
    schema = pa.schema([("part", pa.int32()), ("grp", pa.string()), ("id", pa.int64()), ("size", pa.int64()), ("upto", pa.int64()), ("total", pa.int64()), ("what", pa.string())])
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        g, ids, sizes = b.column(0), b.column(1), b.column(2).to_numpy()
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = pc.not_equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        opening = g[0].as_py()
        new[0] = opening != grp
        sums = np.cumsum(sizes)
        starts = np.flatnonzero(new)
        base = np.zeros(n, np.int64)
        if len(starts):
            lens = np.diff(np.append(starts, n))
            base[starts[0] :] = np.repeat(sums[starts] - sizes[starts], lens)
            base[: starts[0]] = -run
        else:
            base[:] = -run
        upto = sums - base
        ends = np.append(starts[starts > 0] - 1, n - 1)
        if grp is not None and new[0]:
            totals.append((grp, run))
        for e in ends[:-1]:
            totals.append((g[int(e)].as_py(), int(upto[e])))
        grp, run = g[n - 1].as_py(), int(upto[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), g, ids, pa.array(sizes), pa.array(upto), pa.nulls(n, pa.int64()), b.column(3)], schema=schema)
    if grp is not None:
        totals.append((grp, run))
        k = len(totals)
        yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array([t[0] for t in totals], pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([t[1] for t in totals], pa.int64()), pa.nulls(k, pa.string())], schema=schema)


def running_sums(df: DataFrame, group: str, order: list[str], id: str, size: str, keep: str | None = None) -> DataFrame:
    """(id, grp, size, before, upto): running sums of ``size`` within ``group`` in the given order; with ``keep``, that
    column as the string ``what`` too.

    No group is ever in one task: the range covers (group, order, id). The border table has a row for each
    (partition, group) met, at most partitions + groups rows; its window runs over those only.
    """
    spark = df.sparkSession
    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(id).cast("bigint").alias("id"), F.col(size).cast("bigint").alias("size"), F.col(keep).cast("string").alias("what") if keep else F.lit(None).cast("string").alias("what"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).where("grp is not null and id is not null and size is not null")
    keys = ["grp", *[f"o{i}" for i in range(len(order))], "id"]
    ordered = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).select("grp", "id", "size", "what")
    scanned = cut(ordered.mapInArrow(_scan_sums, _SUMS), "sums")
    borders = scanned.where("id is null").select("part", "grp", F.expr("coalesce(sum(total) over (partition by grp order by part rows between unbounded preceding and 1 preceding), 0)").alias("base"))
    found = scanned.where("id is not null").select("part", "grp", "id", "size", "upto", "what")
    return found.join(F.broadcast(borders), ["part", "grp"]).select("id", "grp", "size", F.expr("base + upto - size").alias("before"), F.expr("base + upto").alias("upto"), *(["what"] if keep else []))


def quantiles(df: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """(by, q0, q1, ...): interpolated quantiles of each group, null groups too. Values are counted first and ranked by a
    prefix sum, so that no group's values are ever in one buffer."""
    none = "\0"
    counts = df.where(F.col(value).isNotNull()).groupBy(F.coalesce(F.col(by).cast("string"), F.lit(none)).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("n")).withColumn("zero", F.lit(0))
    sums = running_sums(counts, "g", ["v"], "zero", "n", keep="v").withColumn("v", F.col("what").cast("double"))
    # the ends of each group's last value are its size
    sums = sums.join(counts.groupBy(F.col("g").alias("grp")).agg(F.sum("n").alias("all")), "grp")
    at = lambda k: F.max(F.expr(f"if(before <= {k} and {k} < upto, v, null)"))
    out = []
    for i, q in enumerate(shares):
        low, high = f"floor({q!r}D * (all - 1))", f"ceil({q!r}D * (all - 1))"
        part = F.max(F.expr(f"{q!r}D * (all - 1) - {low}"))
        out.append((at(low) + part * (at(high) - at(low))).alias(f"q{i}"))
    return sums.groupBy("grp").agg(*out).select(F.when(F.col("grp") != none, F.col("grp")).alias(by), *[f"q{i}" for i in range(len(shares))])
