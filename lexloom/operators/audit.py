"""Audits: keys, partitions, recomputed ranks. Each gives counts that must be 0 or a table of what differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(rows, distinct_keys, repeated): repeated counts the keys that more than one row has."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("repeated"))


def overlaps(parts: DataFrame, name: str, key: str) -> DataFrame:
    """(a, b, keys): keys that two named parts share. A key meets itself once for each part that has it, not once a row."""
    sets = parts.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(name)).alias("names")).where(F.size("names") > 1)
    pairs = F.expr("flatten(transform(names, (x, i) -> transform(slice(names, i + 2, size(names)), y -> struct(x as a, y as b))))")
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("keys"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, rows): rows that one table has more often than the other; none if they are identical as bags."""
    cols = a.columns
    rows = a.select(*cols, F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(b.select(*cols, F.lit(0).alias("x"), F.lit(1).alias("y")))
    per = rows.groupBy(*cols).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return per.agg(F.sum(F.greatest(F.col("x") - F.col("y"), F.lit(0))).alias("only_a"), F.sum(F.greatest(F.col("y") - F.col("x"), F.lit(0))).alias("only_b"))


def grid(df: DataFrame, keys: list[str]) -> DataFrame:
    """(expected, found): the cells a full grid of the keys' values has, and those that occur. No grid is written out."""
    cells = df.select(*keys).where(" and ".join(f"{k} is not null" for k in keys)).distinct()
    counts = cells.agg(*[F.count_distinct(k).alias(f"_{i}") for i, k in enumerate(keys)], F.count("*").alias("found"))
    expected = F.lit(1).cast("bigint")
    for i in range(len(keys)):
        expected = expected * F.col(f"_{i}")
    return counts.select(expected.alias("expected"), "found")


def set_relation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(both, only_a, only_b): distinct keys of two tables; subset, equality and disjointness read off it."""
    rows = a.select(key, F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(b.select(key, F.lit(0).alias("x"), F.lit(1).alias("y"))).where(F.col(key).isNotNull())
    per = rows.groupBy(key).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return per.agg(F.count_if(F.col("x") + F.col("y") == 2).alias("both"), F.count_if(F.col("y") == 0).alias("only_a"), F.count_if(F.col("x") == 0).alias("only_b"))


def excluded(df: DataFrame, reserved: DataFrame, key: Column) -> DataFrame:
    """Rows whose key is in none of the reserved hashes, case ignored; rows without a key stay."""
    return df.withColumn("_k", F.lower(key)).join(reserved.where("line_hash is not null").select(F.lower("line_hash").alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def score_checks(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(rows, nulls, not_finite, above_one, repeated): what a table of probabilities must not have."""
    v = F.col(value)
    per = scores.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(v.isNull()).alias("_nulls"), F.count_if(F.isnan(v) | (F.abs(v) == float("inf"))).alias("_odd"), F.count_if((v > 1 + 1e-6) & ~F.isnan(v)).alias("_above"))
    return per.agg(F.sum("_n").alias("rows"), F.sum("_nulls").alias("nulls"), F.sum("_odd").alias("not_finite"), F.sum("_above").alias("above_one"), F.count_if(F.col("_n") > 1).alias("repeated"))


def rank_check(cases: DataFrame, id: str, rank: str, words: str, actual: str) -> DataFrame:
    """(recorded, recomputed, cases): a recorded rank against the actual word's place among the first three of a list."""
    at = F.array_position(F.slice(words, 1, 3), F.col(actual))
    return cases.groupBy(F.col(rank).alias("recorded"), F.coalesce(at, F.lit(0)).cast("int").alias("recomputed")).agg(F.count("*").alias("cases"))


def shape_check(cases: DataFrame, options: str, choice: str, actual: str) -> DataFrame:
    """(cases, broken, no_target, repeated, choice_outside) of the options of each case."""
    o = F.col(options)
    ok = o.isNotNull()
    return cases.agg(
        F.count("*").alias("cases"), F.count_if(~ok | (F.size(o) != 4)).alias("broken"), F.count_if(ok & ~F.coalesce(F.array_contains(o, F.col(actual)), F.lit(False))).alias("no_target"),
        F.count_if(ok & (F.size(F.array_distinct(o)) < F.size(o))).alias("repeated"), F.count_if(ok & ~F.coalesce(F.array_contains(o, F.col(choice)), F.lit(False))).alias("choice_outside"),
    )


def integral(rates: DataFrame, rate: str, cases: str) -> DataFrame:
    """Rates that are no whole number of successes."""
    n = F.col(rate) * F.col(cases)
    return rates.where(F.abs(n - F.round(n)) >= 1e-9)


def index_check(index: DataFrame) -> DataFrame:
    """(rows, bad_context, bad_ending, bad_count) of a continuation index."""
    c, e = F.size(F.split("context", " ")), F.size(F.split("continuation", " "))
    return index.agg(F.count("*").alias("rows"), F.count_if(~c.between(2, 4)).alias("bad_context"), F.count_if(~e.between(1, 3)).alias("bad_ending"), F.count_if(F.col("cnt") < 1).alias("bad_count"))


def reach(cases: DataFrame, actual: str, generators: dict[str, DataFrame], id: str) -> DataFrame:
    """(generator, cases, covered): of how many cases each generator's (id, word) holds the actual word."""
    total, out = cases.count(), None
    for name, g in generators.items():
        hit = cases.join(g.select(F.col(id), F.col("word").alias(actual)), [id, actual], "left_semi").agg(F.count("*").alias("covered"))
        row = hit.select(F.lit(name).alias("generator"), F.lit(total).alias("cases"), "covered")
        out = row if out is None else out.unionAll(row)
    return out


def numeric_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(compared, only_a, only_b, greatest): two arms' numbers for the same keys."""
    x, y = a.select(*keys, F.col(value).alias("x"), F.lit(1).alias("in_a")), b.select(*keys, F.col(value).alias("y"), F.lit(1).alias("in_b"))
    rows = x.join(y, keys, "full")
    return rows.agg(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("compared"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.max(F.abs(F.col("x") - F.col("y"))).alias("greatest"))


def unpivoted(metrics: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return metrics.unpivot(ids, values, "metric", "value")


def pivoted(long: DataFrame, row: str, column: str, values: list[str], measure: str) -> DataFrame:
    return long.groupBy(row).pivot(column, values).agg(F.first(measure))
