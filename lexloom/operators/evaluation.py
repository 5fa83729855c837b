"""Metrics of ranked predictions, comparisons of two arms, and intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.stats import Z, mcnemar, wilson
from lexloom.operators.ordered import quantiles

#: Smallest probability whose logarithm is taken.
TINY = 2.2250738585072014e-308


def ranks(cases: DataFrame, predictions: DataFrame, id: str, actual: str) -> DataFrame:
    """Cases with ``rank``: the rank of the actual word among the predictions, 0 if it is not there."""
    hit = predictions.select(F.col(id), F.col("word").alias(actual), F.col("rank").alias("_r"))
    return cases.join(hit, [id, actual], "left").withColumn("rank", F.coalesce("_r", F.lit(0))).drop("_r")


def _metrics() -> list[Column]:
    r = F.col("rank")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return [F.count("*").alias("cases"), share(r == 1).alias("top1"), share((r > 0) & (r <= 2)).alias("top2"), share((r > 0) & (r <= 3)).alias("top3"), F.round(F.avg(F.when(r > 0, 1 / r).otherwise(0.0)), 6).alias("mrr")]


def metrics(details: DataFrame, by: str = "source") -> DataFrame:
    """Top-1 to top-3 shares and mean reciprocal rank, overall ('(all)') and by source, in one pass."""
    rows = details.withColumn(by, F.coalesce(by, F.lit("")))
    return rows.rollup(by).agg(*_metrics(), F.grouping(by).alias("g")).withColumn(by, F.when(F.col("g") == 1, "(all)").otherwise(F.col(by))).drop("g")


def perplexity(details: DataFrame, by: str = "source") -> DataFrame:
    rows = details.withColumn(by, F.coalesce(by, F.lit("")))
    return rows.groupBy(by).agg(F.count("*").alias("cases"), F.round(F.exp(-F.avg(F.log(F.greatest("p", F.lit(TINY))))), 4).alias("perplexity"), F.round(100 * F.avg((~F.col("known")).cast("double")), 6).alias("oov_percent"))


def intervals(details: DataFrame, by: str = "source") -> DataFrame:
    """Top-3 successes with Wilson bounds."""
    rows = details.withColumn(by, F.coalesce(by, F.lit(""))).groupBy(by).agg(F.count("*").alias("cases"), F.count_if(F.col("rank") > 0).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("cases"))
    return rows.select(by, "cases", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def grouped(details: DataFrame, groups: Column) -> DataFrame:
    """Metrics of overlapping groups; ``groups`` is an array of names for each row."""
    return details.withColumn("grp", F.explode(groups)).groupBy("grp").agg(*_metrics())


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Both arms side by side: keys, rank_a, rank_b. Keys are matched null-safely, unmatched rows are dropped."""
    x, y = a.select(*keys, F.col("rank").alias("rank_a")), b.select(*[F.col(k).alias(f"{k}_b") for k in keys], F.col("rank").alias("rank_b"))
    on = F.lit(True)
    for k in keys:
        on = on & x[k].eqNullSafe(y[f"{k}_b"])
    return x.join(y, on).select(*keys, "rank_a", "rank_b")


def _outcome(rank: Column) -> Column:
    return F.when(rank == 1, "top1").when(rank > 0, "top3").otherwise("missed")


def transitions(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(_outcome(F.col("rank_a")).alias("from"), _outcome(F.col("rank_b")).alias("to")).agg(F.count("*").alias("cases"))


def gains(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cases that only one arm has in its top 3, both, neither, and the exact McNemar p."""
    a, b = F.col("rank_a") > 0, F.col("rank_b") > 0
    rows = pairs.groupBy(*(by or [])).agg(F.count("*").alias("cases"), F.count_if(~a & b).alias("gains"), F.count_if(a & ~b).alias("losses"), F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("neither"))
    return rows.withColumn("p_value", F.round(mcnemar(F.col("gains"), F.col("losses")), 9))


def _resampled(reps: int, seed: int, equal: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        rng = np.random.default_rng(seed)
        draws, sizes = [], []
        for r in sorted(rows, key=lambda r: str(r["source"])):
            counts = np.array([r["losses"], r["ties"], r["wins"]], float)
            n = int(counts.sum())
            got = rng.multinomial(n, counts / n, size=reps)
            draws.append((got[:, 2] - got[:, 0]) / (1 if not equal else n))
            sizes.append(n)
        d = np.mean(draws, axis=0) if equal else np.sum(draws, axis=0) / sum(sizes)
        estimate = np.mean([(r["wins"] - r["losses"]) / (r["wins"] + r["ties"] + r["losses"]) for r in rows]) if equal else sum(r["wins"] - r["losses"] for r in rows) / sum(sizes)
        low, high = np.quantile(d, [0.025, 0.975])
        yield pa.RecordBatch.from_pylist([{"estimate": float(estimate), "low": float(low), "high": float(high)}])

    return run


def bootstrap(pairs: DataFrame, reps: int = 10_000, seed: int = 1, equal: bool = True) -> DataFrame:
    """(estimate, low, high) of the paired top-3 difference, resampled within sources; sources weigh the same, or by size.

    A difference is -1, 0 or 1: resampling rows of a source is one multinomial draw of three counts, so only three
    numbers a source reach the sampling task, whatever the number of rows.
    """
    d = (F.col("rank_b") > 0).cast("int") - (F.col("rank_a") > 0).cast("int")
    counts = pairs.groupBy("source").agg(F.count_if(d == 1).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d == -1).alias("losses"))
    return counts.coalesce(1).mapInArrow(_resampled(reps, seed, equal), "estimate double, low double, high double")


def gate(interval: DataFrame, p_value: float | None = None) -> DataFrame:
    """Whether an arm is promoted: the interval lies above 0 and, where a p value is given, that is below .05."""
    ok = F.col("low") > 0
    return interval.withColumn("promoted", ok & F.lit(p_value < 0.05) if p_value is not None else ok)


def by_seed(details: DataFrame, arms: list[str]) -> DataFrame:
    """Mean, least and greatest top-3 share of each arm over its seeds."""
    per = details.groupBy(*arms, "seed").agg(F.avg((F.col("rank") > 0).cast("double")).alias("top3"), F.avg((F.col("rank") == 1).cast("double")).alias("top1"))
    return per.groupBy(*arms).agg(F.count("*").alias("seeds"), F.round(F.avg("top3"), 6).alias("mean_top3"), F.round(F.min("top3"), 6).alias("least_top3"), F.round(F.max("top3"), 6).alias("most_top3"), F.round(F.avg("top1"), 6).alias("mean_top1"))


def select_arm(details: DataFrame, arms: list[str]) -> DataFrame:
    """The arm with the most top-3 hits over all seeds, and its representative seed: the one whose top-3 share is nearest
    to the arm's mean. Ties by top-1 hits, median latency, then the arm's own order; of seeds the smallest."""
    arm = F.to_json(F.struct(*arms))
    rows = details.withColumn("_arm", arm)
    hits = rows.groupBy("_arm", *arms).agg(F.count_if(F.col("rank") > 0).alias("top3_hits"), F.count_if(F.col("rank") == 1).alias("top1_hits"), F.avg((F.col("rank") > 0).cast("double")).alias("mean"))
    seeds = rows.groupBy("_arm", "seed").agg(F.avg((F.col("rank") > 0).cast("double")).alias("share")).join(hits.select("_arm", "mean"), "_arm")
    nearest = seeds.groupBy("_arm").agg(F.min_by("seed", F.struct(F.round(F.abs(F.col("share") - F.col("mean")), 12), "seed")).alias("seed"))
    medians = quantiles(rows, "_arm", "milliseconds", [0.5])
    return hits.join(medians, "_arm").join(nearest, "_arm").orderBy(F.desc("top3_hits"), F.desc("top1_hits"), "q0", *arms).limit(1).select(*arms, "top3_hits", "top1_hits", F.col("q0").alias("median_ms"), "seed")


def within_of_leader(rows: DataFrame, score: str, margin: float, size: str) -> DataFrame:
    """Of the rows within ``margin`` of the best score, the smallest one."""
    best = rows.agg(F.max(score)).first()[0]
    return rows.where(F.col(score) >= F.lit(best) - margin).orderBy(size, F.desc(score)).limit(1)


def taxonomy(details: DataFrame, by: str = "source") -> DataFrame:
    """Cases in the top 3, on the list below it, and absent; with the share of listed ones that are in the top 3."""
    rows = details.groupBy(F.coalesce(by, F.lit("")).alias(by)).agg(F.count("*").alias("cases"), F.count_if(F.col("rank") > 0).alias("top3"), F.count_if((F.col("rank") == 0) & F.col("listed")).alias("listed_below"), F.count_if(~F.col("listed") & (F.col("rank") == 0)).alias("absent"))
    return rows.withColumn("conditional", F.round(F.try_divide(F.col("top3").cast("double"), F.col("top3") + F.col("listed_below")), 6))


def latency(times: DataFrame, by: str = "method_name") -> DataFrame:
    """Median, 95th percentile and mean of the valid times (positive, not NaN) of each method."""
    ok = times.where("milliseconds is not null and not isnan(milliseconds) and milliseconds > 0")
    means = ok.groupBy(by).agg(F.count("*").alias("calls"), F.round(F.avg("milliseconds"), 6).alias("mean_ms"))
    found = quantiles(ok, by, "milliseconds", [0.5, 0.95]).withColumnRenamed(by, "_by")
    return means.join(found, means[by].eqNullSafe(found["_by"])).select(by, "calls", F.round("q0", 6).alias("median_ms"), F.round("q1", 6).alias("p95_ms"), "mean_ms")


def choice_accuracy(cases: DataFrame, choice: str, actual: str, rank: str, by: str = "source") -> DataFrame:
    """(by, cases, covered, coverage, accuracy, mrr3): cases with a choice, their share, how often the choice is right among
    all cases, and the mean reciprocal rank cut at 3; '(all)' for all."""
    hit = F.coalesce(F.col(choice) == F.col(actual), F.lit(False)).cast("double")
    r = F.col(rank)
    rows = cases.withColumn(by, F.coalesce(by, F.lit(""))).rollup(by).agg(
        F.count("*").alias("cases"), F.count(choice).alias("covered"), F.round(F.avg(F.col(choice).isNotNull().cast("double")), 6).alias("coverage"), F.round(F.avg(hit), 6).alias("accuracy"),
        F.round(F.avg(F.when(r.between(1, 3), 1 / r).otherwise(0.0)), 6).alias("mrr3"), F.grouping(by).alias("g"),
    )
    return rows.withColumn(by, F.when(F.col("g") == 1, "(all)").otherwise(F.col(by))).drop("g")


def promotions(pairs: DataFrame, by: str = "source", level: float = 0.05) -> DataFrame:
    """(by, cases, difference, low, high, p_value, promoted): the paired top-3 difference of each group with its normal
    interval, McNemar's exact p, and whether both speak for the second arm."""
    d = (F.col("rank_b") > 0).cast("int") - (F.col("rank_a") > 0).cast("int")
    stats = pairs.groupBy(by).agg(F.avg(d).alias("m"), F.sqrt(F.var_pop(d) / F.count("*")).alias("e"))
    rows = gains(pairs, [by]).withColumnRenamed(by, "_by").join(stats, F.col("_by").eqNullSafe(stats[by]))
    low, high = F.col("m") - Z * F.col("e"), F.col("m") + Z * F.col("e")
    return rows.select(by, "cases", F.round("m", 6).alias("difference"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), "p_value", ((low > 0) & (F.col("p_value") < level)).alias("promoted"))


def within_budget(rows: DataFrame, limits: dict[str, float], score: str, least: float) -> DataFrame:
    """``rows`` with ``passed``: no column above its limit (nulls fail), and ``score`` not below ``least``."""
    ok = F.coalesce(F.col(score) >= least, F.lit(False))
    for c, most in limits.items():
        ok = ok & F.coalesce(F.col(c) <= most, F.lit(False))
    return rows.withColumn("passed", ok)
