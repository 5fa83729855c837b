"""Ranking rules over scored candidates, calibration of confidences and their checks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.stats import log_add_exp, logit, sigmoid

RULES = ("baseline", "no_boundary", "half_boundary", "token_mean", "token_mean_no_boundary", "char_sqrt", "two_paths")


def rule_scores(features: DataFrame) -> DataFrame:
    """One row for each rule and candidate of (token_logp, boundary_logp, original_score, tokens, characters,
    alternate_score, alternate_distinct); other columns stay."""
    t, b, o = F.col("token_logp"), F.col("boundary_logp"), F.col("original_score")
    n, c = F.col("tokens"), F.col("characters")
    values = (o, t, t + 0.5 * b, t / n + b, t / n, t / F.sqrt(c) + b, F.when(F.col("alternate_distinct"), log_add_exp(o, F.col("alternate_score"))).otherwise(o))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), v.alias("score")) for r, v in zip(RULES, values, strict=True)])
    drop = ("token_logp", "boundary_logp", "original_score", "tokens", "characters", "alternate_score", "alternate_distinct")
    return features.select(*[c for c in features.columns if c not in drop], F.explode(rules).alias("x")).select("*", "x.rule", "x.score").drop("x")


def ranked(scores: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """keys, word, score, rank, share and gap of the k best words: the first word's softmax share among all of the case's
    candidates, and its lead over the second. Ties by word."""
    part = ", ".join(keys)
    rows = scores.withColumn("rank", F.expr(f"row_number() over (partition by {part} order by score desc, word)"))
    rows = rows.withColumn("top", F.expr(f"max(score) over (partition by {part})"))
    stats = rows.groupBy(*keys).agg((1 / F.sum(F.exp(F.col("score") - F.col("top")))).alias("share"), (F.max("score") - F.max(F.when(F.col("rank") == 2, F.col("score")))).alias("gap"))
    return rows.where(F.col("rank") <= k).join(stats, keys).select(*keys, "word", "score", "rank", "share", "gap")


def fit_sigmoid(rows: DataFrame, raw: str, y: str, steps: int = 200) -> dict:
    """Intercept and slope of p = sigmoid(a + b logit(raw)), slope penalty b^2 / 2, by Newton steps with line search.

    A step is one aggregation of six sums; the driver sees those sums only. Both outcomes must occur.
    """
    data = rows.where(F.col(raw).isNotNull() & ~F.isnan(raw) & F.col(y).isNotNull()).select(logit(F.col(raw)).alias("x"), F.col(y).cast("double").alias("y")).persist()
    try:
        n, positives = data.agg(F.count("*"), F.sum("y")).first()
        if not n or positives in (0, n):
            raise ValueError("calibration needs both outcomes")

        def sums(a: float, b: float):
            z = F.lit(a) + F.lit(b) * F.col("x")
            p, w = sigmoid(z), sigmoid(z) * (1 - sigmoid(z))
            loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("y") * z
            x = F.col("x")
            return [float(v) for v in data.agg(F.sum(loss), F.sum(p - F.col("y")), F.sum((p - F.col("y")) * x), F.sum(w), F.sum(w * x), F.sum(w * x * x)).first()]

        beta = np.array([math.log(positives / n) - math.log1p(-positives / n), 0.0])
        s = sums(*beta)
        for step in range(steps):
            objective = s[0] + beta[1] ** 2 / 2
            gradient = np.array([s[1], s[2] + beta[1]])
            if np.abs(gradient).max() < 1e-7:
                return {"intercept": float(beta[0]), "slope": float(beta[1]), "iterations": step, "objective": float(objective), "cases": n, "positives": int(positives)}
            move = np.linalg.solve(np.array([[s[3], s[4]], [s[4], s[5] + 1]]), gradient)
            scale = 1.0
            while True:
                s = sums(*(beta - scale * move))
                after = s[0] + (beta[1] - scale * move[1]) ** 2 / 2
                if after <= objective - 1e-4 * scale * float(gradient @ move) or abs(after - objective) <= 1e-12 * abs(objective):
                    break
                scale /= 2
                if scale < 1e-10:
                    raise RuntimeError("line search failed")
            beta = beta - scale * move
        raise RuntimeError("no convergence")
    finally:
        data.unpersist()


def calibrated(raw: Column, fit: dict) -> Column:
    return sigmoid(F.lit(fit["intercept"]) + F.lit(fit["slope"]) * logit(raw))


def reliability(rows: DataFrame, p: str, y: str) -> DataFrame:
    """(bin, cases, mean_p, observed) of ten equal bins, the last one closed; empty bins stay."""
    spark = rows.sparkSession
    got = rows.where(F.col(p).isNotNull() & ~F.isnan(p)).groupBy((F.least(F.floor(F.col(p) * 10), F.lit(9)) + 1).cast("int").alias("bin")).agg(F.count("*").alias("cases"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(F.col(y).cast("double")), 6).alias("observed"))
    return spark.range(1, 11).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").fillna(0, ["cases"])


def confidence(rows: DataFrame, p: str, y: str) -> DataFrame:
    """(cases, brier, log_loss, ece, mean_p, observed): the bins' part sums are merged, so one pass does."""
    ok = rows.where(F.col(p).isNotNull() & ~F.isnan(p))
    q, t = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(p))), F.col(y).cast("double")
    bins = ok.groupBy(F.least(F.floor(F.col(p) * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(t).alias("sy"), F.sum((q - t) * (q - t)).alias("se"), F.sum(-(t * F.log(q) + (1 - t) * F.log1p(-q))).alias("ll"))
    return bins.agg(
        F.sum("n").alias("cases"), F.round(F.sum("se") / F.sum("n"), 6).alias("brier"), F.round(F.sum("ll") / F.sum("n"), 6).alias("log_loss"),
        F.round(F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("sp") / F.sum("n"), 6).alias("mean_p"), F.round(F.sum("sy") / F.sum("n"), 6).alias("observed"),
    )


def selective(rows: DataFrame, p: str, y: str, thresholds: tuple[float, ...] = (0.0, 0.5, 0.7, 0.85, 0.95)) -> DataFrame:
    """(threshold, answered, correct, accuracy, coverage): answers given from each confidence on. Each row is expanded to
    the few thresholds it passes, then counted."""
    ok = rows.where(F.col(p).isNotNull() & ~F.isnan(p))
    total = F.lit(ok.count())
    each = ok.select(F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col(p))).alias("threshold"), F.col(y).cast("int").alias("y"))
    got = each.groupBy("threshold").agg(F.count("*").alias("answered"), F.sum("y").alias("correct"))
    every = rows.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    out = every.join(got, "threshold", "left").fillna(0, ["answered", "correct"])
    return out.withColumn("accuracy", F.round(F.try_divide(F.col("correct").cast("double"), F.col("answered")), 6)).withColumn("coverage", F.round(F.try_divide(F.col("answered").cast("double"), total), 6))


def diagnose(scores: DataFrame, targets: DataFrame, id: str) -> DataFrame:
    """(id, original_rank, category, third_word, margin) of each target put among its case's candidates.

    ``scores`` has (id, word, score), one row a word; ``targets`` (id, word, score) with a score for absent targets. Cases
    with fewer than three other candidates are left out; ranks tie by word.
    """
    t = targets.select(F.col(id), F.col("word").alias("target"), F.col("score").alias("given"))
    rows = scores.join(t, id)
    mine = rows.where("word = target").select(id, F.col("score").alias("own"))
    others = rows.where("word <> target").withColumn("r", F.expr(f"row_number() over (partition by {id} order by score desc, word)"))
    third = others.where("r = 3").select(id, F.col("word").alias("third_word"), F.col("score").alias("third_score"))
    base = t.join(third, id).join(mine, id, "left").withColumn("present", F.col("own").isNotNull()).withColumn("value", F.coalesce("own", "given")).where("value is not null")
    better = others.select(id, "word", "score").join(base.select(id, "target", "value"), id).where("score > value or (score = value and word < target)").groupBy(id).agg(F.count("*").alias("n"))
    out = base.join(better, id, "left").withColumn("rank", F.coalesce("n", F.lit(0)) + 1)
    category = F.when(F.col("present") & (F.col("rank") <= 3), "already_top3").when(F.col("present"), "covered_below_top3").when(F.col("rank") <= 3, "missing_reaches_top3").otherwise("missing_still_below_top3")
    return out.select(id, F.when(F.col("present"), F.col("rank")).otherwise(F.lit(0)).alias("original_rank"), category.alias("category"), "third_word", F.round(F.col("value") - F.col("third_score"), 6).alias("margin"))
