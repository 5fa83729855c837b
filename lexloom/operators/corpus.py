"""Sampling, deduplication, splits and evaluation cases. Every draw hashes a key: it is the same under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import bucket

#: Draws are made in parts per million.
PARTS = 1_000_000


def bernoulli(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Each row with probability ``share``."""
    return df.where(bucket(F.col(key), PARTS, str(seed)) < int(round(share * PARTS)))


def capped(df: DataFrame, group: str, key: str, share: float, most: int, seed: int) -> DataFrame:
    """Each row of a group with probability ``share``, drawn by a seed of the group's own, up to the first ``most`` by key.
    The cap is a group limit below the shuffle. Null groups draw as ''."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(group, F.lit("")), F.lit(":"), F.col(key).cast("string"))
    drawn = df.where(bucket(own, PARTS) < int(round(share * PARTS)))
    return drawn.withColumn("_n", F.expr(f"row_number() over (partition by {group} order by {key})")).where(F.col("_n") <= most).drop("_n")


def exact_per_group(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows of each group (all, where there are fewer), as a reservoir would give them: the smallest hashes.
    The row_number filter becomes a group limit below the shuffle, so a hot group sends n rows a task."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return df.withColumn("_h", h).withColumn("_n", F.expr(f"row_number() over (partition by {group} order by _h, {key})")).where(F.col("_n") <= n).drop("_h", "_n")


def first_wins(df: DataFrame, text: Column, order: list[str]) -> DataFrame:
    """One row for each distinct normalised text, the first in the given order; empty texts are dropped. The minimum is
    taken before the shuffle, so copies of one text meet as one row a task."""
    rows = df.withColumn("normal", text).where("normal <> ''")
    least = rows.groupBy("normal").agg(F.min(F.struct(*order)).alias("first"))
    return least.select("normal", *[F.col(f"first.{c}").alias(c) for c in order])


def split(key: Column, seed: int, train: int = 80, validation: int = 10) -> Column:
    """train, validation or test, by hash."""
    b = bucket(key, 100, str(seed))
    return F.when(b < train, "train").when(b < train + validation, "validation").otherwise("test")


def nested(key: Column, seed: int, share: float = 0.25) -> Column:
    """A second flag, independent of the split."""
    return bucket(key, PARTS, f"nested {seed}") < int(share * PARTS)


def line_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def last_word_cases(df: DataFrame, id: str, tokens: Column) -> DataFrame:
    """(id, prefix, actual): all but the last word, and the last word, of texts of two words or more."""
    rows = df.select(F.col(id), tokens.alias("t")).where(F.size("t") >= 2)
    return rows.select(id, F.array_join(F.slice("t", F.lit(1), F.size("t") - 1), " ").alias("prefix"), F.element_at("t", -1).alias("actual"))


def random_cases(df: DataFrame, id: str, tokens: Column, seed: int, least: int = 3) -> DataFrame:
    """(id, prefix, actual): the target stands at a hashed position from the second word on."""
    rows = df.select(F.col(id), tokens.alias("t")).where(F.size("t") >= least)
    at = (F.lit(2) + F.pmod(bucket(F.col(id), PARTS, str(seed)), F.size("t") - 1)).cast("int")
    rows = rows.withColumn("at", at)
    return rows.select(id, F.array_join(F.expr("slice(t, 1, at - 1)"), " ").alias("prefix"), F.expr("element_at(t, at)").alias("actual"))


def training_positions(df: DataFrame, id: str, tokens: Column, most: int, seed: int) -> DataFrame:
    """(id, at, word): up to ``most`` hashed target positions of each text, its own words only."""
    rows = df.select(F.col(id), tokens.alias("t")).where(F.size("t") >= 2)
    ranked = F.expr(f"slice(array_sort(transform(sequence(2, size(t)), p -> struct(sha2(concat('{seed}:', {id}, ':', p), 256) as h, p as p))), 1, {most})")
    return rows.select(id, "t", F.explode(ranked).alias("x")).select(id, F.col("x.p").alias("at"), F.expr("element_at(t, x.p)").alias("word"))


def packed_blocks(df: DataFrame, group: str, order: str, tokens: Column, width: int) -> DataFrame:
    """(group, block, tokens): texts of a group laid end to end and cut into blocks; the last may be short. The running
    position comes from a distributed prefix sum, so a large group is never in one task."""
    from lexloom.operators.ordered import running_sums

    rows = df.select(F.col(group), F.col(order), tokens.alias("t")).where(F.size("t") > 0)
    sums = running_sums(rows.withColumn("n", F.size("t")), group, [order], order, "n")
    blocks = sums.select("grp", F.explode(F.expr(f"transform(sequence(before div {width}, (upto - 1) div {width}), b -> struct(b as block, least(upto, (b + 1) * {width}) - greatest(before, b * {width}) as n))")).alias("x"))
    return blocks.groupBy("grp", "x.block").agg(F.sum("x.n").alias("tokens")).select(F.col("grp").alias(group), "block", "tokens")


def schedule(df: DataFrame, key: str, batch: int, seed: int) -> DataFrame:
    """(key, step, slot): a seeded permutation cut into batches; its prefix does not depend on how far it is used."""
    from lexloom.operators.ordered import running_sums

    rows = df.select(F.lit("all").alias("g"), F.col(key), F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256).alias("h"), F.lit(1).alias("one"))
    return running_sums(rows, "g", ["h"], key, "one").select(F.col("id").alias(key), F.expr(f"before div {batch}").alias("step"), F.expr(f"before % {batch}").alias("slot"))


def recipe(parts: list[tuple[DataFrame, int]], key: str, seed: int) -> DataFrame:
    """(step, slot, part, key): batches that take a fixed number of rows from each part; steps end with the part that runs
    out first."""
    total, out, offset = None, None, 0
    for i, (df, take) in enumerate(parts):
        steps = df.count() // take
        total = steps if total is None else min(total, steps)
        rows = schedule(df, key, take, seed + i).select("step", (F.col("slot") + offset).alias("slot"), F.lit(i).alias("part"), key)
        out = rows if out is None else out.unionAll(rows)
        offset += take
    return out.where(F.col("step") < total)


def distractors(targets: DataFrame, counts: DataFrame, near: int = 250, choices: int = 3, seed: int = 1) -> DataFrame:
    """(target, word): for each distinct target, hashed words within ``near`` frequency ranks; unknown targets take
    the neighbourhood of the rarest words.

    Ranks are global: they come from a prefix sum over the counts, and the band join is an equi-join on rank blocks.
    """
    from lexloom.operators.ordered import running_sums

    ranked = running_sums(counts.select(F.lit("all").alias("g"), "word", (-F.col("cnt")).alias("c"), F.lit(0).alias("zero"), F.lit(1).alias("one")), "g", ["c", "word"], "zero", "one", keep="word")
    ranks = ranked.select(F.col("what").alias("word"), F.col("upto").alias("rank"))
    last = counts.count()
    known = targets.select(F.col("target")).distinct().join(ranks.withColumnRenamed("word", "target"), "target", "left").select("target", F.coalesce("rank", F.lit(last)).alias("at"))
    left = known.select("target", "at", F.explode(F.expr(f"sequence((greatest(at - {near}, 1)) div {near}, (at + {near}) div {near})")).alias("block"))
    right = ranks.withColumn("block", F.expr(f"rank div {near}"))
    pool = left.join(right, "block").where(f"abs(rank - at) <= {near} and word <> target")
    h = F.sha2(F.concat(F.lit(f"{seed}:"), "target", F.lit(":"), "word"), 256)
    return pool.withColumn("h", h).withColumn("n", F.expr("row_number() over (partition by target order by h, word)")).where(F.col("n") <= choices).select("target", "word", "rank", "n")
