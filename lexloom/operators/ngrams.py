"""N-gram counting. A gram is (context, word): the context's words joined by blanks, '' for none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut, spread

#: Stands before a line's first word; part of contexts, never a word.
START = "<s>"


def grams(df: DataFrame, tokens: Column, n: int) -> DataFrame:
    """(context, word, cnt) of order n, without line starts."""
    rows = df.select(tokens.alias("t")).where(F.size("t") >= n)
    if n == 1:
        pairs = rows.select(F.lit("").alias("context"), F.explode("t").alias("word"))
    else:
        pairs = rows.select(F.explode(F.expr(f"transform(sequence(1, size(t) - {n - 1}), i -> struct(array_join(slice(t, i, {n - 1}), ' ') as context, t[i + {n - 2}] as word))")).alias("g")).select("g.context", "g.word")
    return pairs.groupBy("context", "word").agg(F.count("*").alias("cnt"))


def all_grams(df: DataFrame, tokens: Column, order: int) -> list[DataFrame]:
    """Orders 1 to ``order`` without line starts."""
    return from_padded(padded(df, tokens, order), order, False)


def start_grams(df: DataFrame, tokens: Column, order: int) -> list[DataFrame]:
    """Orders 1 to ``order`` with line starts in the contexts: the raw counts."""
    return from_padded(padded(df, tokens, order), order, True)


def from_padded(top: DataFrame, order: int, starts: bool) -> list[DataFrame]:
    """The grams of all orders: the text is exploded once, at the highest order; lower orders are sums over its table's tails."""
    cols = [f"w{i}" for i in range(1, order + 1)]
    out = []
    for n in range(1, order + 1):
        own = cols[order - n :]
        rows = top if n == order else top.groupBy(*own).agg(F.sum("cnt").alias("cnt"))
        out.append(_as_pairs(rows if starts else rows.where(F.col(own[0]) != START), own))
    return out


def counted(df: DataFrame, tokens: Column, order: int, starts: bool, continuations: bool = False) -> list[DataFrame]:
    """(context, word, cnt) of all orders, each written once: an order is summed from the next higher one. With
    ``continuations``, orders below the top count distinct left contexts, line start included: the rows of the order above."""
    cols = [f"w{i}" for i in range(1, order + 1)]
    levels = [cut(padded(spread(df), tokens, order), "grams")]
    for n in range(order - 1, 0, -1):
        levels.append(cut(levels[-1].groupBy(*cols[order - n :]).agg(F.sum("cnt").alias("cnt"), F.count("*").alias("left")), f"grams{n}"))
    out = []
    for n, rows in enumerate(reversed(levels), 1):
        own = cols[order - n :]
        rows = rows.withColumn("cnt", F.col("left")) if continuations and n < order else rows
        out.append(_as_pairs(rows if starts else rows.where(F.col(own[0]) != START), own))
    return out


def padded(df: DataFrame, tokens: Column, order: int) -> DataFrame:
    """(w1..wn, cnt) with n - 1 line starts before each line: every word ends exactly one gram. Scalar columns, so that
    counting stays in generated code."""
    # lines without words give nothing; a filter would run the tokens twice, and where the text is read
    padded = df.select(F.concat(F.array_repeat(F.lit(START), order - 1), tokens).alias("t"))
    shifts = [F.slice("t", F.lit(i), F.size("t") - (order - 1)).alias(str(i)) for i in range(1, order + 1)]
    cols = [f"w{i}" for i in range(1, order + 1)]
    exploded = padded.select(F.explode(F.arrays_zip(*shifts)).alias("g")).select(*[F.col(f"g.`{i}`").alias(c) for i, c in enumerate(cols, 1)])
    return exploded.groupBy(*cols).agg(F.count("*").alias("cnt"))


def _as_pairs(rows: DataFrame, cols: list[str]) -> DataFrame:
    context = F.concat_ws(" ", *cols[:-1]) if len(cols) > 1 else F.lit("")
    return rows.select(context.alias("context"), F.col(cols[-1]).alias("word"), F.col("cnt").cast("bigint").alias("cnt"))


def continuation_counts(longer: DataFrame) -> DataFrame:
    """(context, word, cnt): in how many distinct left contexts, line start included, a gram occurs. ``longer`` holds
    the distinct grams one order up, so no row is read twice."""
    context = F.when(F.instr("context", " ") > 0, F.expr("substring(context, instr(context, ' ') + 1)")).otherwise(F.lit(""))
    return longer.groupBy(context.alias("context"), "word").agg(F.count("*").alias("cnt"))


def profile(df: DataFrame, tokens: Column, most: int = 3) -> DataFrame:
    """(model, observed, distinct_grams, singleton_percent) for orders 1 to ``most``."""
    out = None
    for n, g in enumerate(all_grams(df, tokens, most), 1):
        row = g.agg(F.sum("cnt").alias("observed"), F.count("*").alias("distinct_grams"), F.round(100 * F.avg(F.expr("if(cnt = 1, 1.0D, 0.0D)")), 6).alias("singleton_percent")).select(F.lit(f"{n}-gram").alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def prune(grams: DataFrame, least: int) -> DataFrame:
    return grams.where(F.col("cnt") >= least)


def top_terms(df: DataFrame, tokens: Column, k: int, stop: list[str] | None = None, least_length: int = 1) -> DataFrame:
    """The k most frequent words; ties by word. A top-k report."""
    words = df.select(F.explode(tokens).alias("token")).where(F.length("token") >= least_length)
    if stop:
        words = words.where(~F.col("token").isin(stop))
    return words.groupBy("token").agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), "token").limit(k)


def without_blocked(df: DataFrame, tokens: Column, blocked: DataFrame) -> DataFrame:
    """(source, raw, removed, kept, distinct_kept) of a block list: words are counted first, so the list meets each
    distinct word once."""
    counts = df.select("source", F.explode(tokens).alias("w")).groupBy("source", "w").agg(F.count("*").alias("n"))
    bad = blocked.select(F.lower("term").alias("w")).distinct().withColumn("bad", F.lit(True))
    rows = counts.join(bad, "w", "left")
    return rows.groupBy("source").agg(
        F.sum("n").alias("raw"),
        F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("removed"),
        F.coalesce(F.sum(F.when(F.col("bad").isNull(), F.col("n"))), F.lit(0)).alias("kept"),
        F.count_if(F.col("bad").isNull()).alias("distinct_kept"),
    )


def estimated_discount(grams: DataFrame) -> DataFrame:
    """(n1, n2, discount): n1 / (n1 + 2 n2), between .1 and .95; .75 where nothing occurs once or twice."""
    rows = grams.agg(F.count_if(F.col("cnt") == 1).alias("n1"), F.count_if(F.col("cnt") == 2).alias("n2"))
    return rows.withColumn("discount", F.expr("if(n1 + 2 * n2 > 0, greatest(0.1D, least(0.95D, n1 / (n1 + 2 * n2))), 0.75D)"))


def vocabulary(grams1: DataFrame) -> DataFrame:
    """(word, cnt, id): words in binary order, ids from 1; the ids come from a prefix sum, not from one task."""
    from lexloom.operators.ordered import running_sums

    rows = grams1.select(F.lit("all").alias("g"), "word", "cnt", F.lit(1).alias("one"), F.lit(0).alias("zero"))
    ids = running_sums(rows, "g", ["word"], "zero", "one", keep="word").select(F.col("what").alias("word"), F.col("upto").alias("id"))
    return rows.select("word", "cnt").join(ids, "word").select("word", "cnt", "id")
