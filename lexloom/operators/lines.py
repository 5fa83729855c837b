"""Line and word queries over a corpus (source, text). Null texts count as no line; null sources make a group of their own."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_pattern(word: str, ignore_case: bool = False) -> str:
    """A whole word: not next to a letter, digit or underscore."""
    plain = "".join(c if c.isalnum() or c == "_" or c.isspace() else "\\" + c for c in word)
    return ("(?i)" if ignore_case else "") + rf"(?<![\p{{L}}\p{{N}}_]){plain}(?![\p{{L}}\p{{N}}_])"


def has_word(text: Column, word: str, ignore_case: bool = False) -> Column:
    # the cheap test first: most lines lack the word
    near = F.lower(text).contains(word.lower()) if ignore_case else text.contains(word)
    return near & text.rlike(word_pattern(word, ignore_case))


def scan(df: DataFrame, substrings: list[str], exact: str, pattern: str) -> DataFrame:
    """One pass: lines, characters of the longest, lines with each substring, lines equal to ``exact``, lines that match
    ``pattern`` whatever the case."""
    t = F.col("text")
    return df.where(t.isNotNull()).groupBy("source").agg(
        F.count("*").alias("lines"),
        F.max(F.length(t)).alias("longest"),
        *[F.count_if(t.contains(s)).alias(f"with_{re.sub('[^A-Za-z0-9]', '_', s)}") for s in substrings],
        F.count_if(t == exact).alias("exact"),
        F.count_if(F.lower(t).contains(pattern.lower())).alias("matching"),
    )


def word_lines(df: DataFrame, word: str, ignore_case: bool = False) -> DataFrame:
    return df.where(F.col("text").isNotNull()).groupBy("source").agg(F.count_if(has_word(F.col("text"), word, ignore_case)).alias("lines"))


def word_ratio(df: DataFrame, over: str, under: str) -> DataFrame:
    """Lines with one word over lines with another; null where the divisor is 0."""
    t = F.col("text")
    out = df.where(t.isNotNull()).groupBy("source").agg(F.count_if(has_word(t, over)).alias("a"), F.count_if(has_word(t, under)).alias("b"))
    return out.select("source", F.round(F.try_divide(F.col("a").cast("double"), F.col("b")), 6).alias("ratio"))


def find_lines(df: DataFrame, word: str, k: int, id: str) -> DataFrame:
    """The first ``k`` lines of each source with the word, by id: a top-k report."""
    hits = df.where(has_word(F.col("text"), word)).select("source", id, "text")
    return hits.withColumn("n", F.expr(f"row_number() over (partition by source order by {id})")).where(F.col("n") <= k)


def exact_lines(df: DataFrame, line: str) -> DataFrame:
    return df.agg(F.count_if(F.col("text") == line).alias("lines"))


def distinct_matches(df: DataFrame, pattern: str) -> DataFrame:
    """Distinct lines that contain ``pattern`` whatever the case."""
    return df.where(F.lower("text").contains(pattern.lower())).select("text").distinct()


def preview(df: DataFrame, n: int, id: str) -> DataFrame:
    """The first n lines of each source."""
    return df.where(F.col("text").isNotNull()).withColumn("n", F.expr(f"row_number() over (partition by source order by {id})")).where(F.col("n") <= n).select("source", "n", "text")


def quality(df: DataFrame) -> DataFrame:
    """Empty lines, lines with URLs and mentions, median and greatest length of each source."""
    t = F.col("text")
    return df.where(t.isNotNull()).groupBy("source").agg(
        F.count("*").alias("lines"),
        F.count_if(F.trim(t) == "").alias("empty"),
        F.count_if(F.lower(t).rlike(r"https?://|www\.")).alias("with_url"),
        F.count_if(t.rlike(r"@[\p{L}\p{N}_]")).alias("with_mention"),
        F.expr("cast(percentile(length(text), 0.5) as double)").alias("median_characters"),
        F.max(F.length(t)).alias("most_characters"),
    )


def milestone(df: DataFrame, tokens: Column) -> DataFrame:
    """Lines, words and words a line of each source."""
    rows = df.where(F.col("text").isNotNull()).groupBy("source").agg(F.count("*").alias("lines"), F.sum(F.size(tokens)).alias("words"))
    return rows.withColumn("words_per_line", F.round(F.col("words") / F.col("lines"), 6))


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, source, text) of every line of every document."""
    return docs.where("text is not null").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def length_histogram(df: DataFrame, width: int, tokens: Column) -> DataFrame:
    """Lines by word count, in bins of ``width``."""
    return df.where(F.col("text").isNotNull()).select("source", (F.floor(F.size(tokens) / width) * width).cast("bigint").alias("bin")).groupBy("source", "bin").agg(F.count("*").alias("lines"))


def below_percentile(df: DataFrame, share: float, tokens: Column) -> DataFrame:
    """Lines of each source no longer than the source's percentile of word counts, with that limit."""
    rows = df.where(F.col("text").isNotNull()).select(F.col("source"), F.size(tokens).alias("words"))
    limit = rows.groupBy("source").agg(F.expr(f"percentile(words, {share})").alias("limit"))
    return rows.join(limit, "source").where("words <= limit").groupBy("source").agg(F.first("limit").alias("limit"), F.count("*").alias("lines"), F.max("words").alias("longest"))
