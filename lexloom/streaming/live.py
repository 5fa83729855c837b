"""Live phrases: bursts of keystrokes, scored against a static model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.plans.models import Model, contexts_of, predict, shortest

#: Longest phrase that is scored, in characters.
LONGEST = 500


def ready(phrase: Column, language: Column | None = None) -> Column:
    """Whether a phrase is to be scored: it ends at a word's end, is in a script without blanks, or is too long to wait."""
    out = phrase.rlike(r"[\s.!?;:,]$") | (F.length(phrase) > LONGEST)
    return out if language is None else out | language.isin("zh", "chinese")


def checked(phrase: Column, language: Column, languages: list[str]) -> Column:
    """ok, or why a phrase is refused."""
    return F.when(phrase.isNull() | (F.trim(phrase) == ""), "empty").when(F.length(phrase) > LONGEST, "too_long").when(~language.isin(languages), "unknown_language").otherwise("ok")


def bursts(stream: DataFrame, key: str, ts: str, phrase: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(key, started, ended, events, phrase): the last phrase of each burst; a burst ends after ``gap`` without an event.
    On a stream, events later than ``late`` are dropped and a burst comes out once the watermark has passed it."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    w = F.session_window(F.col(ts), gap)
    out = rows.groupBy(F.col(key), w.alias("w")).agg(F.count("*").alias("events"), F.max_by(phrase, F.struct(F.col(ts), F.col(phrase))).alias("phrase"))
    return out.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events", "phrase")


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The newest request of each key; older ones are stale."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(seq)).alias("r")).select("r.*")


def score_batch(model: Model, phrases: DataFrame, id: str, tokens: Column) -> DataFrame:
    return predict(model, phrases, id, tokens)


def score_stream(model: Model, stream: DataFrame, id: str, tokens: Column) -> DataFrame:
    """(id, n, top) of every streamed phrase by a stream-static join on its longest context. The static side holds one row
    per context with its best words; the context is found by one left join per order, longest first."""
    rows = contexts_of(stream, tokens, model.order, model.starts)
    for n in range(model.order, 1, -1):
        side = model.best.where(F.col("n") == n).select(F.col("context").alias(f"c{n}"), F.col("top").alias(f"top{n}"))
        rows = rows.withColumn(f"k{n}", F.expr(f"get(filter(ctx, x -> x.n = {n}), 0).context")).join(side, F.col(f"k{n}") == F.col(f"c{n}"), "left")
    order = range(model.order, 1, -1)
    found = F.coalesce(*[F.col(f"top{n}") for n in order], shortest(model.best))
    level = F.coalesce(*[F.when(F.col(f"top{n}").isNotNull(), F.lit(n)) for n in order], F.lit(1))
    return rows.select(id, level.alias("n"), F.transform(found, lambda x: F.struct(x["word"].alias("word"), (-x["q"]).alias("p"))).alias("top"))


def term_counts(stream: DataFrame, tokens: Column) -> DataFrame:
    """Running word counts over arriving lines; complete or update mode."""
    return stream.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))
