"""Compact models for serving: pruned tables scored sparsely, with caches, dictionaries and continuations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.ngrams import START
from lexloom.plans.models import UNKNOWN, Model, contexts_of
from lexloom.session import cut


@dataclass
class Compact:
    """``base``: (word, p) of the kept words, renormalised; ``grams``: (n, context, word, weight); ``contexts``: (n, context, backoff)."""

    order: int
    base: DataFrame
    grams: DataFrame
    contexts: DataFrame
    starts: bool


def compact(model: Model, words: int, support: int, followers: int, blocked: DataFrame | None = None) -> Compact:
    """The ``words`` likeliest words, contexts of ``support`` or more, ``followers`` grams a context. What is cut from a
    context returns to its backoff."""
    base = model.base.where(F.col("word") != UNKNOWN)
    if blocked is not None:
        base = base.join(blocked.select(F.lower("term").alias("word")).distinct(), "word", "left_anti")
    kept = cut(base.orderBy(F.desc("p"), "word").limit(words), "kept")
    total = float(kept.agg(F.sum("p")).first()[0] or 1.0)
    rows = model.grams.where("weight > 0").join(model.contexts.where(F.col("total") >= support).select("n", "context"), ["n", "context"]).join(kept.select("word"), "word", "left_semi")
    # contexts with a word that was cut go: an anti-join on the words of distinct contexts
    inside = rows.select("n", "context").distinct().select("n", "context", F.explode(F.split("context", " ")).alias("w"))
    foreign = inside.where(F.col("w") != START).join(kept.select(F.col("word").alias("w")), "w", "left_anti").select("n", "context").distinct()
    rows = rows.join(foreign, ["n", "context"], "left_anti").withColumn("r", F.expr("row_number() over (partition by n, context order by weight desc, word)")).where(F.col("r") <= followers).select("n", "context", "word", "weight")
    rows = cut(rows, "compact")
    contexts = rows.groupBy("n", "context").agg(F.greatest(F.lit(0.0), 1 - F.sum("weight")).alias("backoff"))
    return Compact(model.order, kept.select("word", (F.col("p") / total).alias("p")), rows, cut(contexts, "backoffs"), model.starts)


def sparse(model: Compact, cases: DataFrame, id: str, tokens: Column, k: int, more: DataFrame | None = None) -> DataFrame:
    """(id, word, p, n) of all words that can be among a case's best k: words that no context lists share one factor, so
    the k likeliest words and the listed ones suffice. ``more`` adds candidates (id, word). Contexts list a bounded
    number of words; n is the case's longest known order."""
    rows = contexts_of(cases, tokens, model.order, model.starts)
    flat = cut(rows.select(id, F.explode("ctx").alias("c")).select(id, "c.n", "c.context"), "asked")
    backs = flat.join(model.contexts, ["n", "context"]).groupBy(id).agg(F.array_sort(F.collect_list(F.struct("n", "backoff"))).alias("backs"))
    hits = flat.join(model.grams, ["n", "context"]).groupBy(id, "word").agg(F.collect_list(F.struct("n", "weight")).alias("ws"))
    first = [r.word for r in model.base.orderBy(F.desc("p"), "word").limit(k).collect()]
    extra = cases.select(id, F.explode(F.array(*map(F.lit, first))).alias("word"))
    if more is not None:
        extra = extra.unionAll(more.select(id, "word"))
    candidates = hits.select(id, "word").unionAll(extra).distinct().join(model.base, "word").join(hits, [id, "word"], "left").join(backs, id, "left")
    weight = "coalesce(get(filter(ws, w -> w.n = s.n), 0).weight, 0D)"
    p = F.expr(f"if(backs is null, p, aggregate(backs, p, (a, s) -> a * s.backoff + {weight}))")
    return candidates.select(id, "word", p.alias("p"), F.expr("if(backs is null, 1, element_at(backs, -1).n)").alias("n"))


def best(scored: DataFrame, id: str, k: int) -> DataFrame:
    return scored.withColumn("rank", F.expr(f"row_number() over (partition by {id} order by p desc, word)")).where(F.col("rank") <= k)


def predict_cached(model: Compact, cases: DataFrame, id: str, tokens: Column, share: float = 0.05, k: int = 3, span: int = 100, common: int = 100) -> DataFrame:
    """(id, rank, word, p): the model mixed with the words among the last ``span`` of the prefix, the ``common`` likeliest
    words not counted. Prefixes without such words keep the model's probabilities."""
    usual = [r.word for r in model.base.orderBy(F.desc("p"), "word").limit(common).collect()]
    recent = cases.select(id, F.explode(F.slice(F.reverse(tokens), 1, span)).alias("word")).where(~F.col("word").isin(usual)).join(model.base.select("word"), "word", "left_semi").groupBy(id, "word").agg(F.count("*").alias("c"))
    sums = recent.groupBy(id).agg(F.sum("c").alias("all"))
    rows = sparse(model, cases, id, tokens, k, recent).join(recent, [id, "word"], "left").join(sums, id, "left")
    p = F.when(F.col("all").isNull(), F.col("p")).otherwise(F.col("p") * (1 - share) + F.coalesce(share * F.col("c") / F.col("all"), F.lit(0.0)))
    return best(rows.select(id, "word", p.alias("p")), id, k).select(id, "rank", "word", "p")


def predict_dictionary(model: Compact, cases: DataFrame, id: str, tokens: Column, dictionary: DataFrame, penalty: float, k: int = 3) -> DataFrame:
    """(id, rank, word, p): words out of the dictionary weigh ``penalty``, probabilities sum to 1 again. The mass to
    divide by follows the same recursion as a probability, so no distribution is written out."""
    known = dictionary.select("word").distinct().withColumn("known", F.lit(True))
    weighed = cut(model.base.join(known, "word", "left").select("word", "p", F.when(F.col("known"), F.lit(1.0)).otherwise(F.lit(float(penalty))).alias("m")), "weighed")
    mass = float(weighed.agg(F.sum(F.col("p") * F.col("m"))).first()[0])
    gained = model.grams.join(weighed.select("word", "m"), "word").groupBy("n", "context").agg(F.sum(F.col("weight") * F.col("m")).alias("gain")).join(model.contexts, ["n", "context"])
    flat = contexts_of(cases, tokens, model.order, model.starts).select(id, F.explode("ctx").alias("c")).select(id, "c.n", "c.context")
    masses = flat.join(gained, ["n", "context"]).groupBy(id).agg(F.array_sort(F.collect_list(F.struct("n", "backoff", "gain"))).alias("steps")).select(id, F.aggregate("steps", F.lit(mass), lambda a, s: a * s["backoff"] + s["gain"]).alias("mass"))
    # the likeliest words are those after weighing
    first = weighed.orderBy(F.desc(F.col("p") * F.col("m")), "word").limit(k).select("word").collect()
    more = cases.select(id, F.explode(F.array(*[F.lit(r.word) for r in first])).alias("word"))
    rows = sparse(model, cases, id, tokens, k, more).join(weighed.select("word", "m"), "word").join(masses, id, "left")
    return best(rows.select(id, "word", (F.col("p") * F.col("m") / F.coalesce("mass", F.lit(mass))).alias("p")), id, k).select(id, "rank", "word", "p")


def mixed(a: DataFrame, b: DataFrame, id: str, share: float) -> DataFrame:
    """(id, word, p): share a + (1 - share) b of two sparse distributions; a word that one lacks counts 0 there."""
    rows = a.select(id, "word", (share * F.col("p")).alias("p")).unionAll(b.select(id, "word", ((1 - share) * F.col("p")).alias("p")))
    return rows.groupBy(id, "word").agg(F.sum("p").alias("p"))


def continuation_index(df: DataFrame, tokens: Column, k: int = 8, support: int = 1) -> DataFrame:
    """(context, continuation, cnt): line endings of 1 to 3 words after the 2 to 4 words before them; the k most
    frequent of each context, ties by text, then contexts below ``support`` in all are dropped."""
    rows = df.select(tokens.alias("t")).where(F.size("t") >= 3)
    pairs = F.expr(
        "flatten(transform(sequence(1, 3), s -> transform(filter(sequence(2, 4), c -> c <= size(t) - s), "
        "c -> struct(array_join(slice(t, size(t) - s - c + 1, c), ' ') as context, array_join(slice(t, size(t) - s + 1, s), ' ') as continuation))))"
    )
    usable = rows.select(F.explode(pairs).alias("x"))
    counts = usable.groupBy("x.context", "x.continuation").agg(F.count("*").alias("cnt"))
    top = counts.withColumn("r", F.expr("row_number() over (partition by context order by cnt desc, continuation)")).where(F.col("r") <= k).drop("r")
    if support <= 1:
        return top
    return top.withColumn("all", F.expr("sum(cnt) over (partition by context)")).where(F.col("all") >= support).drop("all")


def continuations(index: DataFrame, cases: DataFrame, id: str, tokens: Column, k: int = 3, exclude: DataFrame | None = None) -> DataFrame:
    """(id, rank, continuation, n): from the longest of the last 4 to 2 words that the index knows. Two words give single
    words only; ``exclude`` (id, word) is left out of the chosen context's endings."""
    rows = cases.select(id, tokens.alias("t"))
    asked = rows.select(id, F.explode(F.expr("transform(filter(sequence(2, 4), c -> c <= size(t)), c -> struct(c as n, array_join(slice(t, -c, c), ' ') as context))")).alias("x")).select(id, "x.n", "x.context")
    known = asked.join(index.select("context").distinct(), "context").groupBy(id).agg(F.max_by(F.struct("n", "context"), "n").alias("b")).select(id, "b.n", "b.context")
    hits = known.join(index, "context").select(id, "n", F.when(F.col("n") == 2, F.substring_index("continuation", " ", 1)).otherwise(F.col("continuation")).alias("continuation"), "cnt").groupBy(id, "n", "continuation").agg(F.sum("cnt").alias("cnt"))
    if exclude is not None:
        hits = hits.join(exclude.select(id, F.col("word").alias("continuation")), [id, "continuation"], "left_anti")
    return hits.withColumn("rank", F.expr(f"row_number() over (partition by {id} order by cnt desc, continuation)")).where(F.col("rank") <= k).select(id, "rank", "continuation", "n")
