"""Smoothed n-gram models as tables, and their use on batches of prefixes.

Every smoothing reads p(w | c) = b(c) p(w | c') + weight(c, w), c' being c without its first word. The recursion is run
once, over the model: a gram's probability is one join away from that of its tail, which is a gram of the next lower
order. The k best words of a context are the best of its own grams and b times its tail's best, so a prefix needs no
candidate sets: its longest known context already holds the answer. Scoring a batch is one equi-join per order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.ngrams import START, counted, estimated_discount
from lexloom.session import cut
from lexloom.sources.sinks import fingerprint

UNKNOWN = "<unk>"


def _tail() -> Column:
    """A context without its first word."""
    return F.when(F.instr("context", " ") > 0, F.expr("substring(context, instr(context, ' ') + 1)")).otherwise(F.lit(""))


@dataclass
class Model:
    """``base``: (word, p) with UNKNOWN; ``levels``: (n, context, word, weight, p, total, types, backoff), the last three of the
    context, backoff 1 where nothing is kept. What is derived from them is computed when it is first asked for and written:
    ``contexts``: (n, context, total, types, backoff); ``best``: (n, context, top), top an array of (-p, word) best first."""

    order: int
    base: DataFrame
    levels: DataFrame
    starts: bool
    k: int

    @property
    def grams(self) -> DataFrame:
        return self.levels.select("n", "context", "word", "weight", "p")

    @cached_property
    def contexts(self) -> DataFrame:
        columns = ("total", "types", "backoff")
        return cut(self.levels.groupBy("n", "context").agg(*[F.first(c).alias(c) for c in columns]), "contexts")

    @cached_property
    def best(self) -> DataFrame:
        return best_words(self, self.k)


_SHARED: dict[str, object] = {}


def shared(source: DataFrame, config: dict, build):
    """What ``build`` gives for the files of ``source`` and a configuration: built once in a session, found again by the
    fingerprint of both (paths, lengths and times of the files)."""
    spark = source.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = sorted(source.inputFiles())
    listed = []
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
        path = hadoop(folder)
        listed += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    own = {f.split("://", 1)[-1].split(":", 1)[-1].lstrip("/") for f in files}
    key = fingerprint({"app": spark.sparkContext.applicationId, "files": [x for x in sorted(listed) if x[0].split("://", 1)[-1].split(":", 1)[-1].lstrip("/") in own] or files, **config})
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def base_probabilities(counts: DataFrame) -> DataFrame:
    """(word, p) of unigrams and UNKNOWN: (c + .1) / sum."""
    words = counts.select("word", "cnt").unionAll(counts.sparkSession.createDataFrame([(UNKNOWN, 0)], "word string, cnt bigint"))
    total = words.agg(F.sum(F.col("cnt") + 0.1)).first()[0]
    return words.select("word", ((F.col("cnt") + 0.1) / F.lit(float(total))).alias("p"))


def build(df: DataFrame, tokens: Column, method: str = "kneser_ney", order: int = 3, least: int = 2, discount: float | str = 0.75, k: int = 3) -> Model:
    """A model of the texts of ``df``.

    ``kneser_ney`` and ``absolute`` count line starts as context words; below the top order Kneser-Ney counts left
    contexts. ``interpolated`` and ``witten_bell`` have no line starts. Totals are taken before pruning by the first two
    and after it by the others. ``discount`` may be 'estimated' for the first two.
    """
    if method not in ("kneser_ney", "absolute", "interpolated", "witten_bell"):
        raise ValueError(f"unknown method: {method}")
    starts = method in ("kneser_ney", "absolute")
    counts = counted(df, tokens, order, starts, method == "kneser_ney")
    base = cut(base_probabilities(counts[0]), "base")
    levels = []
    lower = base.select(F.lit("").alias("context"), "word", "p")
    for n in range(2, order + 1):
        own = counts[n - 1]
        d = float(estimated_discount(own).first().discount) if discount == "estimated" else float(discount)
        kept = F.col("cnt") >= least
        stats = own.groupBy("context").agg(F.sum("cnt").alias("all"), F.sum(F.when(kept, F.col("cnt"))).alias("mass"), F.count_if(kept).alias("types"))
        if starts:
            total, b, w = F.col("all"), F.greatest(F.lit(0.0), 1 - (F.col("mass") - d * F.col("types")) / F.col("all")), (F.col("cnt") - d) / F.col("total")
        elif method == "interpolated":
            total, b, w = F.col("mass"), d * F.col("types") / F.col("mass"), (F.col("cnt") - d) / F.col("total")
        else:
            total, b, w = F.col("mass"), F.col("types") / (F.col("mass") + F.col("types")), F.col("cnt") / (F.col("total") + F.col("types"))
        stats = stats.select("context", total.alias("total"), "types", F.when(F.col("types") > 0, b).otherwise(F.lit(1.0)).alias("backoff"))
        rows = own.join(stats, "context").select("context", "word", F.when(kept & (F.col("types") > 0), w).otherwise(F.lit(0.0)).alias("weight"), "total", "types", "backoff", _tail().alias("tail"))
        rows = rows.join(lower.select(F.col("context").alias("tail"), "word", F.col("p").alias("lower")), ["tail", "word"])
        level = cut(rows.select("context", "word", "weight", (F.col("backoff") * F.col("lower") + F.col("weight")).alias("p"), "total", "types", "backoff"), f"level{n}")
        levels.append(level.select(F.lit(n).alias("n"), "*"))
        lower = level
    empty = [df.sparkSession.createDataFrame([], "n int, context string, word string, weight double, p double, total bigint, types bigint, backoff double")]
    return Model(order, base, _union(levels or empty), starts, k)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def best_words(model: Model, k: int, barred: DataFrame | None = None) -> DataFrame:
    """(n, context, top): the k best words of each context, ties by word, UNKNOWN (and ``barred`` words) left out. Each
    group is cut to k rows before the shuffle."""
    base, grams = model.base.where(F.col("word") != UNKNOWN), model.grams
    if barred is not None:
        base, grams = (t.join(barred.select("word").distinct(), "word", "left_anti") for t in (base, grams))
    first = base.orderBy(F.desc("p"), "word").limit(k).agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("q"), "word"))).alias("top"))
    out = [first.select(F.lit(1).alias("n"), F.lit("").alias("context"), "top")]
    lower = first.select(F.lit("").alias("tail"), F.col("top").alias("below"))
    for n in range(2, model.order + 1):
        own = grams.where(F.col("n") == n).withColumn("r", F.expr("row_number() over (partition by context order by p desc, word)")).where(F.col("r") <= k)
        own = own.groupBy("context").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("q"), "word"))).alias("own"))
        rows = model.contexts.where(F.col("n") == n).select("context", "backoff", _tail().alias("tail")).join(own, "context", "left").join(F.broadcast(lower) if n == 2 else lower, "tail")  # one row at order 1
        # a word of the context's own that comes again from below has a smaller p there and is dropped
        rest = F.expr("transform(filter(below, x -> not exists(own, o -> o.word = x.word)), x -> struct(x.q * backoff as q, x.word as word))")
        top = F.when(F.col("own").isNull(), F.col("below")).otherwise(F.slice(F.array_sort(F.concat("own", rest)), 1, k))
        level = cut(rows.select("context", top.alias("top")), f"best{n}")
        out.append(level.select(F.lit(n).alias("n"), "*"))
        lower = level.select(F.col("context").alias("tail"), F.col("top").alias("below"))
    return _union(out)


def contexts_of(cases: DataFrame, tokens: Column, order: int, starts: bool) -> DataFrame:
    """Adds ``ctx``: an array of (n, context) for n from 2 to ``order``, the last n - 1 words (or line starts) of the prefix."""
    t = F.concat(F.array_repeat(F.lit(START), order - 1), tokens) if starts else tokens
    rows = cases.withColumn("_t", t)
    if order < 2:
        return cases.withColumn("ctx", F.expr("cast(array() as array<struct<n:int,context:string>>)"))
    parts = [F.when(F.size("_t") >= n - 1, F.struct(F.lit(n).alias("n"), F.array_join(F.slice("_t", -(n - 1), n - 1), " ").alias("context"))) for n in range(2, order + 1)]
    return rows.withColumn("ctx", F.array_compact(F.array(*parts))).drop("_t")


def predict(model: Model, cases: DataFrame, id: str, tokens: Column) -> DataFrame:
    """(id, rank, word, p, n): the best words of each case, from its longest known context of order n."""
    rows = contexts_of(cases, tokens, model.order, model.starts)
    found = _longest(rows, model.best).select(id, "n", F.posexplode("top").alias("i", "x"))
    return found.select(id, (F.col("i") + 1).alias("rank"), F.col("x.word").alias("word"), (-F.col("x.q")).alias("p"), "n")


def shortest(best: DataFrame) -> Column:
    """The best words without any context, a few structs, as a literal: no join has to bring them to every row."""
    row, kind = best.where("n = 1").select("top").first(), best.schema["top"].dataType
    words = [] if row is None else row.top
    structs = [F.struct(*[F.lit(x[f.name]).cast(f.dataType).alias(f.name) for f in kind.elementType.fields]) for x in words]
    return F.array(*structs).cast(kind) if structs else F.lit(None).cast(kind)


def _longest(rows: DataFrame, best: DataFrame) -> DataFrame:
    """``rows`` with (n, top) of their longest known context. Distinct contexts are looked up once, whatever number of
    cases end in them."""
    asked = rows.select(F.col("ctx").alias("c")).distinct()
    hits = asked.select("c", F.explode("c").alias("x")).select("c", "x.n", "x.context").join(best.where("n > 1"), ["n", "context"])
    longest = hits.groupBy("c").agg(F.max_by(F.struct("n", "top"), "n").alias("hit"))
    out = rows.join(longest, rows["ctx"] == longest["c"], "left")
    return out.select(*rows.columns, F.coalesce("hit.n", F.lit(1)).alias("n"), F.coalesce("hit.top", shortest(best)).alias("top"))


def evidence(model: Model, cases: DataFrame, id: str, tokens: Column) -> DataFrame:
    """(id, n, context, total, types): the longest context with kept grams."""
    rows = contexts_of(cases, tokens, model.order, model.starts).select(id, F.explode("ctx").alias("c")).select(id, "c.n", "c.context")
    hits = rows.join(model.contexts.where("types > 0"), ["n", "context"])
    best = hits.groupBy(id).agg(F.max_by(F.struct("n", "context", "total", "types"), "n").alias("h"))
    return cases.select(id).join(best, id, "left").select(id, F.coalesce("h.n", F.lit(1)).alias("n"), F.coalesce("h.context", F.lit("")).alias("context"), F.coalesce("h.total", F.lit(0)).alias("total"), F.coalesce("h.types", F.lit(0)).alias("types"))


def word_probability(model: Model, rows: DataFrame, id: str, word: str, tokens: Column, unknown: bool = True) -> DataFrame:
    """(id, word, p, known) of given (id, word) pairs with their prefixes.

    The longest context that holds the word gives p; longer known contexts multiply it by their backoffs. Words out of
    the vocabulary take UNKNOWN's probability, or null.
    """
    asked = contexts_of(rows, tokens, model.order, model.starts).select(id, F.col(word).alias("word"), "ctx")
    named = asked.join(model.base.select("word", F.lit(True).alias("known")), "word", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    named = named.withColumn("target", F.when(F.col("known"), F.col("word")).otherwise(F.lit(UNKNOWN)))
    flat = named.select(id, "word", "known", "target", F.explode("ctx").alias("c")).select(id, "word", "known", "target", "c.n", "c.context")
    backs = flat.join(model.contexts.select("n", "context", "backoff"), ["n", "context"])
    both = backs.join(model.grams.select("n", "context", F.col("word").alias("target"), "p"), ["n", "context", "target"], "left")
    steps = both.groupBy(id, "word").agg(F.array_sort(F.collect_list(F.struct("n", "backoff", "p"))).alias("steps"))
    base = model.base.select(F.col("word").alias("target"), F.col("p").alias("p1"))
    out = named.select(id, "word", "known", "target").join(base, "target").join(steps, [id, "word"], "left")
    p = F.expr("if(steps is null, p1, aggregate(steps, p1, (a, s) -> coalesce(s.p, a * s.backoff)))")
    out = out.select(id, "word", p.alias("p"), "known")
    return out if unknown else out.withColumn("p", F.when(F.col("known"), F.col("p")))


def rank_choices(model: Model, cases: DataFrame, id: str, options: str, tokens: Column) -> DataFrame:
    """(id, word, p, rank): the options of each case, unknown ones last without probability, ties by word."""
    rows = cases.withColumn("option", F.explode(F.array_distinct(options)))
    scored = word_probability(model, rows, id, "option", tokens, unknown=False)
    return scored.withColumn("rank", F.expr(f"row_number() over (partition by {id} order by p desc nulls last, word)")).select(id, "word", "p", "rank")


def formatted(predictions: DataFrame, id: str) -> DataFrame:
    """(id, text): predictions as "1. word (12.3 %)", best first, at most a few a case."""
    line = F.format_string("%d. %s (%.1f %%)", F.col("rank").cast("int"), F.col("word"), 100 * F.col("p"))
    rows = predictions.select(id, F.struct("rank", line.alias("line")).alias("x"))
    return rows.groupBy(id).agg(F.array_sort(F.collect_list("x")).alias("x")).select(id, F.array_join(F.col("x.line"), "; ").alias("text"))


# --- plain back-off ----------------------------------------------------------------------------


@dataclass
class BackOff:
    """``best``: (n, context, top), top an array of (score, word, n), best first; ``contexts``: (n, context, total)."""

    order: int
    grams: DataFrame
    contexts: DataFrame
    best: DataFrame
    words: int


def build_backoff(df: DataFrame, tokens: Column, order: int = 3, least: int = 1, k: int = 3) -> BackOff:
    """Relative frequencies of the longest known context, filled up from shorter ones."""
    kept = [g if n == 1 else g.where(F.col("cnt") >= least) for n, g in enumerate(counted(df, tokens, order, False), 1)]
    words = kept[0].count()
    grams, contexts, best, lower = [], [], [], None
    for n, g in enumerate(kept, 1):
        totals = g.groupBy("context").agg(F.sum("cnt").alias("total"))
        own = g.withColumn("r", F.expr("row_number() over (partition by context order by cnt desc, word)")).where(F.col("r") <= k).join(totals, "context")
        own = own.groupBy("context").agg(F.array_sort(F.collect_list(F.struct("r", "word", (F.col("cnt") / F.col("total")).alias("score"), F.lit(n).alias("n")))).alias("own"))
        if lower is None:
            level = own.select("context", F.col("own").alias("top"))
        else:
            rows = own.withColumn("tail", _tail()).join(F.broadcast(lower) if n == 2 else lower, "tail", "left")  # one row at order 1
            rest = F.expr("filter(coalesce(below, array()), x -> not exists(own, o -> o.word = x.word))")
            level = rows.select("context", F.slice(F.concat("own", rest), 1, k).alias("top"))
        level = cut(level, f"filled{n}")
        lower = level.select(F.col("context").alias("tail"), F.col("top").alias("below"))
        grams.append(g.select(F.lit(n).alias("n"), "*"))
        contexts.append(totals.select(F.lit(n).alias("n"), "*"))
        best.append(level.select(F.lit(n).alias("n"), "*"))
    return BackOff(order, _union(grams), cut(_union(contexts), "totals"), _union(best), words)


def predict_backoff(model: BackOff, cases: DataFrame, id: str, tokens: Column) -> DataFrame:
    """(id, rank, word, score, n): a word stands at its longest context; n is that context's order."""
    rows = contexts_of(cases, tokens, model.order, False)
    found = _longest(rows, model.best).select(id, F.posexplode("top").alias("i", "x"))
    return found.select(id, (F.col("i") + 1).alias("rank"), F.col("x.word").alias("word"), F.col("x.score").alias("score"), F.col("x.n").alias("n"))


def smoothed_probability(model: BackOff, cases: DataFrame, id: str, word: str, tokens: Column, alpha: float = 0.5) -> DataFrame:
    """(id, p): (count + alpha) / (total + alpha V) in the longest known context."""
    rows = contexts_of(cases, tokens, model.order, False).select(id, F.col(word).alias("word"), "ctx")
    flat = rows.select(id, "word", F.explode("ctx").alias("c")).select(id, "word", "c.n", "c.context")
    longest = flat.join(model.contexts.where("n > 1"), ["n", "context"]).groupBy(id, "word").agg(F.max_by(F.struct("n", "context", "total"), "n").alias("h"))
    first = model.contexts.where("n = 1").agg(F.sum("total")).first()[0] or 0
    named = rows.select(id, "word").distinct().join(longest, [id, "word"], "left").select(id, "word", F.coalesce("h.n", F.lit(1)).alias("n"), F.coalesce("h.context", F.lit("")).alias("context"), F.coalesce("h.total", F.lit(first)).alias("total"))
    seen = named.join(model.grams, ["n", "context", "word"], "left")
    return seen.select(id, ((F.coalesce("cnt", F.lit(0)) + alpha) / (F.col("total") + alpha * model.words)).alias("p"))
