"""Drawing documents so that sources have their target shares of all tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import source_name
from lexloom.operators.ordered import running_sums
from lexloom.session import cut, small

#: A byte-level BPE vocabulary as ranks, and its splitting pattern.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _counted(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        encode = tiktoken.Encoding("counting", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            sizes = [len(encode(t.as_py())) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sizes, pa.int64())], names=["doc_id", "source", "quality", "tokens"])

    return run


def token_counts(docs: DataFrame, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source, quality, tokens) of each document; quality is the share of letters among the characters, 0 to 1.
    Null ids, sources and texts are left out."""
    rows = docs.where("doc_id is not null and source is not null and text is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        source_name(F.col("source")).alias("source"),
        F.expr(r"length(regexp_replace(text, '[^\\p{L}]+', '')) / greatest(length(text), 1)").alias("quality"),
        F.col("text"),
    )
    return rows.mapInArrow(_counted(path, pattern), "doc_id bigint, source string, quality double, tokens bigint")


def budgets(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, documents, budget, epochs, rest) of each target source.

    ``total`` is the size aimed at, by default all tokens of the target sources. A source gets its share of it, at most
    ``max_repeats`` times what it has: what small sources cannot give is not taken from others, whose shares keep their
    ratios to each other. Sources without documents get 0. Repeated targets count once, the largest; null or negative
    shares and repeats count as 0.
    """
    t = targets.where("source is not null").groupBy(source_name(F.col("source")).alias("source")).agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    rows = t.join(have, "source", "left").fillna(0, ["available", "documents"])
    # one row per target source: the window below runs over that small table only
    whole = F.lit(total).cast("bigint") if total is not None else F.expr("sum(available) over (partition by 1)")
    rows = rows.withColumn("total", whole).withColumn("budget", F.expr("cast(least(floor(greatest(target_share, 0) * total), greatest(max_repeats, 0) * available) as bigint)"))
    return rows.withColumn("epochs", F.expr("if(available > 0, budget div available, 0)")).withColumn("rest", F.expr("budget - epochs * available")).drop("total")


def draw(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source, tokens, uses): the drawn documents and how often each is used.

    Every source first completes whole epochs. What is left of its budget is filled by Efraimidis-Spirakis sampling
    without replacement: keys -ln(u) / quality, smallest first, taken while the running sum of tokens comes nearer to
    the budget. Keys depend on (seed, doc_id) only. Documents of no token count as used in each epoch.
    """
    sized = cut(token_counts(docs, path, pattern), "tokens")
    plan = cut(budgets(sized, targets, total), "budgets")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = sized.join(small(plan.select("source", "epochs", "rest")), "source").withColumn("key", -F.log(u) / F.greatest("quality", F.lit(1e-3)))
    sums = running_sums(keyed, "source", ["key"], "doc_id", "tokens")
    picked = sums.join(small(plan.select(F.col("source").alias("grp"), "epochs", "rest")), "grp")
    uses = F.expr("cast(epochs + if(before < rest and upto - rest <= rest - before, 1, 0) as int)")
    return picked.select(F.col("id").alias("doc_id"), F.col("grp").alias("source"), F.col("size").alias("tokens"), uses.alias("uses")).where("uses > 0")


def shares(docs: DataFrame, targets: DataFrame, **kinds) -> DataFrame:
    """(source, target_share, documents, tokens, actual_share) of a draw, one row for each target source."""
    drawn = draw(docs, targets, **kinds).groupBy("source").agg(F.count("*").alias("documents"), F.expr("sum(tokens * uses)").alias("tokens"))
    t = targets.where("source is not null").groupBy(source_name(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"))
    rows = t.join(drawn, "source", "left").fillna(0, ["documents", "tokens"])
    return rows.withColumn("actual_share", F.expr("round(tokens / nullif(sum(tokens) over (partition by 1), 0), 6)"))
