"""Word tries as relations, and beam search over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut


def trie(words: DataFrame, most: int = 6) -> DataFrame:
    """(path, parent, token, depth, word): the nodes of (word, token_path); a word of one token or of more than ``most`` is
    left out; a node that ends a word carries it, children or not. A path that two words share is an error."""
    rows = words.where(F.size("token_path").between(2, most))
    nodes = rows.select(F.explode(F.expr("transform(sequence(1, size(token_path)), d -> struct(slice(token_path, 1, d) as path, slice(token_path, 1, d - 1) as parent, token_path[d - 1] as token, d as depth, if(d = size(token_path), word, null) as word))")).alias("n")).select("n.*")
    out = nodes.groupBy("path", "parent", "token", "depth").agg(F.max("word").alias("word"), F.count_distinct("word").alias("words"))
    checked = F.when(F.col("words") > 1, F.raise_error(F.lit("two words share a token path"))).otherwise(F.col("word"))
    return out.select("path", "parent", "token", "depth", checked.alias("word"))


def statistics(words: DataFrame, most: int = 6) -> DataFrame:
    n = F.size("token_path")
    return words.agg(F.count("*").alias("words"), F.count_if(n > most).alias("over_depth"), F.count_if(n < 2).alias("single_token"), F.count_if(n.between(2, most)).alias("eligible"))


def beam_search(nodes: DataFrame, edges: DataFrame, beam: int, most: int = 6, cap: int = 128) -> DataFrame:
    """(case_id, word, score, rank): complete words by the sum of their edges' log-probabilities.

    ``edges`` has (case_id, path, logp), the score of stepping onto a node. A depth is one join; after all edges of a
    depth are scored, each case keeps its ``beam`` best open paths, ties by path. Six depths at most: the loop's length
    does not depend on the data.
    """
    inner = nodes.select(F.col("parent").alias("path")).distinct().withColumn("open", F.lit(True))
    steps = nodes.join(edges, "path").join(inner, "path", "left")
    frontier, done = None, None
    for depth in range(1, most + 1):
        here = steps.where(F.col("depth") == depth)
        reached = here.select("case_id", "path", "word", "open", F.col("logp").alias("score")) if frontier is None else here.join(frontier, ["case_id", "parent"]).select("case_id", "path", "word", "open", (F.col("logp") + F.col("base")).alias("score"))
        reached = cut(reached, f"depth{depth}")
        found = reached.where("word is not null").select("case_id", "word", "score")
        done = found if done is None else done.unionAll(found)
        kept = reached.where("open").withColumn("r", F.expr("row_number() over (partition by case_id order by score desc, path)")).where(F.col("r") <= beam)
        frontier = kept.select("case_id", F.col("path").alias("parent"), F.col("score").alias("base"))
    return done.withColumn("rank", F.expr("row_number() over (partition by case_id order by score desc, word)")).where(F.col("rank") <= cap)
