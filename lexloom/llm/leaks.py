"""Passages of held-out items inside documents: a prefix-filtered join of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import words
from lexloom.session import cut, small

#: Words of a shingle, and consecutive words that make a leak.
SHINGLE = 5
RUN = 12
_REACH = RUN - 1
_WIDTH = 2 * _REACH + SHINGLE
_DDL = "h bigint, id bigint, at int, near array<bigint>"
_MUL = np.uint64(0x9E3779B97F4A7C15)


#: Bits of the filter of item shingles, two megabytes however many there are; the more shingles, the less it leaves out.
FILTER_BITS = 1 << 24


def key_filter(posts: DataFrame) -> np.ndarray:
    """A bit for each hashed key of ``posts``, packed by 64: what has no bit is no key."""
    h = posts.select(F.expr(f"key & {FILTER_BITS - 1}").alias("h"))
    got = h.groupBy(F.expr("cast(shiftright(h, 6) as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def sequence(text: Column) -> Column:
    """64-bit ids of a text's words in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _hits(wanted=None):
    """(shingle, id, position, the words around it) of each shingle that passes the filter. Words before the text's
    start and behind its end are marked by 0."""
    schema = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("at", pa.int32()), ("near", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            docs = b.column(0).to_numpy()
            lens = np.diff(b.column(1).offsets.to_numpy())
            flat = b.column(1).flatten().to_numpy().view(np.uint64)
            n = len(flat) - SHINGLE + 1
            if n <= 0:
                continue
            row = np.repeat(np.arange(len(lens)), lens)
            end = np.cumsum(lens)
            h = np.zeros(n, np.uint64)
            for k in range(SHINGLE):
                h = (h ^ (h >> np.uint64(31))) * _MUL + flat[k : k + n]
            h ^= h >> np.uint64(29)
            ok = (np.arange(n) + SHINGLE <= end[row[:n]]) & (lens[row[:n]] >= RUN)
            if wanted is not None:
                bit = h & np.uint64(FILTER_BITS - 1)
                ok &= (wanted.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            at = np.flatnonzero(ok)
            for s in range(0, len(at), 50_000):
                i = at[s : s + 50_000]
                r = row[i]
                near = i[:, None] + np.arange(-_REACH, SHINGLE + _REACH)
                inside = (near >= (end - lens)[r][:, None]) & (near < end[r][:, None])
                ids = np.where(inside, flat[np.clip(near, 0, len(flat) - 1)], np.uint64(0)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, _WIDTH, dtype=np.int32)), pa.array(ids.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(h[i].view(np.int64)), pa.array(docs[r]), pa.array((i - (end - lens)[r]).astype(np.int32)), lists], schema=schema)

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep (doc_id, item_id) whose words around the common shingle agree in RUN consecutive places."""
    for b in batches:
        if not b.num_rows:
            continue
        x = b.column(2).flatten().to_numpy().reshape(-1, _WIDTH)
        y = b.column(3).flatten().to_numpy().reshape(-1, _WIDTH)
        same = (x == y) & (x != 0)
        left = np.cumprod(same[:, _REACH - 1 :: -1] if _REACH else same[:, :0], axis=1).sum(axis=1)
        right = np.cumprod(same[:, _REACH:], axis=1).sum(axis=1)
        yield b.select([0, 1]).filter(pa.array((right >= SHINGLE) & (left + right >= RUN)))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the text and the item share at least RUN consecutive words.

    Shingles of the items are ordered by how many documents hold them; of each item window of RUN words the rarest one
    is necessary. Only document positions whose shingle is an item shingle leave the scan, with the words around them;
    necessary shingles are joined, and the run through the match is checked word by word. Null ids and texts, and texts
    of fewer than RUN words, are in no pair; repeated rows give one pair.
    """
    spark = docs.sparkSession
    item_hits = cut(
        items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("id"), sequence(F.col("text")).alias("ids")).mapInArrow(_hits(), _DDL), "items"
    )
    wanted = spark.sparkContext.broadcast(key_filter(item_hits.select(F.col("h").alias("key"))))
    doc_rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("id"), sequence(F.col("text")).alias("ids"))
    doc_hits = cut(doc_rows.mapInArrow(_hits(wanted), _DDL), "hits")

    counts = doc_hits.groupBy("h").agg(F.count("*").alias("n"))
    ranked = item_hits.join(counts, "h", "left").withColumn("rank", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "at"))
    windows = ranked.selectExpr("id", "at", f"min(rank) over (partition by id order by at rows between current row and {RUN - SHINGLE} following) as rarest", "lead(at, " + str(RUN - SHINGLE) + ") over (partition by id order by at) as full")
    # a shingle that no document holds makes its windows impossible
    chosen = windows.where("full is not null and rarest.n > 0").select("id", F.col("rarest.at").alias("at")).distinct()
    necessary = cut(item_hits.join(chosen, ["id", "at"]).select("h", F.col("id").alias("item_id"), F.col("near").alias("item_near")), "necessary")
    candidates = doc_hits.join(small(necessary), "h").select(F.col("id").alias("doc_id"), "item_id", "near", "item_near")
    return candidates.mapInArrow(_verified, "doc_id bigint, item_id bigint").distinct()


def leak_report(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(item_id, reserve_role, documents): how many documents hold a passage of each item."""
    n = pairs.groupBy("item_id").agg(F.count("*").alias("n"))
    return items.select("item_id", "reserve_role").join(n, "item_id", "left").select("item_id", "reserve_role", F.coalesce("n", F.lit(0)).alias("documents"))
