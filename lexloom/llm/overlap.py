"""Similarity joins on bags of words: rare-first prefixes, bounds, and one exact check of each pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import source_name, words
from lexloom.llm.copies import content_key
from lexloom.session import cut, partitions, settings

#: Buckets of the word counts. The counts only order words by rarity; they are the one thing broadcast, 4 bytes each.
BUCKETS = 1 << 18
#: Bags of up to LONG words are joined on pairs of prefix words, longer ones on single prefix words.
LONG = 64
#: Lines with more words than MANY would give too many pairs; they are joined on single words, in a key space of their own.
MANY = 256
#: Occurrences of a word behind one join key; a more frequent word is spread over as many keys as that takes.
SPREAD = 1 << 20
#: Words of all bags behind one partition of a join, and the most partitions of one.
TASK_WORDS, MOST_PARTITIONS = 250_000, 1 << 16
MIN_WORDS = 12
#: Words that a line must share with a case at least.
LEAST = (4 * MIN_WORDS + 4) // 5
_TIE, _KEY, _FEW, _LOOSE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def word_ids(text: Column) -> Column:
    """Sorted 64-bit ids of a text's words, one for each occurrence."""
    return F.sort_array(F.transform(words(text), lambda w: F.xxhash64(w)))


def word_counts(spark: SparkSession, *bags: DataFrame) -> np.ndarray:
    """How often the words of each bucket occur in all bags (a column ``bag`` each): BUCKETS numbers, whatever the data's size."""
    counts = np.zeros(BUCKETS, np.int64)
    rows = None
    for b in bags:
        one = b.select(F.explode("bag").alias("w"))
        rows = one if rows is None else rows.unionAll(one)
    got = rows.groupBy(F.pmod("w", F.lit(BUCKETS)).cast("int").alias("b")).count().toArrow()
    counts[got.column("b").to_numpy()] = got.column("count").to_numpy()
    return np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32)


def tasks(spark: SparkSession, counts: np.ndarray) -> int:
    """Partitions of a join of bags with these word counts, so that a task's share stays the same at every size."""
    return int(min(max(partitions(spark), -(-int(counts.sum(dtype=np.int64)) // TASK_WORDS)), MOST_PARTITIONS))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _mix(x * np.uint64(3) + _mix(y))


def _ordered(bags: pa.ListArray, counts: np.ndarray):
    """Flat word ids, rarest first in each bag; a repeated word gets an id of its own for each repetition, so that
    bags become sets. Also the row and the position of each, the bags' sizes, and the words' counts."""
    lens = np.diff(bags.offsets.to_numpy())
    flat = bags.flatten().to_numpy()
    row = np.repeat(np.arange(len(lens)), lens)
    often = counts[flat & (BUCKETS - 1)]
    order = np.lexsort((flat, often, row))
    flat, often = flat[order].view(np.uint64), often[order]
    at = np.arange(len(flat))
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
    nth = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    start = np.cumsum(lens) - lens
    return flat + nth * _TIE, row, at - start[row], lens, often


def _signature(ids: np.ndarray, row: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64 bits of each bag. A bit of one bag that the other lacks is a word the other lacks."""
    out = np.zeros(len(lens), np.uint64)
    full = lens > 0
    if full.any():
        out[full] = np.bitwise_or.reduceat(np.uint64(1) << ((_mix(ids) >> np.uint64(32)) & np.uint64(63)), (np.cumsum(lens) - lens)[full])
    return out.view(np.int64)


def _twos(ids: np.ndarray, row: np.ndarray, pos: np.ndarray, limit: np.ndarray):
    """Pairs (first, second) of indices of each row's words below the position ``limit`` of the row."""
    i = np.flatnonzero(pos < limit[row])
    for lag in range(1, int(limit.max(initial=0))):
        i = i[pos[i] + lag < limit[row[i]]]
        if not len(i):
            return
        yield i, i + lag


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, kind)


def _posts(counts):
    """Postings of bags for a join with themselves: (key, id, p, signature), p being size * 2^32 + position of the key's
    last word. Keys are pairs of words of the necessary prefix, single ones for bags above LONG."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("p", pa.int64()), ("sig", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            doc = b.column(0).to_numpy()
            ids, row, pos, lens, _ = _ordered(b.column(1), counts.value)
            sig = _signature(ids, row, lens)
            need = (4 * lens + 4) // 5
            m = (pos < (lens - need + 1)[row]) & (lens > LONG)[row]
            keys, rows, at = [_mix(ids[m] ^ _KEY)], [row[m]], [pos[m]]
            # 1.25 LONG: partners of both kinds meet
            for i, j in _twos(ids, row, pos, np.where(lens * 4 <= LONG * 5, lens - need + 2, 0)):
                keys.append(_pair(ids[i], ids[j])), rows.append(row[i]), at.append(pos[j])
            r = _joined(rows, np.int64)
            p = (lens[r].astype(np.int64) << 32) + _joined(at, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(_joined(keys, np.uint64).view(np.int64)), pa.array(doc[r]), pa.array(p), pa.array(sig[r])], schema=schema)

    return run


def _spread(often: np.ndarray) -> np.ndarray:
    """Keys over which the occurrences of a word are spread."""
    return 1 + often.astype(np.int64) // SPREAD


def _salted(ids: np.ndarray, space: np.uint64, salt: np.ndarray) -> np.ndarray:
    return _mix((ids ^ space) + salt.astype(np.uint64) * _TIE).view(np.int64)


def _case_posts(counts):
    """Postings of cases: (key, second, id, need). A line with ``need`` words of a case holds two of its first
    n - need + 2 words, in rare-first order, or one of its first n - need + 1. The key is the first word of a pair, on all
    its spread, ``second`` 16 bits of the other."""
    schema = pa.schema([("key", pa.int64()), ("second", pa.int16()), ("id", pa.int64()), ("need", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            doc = b.column(0).to_numpy()
            ids, row, pos, lens, often = _ordered(b.column(1), counts.value)
            need = (4 * lens + 4) // 5
            wide = _spread(often)
            keys, seconds, rows = [], [], []

            def add(i, space, second):
                n = wide[i]
                salt = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                i, second = np.repeat(i, n), np.repeat(second, n)
                keys.append(_salted(ids[i], space, salt)), seconds.append(second), rows.append(row[i])

            one = pos < (lens - need + 1)[row]
            for space, few in ((_FEW, lens > LONG), (_LOOSE, lens <= LONG)):
                i = np.flatnonzero(one & few[row])
                add(i, space, np.zeros(len(i), np.uint16))
            for i, j in _twos(ids, row, pos, np.where(lens <= LONG, lens - need + 2, 0)):
                add(i, _KEY, ids[j].astype(np.uint16))
            r = _joined(rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(_joined(keys, np.int64)), pa.array(_joined(seconds, np.uint16).view(np.int16)), pa.array(doc[r]), pa.array(need[r].astype(np.int32))], schema=schema)

    return run


def _line_posts(counts):
    """Postings of lines: (key, id, left, seconds), one for each word that may be the first of two common words: what
    follows it must hold the rest of at least LEAST words. ``seconds`` are 16 bits of each word that may come second;
    ``left`` is the number of words from the key on. So a line of n words gives n - LEAST + 1 rows, whatever the counts.

    Lines above MANY words, and all lines for cases above LONG words, give single words."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("left", pa.int32()), ("seconds", pa.list_(pa.int16()))])
    long_need = (4 * (LONG + 1) + 4) // 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            doc = b.column(0).to_numpy()
            ids, row, pos, lens, often = _ordered(b.column(1), counts.value)
            salt = (_mix(doc.view(np.uint64))[row] % _spread(often).astype(np.uint64)).astype(np.int64)
            short = ids.astype(np.uint16).view(np.int16)
            size = lens[row]
            for space, m, paired in (
                (_KEY, (pos < size - LEAST + 1) & (size <= MANY), True),
                (_FEW, pos < size - long_need + 1, False),
                (_LOOSE, (pos < size - LEAST + 1) & (size > MANY), False),
            ):
                i = np.flatnonzero(m)
                if not len(i):
                    continue
                left = size[i] - pos[i]
                if paired:  # the second word has LEAST - 2 behind it
                    n = left - 1 - (LEAST - 2)
                    offsets = np.concatenate([[0], np.cumsum(n)])
                    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n) + np.repeat(i + 1, n)
                    seconds = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(short[at]))
                else:
                    seconds = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32)), pa.array(np.zeros(len(i), np.int16)))
                yield pa.RecordBatch.from_arrays([pa.array(_salted(ids[i], space, salt[i])), pa.array(doc[row[i]]), pa.array(left.astype(np.int32)), seconds], schema=schema)

    return run


def _checked(shares):
    """Keep (a, b, ...) whose bags share enough words; ``shares(na, nb)`` is the number needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(BUCKETS, np.int32)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x, rx, _, nx, _ = _ordered(b.column(2), none)
            y, ry, _, ny, _ = _ordered(b.column(3), none)
            row, ids = np.concatenate([rx, ry]), np.concatenate([x, y])
            order = np.lexsort((ids, row))
            row, ids = row[order], ids[order]
            both = (ids[1:] == ids[:-1]) & (row[1:] == row[:-1])
            common = np.bincount(row[1:][both], minlength=n)
            ok = common >= shares(nx, ny)
            yield b.select([0, 1]).filter(pa.array(ok))

    return run


def bags(df: DataFrame, id: str, text: str, least: int, content: bool) -> DataFrame:
    """(id, bag, c, w, w2): word ids of each text of ``least`` words or more, a hash of the content and two of the bag; null
    ids and texts are left out. Written once: the words of a text are not sought again by counts, classes and members."""
    rows = df.where(F.col(id).isNotNull() & F.col(text).isNotNull())
    c = F.xxhash64(content_key(F.col(text))) if content else F.lit(0).cast("bigint")
    rows = rows.select(F.col(id).cast("bigint").alias("id"), word_ids(F.col(text)).alias("bag"), c.alias("c")).where(F.size("bag") >= least)
    return cut(rows.withColumn("w", F.xxhash64("bag")).withColumn("w2", F.xxhash64(F.lit(7), "bag")), "bags")


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with one content and one bag make a class, named by two 64-bit hashes and its smallest id.

    Returns (rep, bag, c) of the classes and (id, rep) of the rows; a class of any size stays one row in the joins.
    """
    one = cut(rows.groupBy("c", "w", "w2").agg(F.min("id").alias("rep"), F.first("bag").alias("bag")), "classes")
    members = rows.select("id", "c", "w", "w2").join(one.select("c", "w", "w2", "rep"), ["c", "w", "w2"]).select("id", "rep")
    return one.select("rep", "bag", "c"), members


def near_pairs(df: DataFrame, id: str = "case_id", text: str = "prefix") -> DataFrame:
    """(case_a, case_b): pairs whose bags of words share at least 80 % of the larger one, both of MIN_WORDS words or
    more, without pairs of the same content. See :func:`near_classes`; every pair of rows is given.

    Null ids and texts, and texts that are too short, are in no pair. Repeated rows of one id form no pair.
    """
    found, members = near_classes(df, id, text)
    a = members.select(F.col("rep").alias("a"), F.col("id").alias("ia"))
    b = members.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    out = found.join(a, "a").join(b, "b").where("ia <> ib")
    return out.select(F.least("ia", "ib").alias("case_a"), F.greatest("ia", "ib").alias("case_b"))


def near_classes(df: DataFrame, id: str = "case_id", text: str = "prefix") -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of classes of near-duplicates, and the members (id, rep) of all classes.

    Words are ordered by their counts over all rows, rarest first. Two bags of sizes n <= m that share 0.8 m words
    have two common words among their first n - 0.8 n + 2: those pairs are the keys of the join (single words for
    bags above LONG). Candidates pass the length bound, the bound from the key's position and the bound from the
    signatures of what is left; each distinct pair is then checked once on whole bags.
    """
    spark = df.sparkSession
    rows = bags(df, id, text, MIN_WORDS, True)
    one, members = classes(rows)
    counts = spark.sparkContext.broadcast(word_counts(spark, rows))
    # every partition of the join gets a like share of the words, and the sizes and positions travel in one number
    packed = one.select("rep", "bag").mapInArrow(_posts(counts), "key bigint, id bigint, p bigint, sig bigint").repartition(tasks(spark, counts.value), "key")
    a, b = (packed.select("key", *[F.col(c).alias(f"{c}{s}") for c in ("id", "p", "sig")]) for s in "ab")
    na, nb, ata, atb = ("shiftright(pa, 32)", "shiftright(pb, 32)", "(pa & 4294967295)", "(pb & 4294967295)")
    need = f"((4 * greatest({na}, {nb}) + 4) div 5)"
    pairs = (
        a.join(b, "key").where("ida < idb")
        .where(f"5 * least({na}, {nb}) >= 4 * greatest({na}, {nb})")
        # the first common words of a true pair are one of its keys; behind them no more than the shorter rest can match
        .where(f"least({na} - {ata}, {nb} - {atb}) + 1 >= {need}")
        .where(f"bit_count(siga & ~sigb) <= {na} - {need} and bit_count(sigb & ~siga) <= {nb} - {need}")
        .select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct()
    )
    with_a = pairs.join(one.select(F.col("rep").alias("a"), F.col("bag").alias("x"), F.col("c").alias("ca")), "a")
    with_b = with_a.join(one.select(F.col("rep").alias("b"), F.col("bag").alias("y"), F.col("c").alias("cb")), "b")
    found = with_b.where("not (ca <=> cb)").select("a", "b", "x", "y").mapInArrow(_checked(lambda n, m: (4 * np.maximum(n, m) + 4) // 5), "a bigint, b bigint")
    return found, members


def near_links(df: DataFrame, id: str = "case_id", text: str = "prefix") -> DataFrame:
    """(case_id, class_id, links): every text of MIN_WORDS words or more, the class of rows with its content and bag
    (named by its smallest id), and the number of its near-duplicates. Pairs of classes are never expanded into pairs of rows."""
    found, members = near_classes(df, id, text)
    sizes = members.groupBy("rep").agg(F.count("*").alias("n"))
    both = cut(found, "classes")
    both = both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(sizes.select(F.col("rep").alias("b"), "n"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    return members.join(links, "rep", "left").select(F.col("id").alias("case_id"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _by_hash(cases: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(case_id, h) and (line_id, h), nulls left out."""
    c = cases.where("line_hash is not null and case_id is not null").select(F.col("case_id").cast("bigint").alias("case_id"), F.lower("line_hash").alias("h"))
    return c, lines.where("line_hash is not null and line_id is not null").select(F.col("line_id").cast("bigint").alias("line_id"), F.lower("line_hash").alias("h"))


def shared_classes(cases: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b) of a class of cases of MIN_WORDS words or more and a class of lines that holds 80 % of them, and the
    members (id, rep) of both kinds of classes.

    Equal hashes of canonical records (the bag of words) are folded into classes. A case's two rarest words within the
    line are among the first of its words, in the order of counts over all rows; such pairs are the keys. Postings
    are partitioned by the first word of a pair; the pairs of a line are only formed behind the shuffle, where they meet
    a hash table of the cases' pairs, so that what is shuffled grows with the words and what is compared with the pairs.
    """
    spark = cases.sparkSession
    x_rows = bags(cases, "case_id", "prefix", MIN_WORDS, False)
    y_rows = bags(lines, "line_id", "text", LEAST, False)
    (x, x_members), (y, y_members) = classes(x_rows), classes(y_rows)
    counts = spark.sparkContext.broadcast(word_counts(spark, x_rows, y_rows))
    n = tasks(spark, counts.value)
    px = x.select("rep", "bag").mapInArrow(_case_posts(counts), "key bigint, second smallint, id bigint, need int").select("key", "second", F.col("id").alias("a"), "need").repartition(n, "key")
    py = y.select("rep", "bag").mapInArrow(_line_posts(counts), "key bigint, id bigint, left int, seconds array<smallint>").repartition(n, "key")
    py = py.select("key", F.col("id").alias("b"), "left", F.posexplode("seconds").alias("q", "second"))
    pairs = py.join(px.hint("shuffle_hash"), ["key", "second"]).where("left - q >= need").select("a", "b").distinct()
    with settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):  # partitioned by the first word, joined on both
        pairs = cut(pairs, "candidates")
    with_x = pairs.join(x.select(F.col("rep").alias("a"), F.col("bag").alias("x")), "a")
    with_y = with_x.join(y.select(F.col("rep").alias("b"), F.col("bag").alias("y")), "b").select("a", "b", "x", "y")
    found = with_y.mapInArrow(_checked(lambda n, m: (4 * n + 4) // 5), "a bigint, b bigint")
    return found, x_members, y_members


def shared_lines(cases: DataFrame, lines: DataFrame) -> DataFrame:
    """(case_id, line_id): the line hashes are equal, ignoring case; or the prefix has MIN_WORDS words and 80 % of them
    are in the line (see :func:`shared_classes`). Null hashes, ids and texts equal nothing; repeated rows give one pair.
    """
    found, x_members, y_members = shared_classes(cases, lines)
    c, t = _by_hash(cases, lines)
    a = x_members.select(F.col("rep").alias("a"), F.col("id").alias("case_id"))
    b = y_members.select(F.col("rep").alias("b"), F.col("id").alias("line_id"))
    by_words = found.join(a, "a").join(b, "b").select("case_id", "line_id")
    return c.join(t, "h").select("case_id", "line_id").unionAll(by_words).distinct()


def line_links(cases: DataFrame, lines: DataFrame) -> DataFrame:
    """(case_id, class_id, by_hash, by_words): for each case with a line hash or MIN_WORDS words, the class of its bag (its
    own id if it has fewer words), the number of lines with its hash and of lines that hold 80 % of its words. Counts of
    classes and hashes are joined, pairs of rows are never formed; repeated rows count as often as they occur."""
    found, x_members, y_members = shared_classes(cases, lines)
    c, t = _by_hash(cases, lines)
    per_hash = t.groupBy("h").agg(F.count("*").alias("k"))
    by_hash = c.join(per_hash, "h", "left").groupBy("case_id").agg(F.max(F.coalesce("k", F.lit(0))).alias("by_hash"))
    sizes = y_members.groupBy(F.col("rep").alias("b")).agg(F.count("*").alias("k"))
    links = found.join(sizes, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("k").alias("by_words"))
    by_words = x_members.join(links, "rep", "left").select(F.col("id").alias("case_id"), "rep", "by_words").distinct()
    return by_words.join(by_hash, "case_id", "full").select("case_id", F.coalesce("rep", "case_id").alias("class_id"), F.coalesce("by_hash", F.lit(0)).alias("by_hash"), F.coalesce("by_words", F.lit(0)).alias("by_words"))


def overlap_report(cases: DataFrame, pairs: DataFrame) -> DataFrame:
    """(split, source, cases, leaked, pairs): cases of each split and source, those with a training line, and their pairs."""
    per_case = pairs.groupBy("case_id").agg(F.count("*").alias("n"))
    rows = cases.select("case_id", F.coalesce("split", F.lit("")).alias("split"), F.coalesce(source_name(F.col("source")), F.lit("")).alias("source")).join(per_case, "case_id", "left")
    return rows.groupBy("split", "source").agg(F.count("*").alias("cases"), F.count("n").alias("leaked"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
