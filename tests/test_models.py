"""Models against a plain dense computation on a toy corpus."""

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom.functions.text import tokens_model
from lexloom.plans import models, product

LINES = ["birds can fly very high"] * 20 + ["little birds can swim in water"] + ["boats can float in water"] * 10 + ["people read books at home"]
PREFIXES = ["birds can", "little birds can", "unseen lexemes", "", "BIRDS, can", "in"]


def dense(lines, prefix, method, order, least, d):
    """p(w | prefix) of every word, by the recursion as written in textbooks."""
    toks = [x.split() for x in lines if x]
    starts = method in ("kneser_ney", "absolute")
    grams = {n: Counter() for n in range(1, order + 1)}
    for t in toks:
        p = ["<s>"] * (order - 1) * starts + t
        first = (order - 1) * starts
        for n in grams:
            for e in range(max(first, n - 1), len(p)):
                grams[n][tuple(p[e - n + 1 : e + 1])] += 1
    if method == "kneser_ney":
        eff = {n: Counter(g[1:] for g in grams[n + 1]) for n in range(1, order)} | {order: grams[order]}
    else:
        eff = grams
    vocab = sorted({g[0] for g in eff[1]}) + ["<unk>"]
    total = sum(eff[1].values()) + 0.1 * len(vocab)
    p = {w: (eff[1].get((w,), 0) + 0.1) / total for w in vocab}
    words = ["<s>"] * (order - 1) * starts + [w for w in "".join(c if c.isalpha() else " " for c in prefix.lower()).split()]
    for n in range(2, order + 1):
        if len(words) < n - 1:
            continue
        c = tuple(words[len(words) - n + 1 :])
        rows = {g[-1]: k for g, k in eff[n].items() if g[:-1] == c}
        kept = {w: k for w, k in rows.items() if k >= least}
        if not kept:
            continue
        if starts:
            t = sum(rows.values())
            b, add = max(0, 1 - sum(k - d for k in kept.values()) / t), {w: (k - d) / t for w, k in kept.items()}
        elif method == "interpolated":
            t = sum(kept.values())
            b, add = d * len(kept) / t, {w: (k - d) / t for w, k in kept.items()}
        else:
            t, k0 = sum(kept.values()), len(kept)
            b, add = k0 / (t + k0), {w: k / (t + k0) for w, k in kept.items()}
        p = {w: b * x + add.get(w, 0) for w, x in p.items()}
    return p


@pytest.fixture(scope="module")
def tables(spark):
    df = spark.createDataFrame([(x,) for x in LINES + ["", None]], "text string")
    cases = spark.createDataFrame(list(enumerate(PREFIXES)), "case_id bigint, prefix string")
    return df, cases


CONFIGS = [("kneser_ney", 5, 1), ("kneser_ney", 5, 2), ("absolute", 5, 1), ("absolute", 3, 2), ("interpolated", 3, 1), ("interpolated", 3, 2), ("witten_bell", 3, 1)]


@pytest.mark.parametrize(("method", "order", "least"), CONFIGS)
def test_against_dense(spark, tables, method, order, least):
    df, cases = tables
    t = tokens_model(F.col("prefix"))
    m = models.build(df, tokens_model(F.col("text")), method, order, least)
    want = {i: dense(LINES, p, method, order, least, 0.75) for i, p in enumerate(PREFIXES)}
    words = [w for w in want[0]]
    rows = cases.withColumn("word", F.explode(F.array(*map(F.lit, words))))
    got = {(r.case_id, r.word): r.p for r in models.word_probability(m, rows, "case_id", "word", t).collect()}
    for i, w in itertools.product(want, words):
        assert abs(got[i, w] - want[i][w]) < 1e-12
    for i in want:
        assert abs(sum(got[i, w] for w in words) - 1) < 1e-10
    top = {}
    for r in models.predict(m, cases, "case_id", t).collect():
        top.setdefault(r.case_id, []).append((r.rank, r.word, r.p))
    for i in want:
        best = sorted(((-p, w) for w, p in want[i].items() if w != "<unk>"))[:3]
        assert [w for _, w, _ in sorted(top[i])] == [w for _, w in best]
        assert all(abs(p + q) < 1e-12 for (_, _, p), (q, _) in zip(sorted(top[i]), best, strict=True))
    assert sorted(top[0])[0][1] == "fly" if (method, least) != ("x", 0) else True


def test_known_values(spark, tables):
    df, cases = tables
    m = models.build(df, tokens_model(F.col("text")), "kneser_ney", 5, 1)
    got = {(r.case_id, r.rank): (r.word, round(r.p, 8)) for r in models.predict(m, cases, "case_id", tokens_model(F.col("prefix"))).collect()}
    assert got[0, 1] == ("fly", 0.97798913) and got[0, 2] == ("swim", 0.00611413) and got[1, 1] == ("swim", 0.55978261) and got[3, 1] == ("birds", 0.6191247)


def test_choices_and_evidence(spark, tables):
    df, cases = tables
    t = tokens_model(F.col("prefix"))
    m = models.build(df, tokens_model(F.col("text")), "interpolated", 3, 1)
    rows = cases.withColumn("options", F.array(F.lit("float"), F.lit("fly"), F.lit("unseenlexeme"), F.lit("fly")))
    got = sorted((r["rank"], r.word, r.p) for r in models.rank_choices(m, rows, "case_id", "options", t).where("case_id = 0").collect())
    assert [g[1] for g in got] == ["fly", "float", "unseenlexeme"] and got[2][2] is None
    e = {r.case_id: (r.n, r.context) for r in models.evidence(m, cases, "case_id", t).collect()}
    assert e[0] == (3, "birds can") and e[2] == (1, "") and e[5] == (2, "in")


def test_backoff(spark, tables):
    df, cases = tables
    t = tokens_model(F.col("prefix"))
    m = models.build_backoff(df, tokens_model(F.col("text")), 3, 1)
    got = {(r.case_id, r["rank"]): (r.word, r.n) for r in models.predict_backoff(m, cases, "case_id", t).collect()}
    assert got[0, 1] == ("fly", 3) and got[0, 2] == ("swim", 3) and got[0, 3] == ("float", 2) and got[2, 1] == ("can", 1)
    p = models.smoothed_probability(m, cases.withColumn("actual", F.lit("fly")), "case_id", "actual", t)
    assert abs({r.case_id: r.p for r in p.collect()}[0] - 20.5 / (21 + 0.5 * m.words)) < 1e-12


def test_compact_is_exact_and_serves(spark, tables):
    df, cases = tables
    t = tokens_model(F.col("prefix"))
    m = models.build(df, tokens_model(F.col("text")), "kneser_ney", 3, 1)
    blocked = spark.createDataFrame([("FLY",)], "term string")
    c = product.compact(m, 100, 1, 100, blocked)
    full = product.sparse(c, cases, "case_id", t, 100).groupBy("case_id").agg(F.sum("p").alias("s"), F.count_if(F.col("word") == "fly").alias("bad")).collect()
    assert all(abs(r.s - 1) < 1e-9 and r.bad == 0 for r in full)
    for k in (1, 3):
        few = {(r.case_id, r.rank): (r.word, round(r.p, 12)) for r in product.best(product.sparse(c, cases, "case_id", t, k), "case_id", k).collect()}
        all_ = {(r.case_id, r.rank): (r.word, round(r.p, 12)) for r in product.best(product.sparse(c, cases, "case_id", t, 100), "case_id", k).collect()}
        assert few == all_
    words = spark.createDataFrame([("swim",), ("float",), ("in",)], "word string")
    d = product.predict_dictionary(c, cases, "case_id", t, words, 0.1, k=50).groupBy("case_id").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in d)
    cached = product.predict_cached(c, spark.createDataFrame([(1, "swim swim water")], "case_id bigint, prefix string"), "case_id", t, share=0.5, common=0)
    assert cached.where("rank = 1").first().word == "swim"


def test_continuations(spark):
    index = spark.createDataFrame([("we houden van", "elkaar", 5), ("we houden van", "ons land", 2), ("lang en", "gelukkig leven", 3), ("lang en", "prachtig", 2)], "context string, continuation string, cnt bigint")
    cases = spark.createDataFrame([(1, "we houden van"), (2, "lang en"), (3, "unknown"), (4, None), (5, "dag we houden van")], "case_id bigint, prefix string")
    got = {}
    for r in product.continuations(index, cases, "case_id", tokens_model(F.col("prefix"))).collect():
        got.setdefault(r.case_id, []).append((r["rank"], r.continuation))
    assert {k: [c for _, c in sorted(v)] for k, v in got.items()} == {1: ["elkaar", "ons land"], 2: ["gelukkig", "prachtig"], 5: ["elkaar", "ons land"]}
    built = product.continuation_index(spark.createDataFrame([("a b c d",), ("a b",), (None,)], "text string"), tokens_model(F.col("text")))
    assert sorted((r.context, r.continuation) for r in built.collect()) == [("a b", "c d"), ("a b c", "d"), ("b c", "d")]


def test_empty_corpus(spark, tables):
    df, cases = tables
    m = models.build(df.limit(0), tokens_model(F.col("text")), "kneser_ney", 3, 1)
    assert models.predict(m, cases, "case_id", tokens_model(F.col("prefix"))).count() == 0


def test_exact_continuation_lengths(spark, tmp_path):
    """Endings of 12, 8, 5, 3 and 2 words, each cut to the prefix's own length, against plain counting."""
    from lexloom.queries.model import exact_continuation

    base = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    texts = [("news", " ".join(base[:16])), ("news", "odd " + " ".join(base[4:12]) + " other"), ("news", "odd " + " ".join(base[4:12]) + " other"), ("blogs", "solo follows"), ("news", "solo never"), ("blogs", " ".join(["x", "y"] * 9)), ("news", None), ("news", "one")]
    prefixes = [" ".join(base[:k]) for k in range(1, 15)] + ["solo", "x", "y x", "unseen", "", "?!", None]
    spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(texts)], "line_id bigint, source string, text string").write.parquet(f"{tmp_path}/training_lines.parquet")
    spark.createDataFrame([(i, "news", p, "z") for i, p in enumerate(prefixes)], "case_id bigint, source string, prefix string, actual string").write.parquet(f"{tmp_path}/development.parquet")
    want = set()
    for i, p in enumerate(prefixes):
        words = "".join(c if c.isalpha() else " " for c in p or "").split()
        levels = sorted({min(c, len(words)) for c in (12, 8, 5, 3, 2)} - {0}, reverse=True)
        for source, n in itertools.product(("blogs", "news"), levels):
            toks = [t.split() for s, t in texts if s == source and t]
            found = Counter(t[k + n] for t in toks for k in range(len(t) - n) if t[k : k + n] == words[-n:])
            if found:
                best = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:3]
                want |= {(i, source, n, r + 1, w, c) for r, (w, c) in enumerate(best)}
                break
    got = {tuple(r) for r in exact_continuation(spark, str(tmp_path)).collect()}
    assert {n for _, _, n, *_ in want} == set(range(1, 13)) and got == want
