import random
from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions.stats import mcnemar, wilson
from lexloom.functions.text import normalize_ascii, tokens_model, tokens_unicode
from lexloom.operators import audit, calibration, corpus, evaluation, lines, ngrams, trie
from lexloom.operators.ordered import adjacent_runs, quantiles, running_sums


def corpus_of(spark, texts, source="blogs"):
    return spark.createDataFrame([(i, source, t) for i, t in enumerate(texts)], "line_id bigint, source string, text string")


def one(df):
    return [tuple(r) for r in df.collect()]


# --- line queries --------------------------------------------------------------------------------


def test_line_queries(spark):
    df = corpus_of(spark, ["A clear model supports a decision.", "Remodel the data", "data data", "DATA!", "my_data", None, ""])
    assert one(lines.word_lines(df, "data")) == [("blogs", 2)]
    assert one(lines.word_lines(df, "data", ignore_case=True)) == [("blogs", 3)]
    assert one(lines.word_ratio(df, "data", "model")) == [("blogs", 2.0)]
    assert one(lines.word_ratio(df, "data", "absent")) == [("blogs", None)]
    assert one(lines.exact_lines(df, "data data")) == [(1,)]
    s = lines.scan(df, ["data"], "DATA!", "MODEL").first()
    assert (s.lines, s.longest, s.with_data, s.exact, s.matching) == (6, 34, 3, 1, 2)
    assert [r.line_id for r in lines.find_lines(df, "data", 1, "line_id").collect()] == [1]
    assert {r.text for r in lines.distinct_matches(df, "DATA").collect()} == {"Remodel the data", "data data", "DATA!", "my_data"}
    assert sorted(r.n for r in lines.preview(df, 2, "line_id").collect()) == [1, 2]
    assert lines.word_lines(df.limit(0), "x").count() == 0
    q = lines.quality(corpus_of(spark, ["see https://x.y now", "@ann hi", " ", "plain"])).first()
    assert (q.lines, q.empty, q.with_url, q.with_mention, q.most_characters) == (4, 1, 1, 1, 19)


def test_regex_marks_in_words_are_literal(spark):
    assert one(lines.word_lines(corpus_of(spark, ["a.b", "axb"]), "a.b")) == [("blogs", 1)]


def test_dialects(spark):
    df = spark.createDataFrame([("You're here; I’m too!",), ("rock''n 'quoted' @me http://x.y &amp; done",), (None,), ("é́cole नमस्ते",)], "text string")
    model = [r[0] for r in df.select(tokens_model(F.col("text"))).collect()]
    assert model[0] == ["you're", "here", "i'm", "too"] and model[1] == ["rock", "n", "quoted", "done"] and model[2] == []
    ascii_ = [r[0] for r in df.select(normalize_ascii(F.col("text"))).collect()]
    assert ascii_[0] == "you're here i m too" and ascii_[1] == "rock''n quoted done" and ascii_[2] == ""
    raw = df.select(normalize_ascii(F.col("text"), entities=False)).collect()[1][0]
    assert raw == "rock''n quoted amp done"
    assert df.select(tokens_unicode(F.col("text"))).collect()[3][0] == ["é́cole", "नमस्ते"]


# --- ordered scans -------------------------------------------------------------------------------


def test_running_sums_against_plain_loop(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aab"), rng.randrange(5), rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, grp string, o int, size bigint")
    got = {r.id: (r.before, r.upto) for r in running_sums(df, "grp", ["o"], "id", "size").collect()}
    want, run = {}, Counter()
    for i, g, o, s in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want[i] = (run[g], run[g] + s)
        run[g] += s
    assert got == want
    assert running_sums(df.limit(0), "grp", ["o"], "id", "size").count() == 0


def test_adjacent_runs(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", f"k{rng.randrange(300)}", None])) for i in range(4000)]
    df = spark.createDataFrame(rows, "id bigint, key string")
    least = {}
    for i, k in rows:
        if k is not None:
            least[k] = min(i, least.get(k, i))
    assert {r.id: r.head for r in adjacent_runs(df, "key", "id").collect()} == {i: least[k] for i, k in rows if k is not None}


# --- sampling and cases --------------------------------------------------------------------------


def test_draws_do_not_depend_on_partitions(spark):
    df = corpus_of(spark, [f"one two three four {i}" for i in range(500)])
    for make in (
        lambda d: corpus.bernoulli(d, "line_id", 0.2, 3).select("line_id"),
        lambda d: corpus.exact_per_group(d, "source", "line_id", 20, 3).select("line_id"),
        lambda d: d.select("line_id", corpus.split(F.col("line_id"), 5)),
        lambda d: corpus.random_cases(d, "line_id", tokens_model(F.col("text")), 5),
        lambda d: corpus.schedule(d, "line_id", 8, 3),
    ):
        assert sorted(one(make(df))) == sorted(one(make(df.repartition(7))))
    assert 60 < corpus.bernoulli(df, "line_id", 0.2, 3).count() < 140
    assert corpus.exact_per_group(df, "source", "line_id", 20, 3).count() == 20


def test_first_wins_and_cases(spark):
    df = spark.createDataFrame([(2, "b", "Same text!"), (1, "b", "same text"), (9, "a", "SAME text"), (3, "a", "..."), (4, "a", None)], "line_id bigint, source string, text string")
    assert one(corpus.first_wins(df, F.array_join(tokens_model(F.col("text")), " "), ["source", "line_id"])) == [("same text", "a", 9)]
    assert sorted(one(corpus.last_word_cases(df, "line_id", tokens_model(F.col("text"))))) == [(1, "same", "text"), (2, "same", "text"), (9, "same", "text")]


def test_packed_blocks(spark):
    df = corpus_of(spark, ["a b c", "d e f g h", "i"])
    assert sorted(one(corpus.packed_blocks(df, "source", "line_id", tokens_model(F.col("text")), 4))) == [("blogs", 0, 4), ("blogs", 1, 4), ("blogs", 2, 1)]


def test_distractors(spark):
    counts = spark.createDataFrame([(f"w{i:03d}", 1000 - i) for i in range(400)], "word string, cnt bigint")
    targets = spark.createDataFrame([("w000",), ("w200",), ("unknown",), ("w200",)], "target string")
    got = corpus.distractors(targets, counts, near=10).collect()
    by = {t: [r for r in got if r.target == t] for t in ("w000", "w200", "unknown")}
    assert all(len(v) == 3 for v in by.values()) and all(abs(r["rank"] - 201) <= 10 and r.word != "w200" for r in by["w200"])
    assert all(r["rank"] >= 390 for r in by["unknown"])


# --- n-grams -------------------------------------------------------------------------------------


def test_grams_both_ways(spark):
    df = corpus_of(spark, ["a b c a b", "b", "", None, "a b"])
    t = tokens_model(F.col("text"))
    for n in (1, 2, 3):
        assert sorted(one(ngrams.grams(df, t, n))) == sorted(one(ngrams.all_grams(df, t, 3)[n - 1]))
    starts = ngrams.start_grams(df, t, 3)
    assert ("<s> <s>", "a", 2) in one(starts[2]) and sum(r[2] for r in one(starts[0])) == 8
    assert ("", "b", 2) in one(ngrams.continuation_counts(starts[1]))
    assert one(ngrams.estimated_discount(spark.createDataFrame([], "cnt bigint"))) == [(0, 0, 0.75)]


# --- evaluation ----------------------------------------------------------------------------------


def test_metrics_and_intervals(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 0), ("b", 3)], "source string, rank int")
    got = {r.source: r for r in evaluation.metrics(rows).collect()}
    assert got["(all)"].cases == 4 and got["(all)"].top3 == 0.75 and got["a"].mrr == 0.75 and got[""].top1 == 0
    low, high = wilson(F.col("h"), F.col("n"))
    w = spark.createDataFrame([(2, 2), (0, 0)], "h int, n int").select(low.alias("l"), high.alias("h")).collect()
    assert abs(w[0].l - 0.3424) < 1e-3 and w[0].h == 1.0 and w[1].l is None and w[1].h is None


@pytest.mark.parametrize(("wins", "losses", "p"), [(6, 0, 0.03125), (0, 0, 1.0), (3, 3, 1.0), (5, 1, 0.21875), (3000, 2800, None)])
def test_mcnemar(spark, wins, losses, p):
    got = spark.range(1).select(mcnemar(F.lit(wins).cast("bigint"), F.lit(losses).cast("bigint")).alias("p")).first().p
    assert abs(got - p) < 1e-9 if p is not None else 0.005 < got < 0.05


def test_bootstrap_weighs_sources_alike(spark):
    rows = [("blogs", 0, 1)] * 2 + [("news", 1, 1)] * 3 + [("twitter", 1, 0)] * 5
    pairs = spark.createDataFrame(rows, "source string, rank_a int, rank_b int")
    equal, pooled = evaluation.bootstrap(pairs, 500).first(), evaluation.bootstrap(pairs, 500, equal=False).first()
    assert equal.estimate == 0 and equal.low == 0 and equal.high == 0 and abs(pooled.estimate + 0.3) < 1e-12
    assert [r.promoted for r in evaluation.gate(evaluation.bootstrap(pairs, 50)).collect()] == [False]


def test_selection_and_taxonomy(spark):
    rows = [("m1", 1, 1, 5.0), ("m1", 1, 0, 6.0), ("m2", 1, 2, 1.0), ("m2", 1, 0, 1.0)]
    d = spark.createDataFrame(rows, "arm string, seed int, rank int, milliseconds double")
    assert evaluation.select_arm(d, ["arm"]).first().arm == "m1"
    assert evaluation.within_of_leader(spark.createDataFrame([(0.3, 9), (0.298, 2), (0.2, 1)], "score double, size int"), "score", 0.005, "size").first().size == 2
    t = evaluation.taxonomy(spark.createDataFrame([("a", 1, True), ("a", 0, True), ("a", 0, False)], "source string, rank int, listed boolean")).first()
    assert (t.top3, t.listed_below, t.absent, t.conditional) == (1, 1, 1, 0.5)


# --- rules and calibration -----------------------------------------------------------------------


def test_rules(spark):
    rows = [("c", "a", -1.0, -2.0, -3.0, 1, 1, -9.0, False), ("c", "long", -1.1, -0.1, -1.2, 1, 4, -2.0, True), ("c", "word", -2.0, -0.1, -2.1, 2, 4, -5.0, False)]
    f = spark.createDataFrame(rows, "case_id string, word string, token_logp double, boundary_logp double, original_score double, tokens int, characters int, alternate_score double, alternate_distinct boolean")
    top = {(r.rule): r.word for r in calibration.ranked(calibration.rule_scores(f), ["case_id", "rule"]).where("rank = 1").collect()}
    assert top["baseline"] == "long" and top["no_boundary"] == "a" and top["char_sqrt"] == "long" and set(top) == set(calibration.RULES)
    r = calibration.ranked(f.select("case_id", "word", F.lit(0.0).alias("score")), ["case_id"]).orderBy("rank").collect()
    assert [x.word for x in r] == ["a", "long", "word"] and abs(r[0].share - 1 / 3) < 1e-12 and r[0].gap == 0


def test_calibration(spark):
    rows = spark.createDataFrame([(0.01 + 0.98 * i / 199, int(i % 4 == 0)) for i in range(200)], "p double, y int")
    fit = calibration.fit_sigmoid(rows, "p", "y")
    assert fit["cases"] == 200 and fit["positives"] == 50
    before = calibration.confidence(rows, "p", "y").first()
    after = calibration.confidence(rows.withColumn("q", calibrated_column(fit)), "q", "y").first()
    assert after.brier < before.brier
    with pytest.raises(ValueError):
        calibration.fit_sigmoid(rows.where("y = 0"), "p", "y")
    ends = spark.createDataFrame([(0.0, 0), (1.0, 1), (None, 1), (float("nan"), 0)], "p double, y int")
    bins = calibration.reliability(ends, "p", "y").orderBy("bin").collect()
    assert len(bins) == 10 and bins[0].cases == 1 and bins[9].cases == 1 and bins[4].mean_p is None
    assert calibration.confidence(ends, "p", "y").first().brier == 0
    s = {r.threshold: r for r in calibration.selective(ends, "p", "y").collect()}
    assert s[0.0].answered == 2 and s[0.95].accuracy == 1.0 and s[0.95].coverage == 0.5


def calibrated_column(fit):
    return calibration.calibrated(F.col("p"), fit)


def test_diagnosis(spark):
    scores = spark.createDataFrame([(c, w, s) for c in (1, 2, 3) for w, s in (("a", 4.0), ("b", 3.0), ("c", 2.0), ("d", 1.0))], "case_id bigint, word string, score double")
    targets = spark.createDataFrame([(1, "d", 0.0), (2, "new", 3.5), (3, "zzz", 0.5)], "case_id bigint, word string, score double")
    got = {r.case_id: r for r in calibration.diagnose(scores, targets, "case_id").collect()}
    assert got[1].category == "covered_below_top3" and got[1].original_rank == 4 and got[1].margin == -1
    assert got[2].category == "missing_reaches_top3" and got[2].third_word == "c" and got[2].margin == 1.5
    assert got[3].category == "missing_still_below_top3"


# --- audits and tries ----------------------------------------------------------------------------


def test_audits(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", None)], "part string, h string")
    assert one(audit.duplicate_keys(df, ["part", "h"])) == [(5, 4, 1)]
    assert one(audit.overlaps(df, "part", "h")) == [("a", "b", 1)]
    assert one(audit.difference(df, df.repartition(3))) == [(0, 0)]
    assert one(audit.difference(df, df.where("part <> 'a'"))) == [(2, 0)]
    reserved = spark.createDataFrame([("X",), (None,)], "line_hash string")
    assert sorted(r.part for r in audit.excluded(df, reserved, F.col("h")).collect()) == ["b", "c"]
    s = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.5), (1, 2, None), (2, 1, float("nan")), (2, 2, 1.5)], "c int, w int, p double")
    assert one(audit.score_checks(s, ["c", "w"], "p")) == [(5, 1, 1, 1, 1)]
    assert audit.integral(spark.createDataFrame([(0.5, 4), (0.3, 4)], "r double, n int"), "r", "n").count() == 1


def test_trie(spark):
    words = spark.createDataFrame([("the", ["a", "b"]), ("there", ["a", "b", "c"]), ("one", ["z"]), ("deep", list("abcdefg"))], "word string, token_path array<string>")
    assert one(trie.statistics(words)) == [(4, 1, 1, 2)]
    nodes = trie.trie(words)
    edges = spark.createDataFrame([(1, ["a"], -0.1), (1, ["a", "b"], -0.2), (1, ["a", "b", "c"], -0.4)], "case_id int, path array<string>, logp double")
    got = [(r.word, round(r.score, 6), r["rank"]) for r in trie.beam_search(nodes, edges, 4).orderBy("rank").collect()]
    assert got == [("the", -0.3, 1), ("there", -0.7, 2)]
    with pytest.raises(Exception, match="share a token path"):
        trie.trie(spark.createDataFrame([("x", ["a", "b"]), ("y", ["a", "b"])], "word string, token_path array<string>")).collect()


def test_trie_beam_of_every_case(spark, tmp_path):
    """Every case with scores has its words, scored by shares of its own scores."""
    import math

    from lexloom.queries.evaluate import trie_beam

    vocab = ["reader", "reads", "ready", "riding", "in"]
    rows = {7: {"reader": 0.2, "reads": 0.1, "riding": 0.1}, 8: {"ready": 0.5}, 9: {"in": 0.4}, 10: {"reads": 0.0, "ready": 0.3, "riding": 0.3}}
    spark.createDataFrame(list(enumerate(vocab)), "word_id int, word string").write.parquet(f"{tmp_path}/vocabulary.parquet")
    spark.createDataFrame([(c, vocab.index(w), p) for c, ws in rows.items() for w, p in ws.items()] + [(11, 0, None)], "case_id bigint, word_id int, cpu_probability double").write.parquet(f"{tmp_path}/candidate_scores.parquet")
    want = {}
    for c, ws in rows.items():
        ws = {w: p for w, p in ws.items() if p > 0 and len(w) > 2}
        for w in ws:
            cuts = [w[:k] for k in range(0, len(w), 2)] + [w]
            mass = [sum(p for x, p in ws.items() if x.startswith(k) and len(x) >= len(k)) for k in cuts]
            below = [sum(p for x, p in ws.items() if x.startswith(k) and len(x) > len(k)) for k in cuts]
            want[c, w] = round(sum(math.log(m / b) for m, b in zip(mass[1:], below[:-1], strict=True)), 6)
    got = {(r.case_id, r.word): r.score for r in trie_beam(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want)


def test_quantiles_without_buffers(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.1, 2.5, 7.25, -3.0, rng.random()])) for _ in range(500)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.q0, r.q1, r.q2) for r in quantiles(df, "g", "v", [0.0, 0.5, 0.95]).collect()}
    for g in ("a", "b", None, "one"):
        own = [v for k, v in rows if k == g and v is not None]
        assert np.allclose(got[g], np.quantile(own, [0, 0.5, 0.95]))
    assert "none" not in got


def test_mcnemar_of_large_counts(spark):
    pairs = [(0, 0), (1, 0), (3, 4), (10, 30), (200, 260), (1000, 1000), (0, 400)]
    big = [(10**9, 10**9 + 100_000), (10**9, 10**9)]
    got = [r[0] for r in spark.createDataFrame(pairs + big, "a bigint, b bigint").select("a", "b", mcnemar(F.col("a"), F.col("b")).alias("p")).select("p").collect()]
    for (a, b), p in zip(pairs, got, strict=False):
        want = min(1.0, float(2 * sum(Fraction(comb(a + b, i), 2 ** (a + b)) for i in range(min(a, b) + 1)))) if a + b else 1.0
        assert abs(p - want) <= 1e-9 * max(want, 1e-300) or abs(p - want) < 1e-12
    assert 0.02 < got[-2] < 0.03 and got[-1] == 1.0


def test_words_with_escapes(spark):
    df = spark.createDataFrame([("blogs", "a \\E b"), ("blogs", "a.c"), ("blogs", "abc")], "source string, text string")
    assert df.where(lines.has_word(F.col("text"), "a.c")).count() == 1
    assert df.where(F.col("text").rlike(lines.word_pattern("\\E"))).count() == 1


def test_capped_draws(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(6000)], "id bigint, source string")
    got = corpus.capped(df, "source", "id", 0.5, 700, 3).collect()
    a, none = [r.id for r in got if r.source], [r.id for r in got if r.source is None]
    assert len(a) == len(none) == 700 and max(a) < 2600
    assert len(corpus.capped(df, "source", "id", 0.1, 10**6, 3).collect()) in range(500, 700)
