"""Evaluation: metrics, intervals, paired comparisons, ranking rules, calibration, audits, tries and live phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions.text import source_name
from lexloom.operators import audit, calibration, evaluation, trie
from lexloom.operators.ordered import quantiles
from lexloom.queries.common import CASES, SCORES, SOURCE, bucket, scores
from lexloom.queries.model import _probability
from lexloom.session import cut, table
from lexloom.streaming import live


def _details(s, d):
    """Recorded ranks of all cases with a target: (case_id, source, split, rank, listed, words)."""
    dev = table(s, d, "development").where("actual is not null")
    return dev.select("case_id", source_name(F.col("source")).alias("source"), "split", F.col("ngram_rank").alias("rank"), F.coalesce(F.array_contains(F.from_json("ngram_candidates_json", "array<string>"), F.col("actual")), F.lit(False)).alias("listed"), F.size(F.split("prefix", r"\s+")).alias("words"))


def _ranked(s, d):
    """The table's own candidate scores as a second arm: (case_id, word, score, rank, share, gap)."""
    return calibration.ranked(scores(s, d), ["case_id"])


def _arm(s, d):
    dev = table(s, d, "development").where("actual is not null").select("case_id", source_name(F.col("source")).alias("source"), "actual")
    top = _ranked(s, d).select("case_id", "word", "rank")
    scored = scores(s, d).select("case_id").distinct()
    return evaluation.ranks(dev.join(scored, "case_id", "left_semi"), top, "case_id", "actual")


def _pairs(s, d):
    return evaluation.paired(_details(s, d), _arm(s, d), ["case_id", "source"])


def eval_rollup(s, d):
    return evaluation.metrics(_details(s, d))


def mrr(s, d):
    return evaluation.metrics(_arm(s, d)).select("source", "cases", "mrr")


def wilson_by_source(s, d):
    return evaluation.intervals(_details(s, d))


def grouped_metrics(s, d):
    """Overlapping groups: all, source, and the prefix's length."""
    size = F.when(F.col("words") <= 4, "1-4").when(F.col("words") <= 12, "5-12").otherwise("13+")
    groups = F.array(F.lit("all"), F.concat(F.lit("source "), "source"), F.concat(F.lit("words "), size))
    return evaluation.grouped(_details(s, d), groups)


def paired_transitions(s, d):
    return evaluation.transitions(_pairs(s, d))


def mcnemar(s, d):
    return evaluation.gains(_pairs(s, d), ["source"])


def bootstrap_ci(s, d):
    return evaluation.bootstrap(_pairs(s, d))


def bootstrap_pooled(s, d):
    return evaluation.bootstrap(_pairs(s, d), 2000, 1, equal=False)


def error_taxonomy(s, d):
    return evaluation.taxonomy(_details(s, d))


def error_by_length(s, d):
    return evaluation.taxonomy(_details(s, d).withColumn("length", F.when(F.col("words") <= 3, "1-3").when(F.col("words") <= 9, "4-9").otherwise("10+")), "length")


def perplexity(s, d):
    """Perplexity of the recorded targets under the Kneser-Ney trigram model."""
    from lexloom.plans import models
    from lexloom.queries.common import cases
    from lexloom.queries.model import _kn, _prefix

    c = cases(s, d)
    p = models.word_probability(_kn(s, d), c, "case_id", "actual", _prefix())
    return evaluation.perplexity(c.select("case_id", "source").join(p, "case_id"))


def _features(s, d):
    """Candidate features derived from the scores: log-probability, a boundary term by length, lengths and a second path."""
    w = F.length("word")
    logp = F.log(F.greatest("score", F.lit(1e-9)))
    rows = scores(s, d).withColumn("token_logp", logp).withColumn("boundary_logp", -w / 10.0)
    return rows.select("case_id", "word", "token_logp", "boundary_logp", (F.col("token_logp") + F.col("boundary_logp")).alias("original_score"), F.ceil(w / 4).alias("tokens"), w.alias("characters"), (F.col("token_logp") - 1).alias("alternate_score"), (w % 2 == 0).alias("alternate_distinct"))


def ranking_variants(s, d):
    top = calibration.ranked(calibration.rule_scores(_features(s, d)), ["case_id", "rule"])
    return top.select("case_id", "rule", "word", "rank", F.round("score", 6).alias("score"))


def softmax_share(s, d):
    return _ranked(s, d).where("rank = 1").select("case_id", "word", F.round("share", 6).alias("share"), F.round("gap", 6).alias("gap"))


def _confidences(s, d):
    """(case_id, p, y): the best candidate's share and whether it is the target."""
    dev = table(s, d, "development").where("actual is not null").select("case_id", "actual")
    return _ranked(s, d).where("rank = 1").join(dev, "case_id").select("case_id", F.col("share").alias("p"), (F.col("word") == F.col("actual")).cast("int").alias("y"))


def calibration_fit(s, d):
    rows = cut(_confidences(s, d), "confidences")
    f = calibration.fit_sigmoid(rows, "p", "y")
    return s.createDataFrame([(round(f["intercept"], 6), round(f["slope"], 6), f["cases"], f["positives"])], "intercept double, slope double, cases bigint, positives bigint")


def calibration_apply(s, d):
    rows = cut(_confidences(s, d), "confidences")
    f = calibration.fit_sigmoid(rows, "p", "y")
    return calibration.confidence(rows.withColumn("q", calibration.calibrated(F.col("p"), f)), "q", "y")


def reliability_bins(s, d):
    return calibration.reliability(_confidences(s, d), "p", "y")


def brier_ece(s, d):
    return calibration.confidence(_confidences(s, d), "p", "y")


def selective_accuracy(s, d):
    return calibration.selective(_confidences(s, d), "p", "y")


def target_diagnosis(s, d):
    """Targets put among their candidates; absent ones get the middle of the probability scale."""
    targets = table(s, d, "development").where("actual is not null").select("case_id", F.col("actual").alias("word"), F.lit(0.05).alias("score"))
    return calibration.diagnose(scores(s, d), targets, "case_id")


def third_other_margin(s, d):
    """The lead of the third over the fourth candidate."""
    top = calibration.ranked(scores(s, d), ["case_id"], 4)
    return top.groupBy("case_id").agg(F.round(F.max(F.when(F.col("rank") == 3, F.col("score"))) - F.max(F.when(F.col("rank") == 4, F.col("score"))), 6).alias("margin")).where("margin is not null")


def target_rank(s, d):
    """The target's full rank in its case's score list."""
    r = calibration.ranked(scores(s, d), ["case_id"], 1 << 30)
    dev = table(s, d, "development").where("actual is not null").select("case_id", F.col("actual").alias("word"))
    return r.join(dev, ["case_id", "word"]).select("case_id", "rank")


def ordered_union(s, d):
    """Candidates and options of each case in order of first appearance."""
    dev = table(s, d, "development").select("case_id", F.array_distinct(F.concat(F.from_json("ngram_candidates_json", "array<string>"), F.from_json("options_json", "array<string>"))).alias("words"))
    return dev.where("words is not null").select("case_id", F.array_join("words", " ").alias("words"))


def score_audit(s, d):
    return audit.score_checks(table(s, d, "candidate_scores"), ["case_id", "word_id"], "cpu_probability")


def rank_audit(s, d):
    dev = table(s, d, "development").where("actual is not null").select("ngram_rank", F.from_json("ngram_candidates_json", "array<string>").alias("words"), "actual", "case_id").where("words is not null")
    return audit.rank_check(dev, "case_id", "ngram_rank", "words", "actual")


def option_audit(s, d):
    return audit.shape_check(table(s, d, "development").select(F.from_json("options_json", "array<string>").alias("options"), "ngram_choice", "actual"), "options", "ngram_choice", "actual")


def candidate_reach(s, d):
    dev = table(s, d, "development").where("actual is not null").select("case_id", "actual")
    listed = table(s, d, "development").select("case_id", F.explode(F.array_distinct(F.from_json("ngram_candidates_json", "array<string>"))).alias("word"))
    return audit.reach(dev, "actual", {"candidates": listed, "scores": scores(s, d)}, "case_id")


def split_reconstruction(s, d):
    """A split made twice, in another partitioning, must not differ; the sizes of its parts go with it."""
    from lexloom.operators.corpus import split

    rows = table(s, d, "training_lines").select("line_id", split(F.col("line_id"), 20261101).alias("split"))
    sizes = rows.groupBy("split").agg(F.count("*").alias("lines"), F.sum("line_id").alias("ids"))
    again = rows.repartition(5).groupBy("split").agg(F.count("*").alias("lines_again"), F.sum("line_id").alias("ids_again"))
    return sizes.join(again, "split", "full").select("split", "lines", "ids", "lines_again", "ids_again")


def latency_summary(s, d):
    return evaluation.latency(table(s, d, "timing"))


def arm_selection(s, d):
    rows = _timed(s, d)
    return evaluation.select_arm(rows, ["method_name"]).select("method_name", "top3_hits", "top1_hits", F.round("median_ms", 6).alias("median_ms"), "seed")


def _timed(s, d):
    ok = table(s, d, "timing").where("milliseconds is not null and not isnan(milliseconds) and milliseconds > 0 and method_name is not null")
    return ok.join(_details(s, d).select("case_id", "rank"), "case_id").select("method_name", F.col("round_no").alias("seed"), "rank", "milliseconds")


def seed_summary(s, d):
    return evaluation.by_seed(_timed(s, d), ["method_name"])


def metric_unpivot(s, d):
    return audit.unpivoted(evaluation.metrics(_details(s, d)).select("source", "top1", "top2", "top3", "mrr"), ["source"], ["top1", "top2", "top3", "mrr"])


def metric_pivot(s, d):
    rows = _details(s, d).where("source is not null").groupBy("split", "source").agg(F.round(F.avg((F.col("rank") > 0).cast("double")), 6).alias("top3"))
    return audit.pivoted(rows, "split", "source", ["blogs", "news", "twitter"], "top3")


def trie_beam(s, d):
    """Beam search for every case with scores, over the vocabulary's words in pieces of two letters; a step onto a node is
    scored by the node's share among its siblings, of the case's scores of the words below. Scores of 0 open no path; a
    word on the way to a scored one is found too."""
    v = table(s, d, "vocabulary")
    words = v.select("word", F.expr("transform(sequence(0, (length(word) - 1) div 2), i -> substring(word, i * 2 + 1, 2))").alias("token_path"))
    nodes = cut(trie.trie(words), "nodes")
    paths = words.where(F.size("token_path").between(2, 6)).select("word", F.explode(F.expr("transform(sequence(1, size(token_path)), k -> slice(token_path, 1, k))")).alias("path"))
    below = scores(s, d).where("case_id is not null and score > 0").join(paths, "word").groupBy("case_id", "path").agg(F.sum("score").alias("mass"))
    share = F.expr("mass / sum(mass) over (partition by case_id, slice(path, 1, size(path) - 1))")
    edges = cut(below.withColumn("logp", F.log(share)).select("case_id", "path", "logp"), "edges")
    out = trie.beam_search(nodes, edges, 16)
    return out.select("case_id", "word", F.round("score", 6).alias("score"), "rank")


def trie_statistics(s, d):
    v = table(s, d, "vocabulary")
    return trie.statistics(v.select("word", F.expr("transform(sequence(0, (length(word) - 1) div 2), i -> substring(word, i * 2 + 1, 2))").alias("token_path")))


def session_debounce(s, d):
    out = live.bursts(table(s, d, "events"), "user_id", "ts", "event_type")
    return out.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("started"), "events", F.col("phrase").alias("last_event"))


def latest_request(s, d):
    return live.latest(table(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


def grid_audit(s, d):
    return audit.grid(table(s, d, "timing"), ["round_no", "method_name"])


def set_audit(s, d):
    """Cases with scores against cases with timings."""
    return audit.set_relation(table(s, d, "candidate_scores"), table(s, d, "timing"), "case_id")


def arm_difference(s, d):
    """The scores of repeated rows against each other: the greatest difference of the two kept ones."""
    ok = table(s, d, "candidate_scores").where("cpu_probability is not null and not isnan(cpu_probability)")
    both = ok.groupBy("case_id", "word_id")
    return audit.numeric_difference(both.agg(F.max("cpu_probability").alias("p")), both.agg(F.min("cpu_probability").alias("p")), ["case_id", "word_id"], "p")


def paired_groups(s, d):
    """Gains and losses of overlapping groups."""
    size = F.when(F.col("words") <= 4, "1-4").when(F.col("words") <= 12, "5-12").otherwise("13+")
    pairs = _pairs(s, d).join(_details(s, d).select("case_id", "words"), "case_id")
    rows = pairs.withColumn("grp", F.explode(F.array(F.lit("all"), F.concat(F.lit("source "), "source"), F.concat(F.lit("words "), size))))
    return evaluation.gains(rows, ["grp"])


def gated_selection(s, d):
    """Of the methods within half a point of the best top-3 share, the fastest."""
    timed = _timed(s, d)
    shares = timed.groupBy("method_name").agg(F.avg((F.col("rank") > 0).cast("double")).alias("top3"))
    rows = shares.join(quantiles(timed, "method_name", "milliseconds", [0.5]).withColumnRenamed("q0", "median_ms"), "method_name")
    return evaluation.within_of_leader(rows, "top3", 0.005, "median_ms").select("method_name", F.round("top3", 6).alias("top3"), F.round("median_ms", 6).alias("median_ms"))


def wide_export(s, d):
    """Both arms side by side, one row a case."""
    return _pairs(s, d)


def line_length_deciles(s, d):
    """Deciles of line length by source."""
    t = table(s, d, "training_lines").where("text is not null").select(source_name(F.col("source")).alias("source"), F.length("text").alias("n"))
    p = t.groupBy("source").agg(F.expr("percentile(n, array(0.1, 0.5, 0.9))").alias("p"))
    return p.select("source", F.posexplode("p").alias("i", "value")).select("source", "i", F.round("value", 6).alias("value"))


def disjoint_parts(s, d):
    """Development, reserved and training hashes held against each other."""
    rows = table(s, d, "development").select(F.lit("development").alias("part"), F.lower("line_hash").alias("h"))
    rows = rows.unionAll(table(s, d, "reserved_hashes").select(F.lit("reserved"), F.lower("line_hash"))).unionAll(table(s, d, "training_lines").select(F.lit("training"), F.lower("line_hash")))
    return audit.overlaps(rows, "part", "h")


_ALL = [
    eval_rollup, mrr, wilson_by_source, grouped_metrics, paired_transitions, mcnemar, bootstrap_ci, bootstrap_pooled, error_taxonomy, error_by_length, perplexity, ranking_variants, softmax_share, calibration_fit, calibration_apply,
    reliability_bins, brier_ece, selective_accuracy, target_diagnosis, third_other_margin, target_rank, ordered_union, score_audit, rank_audit, option_audit, candidate_reach, split_reconstruction, latency_summary, arm_selection, seed_summary,
    metric_unpivot, metric_pivot, trie_beam, trie_statistics, session_debounce, latest_request, grid_audit, set_audit, arm_difference, paired_groups, gated_selection, wide_export, line_length_deciles, disjoint_parts,
]
QUERIES = {f.__name__: f for f in _ALL}


# --- SQL ---------------------------------------------------------------------------------------

def _list(column: str) -> str:
    return f"(case when json_valid({column}) and json_type({column}) = 'ARRAY' then from_json({column}, '[\"VARCHAR\"]') end)"


_DETAILS = f"(select case_id, {SOURCE} as source, split, ngram_rank as rank, coalesce(list_contains({_list('ngram_candidates_json')}, actual), false) as listed, len(regexp_split_to_array(prefix, '\\s+')) as words from development where actual is not null)"
_RANKED = f"(select *, row_number() over (partition by case_id order by score desc, word) as rank, max(score) over (partition by case_id) as top, sum(exp(score)) over (partition by case_id) as den from {SCORES})"
_ARM = f"(select case_id, source, coalesce(rank, 0) as rank from (select case_id, {SOURCE} as source, actual from development where actual is not null and case_id in (select case_id from {SCORES})) left join (select case_id, word as actual, rank from {_RANKED} where rank <= 3) using (case_id, actual))"
_PAIRS = f"(select a.case_id, a.source, a.rank as rank_a, b.rank as rank_b from {_DETAILS} a join {_ARM} b on a.case_id = b.case_id and a.source is not distinct from b.source)"
_METRICS = "count(*) as cases, round(avg((rank = 1)::double), 6) as top1, round(avg((rank between 1 and 2)::double), 6) as top2, round(avg((rank between 1 and 3)::double), 6) as top3, round(avg(case when rank > 0 then 1 / rank else 0 end), 6) as mrr"


def _rollup(rows: str) -> str:
    return f"select coalesce(source, '') as source, {_METRICS} from {rows} group by 1 union all select '(all)', {_METRICS} from {rows}"


_OUT = "case when {0} = 1 then 'top1' when {0} > 0 then 'top3' else 'missed' end"
_CONF = f"(select case_id, exp(top) / den as p, (word = actual)::int as y from {_RANKED} join development using (case_id) where rank = 1 and actual is not null)"
_Q = "greatest(1e-12, least(1 - 1e-12, p))"
_EVENT = "(select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as g from (select *, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 10 minute then 1 else 0 end as fresh from events))"
_FEATURES = f"(select case_id, word, ln(greatest(score, 1e-9)) as t, -length(word) / 10.0 as b, ceil(length(word) / 4) as n, length(word) as c from {SCORES})"
_RULES = [("baseline", "t + b"), ("no_boundary", "t"), ("half_boundary", "t + 0.5 * b"), ("token_mean", "t / n + b"), ("token_mean_no_boundary", "t / n"), ("char_sqrt", "t / sqrt(c) + b"), ("two_paths", "case when c % 2 = 0 then greatest(t + b, t - 1) + ln(1 + exp(-abs(t + b - (t - 1)))) else t + b end")]
_TIMED = f"(select method_name, round_no as seed, rank, milliseconds from timing join {_DETAILS} using (case_id) where milliseconds is not null and not isnan(milliseconds) and milliseconds > 0 and method_name is not null)"


def _taxonomy(key: str) -> str:
    return f"select coalesce({key}, '') as {{0}}, count(*) as cases, count(*) filter (rank > 0) as top3, count(*) filter (rank = 0 and listed) as listed_below, count(*) filter (rank = 0 and not listed) as absent, round(count(*) filter (rank > 0) / nullif(count(*) filter (rank > 0) + count(*) filter (rank = 0 and listed), 0), 6) as conditional from {_DETAILS} group by 1"


# the exact tail: C(n, i) / 2^n summed on a log scale
_MCNEMAR = f"""with g as (select source, count(*) as cases, count(*) filter (rank_a = 0 and rank_b > 0) as gains, count(*) filter (rank_a > 0 and rank_b = 0) as losses, count(*) filter (rank_a > 0 and rank_b > 0) as "both", count(*) filter (rank_a = 0 and rank_b = 0) as neither from {_PAIRS} group by 1)
select *, round(case when gains + losses = 0 then 1 else least(1, 2 * list_sum(list_transform(range(0, least(gains, losses) + 1), lambda i: exp(lgamma(gains + losses + 1) - lgamma(i + 1) - lgamma(gains + losses - i + 1) - (gains + losses) * ln(2))))) end, 9) as p_value from g"""
_DIAGNOSIS = f"""with t as (select case_id, actual as target from development where actual is not null), s as (select x.*, target from {SCORES} x join t using (case_id)), o as (select *, row_number() over (partition by case_id order by score desc, word) as r from s where word <> target),
third as (select case_id, word as third_word, score as third_score from o where r = 3), m as (select case_id, score as own from s where word = target),
b as (select t.case_id, target, third_word, third_score, own is not null as present, coalesce(own, 0.05) as value from t join third using (case_id) left join m using (case_id)),
k as (select b.*, 1 + (select count(*) from o where o.case_id = b.case_id and (o.score > b.value or (o.score = b.value and o.word < b.target))) as rank from b)
select case_id, case when present then rank else 0 end as original_rank, case when present and rank <= 3 then 'already_top3' when present then 'covered_below_top3' when rank <= 3 then 'missing_reaches_top3' else 'missing_still_below_top3' end as category, third_word, round(value - third_score, 6) as margin from k"""
ORACLE = {
    "perplexity": f"select coalesce(source, '') as source, count(*) as cases, round(exp(-avg(ln(greatest(p, 2.2250738585072014e-308)))), 4) as perplexity, round(100 * avg((not known)::double), 6) as oov_percent from {CASES} join ({_probability(CASES, 'actual', '{0}')}) using (case_id) group by 1",
    "eval_rollup": _rollup(_DETAILS),
    "mrr": f"select source, cases, mrr from ({_rollup(_ARM)})",
    "wilson_by_source": f"with g as (select coalesce(source, '') as source, count(*) as cases, count(*) filter (rank > 0) as hits from {_DETAILS} group by 1), c as (select *, hits / cases as p, 1.959963984540054 as z from g) select source, cases, hits, round(greatest(0, (p + z * z / (2 * cases) - z * sqrt(p * (1 - p) / cases + z * z / (4 * cases * cases))) / (1 + z * z / cases)), 6) as low, round(least(1, (p + z * z / (2 * cases) + z * sqrt(p * (1 - p) / cases + z * z / (4 * cases * cases))) / (1 + z * z / cases)), 6) as high from c",
    "grouped_metrics": f"with g as (select *, unnest(['all', 'source ' || source, 'words ' || case when words <= 4 then '1-4' when words <= 12 then '5-12' else '13+' end]) as grp from {_DETAILS}) select grp, {_METRICS} from g group by 1",
    "paired_transitions": f"select {_OUT.format('rank_a')} as \"from\", {_OUT.format('rank_b')} as \"to\", count(*) as cases from {_PAIRS} group by 1, 2",
    "mcnemar": _MCNEMAR,
    "error_taxonomy": _taxonomy("source").format("source"),
    "error_by_length": _taxonomy("case when words <= 3 then '1-3' when words <= 9 then '4-9' else '10+' end").format("length"),
    "ranking_variants": f"with f as {_FEATURES}, v as ({' union all '.join(f"select case_id, word, '{r}' as rule, {e} as score from f" for r, e in _RULES)}) select case_id, rule, word, rank, round(score, 6) as score from (select *, row_number() over (partition by case_id, rule order by score desc, word) as rank from v) where rank <= 3",
    "softmax_share": f"select case_id, word, round(exp(top) / den, 6) as share, round(top - (select max(score) from {_RANKED} b where b.case_id = a.case_id and b.rank = 2), 6) as gap from {_RANKED} a where rank = 1",
    "reliability_bins": f"with b as (select least(floor(p * 10), 9)::int + 1 as bin, count(*) as cases, round(avg(p), 6) as mean_p, round(avg(y), 6) as observed from {_CONF} group by 1) select i::int as bin, coalesce(cases, 0) as cases, mean_p, observed from (select unnest(range(1, 11)) as i) left join b on b.bin = i",
    "brier_ece": f"with b as (select least(floor(p * 10), 9) as bin, count(*) as n, sum(p) as sp, sum(y) as sy, sum(({_Q} - y) * ({_Q} - y)) as se, sum(-(y * ln({_Q}) + (1 - y) * ln(1 - {_Q}))) as ll from {_CONF} group by 1) select sum(n)::bigint as cases, round(sum(se) / sum(n), 6) as brier, round(sum(ll) / sum(n), 6) as log_loss, round(sum(abs(sp - sy)) / sum(n), 6) as ece, round(sum(sp) / sum(n), 6) as mean_p, round(sum(sy) / sum(n), 6) as observed from b",
    "selective_accuracy": f"with c as {_CONF} select threshold, count(p) as answered, coalesce(sum(y), 0)::bigint as correct, round(sum(y) / nullif(count(p), 0), 6) as accuracy, round(count(p) / (select count(*) from c), 6) as coverage from (select unnest([0.0::double, 0.5, 0.7, 0.85, 0.95]) as threshold) left join c on p >= threshold group by 1",
    "target_diagnosis": _DIAGNOSIS,
    "third_other_margin": f"select case_id, round(max(score) filter (rank = 3) - max(score) filter (rank = 4), 6) as margin from {_RANKED} group by 1 having count(*) filter (rank = 4) > 0",
    "target_rank": f"select case_id, rank from {_RANKED} join development using (case_id) where word = actual",
    "ordered_union": f"with w as (select case_id, list_concat({_list('ngram_candidates_json')}, {_list('options_json')}) as w from development where {_list('ngram_candidates_json')} is not null and {_list('options_json')} is not null), u as (select case_id, x, min(i) as i from (select case_id, unnest(w) as x, unnest(range(len(w))) as i from w) where x is not null group by 1, 2), a as (select case_id, string_agg(x, ' ' order by i) as words from u group by 1) select case_id, coalesce(words, '') as words from w left join a using (case_id)",
    "score_audit": "with p as (select case_id, word_id, count(*) as n, count(*) filter (cpu_probability is null) as a, count(*) filter (isnan(cpu_probability) or isinf(cpu_probability)) as b, count(*) filter (cpu_probability > 1.000001 and not isnan(cpu_probability)) as c from candidate_scores group by 1, 2) select sum(n)::bigint as rows, sum(a)::bigint as nulls, sum(b)::bigint as not_finite, sum(c)::bigint as above_one, count(*) filter (n > 1) as repeated from p",
    "rank_audit": f"select ngram_rank as recorded, coalesce(list_position({_list('ngram_candidates_json')}[1:3], actual), 0)::int as recomputed, count(*) as cases from development where actual is not null and {_list('ngram_candidates_json')} is not null group by 1, 2",
    "option_audit": f"with o as (select {_list('options_json')} as o, ngram_choice, actual from development) select count(*) as cases, count(*) filter (o is null or len(o) <> 4) as broken, count(*) filter (o is not null and not coalesce(list_contains(o, actual), false)) as no_target, count(*) filter (o is not null and len(list_distinct(o)) < len(o)) as repeated, count(*) filter (o is not null and not coalesce(list_contains(o, ngram_choice), false)) as choice_outside from o",
    "candidate_reach": f"with c as (select case_id, actual from development where actual is not null) select 'candidates' as generator, (select count(*) from c)::int as cases, (select count(*) from development where actual is not null and list_contains({_list('ngram_candidates_json')}, actual)) as covered union all select 'scores', (select count(*) from c)::int, (select count(*) from c where (case_id, actual) in (select case_id, word from {SCORES}))",
    "split_reconstruction": f"select case when b < 80 then 'train' when b < 90 then 'validation' else 'test' end as split, count(*) as lines, sum(line_id)::bigint as ids, count(*) as lines_again, sum(line_id)::bigint as ids_again from (select line_id, {bucket('line_id', 100, '20261101')} as b from training_lines) group by 1",
    "latency_summary": "select method_name, count(*) as calls, round(quantile_cont(milliseconds, 0.5), 6) as median_ms, round(quantile_cont(milliseconds, 0.95), 6) as p95_ms, round(avg(milliseconds), 6) as mean_ms from timing where milliseconds is not null and not isnan(milliseconds) and milliseconds > 0 group by 1",
    "arm_selection": f"with t as {_TIMED}, a as (select method_name, count(*) filter (rank > 0) as top3_hits, count(*) filter (rank = 1) as top1_hits, round(quantile_cont(milliseconds, 0.5), 6) as median_ms, avg((rank > 0)::double) as m from t group by 1 order by 2 desc, 3 desc, 4, 1 limit 1), p as (select method_name, seed, avg((rank > 0)::double) as v from t group by 1, 2) select method_name, top3_hits, top1_hits, median_ms, (select p.seed from p where p.method_name = a.method_name order by round(abs(v - m), 12), p.seed limit 1) as seed from a",
    "seed_summary": f"with p as (select method_name, seed, avg((rank > 0)::double) as top3, avg((rank = 1)::double) as top1 from {_TIMED} group by 1, 2) select method_name, count(*) as seeds, round(avg(top3), 6) as mean_top3, round(min(top3), 6) as least_top3, round(max(top3), 6) as most_top3, round(avg(top1), 6) as mean_top1 from p group by 1",
    "grid_audit": "select (count(distinct round_no) * count(distinct method_name))::bigint as expected, count(distinct (round_no, method_name)) as found from timing where round_no is not null and method_name is not null",
    "set_audit": "with a as (select distinct case_id from candidate_scores where case_id is not null), b as (select distinct case_id from timing where case_id is not null) select (select count(*) from a join b using (case_id)) as both, (select count(*) from a anti join b using (case_id)) as only_a, (select count(*) from b anti join a using (case_id)) as only_b",
    "arm_difference": "with ok as (select * from candidate_scores where cpu_probability is not null and not isnan(cpu_probability)), a as (select case_id, word_id, max(cpu_probability) as x, 1 as ia from ok group by 1, 2), b as (select case_id, word_id, min(cpu_probability) as y, 1 as ib from ok group by 1, 2) select count(*) filter (ia is not null and ib is not null) as compared, count(*) filter (ib is null) as only_a, count(*) filter (ia is null) as only_b, max(abs(x - y)) as greatest from a full join b on a.case_id = b.case_id and a.word_id = b.word_id",
    "paired_groups": _MCNEMAR.replace("select source, count(*)", "select grp, count(*)").replace(_PAIRS, f"(select *, unnest(['all', 'source ' || source, 'words ' || case when words <= 4 then '1-4' when words <= 12 then '5-12' else '13+' end]) as grp from {_PAIRS} join (select case_id, words from {_DETAILS}) using (case_id))"),
    "gated_selection": f"with r as (select method_name, avg((rank > 0)::double) as top3, quantile_cont(milliseconds, 0.5) as median_ms from {_TIMED} group by 1) select method_name, round(top3, 6) as top3, round(median_ms, 6) as median_ms from r where top3 >= (select max(top3) from r) - 0.005 order by r.median_ms, r.top3 desc limit 1",
    "wide_export": f"select case_id, source, rank_a, rank_b from {_PAIRS}",
    "metric_unpivot": f"unpivot (select source, top1, top2, top3, mrr from ({_rollup(_DETAILS)})) on top1, top2, top3, mrr into name metric value value",
    "metric_pivot": f"select split, " + ", ".join(f"round(avg((rank > 0)::double) filter (source = '{x}'), 6) as {x}" for x in ("blogs", "news", "twitter")) + f" from {_DETAILS} where source is not null group by 1",
    "trie_statistics": "with n as (select (length(word) + 1) // 2 as n from vocabulary) select count(*) as words, count(*) filter (n > 6) as over_depth, count(*) filter (n < 2) as single_token, count(*) filter (n between 2 and 6) as eligible from n",
    "session_debounce": f"select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as started, count(*) as events, arg_max(event_type, (ts, event_type)) as last_event from {_EVENT} group by user_id, g",
    "latest_request": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1",
    "line_length_deciles": f"with q as (select {SOURCE} as source, quantile_cont(length(text), [0.1, 0.5, 0.9]) as p from training_lines where text is not null group by 1) select source, unnest([0, 1, 2])::int as i, round(unnest(p), 6) as value from q",
    "disjoint_parts": "with r as (select 'development' as part, lower(line_hash) as h from development where line_hash is not null union select 'reserved', lower(line_hash) from reserved_hashes where line_hash is not null union select 'training', lower(line_hash) from training_lines where line_hash is not null) select x.part as a, y.part as b, count(*) as keys from r x join r y on x.h = y.h and x.part < y.part group by 1, 2",
}
