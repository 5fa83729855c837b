"""Samples with caps, shortlists, gates, recomputed metrics, compaction variants and round trips through files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexloom.functions.text import source_name
from lexloom.operators import audit, corpus, evaluation
from lexloom.operators.ordered import quantiles
from lexloom.plans import product
from lexloom.queries.common import SCORES, SOURCE, bucket, lines, scores
from lexloom.queries.evaluate import _DETAILS, _MCNEMAR, _PAIRS, _TIMED, _details, _list, _pairs, _timed
from lexloom.queries.model import _COMPACT, _kn, _shared
from lexloom.session import remove_later, shared_dir, table
from lexloom.sources import readers, sinks


def capped_sample(s, d):
    """A tenth of each source's lines by the source's own seed, 500 at most."""
    return corpus.capped(lines(s, d), "source", "line_id", 0.1, 500, 7).select("line_id", "source")


def choice_accuracy(s, d):
    dev = table(s, d, "development").where("actual is not null").select(source_name(F.col("source")).alias("source"), "ngram_choice", "actual", "ngram_rank")
    return evaluation.choice_accuracy(dev, "ngram_choice", "actual", "ngram_rank")


def reserved_after_exclusion(s, d):
    """300 lines of each source among those whose hash no reserved case has."""
    t = table(s, d, "training_lines").select("line_id", source_name(F.col("source")).alias("source"), "line_hash")
    return corpus.exact_per_group(audit.excluded(t, table(s, d, "reserved_hashes"), F.col("line_hash")), "source", "line_id", 300, 11).select("line_id", "source")


def shortlist(s, d):
    """(case_id, size64, size256, hit64, hit256): the best 64 or 256 scored words of each case together with its listed
    candidates, and whether the target is among them."""
    ranked = scores(s, d).withColumn("r", F.expr("row_number() over (partition by case_id order by score desc, word)")).where("r <= 256").select("case_id", "word", "r")
    listed = table(s, d, "development").select("case_id", F.explode(F.slice(F.array_distinct(F.from_json("ngram_candidates_json", "array<string>")), 1, 20)).alias("word")).select("case_id", "word", F.lit(0).alias("r"))
    words = ranked.unionAll(listed.where("word is not null")).groupBy("case_id", "word").agg(F.min("r").alias("r"))
    targets = table(s, d, "development").where("actual is not null").select("case_id", F.col("actual").alias("word"), F.lit(True).alias("is_target"))
    rows = words.join(targets, ["case_id", "word"], "left")
    return rows.groupBy("case_id").agg(F.count_if(F.col("r") <= 64).alias("size64"), F.count("*").alias("size256"), (F.count_if((F.col("r") <= 64) & F.col("is_target")) > 0).alias("hit64"), (F.count_if(F.col("is_target")) > 0).alias("hit256"))


def topk_before_distinct(s, d):
    """The words of each case's three best rows as delivered, repeated rows counted before they are folded."""
    ok = table(s, d, "candidate_scores").where("cpu_probability is not null and not isnan(cpu_probability)")
    top = ok.withColumn("r", F.expr("row_number() over (partition by case_id order by cpu_probability desc, word_id)")).where("r <= 3")
    return top.select("case_id", "word_id").distinct()


def cross_schedule(s, d):
    """Every method in every round, methods rotated by the round, with the calls recorded for the cell. The axes are
    counted values: a row a method, exploded over the rounds."""
    t = table(s, d, "timing").where("round_no is not null and method_name is not null")
    axes = t.agg(F.sort_array(F.collect_set("round_no")).alias("rounds"), F.sort_array(F.collect_set("method_name")).alias("methods"))
    cells = axes.select("methods", F.explode("rounds").alias("round_no")).select("round_no", "methods", F.posexplode("methods").alias("i", "method_name"))
    cells = cells.select("round_no", "method_name", F.expr("pmod(i + round_no, size(methods)) + 1").alias("place"))
    calls = t.groupBy("round_no", "method_name").agg(F.count("*").alias("calls"))
    return cells.join(calls, ["round_no", "method_name"], "left").fillna(0, ["calls"])


def promotion_gates(s, d):
    return evaluation.promotions(_pairs(s, d))


def resource_gates(s, d):
    """Methods within 50 ms at the median, 500 ms at the 95th percentile, and a top-3 share of a tenth."""
    t = _timed(s, d)
    q = quantiles(t, "method_name", "milliseconds", [0.5, 0.95])
    rows = t.groupBy("method_name").agg(F.avg((F.col("rank") > 0).cast("double")).alias("top3")).join(q, "method_name")
    rows = evaluation.within_budget(rows, {"q0": 50.0, "q1": 500.0}, "top3", 0.1)
    return rows.select("method_name", F.round("top3", 6).alias("top3"), F.round("q0", 6).alias("median_ms"), F.round("q1", 6).alias("p95_ms"), "passed")


def recomputed_metrics(s, d):
    """Top-3 shares by source from the recorded ranks and from the lists themselves, and the greatest difference."""
    dev = table(s, d, "development").where("actual is not null").select(F.coalesce(source_name(F.col("source")), F.lit("")).alias("source"), "ngram_rank", F.array_position(F.slice(F.from_json("ngram_candidates_json", "array<string>"), 1, 3), F.col("actual")).alias("at"))
    ok = dev.where("at is not null")
    rows = ok.groupBy("source").agg(F.count("*").alias("cases"), F.avg((F.col("ngram_rank") > 0).cast("double")).alias("a"), F.avg((F.col("at") > 0).cast("double")).alias("b"))
    return rows.select("source", "cases", F.round("a", 9).alias("recorded"), F.round("b", 9).alias("recomputed"), (F.abs(F.col("a") - F.col("b")) < 1e-12).alias("same"))


def released_metrics(s, d):
    """Rates by split and source, of which each must be a whole number of cases; broken counts those that are not."""
    rows = _details(s, d).groupBy("split", "source").agg(F.count("*").alias("cases"), F.avg((F.col("rank") > 0).cast("double")).alias("rate"))
    broken = audit.integral(rows, "rate", "cases").select("split", "source", F.lit(1).alias("b"))
    both = rows.select("split", "source", "rate", "cases", F.lit(0).alias("b")).unionAll(broken.select("split", "source", F.lit(None).cast("double"), F.lit(None).cast("bigint"), "b"))
    return both.agg(F.count("rate").alias("rates"), F.sum("cases").alias("cases"), F.round(F.sum(F.col("rate") * F.col("cases")), 3).alias("hits"), F.sum("b").cast("bigint").alias("broken"))


def paired_difference(s, d):
    """The paired top-3 difference, all cases alike and all sources alike: what the bootstrap's intervals stand around."""
    rows = _pairs(s, d).select("source", ((F.col("rank_b") > 0).cast("int") - (F.col("rank_a") > 0).cast("int")).alias("d")).groupBy("source").agg(F.count("*").alias("n"), F.sum("d").alias("t"))
    return rows.agg(F.sum("n").alias("cases"), F.round(F.sum("t") / F.sum("n"), 6).alias("pooled"), F.round(F.avg(F.col("t") / F.col("n")), 6).alias("by_source"))


def compaction_variants(s, d):
    """Grams and contexts that are left with 4, 8 or 16 followers a context."""
    out = None
    for k in (4, 8, 16):
        c = _shared(s, d, "compact", {"words": 20_000, "followers": k}, lambda k=k: product.compact(_kn(s, d), 20_000, 3, k, table(s, d, "blocked_terms")))
        row = c.grams.agg(F.lit(k).alias("followers"), F.count("*").alias("grams"), F.count_distinct("n", "context").alias("contexts"))
        out = row if out is None else out.unionAll(row)
    return out


def file_round_trips(s, d):
    """Rows that are lost or gained on the way through each kind of file; none may be."""
    rows = table(s, d, "training_lines").where("text is not null").select("line_id", F.regexp_replace("text", r"[\r\n\x85\u2028\u2029]+", " ").alias("text")).where("trim(text) <> ''")
    root = f"{shared_dir(s)}/lexloom-trip-{uuid.uuid4().hex}"
    remove_later(s, root)
    out = None
    for kind in ("csv", "tsv", "json", "text", "table"):
        path, back = f"{root}/{kind}", None
        if kind in ("csv", "tsv"):
            sep = "," if kind == "csv" else "\t"
            sinks.write_csv(rows, path, sep, "none" if kind == "csv" else "bzip2")
            back = readers.read_delimited(s, path, "line_id bigint, text string", sep, ["line_id", "text"])
        elif kind == "json":
            sinks.write_json(rows, path)
            back = readers.read_json_lines(s, path, "line_id bigint, text string")
        elif kind == "text":
            sinks.write_text(rows.select(F.concat_ws("\t", "line_id", "text").alias("line")), "line", path)
            back = s.read.text(path).select(F.split("value", "\t", 2).alias("p")).select(F.col("p")[0].cast("bigint").alias("line_id"), F.col("p")[1].alias("text"))
        else:
            sinks.write_table(rows, path)
            back = s.read.parquet(path)
        row = audit.difference(rows, back.select("line_id", "text")).select(F.lit(kind).alias("kind"), F.lit(back.count()).alias("rows"), "only_a", "only_b")
        out = row if out is None else out.unionAll(row)
    return out


_ALL = [capped_sample, choice_accuracy, reserved_after_exclusion, shortlist, topk_before_distinct, cross_schedule, promotion_gates, resource_gates, recomputed_metrics, released_metrics, paired_difference, compaction_variants, file_round_trips]
QUERIES = {f.__name__: f for f in _ALL}

_DEV = f"(select coalesce({SOURCE}, '') as source, ngram_choice, actual, ngram_rank from development where actual is not null)"
_CHOICE = "count(*) as cases, count(ngram_choice) as covered, round(avg((ngram_choice is not null)::double), 6) as coverage, round(avg(coalesce(ngram_choice = actual, false)::double), 6) as accuracy, round(avg(case when ngram_rank between 1 and 3 then 1 / ngram_rank else 0 end), 6) as mrr3"
_DRAW = "(select line_id, source, row_number() over (partition by source order by line_id) as n from (select line_id, {0} as source from training_lines) where {1} < 100000)"
_COMPACT_BIG = _COMPACT.replace("limit 2000", "limit 20000")
_CLEAN = r"(select line_id, trim(regexp_replace(text, '[\r\n\x{85}\x{2028}\x{2029}]+', ' ', 'g'), ' ') as text from training_lines where text is not null)"
ORACLE = {
    "capped_sample": "select line_id, source from " + _DRAW.format(SOURCE, "(('0x' || substr(sha256('7:' || coalesce(source, '') || ':' || line_id::varchar), 1, 8))::bigint % 1000000)") + " where n <= 500",
    "choice_accuracy": f"select source, {_CHOICE} from {_DEV} group by 1 union all select '(all)', {_CHOICE} from {_DEV}",
    "reserved_after_exclusion": f"select line_id, source from (select line_id, {SOURCE} as source, row_number() over (partition by {SOURCE} order by sha256('11:' || line_id::varchar), line_id) as n from training_lines where line_hash is null or lower(line_hash) not in (select lower(line_hash) from reserved_hashes where line_hash is not null)) where n <= 300",
    "shortlist": f"with r as (select case_id, word, row_number() over (partition by case_id order by score desc, word) as r from {SCORES}), l as (select case_id, unnest(list_distinct(w)) as word, 0 as r from (select case_id, {_list('ngram_candidates_json')} as w from development)), u as (select case_id, word, min(r) as r from (select * from r where r <= 256 union all select * from l where word is not null) group by 1, 2), t as (select case_id, actual from development where actual is not null) select case_id, count(*) filter (r <= 64) as size64, count(*) as size256, count(*) filter (r <= 64 and word = actual) > 0 as hit64, count(*) filter (word = actual) > 0 as hit256 from u left join t using (case_id) group by 1",
    "topk_before_distinct": "select distinct case_id, word_id from (select case_id, word_id, row_number() over (partition by case_id order by cpu_probability desc, word_id) as r from candidate_scores where cpu_probability is not null and not isnan(cpu_probability)) where r <= 3",
    "cross_schedule": "with t as (select * from timing where round_no is not null and method_name is not null), m as (select method_name, row_number() over (order by method_name) - 1 as i, count(*) over () as k from (select distinct method_name from t)), c as (select round_no, method_name, count(*) as calls from t group by 1, 2) select r.round_no, m.method_name, ((i + r.round_no) % k + 1)::bigint as place, coalesce(calls, 0) as calls from m cross join (select distinct round_no from t) r left join c on c.round_no = r.round_no and c.method_name = m.method_name",
    "promotion_gates": f"with m as ({_MCNEMAR}), s as (select source, avg(x) as m, sqrt(var_pop(x) / count(*)) as e from (select source, (rank_b > 0)::int - (rank_a > 0)::int as x from {_PAIRS}) group by 1) select m.source, cases, round(s.m, 6) as difference, round(s.m - 1.959963984540054 * e, 6) as low, round(s.m + 1.959963984540054 * e, 6) as high, p_value, s.m - 1.959963984540054 * e > 0 and p_value < 0.05 as promoted from m join s on m.source is not distinct from s.source",
    "resource_gates": f"select method_name, round(avg((rank > 0)::double), 6) as top3, round(quantile_cont(milliseconds, 0.5), 6) as median_ms, round(quantile_cont(milliseconds, 0.95), 6) as p95_ms, quantile_cont(milliseconds, 0.5) <= 50 and quantile_cont(milliseconds, 0.95) <= 500 and avg((rank > 0)::double) >= 0.1 as passed from {_TIMED} group by 1",
    "recomputed_metrics": f"select source, count(*) as cases, round(avg((ngram_rank > 0)::double), 9) as recorded, round(avg((p > 0)::double), 9) as recomputed, abs(avg((ngram_rank > 0)::double) - avg((p > 0)::double)) < 1e-12 as same from (select coalesce({SOURCE}, '') as source, ngram_rank, coalesce(list_position(w[1:3], actual), 0) as p from (select source, ngram_rank, actual, {_list('ngram_candidates_json')} as w from development where actual is not null) where w is not null) group by 1",
    "released_metrics": f"with r as (select split, source, count(*) as cases, avg((rank > 0)::double) as rate from {_DETAILS} group by 1, 2) select count(*) as rates, sum(cases)::bigint as cases, round(sum(rate * cases), 3) as hits, count(*) filter (abs(rate * cases - round(rate * cases)) >= 1e-9) as broken from r",
    "paired_difference": f"with r as (select source, count(*) as n, sum((rank_b > 0)::int - (rank_a > 0)::int) as t from {_PAIRS} group by 1) select sum(n)::bigint as cases, round(sum(t) / sum(n), 6) as pooled, round(avg(t / n), 6) as by_source from r",
    "compaction_variants": " union all ".join(f"select * from (with {_COMPACT_BIG.replace('r <= 8', f'r <= {k}')} select {k} as followers, (select count(*) from k2) + (select count(*) from k3) as grams, (select count(*) from m2) + (select count(*) from m3) as contexts)" for k in (4, 8, 16)),
    "file_round_trips": f"select unnest(['csv', 'tsv', 'json', 'text', 'table']) as kind, (select count(*) from {_CLEAN} where text <> '')::int as rows, 0::bigint as only_a, 0::bigint as only_b",
}
