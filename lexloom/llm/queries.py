"""Queries pN_... over the project's tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.llm import abuse, copies, encoding, leaks, mixture, overlap, sentences
from lexloom.session import table


def p1_found(spark, d):
    return overlap.shared_lines(table(spark, d, "development"), table(spark, d, "training_lines"))


def p1_report(spark, d):
    dev = table(spark, d, "development")
    return overlap.overlap_report(dev, p1_found(spark, d))


def p1_links(spark, d):
    return overlap.line_links(table(spark, d, "development"), table(spark, d, "training_lines"))


def p2_found(spark, d):
    return copies.superfluous(table(spark, d, "development"))


def p2_collapsed(spark, d):
    return copies.collapsed(table(spark, d, "development"))


def p3_found(spark, d):
    return overlap.near_pairs(table(spark, d, "development"))


def p3_links(spark, d):
    return overlap.near_links(table(spark, d, "development"))


def p4_found(spark, d):
    return encoding.garbled(table(spark, d, "development"))


def p4_restored(spark, d):
    return encoding.restored(table(spark, d, "development"))


def p4_evidence(spark, d):
    return encoding.evidence(table(spark, d, "development"))


def p5_found(spark, d):
    return abuse.abusive(table(spark, d, "development"), table(spark, d, "toxicity_labels"))


def p5_scores(spark, d):
    return abuse.scores(table(spark, d, "development"), table(spark, d, "toxicity_labels"))


def p5_rates(spark, d):
    return abuse.rates(table(spark, d, "development"), table(spark, d, "toxicity_labels"))


def p6_found(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "holdout_items"))


def p6_report(spark, d):
    return leaks.leak_report(table(spark, d, "holdout_items"), p6_found(spark, d))


def p7_mixture(spark, d):
    return mixture.draw(table(spark, d, "documents"), table(spark, d, "mixture_targets"))


def p7_shares(spark, d):
    return mixture.shares(table(spark, d, "documents"), table(spark, d, "mixture_targets"))


def p8_found(spark, d):
    return sentences.sentences(table(spark, d, "documents"))


def p8_cover(spark, d):
    """(doc_id, characters, split): the non-blank characters of each text that are in its sentences."""
    docs = table(spark, d, "documents").where("doc_id is not null and text is not null").select("doc_id", "text")
    spans = sentences.sentences(docs).join(docs, "doc_id")
    own = F.regexp_replace(F.substring("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")), _BLANKS, "")
    return spans.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length(own)).alias("characters")).where("characters > 0").select("doc_id", "characters", (F.col("sentences") > 0).alias("split"))


_BLANKS = "[\\s\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"

QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_links, p2_found, p2_collapsed, p3_found, p3_links, p4_found, p4_restored, p4_evidence, p5_found, p5_scores, p5_rates, p6_found, p6_report, p7_mixture, p7_shares, p8_found, p8_cover)}

_WORDS = "regexp_extract_all(lower(translate({0}, '''’', '')), '[\\p{{L}}\\p{{N}}]+')"


def _bag(table: str, id: str, text: str, least: int) -> str:
    """(id, n, w, k): each word of each text with the number of its occurrence."""
    return f"""select {id} as id, len(ws) as n, w, row_number() over (partition by {id}, w) as k
      from (select {id}, ws, unnest(ws) as w from (select {id}, {_WORDS.format(text)} as ws from {table} where {text} is not null) where len(ws) >= {least})"""


_P1 = f"""
with x as ({_bag("development", "case_id", "prefix", 12)}), y as ({_bag("training_lines", "line_id", "text", 1)}),
near as (select x.id as case_id, y.id as line_id from x join y on x.w = y.w and x.k = y.k group by x.id, y.id having 5 * count(*) >= 4 * any_value(x.n))
select case_id, line_id from near
union
select case_id, line_id from development d join training_lines t on lower(d.line_hash) = lower(t.line_hash)
"""

_P1_LINKS = f"""
with b as (select case_id, list_sort({_WORDS.format("prefix")}) as ws from development where prefix is not null),
rep as (select case_id, min(case_id) over (partition by ws) as class_id from b where len(ws) >= 12),
x as ({_bag("development", "case_id", "prefix", 12)}), y as ({_bag("training_lines", "line_id", "text", 1)}),
near as (select x.id as case_id, y.id as line_id from x join y on x.w = y.w and x.k = y.k group by x.id, y.id having 5 * count(*) >= 4 * any_value(x.n)),
w as (select case_id, count(*) as by_words from near group by case_id),
h as (select case_id, count(line_id) as by_hash from development d left join training_lines t on lower(d.line_hash) = lower(t.line_hash) where d.line_hash is not null group by case_id)
select case_id, coalesce(class_id, case_id) as class_id, coalesce(by_hash, 0) as by_hash, coalesce(by_words, 0) as by_words
from development left join rep using (case_id) left join w using (case_id) left join h using (case_id) where class_id is not null or line_hash is not null
"""

_LETTERS = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_NAMES = "(?:topic|mood|place|body)"
# a record's fields, one by one: a name and what follows it up to the next name or the end
_FIELD = "(?i)(?:^|[;|{,\\n])[\\s\"]*(" + _NAMES[3:-1] + ")\"?\\s*[:=]"
_CONTENT = f"""select case_id, case when len(f) >= 2 and regexp_matches(prefix, '(?i)^[\\s{{"]*{_NAMES}"?\\s*[:=]')
    then '#' || array_to_string(list_sort(list_transform(f, lambda p: {_LETTERS.format("split_part(p, chr(2), 1)")} || '=' || {_LETTERS.format("split_part(p, chr(2), 2)")})), '#')
    else {_LETTERS.format("prefix")} end as k
  from (select case_id, prefix, list_filter(string_split(regexp_replace(prefix, '{_FIELD}', chr(1) || '\\1' || chr(2), 'g'), chr(1)), lambda p: {_LETTERS.format("p")} <> '') as f
        from development where prefix is not null)"""
_P2 = f"""
with c as ({_CONTENT}), m as (select case_id, min(case_id) over (partition by k) as keep_id from c where k <> '')
select keep_id, case_id from m where case_id <> keep_id
"""
_P2_COLLAPSED = f"with c as ({_CONTENT}) select min(case_id) as keep_id, count(*) as copies from c where k <> '' group by k"
_P3 = f"""
with x as ({_bag("development", "case_id", "prefix", 12)}), c as ({_CONTENT}),
near as (select a.id as case_a, b.id as case_b from x a join x b on a.w = b.w and a.k = b.k and a.id < b.id group by a.id, b.id having 5 * count(*) >= 4 * greatest(any_value(a.n), any_value(b.n)))
select case_a, case_b from near join c p on p.case_id = case_a join c q on q.case_id = case_b where p.k <> q.k
"""
_P3_LINKS = f"""
with f as ({_P3.strip()}), n as (select id, count(*) as links from (select case_a as id from f union all select case_b from f) group by id),
c as ({_CONTENT}), b as (select case_id, list_sort({_WORDS.format("prefix")}) as ws from development where prefix is not null)
select case_id, min(case_id) over (partition by k, ws) as class_id, coalesce(links, 0) as links from b join c using (case_id) left join n on n.id = case_id where len(ws) >= 12
"""
_SOURCE = "coalesce(lower(trim(source)), '')"
_P1_REPORT = f"""
with n as (select case_id, count(*) as n from ({_P1}) group by case_id)
select coalesce(split, '') as split, {_SOURCE} as source, count(*) as cases, count(n.n) as leaked, coalesce(sum(n.n), 0)::bigint as pairs
from development left join n using (case_id) group by 1, 2
"""

_RUNS = "select distinct {0} as id, array_to_string(ws[k:k + 11], ' ') as run from (select {0}, ws, unnest(range(1, len(ws) - 10)) as k from (select {0}, {1} as ws from {2} where text is not null) where len(ws) >= 12)"
_P6 = f"""
with d as ({_RUNS.format("doc_id", _WORDS.format("text"), "documents")}), i as ({_RUNS.format("item_id", _WORDS.format("text"), "holdout_items")})
select distinct d.id as doc_id, i.id as item_id from d join i using (run)
"""
_P6_REPORT = f"with n as (select item_id, count(*) as n from ({_P6}) group by item_id) select item_id, reserve_role, coalesce(n, 0) as documents from holdout_items left join n using (item_id)"

_P8_COVER = f"select doc_id, length(regexp_replace(text, '{_BLANKS}', '', 'g')) as characters, true as split from documents where text is not null and length(regexp_replace(text, '{_BLANKS}', '', 'g')) > 0"

ORACLE = {"p1_found": _P1, "p1_report": _P1_REPORT, "p1_links": _P1_LINKS, "p2_found": _P2, "p2_collapsed": _P2_COLLAPSED, "p3_found": _P3, "p3_links": _P3_LINKS, "p6_found": _P6, "p6_report": _P6_REPORT, "p8_cover": _P8_COVER}
