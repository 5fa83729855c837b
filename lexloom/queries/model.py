"""N-gram tables, smoothed models, predictions and serving."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import tokens_letters as _letters
from lexloom.functions.text import tokens_model
from lexloom.operators import ngrams
from lexloom.plans import models, product
from lexloom.queries.common import CASES, LETTERS, LINES, MODEL, PREFIXES, cases, lines, prefixes, words
from lexloom.session import cut, small, table



def _text():
    return tokens_model(F.col("text"))


def _prefix():
    return tokens_model(F.col("prefix"))


def _model(column):
    return tokens_model(F.col(column))


def _plain(column):
    return _letters(F.col(column))


def ngram_profile(s, d):
    return ngrams.profile(lines(s, d), _text())


def bigram_counts(s, d):
    return ngrams.all_grams(lines(s, d), _text(), 2)[1]


def trigram_counts(s, d):
    return ngrams.grams(lines(s, d), _text(), 3)


def pruned_trigrams(s, d):
    return ngrams.prune(ngrams.all_grams(lines(s, d), _text(), 3)[2], 2)


def fivegram_bos_counts(s, d):
    return ngrams.start_grams(lines(s, d), _text(), 5)[4]


def continuation_counts(s, d):
    return ngrams.continuation_counts(ngrams.start_grams(lines(s, d), _text(), 3)[2])


def estimated_discounts(s, d):
    return ngrams.estimated_discount(ngrams.start_grams(lines(s, d), _text(), 3)[2]).withColumn("discount", F.round("discount", 9))


def vocab_ids(s, d):
    return ngrams.vocabulary(ngrams.all_grams(lines(s, d), _text(), 1)[0])


def constant_baseline(s, d):
    """The most frequent target of each source, the smallest of equals, and how often it is right."""
    n = cases(s, d).groupBy("source", "actual").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.min_by("actual", F.struct(-F.col("n"), F.col("actual"))).alias("word"), F.max("n").alias("hits"), F.sum("n").alias("cases"))


def _shared(s, d, name, config, build):
    """One model for all queries of a session that ask for it over the same files."""
    return models.shared(table(s, d, "training_lines"), {"name": name, **config}, build)


def _kn(s, d, **kinds):
    config = {"method": "kneser_ney", "order": 3, "least": 2} | kinds
    return _shared(s, d, "smoothed", config, lambda: models.build(lines(s, d), _text(), **config))


def _backoff(s, d, dialect, least):
    return _shared(s, d, "backoff", {"dialect": dialect.__name__, "least": least}, lambda: models.build_backoff(lines(s, d), dialect("text"), 3, least))


def kn_weights(s, d):
    m = _kn(s, d)
    return m.grams.where("weight > 0").select("n", "context", "word", F.round("weight", 6).alias("weight"))


def kn_backoff_mass(s, d):
    return _kn(s, d).contexts.where("types > 0").select("n", "context", "total", F.round("backoff", 6).alias("backoff"))


def base_probabilities(s, d):
    return _kn(s, d).base.select("word", F.round("p", 9).alias("p"))


def _rounded(predictions):
    return predictions.select("case_id", "rank", "word", F.round("p", 6).alias("p"))


def kn_top3(s, d):
    return _rounded(models.predict(_kn(s, d), prefixes(s, d), "case_id", _prefix()))


def kn_formatted(s, d):
    return models.formatted(models.predict(_kn(s, d), prefixes(s, d), "case_id", _prefix()), "case_id")


def context_ablation(s, d):
    """How often the best word stays the same if only the last word of a prefix is kept."""
    m = _kn(s, d)
    full = models.predict(m, prefixes(s, d), "case_id", _prefix()).where("rank = 1").select("case_id", F.col("word").alias("a"))
    short = prefixes(s, d).withColumn("prefix", F.array_join(F.slice(F.reverse(_prefix()), 1, 1), " "))
    part = models.predict(m, short, "case_id", _prefix()).where("rank = 1").select("case_id", F.col("word").alias("b"))
    return full.join(part, "case_id").agg(F.count("*").alias("cases"), F.count_if(F.col("a") == F.col("b")).alias("same"))


def index_audit(s, d):
    from lexloom.operators import audit

    return audit.index_check(product.continuation_index(lines(s, d), _text()))


def kn_estimated_top3(s, d):
    return _rounded(models.predict(_kn(s, d, discount="estimated"), prefixes(s, d), "case_id", _prefix()))


def kn5_top3(s, d):
    return _rounded(models.predict(_kn(s, d, order=5), prefixes(s, d), "case_id", _prefix()))


def absolute_top3(s, d):
    return _rounded(models.predict(_kn(s, d, method="absolute"), prefixes(s, d), "case_id", _prefix()))


def interp_top3(s, d):
    return _rounded(models.predict(_kn(s, d, method="interpolated"), prefixes(s, d), "case_id", _prefix()))


def witten_bell_top3(s, d):
    return _rounded(models.predict(_kn(s, d, method="witten_bell"), prefixes(s, d), "case_id", _prefix()))


def unigram_top3(s, d):
    return _rounded(models.predict(_kn(s, d, method="interpolated", order=1), prefixes(s, d), "case_id", _prefix()))


def evidence_order(s, d):
    return models.evidence(_kn(s, d, method="interpolated"), prefixes(s, d), "case_id", _prefix())


def target_probability(s, d):
    out = models.word_probability(_kn(s, d), cases(s, d), "case_id", "actual", _prefix())
    return out.select("case_id", "word", F.round("p", 7).alias("p"), "known")


def choice_ranking(s, d):
    rows = table(s, d, "development").where("prefix is not null").select("case_id", "prefix", F.transform(F.from_json("options_json", "array<string>"), lambda w: F.lower(w)).alias("options")).where("options is not null")
    return _rounded(models.rank_choices(_kn(s, d), rows, "case_id", "options", _prefix()))


def backoff_top3(s, d):
    m = _backoff(s, d, _plain, 1)
    return models.predict_backoff(m, prefixes(s, d), "case_id", _plain("prefix")).select("case_id", "rank", "word", F.round("score", 6).alias("score"), "n")


def legacy_top3(s, d):
    m = _backoff(s, d, _model, 2)
    return models.predict_backoff(m, prefixes(s, d), "case_id", _prefix()).select("case_id", "rank", "word", F.round("score", 6).alias("score"), "n")


def alpha_probability(s, d):
    m = _backoff(s, d, _plain, 1)
    return models.smoothed_probability(m, cases(s, d), "case_id", "actual", _plain("prefix")).select("case_id", F.round("p", 7).alias("p"))


def exact_continuation(s, d):
    """The most frequent next words after a prefix's longest literal ending, first source first. Endings have 12, 8, 5, 3
    or 2 words, each cut to the prefix's own length, so that a short prefix is also asked for as a whole."""
    lengths = (12, 8, 5, 3, 2)
    rows = prefixes(s, d).select("case_id", _prefix().alias("t")).where(F.size("t") > 0)
    asked = rows.select("case_id", F.explode(F.expr(f"transform(array_distinct(transform(array{lengths}, c -> least(c, size(t)))), c -> struct(c as n, array_join(slice(t, -c, c), ' ') as context))")).alias("x")).select("case_id", "x.n", "x.context")
    wanted = asked.select("n", "context").distinct()
    texts = lines(s, d).select("source", _text().alias("t")).where(F.size("t") >= 2)

    def followed(n):
        pairs = texts.where(F.size("t") > n).select("source", F.explode(F.expr(f"transform(sequence(1, size(t) - {n}), i -> struct(array_join(slice(t, i, {n}), ' ') as context, t[i + {n - 1}] as word))")).alias("g"))
        return pairs.select("source", F.lit(n).alias("n"), "g.context", "g.word")

    # only endings that are asked for are counted; the other lengths are whole prefixes, which are few
    parts = [followed(n).join(wanted.where(F.col("n") == n), ["n", "context"], "left_semi") for n in lengths]
    whole = small(wanted.where(~F.col("n").isin(*lengths)))
    parts.append(reduce(DataFrame.unionAll, [followed(n) for n in range(1, max(lengths)) if n not in lengths]).join(whole, ["n", "context"], "left_semi"))
    counts = reduce(DataFrame.unionAll, [p.select("source", "n", "context", "word") for p in parts]).groupBy("source", "n", "context", "word").agg(F.count("*").alias("cnt"))
    best = cut(counts.withColumn("rank", F.expr("row_number() over (partition by source, n, context order by cnt desc, word)")).where("rank <= 3"), "followers")
    hit = asked.join(best.where("rank = 1").select("n", "context", "source"), ["n", "context"]).groupBy("case_id").agg(F.min(F.struct("source", (-F.col("n")).alias("m"), "context")).alias("h")).select("case_id", "h.source", (-F.col("h.m")).alias("n"), "h.context")
    return hit.join(best, ["source", "n", "context"]).select("case_id", "source", "n", "rank", "word", "cnt")


def _compact(s, d):
    return _shared(s, d, "compact", {"words": 2000}, lambda: product.compact(_kn(s, d), 2000, 3, 8, table(s, d, "blocked_terms")))


def compact_followers(s, d):
    c = _compact(s, d)
    return c.grams.join(c.contexts, ["n", "context"]).select("n", "context", "word", F.round("weight", 6).alias("weight"), F.round("backoff", 6).alias("backoff"))


def compact_top3(s, d):
    return _rounded(product.best(product.sparse(_compact(s, d), prefixes(s, d), "case_id", _prefix(), 3), "case_id", 3))


def cache_top3(s, d):
    return _rounded(product.predict_cached(_compact(s, d), prefixes(s, d), "case_id", _prefix()))


def dictionary_top3(s, d):
    return _rounded(product.predict_dictionary(_compact(s, d), prefixes(s, d), "case_id", _prefix(), table(s, d, "vocabulary"), 0.1))


def mixture_top3(s, d):
    c = prefixes(s, d)
    a = product.sparse(_compact(s, d), c, "case_id", _prefix(), 3)
    b = _given(s, d).join(c.select("case_id"), "case_id", "left_semi").select("case_id", "word", F.col("score").alias("p"))
    return _rounded(product.best(product.mixed(a, b, "case_id", 0.75), "case_id", 3))


def _given(s, d):
    from lexloom.queries.common import scores

    return scores(s, d)


def continuation_index(s, d):
    return product.continuation_index(lines(s, d), _text())


def continuation_support(s, d):
    return product.continuation_index(lines(s, d), _text(), support=2)


def continuation_lookup(s, d):
    index = product.continuation_index(lines(s, d), _text())
    c = prefixes(s, d)
    return product.continuations(index, c, "case_id", _prefix(), exclude=c.select("case_id", F.col("actual").alias("word")))


_ALL = [
    ngram_profile, bigram_counts, trigram_counts, pruned_trigrams, fivegram_bos_counts, continuation_counts, estimated_discounts, vocab_ids, constant_baseline, kn_weights, kn_backoff_mass, base_probabilities, kn_top3, kn_formatted, context_ablation, index_audit, kn_estimated_top3,
    kn5_top3, absolute_top3, interp_top3, witten_bell_top3, unigram_top3, evidence_order, target_probability, choice_ranking, backoff_top3, legacy_top3, alpha_probability, exact_continuation, compact_followers, compact_top3, cache_top3,
    dictionary_top3, mixture_top3, continuation_index, continuation_support, continuation_lookup,
]
QUERIES = {f.__name__: f for f in _ALL}


# --- SQL ---------------------------------------------------------------------------------------

_T = words("text")
_TOK = f"tok as (select source, {_T} as t from {LINES})"


def _gram(n: int, pads: int, tok: str = "tok") -> str:
    """All n-grams of token lists with ``pads`` line starts: context and word."""
    p = f"list_concat({['<s>'] * pads if pads else '[]::varchar[]'}, t)"
    context = " || ' ' || ".join(f"p[i - {k}]" for k in range(n - 1, 0, -1)) or "''"
    return f"(select {context} as context, p[i] as word from (select p, unnest(range({max(pads + 1, n)}, len(p) + 1)) as i from (select {p} as p from {tok} where len(t) > 0)))"


def _counts(n: int, pads: int, tok: str = "tok") -> str:
    return f"select context, word, count(*) as cnt from {_gram(n, pads, tok)} group by 1, 2"


def _tail(c: str) -> str:
    return f"(case when contains({c}, ' ') then substr({c}, instr({c}, ' ') + 1) else '' end)"


_PADS = {3: 2, 5: 4}


def _model_sql(method: str, order: int = 3, least: int = 2, discount: str = "0.75") -> str:
    """CTEs tok, base (word, p), t2.. (context, word, weight), b2.. (context, total, types, backoff)."""
    starts = method in ("kneser_ney", "absolute")
    pads = order - 1 if starts else 0
    parts = [_TOK]
    parts += [f"r{n} as ({_counts(n, pads)})" for n in range(1, order + 1)]
    for n in range(1, order + 1):
        kn = method == "kneser_ney" and n < order
        parts.append(f"e{n} as (" + (f"select {_tail('context')} as context, word, count(*) as cnt from r{n + 1} group by 1, 2" if kn else f"select * from r{n}") + ")")
    parts.append("words as (select word, cnt from e1 union all select '<unk>', 0)")
    parts.append("base as (select word, (cnt + 0.1) / (select sum(cnt + 0.1) from words) as p from words)")
    for n in range(2, order + 1):
        d = discount if discount != "estimated" else f"(select case when count(*) filter (cnt = 1) + 2 * count(*) filter (cnt = 2) > 0 then greatest(0.1, least(0.95, count(*) filter (cnt = 1) / (count(*) filter (cnt = 1) + 2 * count(*) filter (cnt = 2)))) else 0.75 end from e{n})"
        total = "sum(cnt)" if starts else f"sum(cnt) filter (cnt >= {least})"
        kept, types = f"sum(cnt) filter (cnt >= {least})", f"count(*) filter (cnt >= {least})"
        backoff = {"interpolated": f"{d} * {types} / {kept}", "witten_bell": f"{types} / ({kept} + {types})"}.get(method, f"greatest(0, 1 - ({kept} - {d} * {types}) / {total})")
        parts.append(f"b{n} as (select context, {total} as total, {types} as types, {backoff} as backoff from e{n} group by 1 having {types} > 0)")
        weight = "cnt / (total + types)" if method == "witten_bell" else f"(cnt - {d}) / total"
        parts.append(f"t{n} as (select context, word, {weight} as weight from e{n} join b{n} using (context) where cnt >= {least})")
    return ", ".join(parts)


def _asked(order: int, starts: bool, rows: str = PREFIXES) -> str:
    p = f"list_concat({['<s>'] * (order - 1)}, t)" if starts else "t"
    cols = ", ".join(f"case when len(p) >= {n - 1} then array_to_string(p[len(p) - {n - 2}:], ' ') end as c{n}" for n in range(2, order + 1))
    return f"ask as (select *, {cols} from (select *, {p} as p from (select *, {words('prefix')} as t from {rows})))"


def _scored(order: int, first: int = 3, extra: str = "") -> str:
    """CTE scored (case_id, word, p): the candidates of each case, level by level."""
    hits = " union ".join(f"select case_id, word from ask join t{n} on t{n}.context = ask.c{n}" for n in range(2, order + 1)) or "select case_id, '' as word from ask where false"
    steps, value = "", "base.p"
    for n in range(2, order + 1):
        steps += f" left join b{n} on b{n}.context = a.c{n} left join t{n} on t{n}.context = a.c{n} and t{n}.word = cand.word"
        value = f"({value} * coalesce(b{n}.backoff, 1) + coalesce(t{n}.weight, 0))"
    return f"cand as ({hits} union select case_id, word from ask, (select word from base where word <> '<unk>' order by p desc, word limit {first}){extra}), scored as (select cand.case_id, cand.word, {value} as p from cand join ask a on a.case_id = cand.case_id join base on base.word = cand.word{steps})"


_BEST = "select case_id, rank, word, round(p, 6) as p from (select *, row_number() over (partition by case_id order by p desc, word) as rank from scored) where rank <= 3"


def _top3(method: str, order: int = 3, least: int = 2, discount: str = "0.75") -> str:
    return f"with {_model_sql(method, order, least, discount)}, {_asked(order, method in ('kneser_ney', 'absolute'))}, {_scored(order)} {_BEST}"


_KN = _model_sql("kneser_ney")
_OPTIONS = "(select case_id, prefix, option from (select case_id, prefix, unnest(list_distinct(list_transform(from_json(options_json, '[\"VARCHAR\"]'), lambda w: lower(w)))) as option from development where prefix is not null and json_valid(options_json) and json_type(options_json) = 'ARRAY'))"


def _probability(rows: str, word: str, unknown: str) -> str:
    steps, value = "", "base.p"
    for n in (2, 3):
        steps += f" left join b{n} on b{n}.context = a.c{n} left join t{n} on t{n}.context = a.c{n} and t{n}.word = base.word"
        value = f"({value} * coalesce(b{n}.backoff, 1) + coalesce(t{n}.weight, 0))"
    return f"with {_KN}, {_asked(3, True, rows)}, named as (select a.*, w.word is not null as known from ask a left join base w on w.word = a.{word}) select case_id, a.{word} as word, {unknown.format(value)} as p, known from named a join base on base.word = case when known then a.{word} else '<unk>' end{steps}"


_PLAINTOK = f"tok as (select source, {LETTERS.format('text')} as t from {LINES})"


def _backoff_sql(tok: str, dialect: str, least: int, rows: str = PREFIXES) -> str:
    parts = [tok] + [f"g{n} as ({_counts(n, 0)}" + (f" having count(*) >= {least}" if n > 1 else "") + ")" for n in (1, 2, 3)]
    parts.append(f"ask as (select case_id, actual, '' as c1, case when len(t) >= 1 then t[len(t)] end as c2, case when len(t) >= 2 then t[len(t) - 1] || ' ' || t[len(t)] end as c3 from (select *, {dialect.format('prefix')} as t from {rows}))")
    return ", ".join(parts)


def _backoff_top3(tok: str, dialect: str, least: int) -> str:
    # a context's own best three are enough at each order
    hits = " union all ".join(f"select case_id, {n} as n, word, cnt, total from ask join (select *, sum(cnt) over (partition by context) as total, row_number() over (partition by context order by cnt desc, word) as r from g{n}) g on g.context = ask.c{n} and r <= 9" for n in (1, 2, 3))
    return f"with {_backoff_sql(tok, dialect, least)}, h as ({hits}), f as (select *, row_number() over (partition by case_id, word order by n desc) as first from h) select case_id, rank, word, round(cnt / total, 6) as score, n::int as n from (select *, row_number() over (partition by case_id order by n desc, cnt desc, word) as rank from f where first = 1) where rank <= 3"


_ALPHA = f"with {_backoff_sql(_PLAINTOK, LETTERS, 1, CASES)}, tot as (select 1 as n, context, sum(cnt) as total from g1 group by 2 union all select 2, context, sum(cnt) from g2 group by 2 union all select 3, context, sum(cnt) from g3 group by 2), l as (select case_id, actual, n, context, total from (select *, row_number() over (partition by case_id order by n desc) as r from (select case_id, actual, tot.* from ask join tot on (tot.n = 1 and tot.context = c1) or (tot.n = 2 and tot.context = c2) or (tot.n = 3 and tot.context = c3))) where r = 1), g as (select 1 as n, * from g1 union all select 2, * from g2 union all select 3, * from g3) select case_id, round((coalesce(cnt, 0) + 0.5) / (total + 0.5 * (select count(*) from g1)), 7) as p from l left join g on g.n = l.n and g.context = l.context and g.word = l.actual"

_EXACT = f"""with {_TOK}, f as ({" union all ".join(f"select source, {n} as n, array_to_string(t[i:i + {n - 1}], ' ') as context, t[i + {n}] as word from (select source, t, unnest(range(1, len(t) - {n} + 1)) as i from tok where len(t) > {n})" for n in range(1, 13))}),
a as (select case_id, n, array_to_string(t[len(t) - n + 1:], ' ') as context from (select case_id, t, unnest(list_distinct(list_transform([12, 8, 5, 3, 2], lambda c: least(c, len(t))))) as n from (select case_id, {words('prefix')} as t from {PREFIXES}) where len(t) > 0)),
c as (select source, n, context, word, count(*) as cnt from f where (n, context) in (select n, context from a) group by all),
h as (select * from (select a.*, s.source, row_number() over (partition by case_id order by s.source, a.n desc) as r from a join (select distinct source, n, context from c) s using (n, context)) where r = 1)
select case_id, source, n, rank, word, cnt from (select case_id, h.source, h.n, c.word, c.cnt, row_number() over (partition by case_id order by cnt desc, word) as rank from h join c using (source, n, context)) where rank <= 3"""

_COMPACT = f"""{_KN}, small as (select word, p from base where word <> '<unk>' and word not in (select lower(term) from blocked_terms) order by p desc, word limit 2000),
kept as (select word, p / (select sum(p) from small) as p from small),
{", ".join(f'''k{n} as (select * from (select context, word, weight, row_number() over (partition by context order by weight desc, word) as r from t{n} join b{n} using (context) where total >= 3 and word in (select word from kept)
  and context not in (select context from (select distinct context, unnest(string_split(context, ' ')) as w from t{n}) where w <> '<s>' and w not in (select word from kept))) where r <= 8),
m{n} as (select context, greatest(0, 1 - sum(weight)) as backoff from k{n} group by 1)''' for n in (2, 3))}"""


def _compact_scored(extra: str = "", first: int = 3) -> str:
    return f"with {_COMPACT}, {_asked(3, True)}, cand as (select case_id, word from ask join k2 on k2.context = c2 union select case_id, word from ask join k3 on k3.context = c3 union select case_id, word from ask, (select word from kept order by p desc, word limit {first}){extra}), scored as (select cand.case_id, cand.word, (kept.p * coalesce(m2.backoff, 1) + coalesce(k2.weight, 0)) * coalesce(m3.backoff, 1) + coalesce(k3.weight, 0) as p from cand join ask a using (case_id) join kept on kept.word = cand.word left join m2 on m2.context = a.c2 left join k2 on k2.context = a.c2 and k2.word = cand.word left join m3 on m3.context = a.c3 left join k3 on k3.context = a.c3 and k3.word = cand.word)"


_RECENT = f"(select case_id, word, count(*) as c from (select case_id, unnest(list_reverse(t)[1:100]) as word from (select case_id, {words('prefix')} as t from {PREFIXES})) where word in (select word from kept) and word not in (select word from kept order by p desc, word limit 100) group by 1, 2)"
_CACHE = _compact_scored(f" union select case_id, word from {_RECENT}") + f", rec as {_RECENT}, tot as (select case_id, sum(c) as s from rec group by 1), mix as (select scored.case_id, scored.word, case when s is null then p else p * 0.95 + coalesce(0.05 * c / s, 0) end as q from scored left join rec using (case_id, word) left join tot on tot.case_id = scored.case_id) select case_id, rank, word, round(q, 6) as p from (select *, row_number() over (partition by case_id order by q desc, word) as rank from mix) where rank <= 3"
_WEIGH = "(case when word in (select word from vocabulary) then 1.0 else 0.1 end)"
_DICTIONARY = (
    _compact_scored(f" union select case_id, word from ask, (select word from kept order by p * {_WEIGH} desc, word limit 3)")
    + f", g2 as (select context, sum(weight * {_WEIGH}) as gain from k2 group by 1), g3 as (select context, sum(weight * {_WEIGH}) as gain from k3 group by 1), mass as (select case_id, ((select sum(p * {_WEIGH}) from kept) * coalesce(m2.backoff, 1) + coalesce(g2.gain, 0)) * coalesce(m3.backoff, 1) + coalesce(g3.gain, 0) as mass from ask left join m2 on m2.context = c2 left join g2 on g2.context = c2 left join m3 on m3.context = c3 left join g3 on g3.context = c3), w as (select case_id, word, p * {_WEIGH} / mass as q from scored join mass using (case_id)) select case_id, rank, word, round(q, 6) as p from (select *, row_number() over (partition by case_id order by q desc, word) as rank from w) where rank <= 3"
)
_MIXTURE = _compact_scored() + ", other as (select case_id, word, max(cpu_probability) as score from candidate_scores join vocabulary using (word_id) where cpu_probability is not null and not isnan(cpu_probability) and case_id in (select case_id from ask) group by 1, 2), mix as (select case_id, word, sum(q) as q from (select case_id, word, 0.75 * p as q from scored union all select case_id, word, 0.25 * score from other) group by 1, 2) select case_id, rank, word, round(q, 6) as p from (select *, row_number() over (partition by case_id order by q desc, word) as rank from mix) where rank <= 3"

_ENDINGS = f"{_TOK}, x as (select t, s, c from tok, (select unnest([1, 2, 3]) as s), (select unnest([2, 3, 4]) as c) where len(t) >= s + c), cc as (select array_to_string(t[len(t) - s - c + 1:len(t) - s], ' ') as context, array_to_string(t[len(t) - s + 1:], ' ') as continuation, count(*) as cnt from x group by 1, 2), ix as (select context, continuation, cnt from (select *, row_number() over (partition by context order by cnt desc, continuation) as r from cc) where r <= 8)"
_LOOKUP = f"with {_ENDINGS}, a as (select case_id, n, array_to_string(t[len(t) - n + 1:], ' ') as context, actual from (select case_id, actual, t, unnest([4, 3, 2]) as n from (select case_id, actual, {words('prefix')} as t from {PREFIXES})) where len(t) >= n), k as (select * from (select *, row_number() over (partition by case_id order by n desc) as r from a where context in (select context from ix)) where r = 1), h as (select case_id, n, actual, case when n = 2 then string_split(continuation, ' ')[1] else continuation end as continuation, sum(cnt) as cnt from k join ix using (context) group by 1, 2, 3, 4) select case_id, rank, continuation, n from (select *, row_number() over (partition by case_id order by cnt desc, continuation) as rank from h where continuation is distinct from actual) where rank <= 3"

ORACLE = {
    "ngram_profile": f"with {_TOK}, " + ", ".join(f"g{n} as ({_counts(n, 0)})" for n in (1, 2, 3)) + " " + " union all ".join(f"select '{n}-gram' as model, sum(cnt)::bigint as observed, count(*) as distinct_grams, round(100 * avg(case when cnt = 1 then 1.0 else 0.0 end), 6) as singleton_percent from g{n}" for n in (1, 2, 3)),
    "bigram_counts": f"with {_TOK} {_counts(2, 0)}",
    "trigram_counts": f"with {_TOK} {_counts(3, 0)}",
    "pruned_trigrams": f"with {_TOK} {_counts(3, 0)} having count(*) >= 2",
    "fivegram_bos_counts": f"with {_TOK} {_counts(5, 4)}",
    "continuation_counts": f"with {_TOK}, r3 as ({_counts(3, 2)}) select {_tail('context')} as context, word, count(*) as cnt from r3 group by 1, 2",
    "estimated_discounts": f"with {_TOK}, r3 as ({_counts(3, 2)}), n as (select count(*) filter (cnt = 1) as n1, count(*) filter (cnt = 2) as n2 from r3) select n1, n2, round(case when n1 + 2 * n2 > 0 then greatest(0.1, least(0.95, n1 / (n1 + 2 * n2))) else 0.75 end, 9) as discount from n",
    "vocab_ids": f"with {_TOK} select word, count(*) as cnt, row_number() over (order by word) as id from {_gram(1, 0)} group by 1",
    "constant_baseline": f"with n as (select source, actual, count(*) as n from {CASES} group by 1, 2) select source, arg_min(actual, (-n, actual)) as word, max(n) as hits, sum(n)::bigint as cases from n group by 1",
    "kn_weights": f"with {_KN} select 2 as n, context, word, round(weight, 6) as weight from t2 union all select 3, context, word, round(weight, 6) from t3",
    "kn_backoff_mass": f"with {_KN} select 2 as n, context, total::bigint as total, round(backoff, 6) as backoff from b2 union all select 3, context, total::bigint, round(backoff, 6) from b3",
    "base_probabilities": f"with {_KN} select word, round(p, 9) as p from base",
    "kn_top3": _top3("kneser_ney"),
    "kn_formatted": f"select case_id, string_agg(format('{{:d}}. {{:s}} ({{:.1f}} %)', rank, word, 100 * p), '; ' order by rank) as text from ({_top3('kneser_ney').replace('round(p, 6) as p', 'p')}) group by 1",
    "context_ablation": f"with f as ({_top3('kneser_ney')}), g as ({_top3('kneser_ney').replace('list_concat(' + str(['<s>'] * 2) + ', t) as p from (select *, ' + words('prefix') + ' as t', 'list_concat(' + str(['<s>'] * 2) + ', t) as p from (select *, ' + words('prefix') + '[-1:] as t')}) select count(*) as cases, count(*) filter (f.word = g.word) as same from f join g on f.case_id = g.case_id and f.rank = 1 and g.rank = 1",
    "index_audit": f"with {_ENDINGS} select count(*) as rows, count(*) filter (len(string_split(context, ' ')) not between 2 and 4) as bad_context, count(*) filter (len(string_split(continuation, ' ')) not between 1 and 3) as bad_ending, count(*) filter (cnt < 1) as bad_count from ix",
    "kn_estimated_top3": _top3("kneser_ney", discount="estimated"),
    "kn5_top3": _top3("kneser_ney", 5),
    "absolute_top3": _top3("absolute"),
    "interp_top3": _top3("interpolated"),
    "witten_bell_top3": _top3("witten_bell"),
    "unigram_top3": f"with {_TOK}, words as (select word, count(*) as cnt from {_gram(1, 0)} group by 1 union all select '<unk>', 0), base as (select word, (cnt + 0.1) / (select sum(cnt + 0.1) from words) as p from words), best as (select word, round(p, 6) as p, row_number() over (order by p desc, word) as rank from base where word <> '<unk>') select case_id, rank, word, p from {PREFIXES}, best where rank <= 3",
    "evidence_order": f"with {_model_sql('interpolated')}, {_asked(3, False)} select case_id, case when b3.context is not null then 3 when b2.context is not null then 2 else 1 end as n, coalesce(b3.context, b2.context, '') as context, coalesce(b3.total, b2.total, 0)::bigint as total, coalesce(b3.types, b2.types, 0) as types from ask left join b2 on b2.context = c2 left join b3 on b3.context = c3",
    "target_probability": _probability(CASES, "actual", "round({0}, 7)"),
    "choice_ranking": f"select case_id, word, round(p, 6) as p, row_number() over (partition by case_id order by p desc nulls last, word) as rank from ({_probability(_OPTIONS, 'option', 'case when known then {0} end')})",
    "backoff_top3": _backoff_top3(_PLAINTOK, LETTERS, 1),
    "legacy_top3": _backoff_top3(_TOK, MODEL, 2),
    "alpha_probability": _ALPHA,
    "exact_continuation": _EXACT,
    "compact_followers": f"with {_COMPACT} select 2 as n, context, word, round(weight, 6) as weight, round(backoff, 6) as backoff from k2 join m2 using (context) union all select 3, context, word, round(weight, 6), round(backoff, 6) from k3 join m3 using (context)",
    "compact_top3": _compact_scored() + " " + _BEST,
    "cache_top3": _CACHE,
    "dictionary_top3": _DICTIONARY,
    "mixture_top3": _MIXTURE,
    "continuation_index": f"with {_ENDINGS} select context, continuation, cnt from ix",
    "continuation_support": f"with {_ENDINGS} select context, continuation, cnt from ix where context in (select context from ix group by 1 having sum(cnt) >= 2)",
    "continuation_lookup": _LOOKUP,
}
