"""Scans, line and word queries, dialects, sampling, splits and cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions.text import normalize_ascii, normalize_letters, source_name, tokens_ascii, tokens_model, tokens_unicode
from lexloom.operators import audit, corpus, ngrams
from lexloom.operators import lines as ops
from lexloom.queries.common import ASCII, ASCII_RAW, ASCII_TEXT, CASES, LETTERS_TEXT, LINES, MODEL, SOURCE, UNICODE, bucket, cases, lines, words
from lexloom.session import table



#: Everyday words of the spaceless example.
ZH_WORDS = ("昨天", "今天", "早上", "晚上", "午饭", "上个星期", "一起", "没有", "帮助", "附近", "打开", "关上", "看见", "找到", "修好", "卖掉", "绿色", "车票", "茶壶", "旧桥", "花园")


def _text():
    return F.col("text")


def _tokens():
    return tokens_model(F.col("text"))


#: Function words left out of term counts.
STOP = ["a", "an", "and", "as", "at", "but", "for", "from", "i", "in", "is", "it", "my", "near", "of", "on", "so", "that", "the", "then", "to", "too", "was", "we", "who", "you"]


def line_counts(s, d):
    return ops.scan(lines(s, d), [], "", "").select("source", "lines")


def longest_line(s, d):
    return ops.scan(lines(s, d), [], "", "").select("source", "longest")


def corpus_scan(s, d):
    return ops.scan(lines(s, d), ["the", "council"], "omg", "BELIEVE")


def quality_metrics(s, d):
    return ops.quality(lines(s, d))


def word_line_count(s, d):
    return ops.word_lines(lines(s, d), "the", ignore_case=True)


def word_ratio(s, d):
    return ops.word_ratio(lines(s, d), "before", "after")


def exact_line_count(s, d):
    return ops.exact_lines(lines(s, d), "omg")


def matching_lines(s, d):
    return ops.find_lines(lines(s, d), "council", 5, "line_id")


def distinct_matches(s, d):
    return ops.distinct_matches(lines(s, d), "LATE AT NIGHT")


def preview_lines(s, d):
    return ops.preview(lines(s, d), 3, "line_id")


def word_count_by_source(s, d):
    return ops.milestone(lines(s, d), _tokens())


def document_line_counts(s, d):
    docs = table(s, d, "documents").select("doc_id", source_name(F.col("source")).alias("source"), "text")
    return ops.document_lines(docs).groupBy("source").agg(F.count("*").alias("lines"), F.count_if(F.trim("text") == "").alias("blank"), F.max(F.length("text")).alias("longest"))


def length_histogram(s, d):
    return ops.length_histogram(lines(s, d), 5, _tokens())


def percentile_filter(s, d):
    return ops.below_percentile(lines(s, d), 0.99, _tokens())


def sentence_length_filter(s, d):
    return lines(s, d).where(F.size(_tokens()).between(2, 80)).groupBy("source").agg(F.count("*").alias("lines"))


def prediction_triggers(s, d):
    """Which prefixes a live front end would score, and which it refuses."""
    from lexloom.streaming.live import checked, ready

    rows = table(s, d, "development").select(checked(F.col("prefix"), F.lit("en"), ["en"]).alias("state"), F.coalesce(ready(F.col("prefix")), F.lit(False)).alias("ready"))
    return rows.groupBy("state", "ready").agg(F.count("*").alias("cases"))


def dialect_ascii(s, d):
    return lines(s, d).select("line_id", normalize_ascii(_text()).alias("normal"))


def dialect_case_study(s, d):
    return lines(s, d).select("line_id", normalize_ascii(_text(), entities=False).alias("normal"))


def dialect_letters(s, d):
    return lines(s, d).select("line_id", normalize_letters(_text()).alias("normal"))


def dialect_model(s, d):
    return lines(s, d).select("line_id", F.array_join(_tokens(), " ").alias("normal"))


def dialect_unicode(s, d):
    docs = table(s, d, "documents").where("text is not null")
    return docs.select(F.explode(tokens_unicode(_text())).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def model_tokens(s, d):
    docs = table(s, d, "documents").where("text is not null")
    return docs.select(F.explode(_tokens()).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def top_terms(s, d):
    return ngrams.top_terms(lines(s, d), tokens_ascii(_text()), 15)


def top_terms_nostop(s, d):
    return ngrams.top_terms(lines(s, d), tokens_ascii(_text()), 15, STOP, 2)


def blocked_filter_totals(s, d):
    rows = table(s, d, "development").where("prefix is not null").select(source_name(F.col("source")).alias("source"), F.col("prefix").alias("text"))
    return ngrams.without_blocked(rows, tokens_ascii(_text()), table(s, d, "blocked_terms"))


def pipeline_checks(s, d):
    """The pipeline's own checks, one row each."""
    rows = lines(s, d).select(F.explode(tokens_ascii(_text())).alias("w"))
    one = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("w").rlike("^[a-z]+(?:'+[a-z]+)*$")).alias("bad"), F.count_if(F.col("w") == "").alias("empty"))
    return one.select(F.explode(F.array(F.struct(F.lit("tokens found").alias("name"), (F.col("n") > 0).alias("ok")), F.struct(F.lit("only words").alias("name"), (F.col("bad") == 0).alias("ok")), F.struct(F.lit("no empty word").alias("name"), (F.col("empty") == 0).alias("ok")))).alias("c")).select("c.name", "c.ok")


def bernoulli_sample(s, d):
    return corpus.bernoulli(lines(s, d), "line_id", 0.02, 20260924).select("line_id", "source")


def sample_diagnostics(s, d):
    rows = lines(s, d).withColumn("sampled", F.expr("1"))
    drawn = corpus.bernoulli(rows, "line_id", 0.02, 20260924).groupBy("source").agg(F.count("*").alias("lines_sampled"))
    return rows.groupBy("source").agg(F.count("*").alias("lines_scanned")).join(drawn, "source", "left").select("source", "lines_scanned", F.coalesce("lines_sampled", F.lit(0)).alias("lines_sampled"), F.round(F.coalesce("lines_sampled", F.lit(0)) / F.col("lines_scanned"), 6).alias("sampling_rate"))


def exact_n_per_source(s, d):
    return corpus.exact_per_group(lines(s, d), "source", "line_id", 50, 7).select("source", "line_id")


def dedup_first_wins(s, d):
    return corpus.first_wins(lines(s, d), F.array_join(_tokens(), " "), ["source", "line_id"])


def split_counts(s, d):
    return lines(s, d).groupBy("source", corpus.split(F.col("line_id"), 20261101).alias("split"), corpus.nested(F.col("line_id"), 20261101).alias("small")).agg(F.count("*").alias("lines"))


def line_hashes(s, d):
    return lines(s, d).select("line_id", corpus.line_hash(_text()).alias("line_hash"))


def contamination_antijoin(s, d):
    """Development cases that no reserved hash names."""
    dev = table(s, d, "development").select("case_id", "line_hash")
    return audit.excluded(dev, table(s, d, "reserved_hashes"), F.col("line_hash")).select("case_id")


def overlap_audit(s, d):
    rows = table(s, d, "development").select("split", F.lower("line_hash").alias("h")).unionAll(table(s, d, "training_lines").select(F.lit("training"), F.lower("line_hash")))
    return audit.overlaps(rows, "split", "h")


def key_audit(s, d):
    return audit.duplicate_keys(table(s, d, "reserved_hashes").select(F.lower("line_hash").alias("h"), "reserve_role"), ["h", "reserve_role"])


def prefix_last_word(s, d):
    return corpus.last_word_cases(lines(s, d), "line_id", _tokens())


def prefix_random_pos(s, d):
    return corpus.random_cases(lines(s, d), "line_id", _tokens(), 20261001)


def training_positions(s, d):
    return corpus.training_positions(lines(s, d), "line_id", _tokens(), 6, 3)


def packed_blocks(s, d):
    return corpus.packed_blocks(lines(s, d), "source", "line_id", _tokens(), 128)


def permutation_schedule(s, d):
    return corpus.schedule(lines(s, d), "line_id", 8, 11)


def recipe_batches(s, d):
    """Six lines of blogs and two of news a batch."""
    rows = lines(s, d)
    return corpus.recipe([(rows.where("source = 'blogs'"), 6), (rows.where("source = 'news'"), 2)], "line_id", 11)


def unicode_word_count(s, d):
    """Words by Unicode word breaks, by language."""
    from lexloom.functions.unicode import word_count

    docs = table(s, d, "documents").where("text is not null")
    return docs.groupBy(F.lower("lang").alias("lang")).agg(F.count("*").alias("documents"), F.sum(word_count(_text())).alias("words"))


def composed_forms(s, d):
    """Texts that change under composition."""
    from lexloom.functions.unicode import nfc

    rows = table(s, d, "documents").where("text is not null")
    return rows.agg(F.count("*").alias("documents"), F.count_if(nfc(_text()) != _text()).alias("changed"))


def spaceless_words(s, d):
    """Words of Chinese documents by a lattice over a fixed small dictionary."""
    from lexloom.functions.unicode import tokens_phrase

    docs = table(s, d, "documents").where("text is not null and lower(lang) = 'zh'")
    return docs.select(F.explode(tokens_phrase(_text(), "chinese", {w: 10 for w in ZH_WORDS})).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def choice_distractors(s, d):
    counts = lines(s, d).select(F.explode(_tokens()).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))
    targets = cases(s, d).select(F.col("actual").alias("target"))
    return corpus.distractors(targets, counts)


_ALL = [
    line_counts, longest_line, corpus_scan, quality_metrics, word_line_count, word_ratio, exact_line_count, matching_lines, distinct_matches, preview_lines, word_count_by_source, document_line_counts, length_histogram,
    percentile_filter, sentence_length_filter, prediction_triggers, dialect_ascii, dialect_case_study, dialect_letters, dialect_model, dialect_unicode, model_tokens, top_terms, top_terms_nostop, blocked_filter_totals, pipeline_checks,
    bernoulli_sample, sample_diagnostics, exact_n_per_source, dedup_first_wins, split_counts, line_hashes, contamination_antijoin, overlap_audit, key_audit, prefix_last_word, prefix_random_pos, training_positions, packed_blocks,
    permutation_schedule, recipe_batches, unicode_word_count, composed_forms, spaceless_words, choice_distractors,
]
QUERIES = {f.__name__: f for f in _ALL}

_T = words("text")
_A = ASCII.format("text")
_IN = lambda w: f"(^|[^\\p{{L}}\\p{{N}}_]){w}([^\\p{{L}}\\p{{N}}_]|$)"
_SMALL = bucket("line_id", 1_000_000, "nested 20261101")
_SPLIT = bucket("line_id", 100, "20261101")
_STOP = ", ".join(f"'{w}'" for w in STOP)
_AT = f"(2 + {bucket('line_id', 1_000_000, '20261001')} % (len(t) - 1))"
_TL = f"(select line_id, source, {_T} as t from {LINES})"
_COUNTS = f"(select word, count(*) as cnt from (select unnest(t) as word from {_TL}) group by 1)"
ORACLE = {
    "line_counts": f"select source, count(*) as lines from {LINES} where text is not null group by 1",
    "longest_line": f"select source, max(length(text)) as longest from {LINES} where text is not null group by 1",
    "corpus_scan": f"select source, count(*) as lines, max(length(text)) as longest, count(*) filter (contains(text, 'the')) as with_the, count(*) filter (contains(text, 'council')) as with_council, count(*) filter (text = 'omg') as exact, count(*) filter (contains(lower(text), 'believe')) as matching from {LINES} where text is not null group by 1",
    "quality_metrics": f"select source, count(*) as lines, count(*) filter (trim(text) = '') as empty, count(*) filter (regexp_matches(lower(text), 'https?://|www\\.')) as with_url, count(*) filter (regexp_matches(text, '@[\\p{{L}}\\p{{N}}_]')) as with_mention, quantile_cont(length(text), 0.5)::double as median_characters, max(length(text)) as most_characters from {LINES} where text is not null group by 1",
    "word_line_count": f"select source, count(*) filter (regexp_matches(lower(text), '{_IN('the')}')) as lines from {LINES} where text is not null group by 1",
    "word_ratio": f"select source, round(count(*) filter (regexp_matches(text, '{_IN('before')}')) / nullif(count(*) filter (regexp_matches(text, '{_IN('after')}')), 0), 6) as ratio from {LINES} where text is not null group by 1",
    "exact_line_count": f"select count(*) filter (text = 'omg') as lines from {LINES}",
    "matching_lines": f"select * from (select source, line_id, text, row_number() over (partition by source order by line_id) as n from {LINES} where regexp_matches(text, '{_IN('council')}')) where n <= 5",
    "distinct_matches": f"select distinct text from {LINES} where contains(lower(text), 'late at night')",
    "preview_lines": f"select source, n, text from (select *, row_number() over (partition by source order by line_id) as n from {LINES} where text is not null) where n <= 3",
    "word_count_by_source": f"select source, count(*) as lines, sum(len({_T}))::bigint as words, round(sum(len({_T})) / count(*), 6) as words_per_line from {LINES} where text is not null group by 1",
    "document_line_counts": f"select source, count(*) as lines, count(*) filter (trim(l, ' ') = '') as blank, max(length(l)) as longest from (select {SOURCE} as source, unnest(string_split(text, chr(10))) as l from documents where text is not null) group by 1",
    "length_histogram": f"select source, (len({_T}) // 5 * 5)::bigint as bin, count(*) as lines from {LINES} where text is not null group by 1, 2",
    "percentile_filter": f"with r as (select source, len({_T}) as words from {LINES} where text is not null), q as (select source, quantile_cont(words, 0.99) as lim from r group by 1) select source, any_value(lim) as \"limit\", count(*) as lines, max(words) as longest from r join q using (source) where words <= lim group by 1",
    "sentence_length_filter": f"select source, count(*) as lines from {_TL} where len(t) between 2 and 80 group by 1",
    "prediction_triggers": "select case when prefix is null or trim(prefix, ' ') = '' then 'empty' when length(prefix) > 500 then 'too_long' else 'ok' end as state, coalesce(regexp_matches(prefix, '[\\s.!?;:,]$') or length(prefix) > 500, false) as ready, count(*) as cases from development group by 1, 2",
    "dialect_ascii": f"select line_id, {ASCII_TEXT.format('text')} as normal from training_lines",
    "dialect_case_study": f"select line_id, {ASCII_RAW.format('text')} as normal from training_lines",
    "dialect_letters": f"select line_id, {LETTERS_TEXT.format('text')} as normal from training_lines",
    "dialect_model": f"select line_id, array_to_string({_T}, ' ') as normal from training_lines",
    "dialect_unicode": f"select word, count(*) as cnt from (select unnest({words('text', UNICODE)}) as word from documents where text is not null) group by 1",
    "model_tokens": f"select word, count(*) as cnt from (select unnest({_T}) as word from documents where text is not null) group by 1",
    "top_terms": f"select token, count(*) as frequency from (select unnest({_A}) as token from training_lines) group by 1 order by 2 desc, 1 limit 15",
    "top_terms_nostop": f"select token, count(*) as frequency from (select unnest({_A}) as token from training_lines) where length(token) >= 2 and token not in ({_STOP}) group by 1 order by 2 desc, 1 limit 15",
    "blocked_filter_totals": f"with c as (select {SOURCE} as source, unnest({ASCII.format('prefix')}) as w from development where prefix is not null), b as (select distinct lower(term) as w from blocked_terms) select source, count(*) as raw, count(*) filter (w in (select w from b)) as removed, count(*) filter (w not in (select w from b)) as kept, count(distinct w) filter (w not in (select w from b)) as distinct_kept from c group by 1",
    "pipeline_checks": f"with w as (select unnest({_A}) as w from training_lines) select 'tokens found' as name, count(*) > 0 as ok from w union all select 'only words', count(*) filter (not regexp_matches(w, '^[a-z]+(?:''+[a-z]+)*$')) = 0 from w union all select 'no empty word', count(*) filter (w = '') = 0 from w",
    "bernoulli_sample": f"select line_id, source from {LINES} where {bucket('line_id', 1_000_000, '20260924')} < 20000",
    "sample_diagnostics": f"select source, count(*) as lines_scanned, count(*) filter ({bucket('line_id', 1_000_000, '20260924')} < 20000) as lines_sampled, round(count(*) filter ({bucket('line_id', 1_000_000, '20260924')} < 20000) / count(*), 6) as sampling_rate from {LINES} group by 1",
    "exact_n_per_source": f"select source, line_id from (select source, line_id, row_number() over (partition by source order by sha256('7:' || line_id), line_id) as n from {LINES}) where n <= 50",
    "dedup_first_wins": f"select normal, source, line_id from (select *, row_number() over (partition by normal order by source, line_id) as n from (select array_to_string({_T}, ' ') as normal, source, line_id from {LINES}) where normal <> '') where n = 1",
    "split_counts": f"select source, case when {_SPLIT} < 80 then 'train' when {_SPLIT} < 90 then 'validation' else 'test' end as split, {_SMALL} < 250000 as small, count(*) as lines from {LINES} group by 1, 2, 3",
    "line_hashes": "select line_id, sha256(text) as line_hash from training_lines",
    "contamination_antijoin": "select case_id from development where line_hash is null or lower(line_hash) not in (select lower(line_hash) from reserved_hashes where line_hash is not null)",
    "overlap_audit": "with r as (select split, lower(line_hash) as h from development where line_hash is not null union select 'training', lower(line_hash) from training_lines where line_hash is not null) select x.split as a, y.split as b, count(*) as keys from r x join r y on x.h = y.h and x.split < y.split group by 1, 2",
    "key_audit": "with p as (select lower(line_hash) as h, reserve_role, count(*) as n from reserved_hashes group by 1, 2) select sum(n)::bigint as rows, count(*) as distinct_keys, count(*) filter (n > 1) as repeated from p",
    "prefix_last_word": f"select line_id, array_to_string(t[1:len(t) - 1], ' ') as prefix, t[len(t)] as actual from {_TL} where len(t) >= 2",
    "prefix_random_pos": f"select line_id, array_to_string(t[1:{_AT} - 1], ' ') as prefix, t[{_AT}] as actual from {_TL} where len(t) >= 3",
    "training_positions": f"select line_id, place as \"at\", t[place] as word from (select *, row_number() over (partition by line_id order by sha256('3:' || line_id || ':' || place), place) as n from (select line_id, t, unnest(range(2, len(t) + 1))::int as place from {_TL} where len(t) >= 2)) where n <= 6",
    "packed_blocks": f"select source, block, count(*) as tokens from (select source, (row_number() over (partition by source order by line_id, k) - 1) // 128 as block from (select source, line_id, unnest(range(len(t))) as k from {_TL})) group by 1, 2",
    "permutation_schedule": f"select line_id, (n - 1) // 8 as step, (n - 1) % 8 as slot from (select line_id, row_number() over (order by sha256('11:' || line_id), line_id) as n from {LINES})",
    "recipe_batches": f"with b as (select line_id, row_number() over (order by sha256('11:' || line_id), line_id) - 1 as n from {LINES} where source = 'blogs'), w as (select line_id, row_number() over (order by sha256('12:' || line_id), line_id) - 1 as n from {LINES} where source = 'news'), a as (select n // 6 as step, n % 6 as slot, 0 as part, line_id from b union all select n // 2, n % 2 + 6, 1, line_id from w) select * from a where step < least((select count(*) from b) // 6, (select count(*) from w) // 2)",
    "composed_forms": "select count(*) as documents, count(*) filter (nfc_normalize(text) <> text) as changed from documents where text is not null",
    "choice_distractors": f"with r as (select word, row_number() over (order by cnt desc, word) as rank from {_COUNTS}), t as (select distinct actual as target from {CASES}), k as (select target, coalesce(rank, (select max(rank) from r)) as place from t left join r on r.word = t.target) select target, word, rank, n from (select target, word, rank, row_number() over (partition by target order by sha256('1:' || target || ':' || word), word) as n from k join r on abs(rank - place) <= 250 and word <> target) where n <= 3",
}
