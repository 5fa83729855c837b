"""Table adapters and SQL pieces that queries share."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions.text import source_name
from lexloom.session import table


def lines(spark, d):
    """The training split as a corpus: (line_id, source, text)."""
    return table(spark, d, "training_lines").select("line_id", source_name(F.col("source")).alias("source"), "text")


def cases(spark, d):
    """Evaluation cases with a prefix and a target: (case_id, source, prefix, actual)."""
    return table(spark, d, "development").where("prefix is not null and actual is not null").select("case_id", source_name(F.col("source")).alias("source"), "prefix", F.lower("actual").alias("actual"))


def prefixes(spark, d):
    """All cases with a prefix, whether their target is known or not: (case_id, source, prefix, actual)."""
    return table(spark, d, "development").where("prefix is not null").select("case_id", source_name(F.col("source")).alias("source"), "prefix", F.lower("actual").alias("actual"))


def scores(spark, d):
    """(case_id, word, score): the best valid probability of each case and word."""
    words = table(spark, d, "vocabulary")
    s = table(spark, d, "candidate_scores").where("cpu_probability is not null and not isnan(cpu_probability)")
    return s.groupBy("case_id", "word_id").agg(F.max("cpu_probability").alias("score")).join(words, "word_id").select("case_id", "word", "score")


SOURCE = "lower(trim(source))"
STRIP = "regexp_replace(translate(lower(coalesce({0}, '')), '’‘', ''''''), 'https?://\\S+|www\\.\\S+|@[\\p{{L}}\\p{{N}}_]+|&[a-z]+;', ' ', 'g')"
MODEL = f"regexp_extract_all({STRIP}, '[a-z]+(?:''[a-z]+)*')"
UNICODE = f"regexp_extract_all({STRIP}, '[\\p{{{{L}}}}][\\p{{{{L}}}}\\p{{{{M}}}}]*(?:''[\\p{{{{L}}}}][\\p{{{{L}}}}\\p{{{{M}}}}]*)*')"
_URLS = "regexp_replace(lower(coalesce({0}, '')), 'https?://\\S+|www\\.\\S+', ' ', 'g')"
_MENTIONS = f"regexp_replace({_URLS}, '@[a-z0-9_]+', ' ', 'g')"
_ENTITIES = f"regexp_replace({_MENTIONS}, '&[a-z]+;', ' ', 'g')"


def _quotes(inner: str, keep: str) -> str:
    t = f"regexp_replace({inner}, '{keep}', ' ', 'g')"
    t = f"regexp_replace({t}, '(^|\\s)''+', '\\1', 'g')"
    t = f"regexp_replace({t}, '''+(\\s|$)', '\\1', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


ASCII_TEXT = _quotes(_ENTITIES, "[^a-z'']")
ASCII_RAW = _quotes(_MENTIONS, "[^a-z'']")
LETTERS_TEXT = _quotes(f"regexp_replace(regexp_replace({_URLS}, '@[\\p{{{{L}}}}\\p{{{{N}}}}_]+', ' ', 'g'), '&[a-z]+;', ' ', 'g')", "[^\\p{{L}}'']")
ASCII = f"list_filter(string_split({ASCII_TEXT}, ' '), lambda w: w <> '')"
LETTERS = f"list_filter(string_split({LETTERS_TEXT}, ' '), lambda w: w <> '')"


def words(column: str, dialect: str = MODEL) -> str:
    return dialect.format(column)


def bucket(key: str, n: int, seed: str = "") -> str:
    text = f"'{seed}:' || ({key})" if seed else f"({key})::varchar"
    return f"(('0x' || substr(sha256({text}), 1, 8))::bigint % {n})"


LINES = f"(select line_id, {SOURCE} as source, text from training_lines)"
CASES = f"(select case_id, {SOURCE} as source, prefix, lower(actual) as actual from development where prefix is not null and actual is not null)"
PREFIXES = f"(select case_id, {SOURCE} as source, prefix, lower(actual) as actual from development where prefix is not null)"
SCORES = "(select case_id, word, score from (select case_id, word_id, max(cpu_probability) as score from candidate_scores where cpu_probability is not null and not isnan(cpu_probability) group by 1, 2) join vocabulary using (word_id))"
