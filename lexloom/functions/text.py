"""Text expressions that stay inside the JVM. Each dialect is kept apart on purpose: they count differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest runs of letters and numbers.
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case, drop ' and ’, take every longest run of letters and numbers. Null gives an empty array."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), "'’", ""), F.lit(WORD), F.lit(0))


def letters(text: Column) -> Column:
    """Lower-cased letters and numbers only, everything else removed."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def source_name(source: Column) -> Column:
    """Source names differ in case and outer blanks only."""
    return F.lower(F.trim(source))


def bucket(key: Column, buckets: int, seed: str = "") -> Column:
    """A stable bucket in [0, buckets) from SHA-256, the same in every engine and partitioning."""
    text = key.cast("string") if not seed else F.concat(F.lit(seed + ":"), key.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


# --- four normalisation dialects -------------------------------------------------------------

_URL = r"https?://\S+|www\.\S+"


def normalize_ascii(text: Column, entities: bool = True) -> Column:
    """ASCII dialect: URLs, mentions and (optionally) entities become blanks, everything but a-z and ' becomes a
    blank, edge quotes go, blanks are squeezed. Null becomes ''."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, _URL, " ")
    t = F.regexp_replace(t, r"@[a-z0-9_]+", " ")
    if entities:
        t = F.regexp_replace(t, r"&[a-z]+;", " ")
    t = F.regexp_replace(t, r"[^a-z']", " ")
    t = F.regexp_replace(t, r"(^|\s)'+", "$1")
    t = F.regexp_replace(t, r"'+(\s|$)", "$1")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def tokens_ascii(text: Column, entities: bool = True) -> Column:
    return F.filter(F.split(normalize_ascii(text, entities), " "), lambda w: w != "")


def normalize_letters(text: Column) -> Column:
    """As :func:`normalize_ascii`, with every Unicode letter kept."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, _URL, " ")
    t = F.regexp_replace(t, r"@[\p{L}\p{N}_]+", " ")
    t = F.regexp_replace(t, r"&[a-z]+;", " ")
    t = F.regexp_replace(t, r"[^\p{L}']", " ")
    t = F.regexp_replace(t, r"(^|\s)'+", "$1")
    t = F.regexp_replace(t, r"'+(\s|$)", "$1")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def _strip(text: Column) -> Column:
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), "’‘", "''")
    return F.regexp_replace(t, _URL + r"|@[\p{L}\p{N}_]+|&[a-z]+;", " ")


def tokens_model(text: Column) -> Column:
    """Model dialect: curly quotes fold to ', then runs of a-z joined by single quotes are extracted."""
    return F.regexp_extract_all(_strip(text), F.lit(r"[a-z]+(?:'[a-z]+)*"), F.lit(0))


def tokens_unicode(text: Column) -> Column:
    """Unicode dialect: a letter with its marks, runs joined by single quotes."""
    return F.regexp_extract_all(_strip(text), F.lit(r"[\p{L}][\p{L}\p{M}]*(?:'[\p{L}][\p{L}\p{M}]*)*"), F.lit(0))


def normalize_model(text: Column) -> Column:
    return F.array_join(tokens_model(text), " ")


def tokens_letters(text: Column) -> Column:
    return F.filter(F.split(normalize_letters(text), " "), lambda w: w != "")
