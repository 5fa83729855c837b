"""Copies hidden by formatting: canonical content keys and the collapse of equal content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import letters
from lexloom.operators.ordered import adjacent_runs
from lexloom.session import cut

#: Names that open a field of a record.
FIELD_NAMES = ("topic", "mood", "place", "body")

_IN, _IS = "\u0001", "\u0002"


def content_key(text: Column, names: tuple[str, ...] = FIELD_NAMES) -> Column:
    """The content of a text whatever its formatting; null for null texts and texts without letters or numbers.

    Running text: its letters and numbers, lower-cased. A record of named fields (a JSON object, ``name: value |
    name: value``, ``name=value; name=value``; at least two fields, the text opening with one): the same of each name
    and value, sorted by name, so that neither notation nor order matters. Case, blanks, marks, quotes and escapes
    of JSON strings never count.
    """
    field = "(?i)(?:^|[;|\\n{,])\\s*[\"“”']?(" + "|".join(names) + ")[\"“”']?\\s*[:=]"
    # in JSON, escapes inside strings stand for other characters
    text = F.when(text.rlike(r"^\s*\{") & text.contains("\\"), F.coalesce(_unescaped(text), text)).otherwise(text)
    marked = F.regexp_replace(F.translate(text, _IN + _IS, ""), field, f"{_IN}$1{_IS}")
    parts = F.filter(F.split(marked, _IN), lambda p: letters(p) != "")
    is_record = (F.size(parts) >= 2) & F.forall(parts, lambda p: p.contains(_IS))
    values = F.transform(parts, lambda p: F.concat(letters(F.substring_index(p, _IS, 1)), F.lit(_IS), letters(F.substring_index(p, _IS, -1))))
    # the regular expression is tried only where a field name opens the text
    opens = text.rlike("(?i)^[\\s{\"“”']*(" + "|".join(names) + ")[\"“”']?\\s*[:=]")
    key = F.when(opens & is_record, F.concat(F.lit(_IN), F.array_join(F.sort_array(values), _IN))).otherwise(letters(text))
    return F.when(letters(text) != "", key)


def _unescaped(text: Column) -> Column:
    fields = F.map_entries(F.from_json(text, "map<string,string>"))
    return F.array_join(F.transform(fields, lambda e: F.concat(F.lit("\n"), e["key"], F.lit("="), e["value"])), "")


def copies(df: DataFrame, id: str = "case_id", text: str = "prefix") -> DataFrame:
    """(id, head): each text with content, and the smallest id of its content.

    Canonical keys are range-partitioned and sorted, neighbours are compared in full. Repeated rows with one id stay
    rows; null ids are left out; other columns of ``df`` are ignored.
    """
    # written, so that neither the sample of the range partitioning nor the shuffle computes the keys again
    keyed = cut(df.select(F.col(id).alias("id"), content_key(F.col(text)).alias("key")).where("key is not null"), "keys")
    return adjacent_runs(keyed, "key", "id")


def superfluous(df: DataFrame, id: str = "case_id", text: str = "prefix") -> DataFrame:
    """(keep_id, case_id): one row for each copy beyond the one kept."""
    return copies(df, id, text).where("id <> head").select(F.col("head").alias("keep_id"), F.col("id").alias("case_id"))


def collapsed(df: DataFrame, id: str = "case_id", text: str = "prefix") -> DataFrame:
    """(keep_id, copies): one row for each content, with the number of rows that carry it."""
    return copies(df, id, text).groupBy(F.col("head").alias("keep_id")).agg(F.count("*").alias("copies"))
