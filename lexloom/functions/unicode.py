"""What the JVM side lacks: composed forms and words of scripts without blanks. Arrow batches, a plain function each."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import tokens_model, tokens_unicode


def nfc(text: Column) -> Column:
    """Text in composed form; null stays null. ASCII texts, which are composed already, never leave the JVM."""

    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.when(text.rlike(r"[^\x00-\x7F]"), composed(text)).otherwise(text)


def segment(text: str, costs: Mapping[str, float], longest: int) -> list[str]:
    """The cheapest path through the word lattice of a text without blanks: words cost what ``costs`` says, an unknown
    character more than any word. Marks and blanks separate and are dropped."""
    out: list[str] = []
    run = ""
    for c in text + " ":
        if c.isalnum():
            run += c
            continue
        n = len(run)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for i in range(n):
            for j in range(i + 1, min(n, i + longest) + 1):
                w = costs.get(run[i:j])
                w = 20.0 if w is None and j == i + 1 else w
                if w is not None and best[i] + w < best[j]:
                    best[j], back[j] = best[i] + w, i
        words, j = [], n
        while j:
            words.append(run[back[j] : j])
            j = back[j]
        out += reversed(words)
        run = ""
    return out


def tokens_spaceless(text: Column, counts: Mapping[str, int]) -> Column:
    """Words of a script without blanks by a unigram lattice over ``counts``, a dictionary of bounded size."""
    total = sum(counts.values()) or 1
    costs = {w: -math.log(c / total) for w, c in counts.items() if c > 0}
    longest = max(map(len, costs), default=1)

    @F.pandas_udf("array<string>")
    def words(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else segment(unicodedata.normalize("NFC", t).lower(), costs, longest))

    return words(text)


def tokens_phrase(text: Column, tokenizer: str, counts: Mapping[str, int] | None = None) -> Column:
    """Words of a typed phrase under one of three tokenizers: english, unicode, chinese."""
    if tokenizer == "english":
        return tokens_model(text)
    if tokenizer == "unicode":
        return tokens_unicode(nfc(text))
    if tokenizer == "chinese":
        return tokens_spaceless(text, counts or {})
    raise ValueError(f"unknown tokenizer: {tokenizer}")


def word_count(text: Column) -> Column:
    """Words by Unicode word breaks."""
    return F.size(F.filter(F.flatten(F.sentences(F.coalesce(text, F.lit("")), F.lit("en"), F.lit("US"))), lambda w: w.rlike(r"[\p{L}\p{N}]")))
