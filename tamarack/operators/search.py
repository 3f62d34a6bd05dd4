"""What searches share: stems, requests and their limits, members of the index, notes. See ``postings`` for the index."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_TRIGRAM, EMPTY_RANK, CATEGORY_RANK = 0.3, 0.35, 0.6
# Frequent words of Spanish and English that a query needn't find.
STOP_WORDS = ("de", "la", "el", "los", "las", "en", "y", "a", "que", "un", "una", "the", "of", "and", "in", "to")


def stem(word: Column) -> Column:
    """A light stem: plural endings of words of more than four letters go, then a final vowel."""
    plural = F.when(F.length(word) > 4, F.regexp_replace(word, "(es|s)$", "")).otherwise(word)
    return F.when(F.length(plural) > 4, F.regexp_replace(plural, "[aeo]$", "")).otherwise(plural)


def light_stems(words: Column) -> Column:
    """:func:`stem` of each word of an array."""
    return F.transform(words, stem)


def top_k(rows: DataFrame, k: int, least: int = 1, most: int = 25) -> DataFrame:
    """The shortlist: opportunity, relevance, reviews (nulls last), id; k is clamped."""
    k = max(least, min(most, k))
    return rows.orderBy(F.desc("opportunity"), F.desc("relevance"), F.desc_nulls_last("reviews"), "id").limit(k)


def request_limit(asked: float | None, default: int = 10, most: int = 25) -> int:
    """How many results a request gets: the default where it names no number, else a whole number from 1 to ``most``."""
    if asked is None or not math.isfinite(asked):
        return default
    return max(1, min(most, math.floor(asked)))


def requested(rows: DataFrame, limit: float | None = None, category: str | None = None, least: int | None = None, most: int = 25) -> DataFrame:
    """The shortlist of rows that a request asks for; a category that is no key, or a floor outside 0 to 100, is an error."""
    if category is not None and not re.fullmatch("[a-z_]{2,40}", category.strip()):
        raise ValueError("a category must be a key of the taxonomy")
    if least is not None and not 0 <= least <= 100:
        raise ValueError("the least score must lie in 0 to 100")
    if category is not None:
        rows = rows.where(F.col("category") == category.strip())
    if least is not None:
        rows = rows.where(F.col("opportunity") >= least)
    return top_k(rows, request_limit(limit, most=most), most=most)


def index_members(scored: DataFrame, least_location: float = 0.7) -> DataFrame:
    """Scored entities that belong to the search index; a null in any of the four conditions keeps a row out."""
    return scored.where(F.col("qualified") & F.col("in_scope") & (F.col("status") == "active") & (F.col("location_confidence") >= least_location))


def result_note(found: Column, asked: Column, place: Column) -> Column:
    """A remark where the list is shorter than what was asked for, else null."""
    none = F.concat(F.lit("No "), place, F.lit(" businesses currently meet the quality threshold for this search."))
    few = F.concat(
        F.lit("Only "), found.cast("string"), F.lit(" "), place, F.when(found == 1, " business meets").otherwise(" businesses meet"),
        F.lit(" the quality threshold, so the list is not padded."),
    )
    return F.when(found >= asked, F.lit(None)).when(found == 0, none).otherwise(few)
