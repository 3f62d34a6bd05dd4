"""Classification by a taxonomy of terms, and validation of model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.numbers import clamp
from tamarack.functions.text import normalize_text

Taxonomy = list[tuple[str, list[str]]]  # (category, its normalised terms), in order of preference


def _terms(taxonomy: Taxonomy) -> Column:
    """Terms longest first; of equal length in the taxonomy's order."""
    flat = sorted(((t, c) for c, terms in taxonomy for t in terms), key=lambda x: -len(x[0]))
    return F.array(*(F.struct(F.lit(t).alias("term"), F.lit(c).alias("category"), F.lit(" " in t).alias("many")) for t, c in flat))


def classify(category_text: Column, name: Column, taxonomy: Taxonomy) -> Column:
    """Struct category, confidence, term. The category text is asked first (0.95 for terms of several words,
    0.85 for one), then the name (0.70, 0.55), else ``other`` with 0.2. One word matches a whole word,
    several match anywhere."""
    terms = _terms(taxonomy)

    def match(text: Column) -> Column:
        padded = F.concat(F.lit(" "), text, F.lit(" "))
        return F.get(F.filter(terms, lambda t: F.when(t["many"], F.contains(text, t["term"])).otherwise(F.contains(padded, F.concat(F.lit(" "), t["term"], F.lit(" "))))), F.lit(0))

    by_category, by_name = match(normalize_text(category_text)), match(normalize_text(name))
    result = lambda m, many, one: F.struct(m["category"].alias("category"), F.when(m["many"], many).otherwise(one).alias("confidence"), m["term"].alias("term"))
    return (
        F.when(by_category.isNotNull(), result(by_category, 0.95, 0.85))
        .when(by_name.isNotNull(), result(by_name, 0.70, 0.55))
        .otherwise(F.struct(F.lit("other").alias("category"), F.lit(0.2).alias("confidence"), F.lit(None).cast("string").alias("term")))
    )


def query_category(query: Column, taxonomy: Taxonomy, excluded: tuple[str, ...] = ()) -> Column:
    """Category of the longest term where the query holds the term or the term the query; null if none."""
    q = normalize_text(query)
    terms = F.filter(_terms(taxonomy), lambda t: ~t["category"].isin(*excluded) if excluded else F.lit(True))
    found = F.filter(terms, lambda t: F.contains(q, t["term"]) | F.contains(t["term"], q))
    return F.when(q != "", F.get(found, F.lit(0))["category"])


def category_keywords(taxonomy: Taxonomy, category: Column) -> Column:
    """Label and terms of a category as one array."""
    table = F.create_map(*[x for c, terms in taxonomy for x in (F.lit(c), F.array(*(F.lit(t) for t in [c, *terms])))])
    return F.coalesce(F.element_at(table, category), F.array().cast("array<string>"))


RESPONSE = "summary string, score double, priority string, strengths array<string>, issues array<string>, services array<string>"
PRIORITIES = ("low", "medium", "high")


def validate_responses(responses: DataFrame, schema: str = RESPONSE) -> tuple[DataFrame, DataFrame]:
    """(request_id, text) of model output to (usable rows with typed fields, unusable rows).

    JSON is taken from a fence, from the whole text, or from the first to the last brace. Score is
    clamped to 0..100 (0 if it is none), priority falls back to ``low``, blank entries go, lists are cut.
    """
    text = F.trim("text")
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    candidate = F.when(fenced != "", F.trim(fenced)).otherwise(text)
    braces = F.regexp_extract(candidate, r"(?s)(\{.*\})", 1)
    parse = lambda c: F.from_json(F.when(F.try_parse_json(c).isNotNull() & c.startswith("{"), c), schema, {"mode": "PERMISSIVE"})
    parsed = responses.withColumn("j", F.coalesce(parse(candidate), parse(braces)))
    some = lambda name, n: F.slice(F.filter(F.coalesce(F.col(f"j.{name}"), F.array().cast("array<string>")), lambda x: F.trim(x) != ""), 1, n).alias(name)
    good = parsed.where("j is not null").select(
        "request_id",
        F.coalesce("j.summary", F.lit("")).alias("summary"),
        clamp(F.col("j.score")).alias("score"),
        F.when(F.col("j.priority").isin(*PRIORITIES), F.col("j.priority")).otherwise("low").alias("priority"),
        some("strengths", 15), some("issues", 25), some("services", 20),
    )
    return good, parsed.where("j is null").select("request_id", "text")
