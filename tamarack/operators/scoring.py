"""Scores of entities, each with its reasons, and the gate to the shortlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.numbers import clamp, round_half_up
from tamarack.operators.sites import WEIGHTS as WEIGHT_OF
from tamarack.operators.sites import issue_weight

# Words of high-value services, neutral category value, weights, thresholds.
HIGH_VALUE_SERVICES = (
    "implante", "implant", "ortodoncia", "invisalign", "estetica dental", "cirugia", "surgery", "injerto",
    "transplante", "laser", "reforma integral", "obra nueva", "promocion", "chalet", "villa", "penthouse", "wedding",
    "boda", "evento corporativo", "charter", "private tour", "tratamiento", "financiacion", "presupuesto",
    "consultoria",
)
NEUTRAL_VALUE = 45.0
WEIGHTS = (0.35, 0.25, 0.40)
MIN_QUALITY, MIN_VALUE, MIN_DIGITAL, MIN_TOTAL, MIN_EVIDENCE, MIN_LOCATION = 28, 35, 20, 45, 0.35, 0.7


_REASONS = "array<struct<code: string, points: double, impact: string>>"


def _reason(code: str, points: Column | float, when: Column) -> Column:
    points = points if isinstance(points, Column) else F.lit(float(points))
    impact = F.when(points < 0, "negative").otherwise("positive")
    return F.when(when, F.struct(F.lit(code).alias("code"), points.cast("double").alias("points"), impact.alias("impact")))


def _reasons(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda r: r.isNotNull())


def business_quality(
    rating: Column, reviews: Column, evidence_score: Column, sources: Column, phone: Column, address: Column, website: Column, socials: Column
) -> tuple[Column, Column]:
    """(score, reasons): 0.55 reputation, 0.30 evidence, 0.15 establishment."""
    n = F.coalesce(reviews, F.lit(0)).cast("double")
    volume = F.when(n <= 0, 0.0).otherwise(clamp(33.3 * F.log10(n + 1)))
    quality = F.when(rating.isNull(), 0.0).otherwise(clamp((rating - 3) / 2 * 100))
    reviewed = (n > 0) & rating.isNotNull()
    reputation = F.when(reviewed, 0.55 * volume + 0.45 * quality).otherwise(F.lit(22.0))
    evidence = clamp(evidence_score * 100)
    plus = lambda flag, points: F.when(flag, float(points)).otherwise(0.0)
    establishment = clamp(plus(phone, 30) + plus(address, 30) + plus(website, 25) + F.least(F.lit(15.0), 7.5 * socials))
    score = round_half_up(clamp(0.55 * reputation + 0.3 * evidence + 0.15 * establishment))
    v, q = round_half_up(0.55 * volume), 0.45 * quality
    reasons = _reasons(
        _reason("very_high_review_volume", v, reviewed & (n >= 400)),
        _reason("high_review_volume", v, reviewed & (n >= 100) & (n < 400)),
        _reason("meaningful_review_volume", v, reviewed & (n >= 25) & (n < 100)),
        _reason("low_review_volume", round_half_up(0.55 * volume - 25), reviewed & (n < 25)),
        _reason("excellent_rating", round_half_up(q), reviewed & (rating >= 4.7)),
        _reason("strong_rating", round_half_up(q), reviewed & (rating >= 4.3) & (rating < 4.7)),
        _reason("weak_rating", round_half_up(q - 30), reviewed & (rating < 3.8)),
        _reason("no_review_evidence", -20, ~reviewed),
        _reason("corroborated_by_multiple_sources", round_half_up(0.12 * evidence), sources >= 2),
        _reason("thin_public_evidence", -12, (sources < 2) & (evidence_score < 0.4)),
        _reason("established_presence", round_half_up(0.15 * establishment), phone & address),
    )
    return score, reasons


def commercial_value(base: Column, confidence: Column, reviews: Column, services: Column, transactional: Column) -> tuple[Column, Column]:
    """(score, reasons): the category's value drawn to the neutral one by doubt, plus scale, services, transactions."""
    sure = clamp(confidence, 0.0, 1.0)
    category = base * sure + NEUTRAL_VALUE * (1 - sure)
    n = F.coalesce(reviews, F.lit(0))
    scale = F.when(n >= 500, 8.0).when(n >= 150, 5.0).otherwise(0.0)
    lowered = F.transform(F.coalesce(services, F.array().cast("array<string>")), F.lower)
    terms = F.array(*(F.lit(t) for t in HIGH_VALUE_SERVICES))
    matched = F.size(F.filter(terms, lambda t: F.exists(lowered, lambda s: F.contains(s, t))))
    service = F.least(F.lit(8.0), 3.0 * matched)
    selling = F.when(F.coalesce(transactional, F.lit(False)), 4.0).otherwise(0.0)
    score = round_half_up(clamp(category + scale + service + selling))
    reasons = _reasons(
        _reason("high_value_category", round_half_up(0.8 * category), base >= 85),
        _reason("solid_value_category", round_half_up(0.8 * category), (base >= 65) & (base < 85)),
        _reason("low_value_category", round_half_up(0.8 * category - 40), base < 65),
        _reason("uncertain_category", -8, sure < 0.5),
        _reason("large_operation", 8, n >= 500),
        _reason("substantial_operation", 5, (n >= 150) & (n < 500)),
        _reason("high_value_services", service, matched > 0),
        _reason("transactional_intent", 4, F.coalesce(transactional, F.lit(False))),
    )
    return score, reasons


def digital_opportunity(has_website: Column, reachable: Column, http_status: Column, audit_missing: Column, codes: Column, socials: Column) -> Column:
    """No site 62 (70 with social profiles); confirmed error 84; no response 52; unaudited 40; else 8 and the weights."""
    up = F.coalesce(reachable, F.lit(False))
    return round_half_up(
        F.when(~has_website, F.lit(62.0) + F.when(socials > 0, 8.0).otherwise(0.0))
        .when(~up & http_status.isNotNull(), 84.0)
        .when(~up, 52.0)
        .when(audit_missing, 40.0)
        .otherwise(clamp(8.0 + issue_weight(codes)))
    )


def digital_reasons(has_website: Column, reachable: Column, http_status: Column, audit_missing: Column, codes: Column, socials: Column) -> Column:
    """What the score of digital_opportunity rests on; a site that didn't answer, or wasn't audited, gives no reason for or against."""
    up, weight = F.coalesce(reachable, F.lit(False)), issue_weight(codes)
    none = F.array().cast(_REASONS)
    known = F.filter(codes, lambda x: issue_weight(F.array(x)) > 0)
    heaviest = F.slice(F.array_sort(F.transform(known, lambda x, i: F.struct((-issue_weight(F.array(x))).alias("k"), i.alias("i"), x.alias("code")))), 1, 6)
    found = F.transform(heaviest, lambda x: F.struct(x["code"].alias("code"), (-x["k"]).cast("double").alias("points"), F.lit("positive").alias("impact")))
    small = _reasons(
        _reason("site_already_strong", -20, F.size(known) == 0), _reason("minor_issues_only", -10, (F.size(known) > 0) & (weight < 15))
    )
    return (
        F.when(~has_website, _reasons(_reason("no_website", WEIGHT_OF["no_website"], F.lit(True)), _reason("social_only_presence", WEIGHT_OF["social_only_presence"], socials > 0)))
        .when(~up & http_status.isNotNull(), _reasons(_reason("website_unreachable", WEIGHT_OF["website_unreachable"], F.lit(True))))
        .when(~up | audit_missing, none)
        .otherwise(F.concat(found.cast(_REASONS), small))
    )


def location_reasons(in_scope: Column) -> Column:
    return _reasons(_reason("location_verified", 0, in_scope))


def opportunity(quality: Column, value: Column, digital: Column, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    """Mean of the three by weights, which are scaled to sum 1; unusable weights fall back to the standard ones."""
    if any(w < 0 for w in weights) or sum(weights) <= 0:
        weights = WEIGHTS
    a, b, c = (w / sum(weights) for w in weights)
    return clamp(quality * a + value * b + digital * c)


def ranked_reasons(*blocks: Column, most: int = 6) -> Column:
    """Codes of the reasons of each block by falling |points|, equal ones in their order; the first ``most``."""

    def order(block: Column) -> Column:
        at = F.transform(block, lambda r, i: F.struct((-F.abs(r["points"])).alias("k"), i.alias("i"), r["code"].alias("code")))
        return F.transform(F.array_sort(at), lambda r: r["code"])

    return F.slice(F.concat(*(order(b) for b in blocks)), 1, most)


def gate(duplicate: Column, in_scope: Column, location: Column, excluded: Column, evidence: Column, named: Column, quality: Column, value: Column, digital: Column, total: Column) -> Column:
    """Codes of all tests that an entity fails; it qualifies if there are none."""
    rules = (
        ("duplicate", duplicate), ("not_in_scope", ~in_scope), ("location_confidence", location < MIN_LOCATION),
        ("excluded_category", excluded), ("thin_evidence", evidence < MIN_EVIDENCE), ("meaningless_name", ~named),
        ("weak_business", quality < MIN_QUALITY), ("low_value", value < MIN_VALUE), ("no_opportunity", digital < MIN_DIGITAL),
        ("low_total", total < MIN_TOTAL),
    )
    return F.filter(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules)), lambda x: x.isNotNull())


def evidence_score(sources: Column, address: Column, postal: Column, located: Column, phone: Column, website: Column, reviews: Column, location: Column) -> Column:
    n = F.coalesce(reviews, F.lit(0))
    plus = lambda flag, points: F.when(flag, points).otherwise(0.0)
    total = (
        F.least(sources, F.lit(3)) * 0.1 + plus(address, 0.12) + plus(postal, 0.10) + plus(located, 0.10) + plus(phone, 0.14)
        + plus(website, 0.10) + plus(n > 0, 0.10) + plus(n >= 20, 0.05) + location * 0.09
    )
    return clamp(round_half_up(total, 3), 0.0, 1.0)


def score_entities(facts: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """One narrow pass over scoring facts (a row for each entity) to scores, reasons, gate and verdict columns."""
    from tamarack.operators.sites import verdict

    c = F.col
    q, q_reasons = business_quality(c("rating"), c("review_count"), c("evidence_score"), c("source_count"), c("has_phone"), c("has_address"), c("has_website"), c("social_count"))
    v, v_reasons = commercial_value(c("category_value").cast("double"), c("category_confidence"), c("review_count"), c("services"), c("has_booking"))
    d = digital_opportunity(c("has_website"), c("reachable"), c("http_status"), c("audit_missing"), c("issue_codes"), c("social_count"))
    out = facts.withColumns({"quality": q, "commercial": v, "digital": d})
    d_reasons = digital_reasons(c("has_website"), c("reachable"), c("http_status"), c("audit_missing"), c("issue_codes"), c("social_count"))
    out = out.withColumn("total", opportunity(c("quality"), c("commercial"), c("digital"), weights))
    return out.withColumns(
        {
            "failed": gate(c("is_duplicate"), c("in_scope"), c("location_confidence"), c("category_excluded"), c("evidence_score"), c("name_meaningful"), c("quality"), c("commercial"), c("digital"), c("total")),
            "opportunity": round_half_up(c("total")),
            "reasons": ranked_reasons(location_reasons(c("in_scope")), q_reasons, v_reasons, d_reasons),
            "verdict": verdict(c("has_website"), c("reachable"), c("http_status"), c("audit_missing"), c("issue_codes"), c("social_count")),
        }
    ).withColumn("qualified", F.size("failed") == 0).drop("total")


def escalated(candidates: DataFrame, cap: int, least: float = MIN_TOTAL, sure: float = 70.0) -> DataFrame:
    """Candidates (id, total, recommended) worth a deep pass, the best ``cap`` by total: those of ``least`` or more
    that the fast pass recommends or didn't see (null), and all of ``sure`` or more."""
    worth = (F.col("total") >= least) & (F.coalesce("recommended", F.lit(True)) | (F.col("total") >= sure))
    return candidates.where(worth).orderBy(F.desc("total"), "id").limit(cap)
