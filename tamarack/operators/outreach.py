"""Lead angles and drafts that cite nothing but findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Angles in order, with the findings that support each.
ANGLES = (
    ("no_website", ("no_website", "social_only_presence")),
    ("unreachable", ("website_unreachable", "http_error_status")),
    ("mobile", ("no_mobile_viewport", "fixed_width_layout")),
    ("conversion", ("no_contact_path", "no_booking_path", "no_phone_link", "weak_cta")),
    ("trust", ("no_https", "broken_links")),
    ("performance", ("very_slow_response", "slow_response", "heavy_page")),
    ("modernity", ("legacy_markup", "free_site_builder", "stale_copyright")),
    ("seo", ("missing_title", "missing_h1", "missing_meta_description")),
)
MAX_FINDINGS, MIN_REVIEWS = 4, 5


def evidence_codes(has_website: Column, audited: Column, codes: Column, socials: Column) -> Column:
    """Findings to speak of: a missing site is one where there are no others."""
    missing = F.when(socials > 0, F.lit("social_only_presence")).otherwise(F.lit("no_website"))
    return F.when(~has_website & (F.size(codes) == 0), F.array(missing)).otherwise(codes)


def lead_angle(codes: Column, audited: Column) -> Column:
    """Struct angle, supporting: the first angle with a finding; else unaudited or polish."""
    none = F.array().cast("array<string>")
    out = F.when(~audited, F.struct(F.lit("unaudited").alias("angle"), none.alias("supporting"))).otherwise(
        F.struct(F.lit("polish").alias("angle"), none.alias("supporting"))
    )
    for angle, rule in reversed(ANGLES):
        own = F.array_intersect(F.array(*(F.lit(c) for c in rule)), codes)
        out = F.when(F.size(own) > 0, F.struct(F.lit(angle).alias("angle"), own.alias("supporting"))).otherwise(out)
    return out


def compose(leads: DataFrame, templates: DataFrame, titles: DataFrame) -> DataFrame:
    """leads (id, name, language, channel, angle, supporting, rating, reviews) to drafts: id, channel, message.

    templates (language, angle, channel, body with {name}, {reputation}, {findings}, opt_out) and titles
    (code, language, title) are small tables by contract and joined on their keys. Reputation is spoken
    of from five reviews; up to four findings; the opt-out line stands in e-mails alone.
    """
    cited = (
        leads.select("id", "channel", "language", F.posexplode(F.slice("supporting", 1, MAX_FINDINGS)).alias("pos", "code"))
        .join(titles, ["code", "language"]).groupBy("id", "channel")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "title"))).alias("f"))
        .select("id", "channel", F.concat_ws("\n", F.transform("f", lambda x: F.concat(F.lit("- "), x["title"]))).alias("findings"))
    )
    reputation = F.when(
        F.col("rating").isNotNull() & (F.col("reviews") >= MIN_REVIEWS),
        F.format_string("%.1f/5 (%d)", F.col("rating"), F.col("reviews").cast("long")),
    ).otherwise("")
    text = F.col("body")
    for key, value in (("{name}", F.col("name")), ("{reputation}", reputation), ("{findings}", F.coalesce("findings", F.lit("")))):
        text = F.replace(text, F.lit(key), value)
    opt_out = F.when(F.col("channel") == "email", F.concat(F.lit("\n"), F.coalesce("opt_out", F.lit("")))).otherwise("")
    return leads.join(templates, ["language", "angle", "channel"]).join(cited, ["id", "channel"], "left").select("id", "channel", F.concat(text, opt_out).alias("message"))
