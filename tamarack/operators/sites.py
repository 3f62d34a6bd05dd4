"""Findings of sites over a table of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions.contact import canonical_url, domain, host, is_free_builder, phone
from tamarack.functions.html import SERVICE_WORDS, needs_rendering, page_signals, page_type, service_hints, with_parts
from tamarack.functions.text import name_similarity, normalize_text, strip_diacritics

# Codes, categories, severities and weights of findings.
ISSUES = (
    ("no_website", "availability", "high", 30), ("website_unreachable", "availability", "high", 34),
    ("http_error_status", "availability", "high", 24), ("no_https", "trust", "high", 14),
    ("no_mobile_viewport", "mobile", "high", 18), ("fixed_width_layout", "mobile", "medium", 10),
    ("slow_response", "performance", "medium", 10), ("very_slow_response", "performance", "high", 16),
    ("heavy_page", "performance", "medium", 7), ("no_phone_link", "conversion", "high", 11),
    ("no_contact_path", "conversion", "high", 13), ("no_booking_path", "conversion", "high", 12),
    ("no_whatsapp", "conversion", "low", 4), ("weak_cta", "conversion", "medium", 9),
    ("missing_title", "seo", "medium", 7), ("missing_meta_description", "seo", "low", 4),
    ("missing_h1", "seo", "medium", 5), ("broken_heading_structure", "seo", "low", 3),
    ("missing_canonical", "seo", "low", 3), ("low_image_alt_coverage", "accessibility", "medium", 6),
    ("no_lang_attribute", "accessibility", "low", 3), ("broken_links", "trust", "medium", 8),
    ("no_social_links", "trust", "low", 3), ("stale_copyright", "modernity", "medium", 7),
    ("legacy_markup", "modernity", "medium", 9), ("free_site_builder", "modernity", "medium", 11),
    ("social_only_presence", "modernity", "high", 15), ("no_analytics", "modernity", "low", 3),
)
WEIGHTS = {code: weight for code, _, _, weight in ISSUES}
SLOW_MS, VERY_SLOW_MS = 1800, 3500


def issue_table(spark: SparkSession) -> DataFrame:
    """code, category, severity, weight: a few rows, to be broadcast."""
    return spark.createDataFrame(list(ISSUES), "code string, category string, severity string, weight int")


def pages_with_signals(pages: DataFrame) -> DataFrame:
    """url, html (and page_id, http_status, response_time_ms where present) to the signals of each page.

    The tags of a page are read once, by family in a projection of their own; columns that nobody asks for cost nothing.
    """
    extra = [c for c in ("page_id", "http_status", "response_time_ms") if c in pages.columns]
    parted = with_parts(pages.select("url", *extra, "html"))
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    out = parted.select(
        "url", *extra, domain(F.col("url")).alias("site"), F.sha2("html", 256).alias("content_hash"),
        *(c.alias(n) for n, c in page_signals(F.col("url")).items()),
    )
    return out.withColumns(
        {
            "page_type": F.when(path.isin("", "/"), F.lit("home")).otherwise(page_type(path)),
            "uses_https": F.lower("url").startswith("https://"),
            "free_builder": is_free_builder(F.col("url")),
            "services": service_hints(F.col("text")),
            "needs_rendering": needs_rendering(),
        }
    )


def site_rollup(signals: DataFrame) -> DataFrame:
    """One row for each site: flags of any page, measures of its home page (else its least URL)."""
    home = F.struct((F.col("page_type") != "home").alias("k"), F.col("url").alias("u"))
    of_home = lambda c: F.min_by(c, home).alias(c)
    any_page = lambda c: F.bool_or(c).alias(c)
    words = F.array(*(F.lit(w) for w in SERVICE_WORDS))
    bits = F.create_map(*(F.lit(x).cast("long") if isinstance(x, int) else F.lit(x) for i, w in enumerate(SERVICE_WORDS) for x in (w, 1 << i)))
    return signals.where("site is not null").groupBy("site").agg(
        F.count("*").alias("n_pages"),
        *(of_home(c) for c in (
            "title", "meta_description", "has_viewport", "canonical", "lang", "heading_levels", "h1_count", "uses_https",
            "uses_fixed_width", "copyright_year", "free_builder", "image_count", "images_with_alt",
        )),
        *(of_home(c) for c in ("http_status", "response_time_ms") if c in signals.columns),
        *(any_page(c) for c in ("has_tel", "has_mailto", "has_whatsapp", "has_booking", "has_contact_form", "has_analytics", "uses_legacy")),
        F.bool_or(F.col("page_type") == "contact").alias("has_contact_page"),
        F.max("cta_count").alias("cta_count"),
        F.array_distinct(F.flatten(F.collect_set("social_platforms"))).alias("social_platforms"),
        # a bit for each word that there is: 8 bytes, however many pages a site has
        F.bit_or(F.aggregate("services", F.lit(0).cast("long"), lambda m, w: m.bitwiseOR(F.coalesce(F.element_at(bits, w), F.lit(0).cast("long"))))).alias("services"),
    ).withColumn("services", F.slice(F.filter(words, lambda w: F.element_at(bits, w).bitwiseAND(F.col("services")) != 0), 1, 25))


def issue_codes(columns: list[str], as_of_year: int) -> Column:
    """Codes of a site's findings, in catalogue order, over the columns of site_rollup."""
    c = F.col
    levels = c("heading_levels")
    steps = F.zip_with(F.slice(levels, 2, 10_000), F.slice(levels, 1, 10_000), lambda a, b: a - b)
    no = lambda name: ~F.coalesce(c(name), F.lit(False))
    ms = c("response_time_ms") if "response_time_ms" in columns else F.lit(None).cast("int")
    status = c("http_status") if "http_status" in columns else F.lit(None).cast("int")
    broken = c("broken_links") if "broken_links" in columns else F.lit(0)
    rules = (
        ("http_error_status", (status < 200) | (status >= 400)),
        ("no_https", no("uses_https")),
        ("no_mobile_viewport", no("has_viewport")),
        ("fixed_width_layout", c("has_viewport") & c("uses_fixed_width")),
        ("very_slow_response", ms > VERY_SLOW_MS),
        ("slow_response", (ms > SLOW_MS) & (ms <= VERY_SLOW_MS)),
        ("no_phone_link", no("has_tel")),
        ("no_contact_path", no("has_contact_form") & no("has_mailto") & no("has_contact_page")),
        ("no_booking_path", no("has_booking")),
        ("no_whatsapp", no("has_whatsapp")),
        ("weak_cta", c("cta_count") == 0),
        ("missing_title", F.coalesce(F.length("title"), F.lit(0)) < 10),
        ("missing_meta_description", c("meta_description").isNull()),
        ("missing_h1", c("h1_count") == 0),
        ("broken_heading_structure", F.exists(steps, lambda s: s > 1)),
        ("missing_canonical", F.coalesce(c("canonical"), F.lit("")) == ""),
        ("low_image_alt_coverage", (c("image_count") >= 4) & (c("images_with_alt") / c("image_count") < 0.6)),
        ("no_lang_attribute", F.coalesce(c("lang"), F.lit("")) == ""),
        ("broken_links", broken > 0),
        ("no_social_links", F.size("social_platforms") == 0),
        ("stale_copyright", c("copyright_year") < as_of_year - 1),
        ("legacy_markup", c("uses_legacy")),
        ("free_site_builder", c("free_builder")),
        ("no_analytics", no("has_analytics")),
    )
    return F.filter(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules)), lambda x: x.isNotNull())


def site_issues(rollup: DataFrame, as_of_year: int) -> DataFrame:
    """site_rollup with the column issue_codes."""
    return rollup.withColumn("issue_codes", issue_codes(rollup.columns, as_of_year))


def exploded_issues(issues: DataFrame, key: str = "site") -> DataFrame:
    """A row for each known finding: key, code, category, severity, weight."""
    catalogue = F.broadcast(issue_table(issues.sparkSession))  # the fixed catalogue
    return issues.select(key, F.explode("issue_codes").alias("code")).join(catalogue, "code").select(
        key, "code", "category", "severity", "weight"
    )


def issue_weight(codes: Column) -> Column:
    """Sum of the weights of an array of codes, without a join."""
    table = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return F.aggregate(codes, F.lit(0), lambda a, x: a + F.coalesce(F.element_at(table, x), F.lit(0)))


# What a summary says of findings, the first code of a group that a site has.
HIGHLIGHTS = (
    (("no_mobile_viewport",), "no responsive mobile layout"),
    (("no_contact_path",), "no usable contact path"),
    (("no_booking_path",), "no online booking"),
    (("very_slow_response", "slow_response"), "slow response ({ms} ms)"),
    (("legacy_markup", "stale_copyright"), "dated build"),
)


def summary(codes: Column, pages: Column, response_ms: Column) -> Column:
    """One sentence on a site: that it doesn't load, or its pages and what its findings come to."""
    has = lambda names: F.arrays_overlap(codes, F.array(*(F.lit(n) for n in names)))
    said = lambda text: F.replace(F.lit(text), F.lit("{ms}"), F.coalesce(response_ms.cast("string"), F.lit("?")))
    found = F.filter(F.array(*(F.when(has(names), said(text)) for names, text in HIGHLIGHTS)), lambda x: x.isNotNull())
    audited = F.concat(F.lit("Audited "), pages.cast("string"), F.lit(" pages"))
    return (
        F.when(has(("http_error_status",)), "The homepage does not load successfully.")
        .when(F.size(found) == 0, F.concat(audited, F.lit("; the site is technically sound with only minor findings.")))
        .otherwise(F.concat(audited, F.lit(". Key problems: "), F.concat_ws(", ", found), F.lit(".")))
    )


def verdict(has_website: Column, reachable: Column, http_status: Column, audit_missing: Column, codes: Column, socials: Column) -> Column:
    """The ordered label of a site's state."""
    has = lambda *names: F.arrays_overlap(codes, F.array(*(F.lit(n) for n in names)))
    return (
        F.when(~has_website & (socials > 0), "social profiles only")
        .when(~has_website, "no website")
        .when(~F.coalesce(reachable, F.lit(False)) & http_status.isNull(), "did not respond")
        .when(~F.coalesce(reachable, F.lit(False)), "unreachable")
        .when(audit_missing, "not audited yet")
        .when(has("no_mobile_viewport", "fixed_width_layout"), "weak mobile experience")
        .when(has("legacy_markup", "stale_copyright", "free_site_builder"), "outdated")
        .when(has("no_contact_path", "no_booking_path", "no_phone_link"), "weak conversion path")
        .when(has("very_slow_response", "slow_response"), "slow")
        .when(F.size(codes) == 0, "solid")
        .otherwise("minor issues")
    )


def priority_pages(links: DataFrame, budget: int = 8) -> DataFrame:
    """links: (site, url, pos, link_text) -> the first page of each type, at most budget - 1 for a site."""
    typed = (
        links.withColumn("target", F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "/$", ""))
        .withColumn("page_type", page_type(F.concat_ws(" ", F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), F.coalesce("link_text", F.lit("")))))
        .where((F.col("page_type") != "other") & (host(F.col("url")) == F.col("site")))
    )
    firsts = typed.groupBy("site", "page_type").agg(F.min(F.struct("pos", "target")).alias("x")).select("site", "page_type", "x.*")
    order = Window.partitionBy("site").orderBy("pos", "target")
    return firsts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget - 1)


def broken_link_rate(links: DataFrame, status: DataFrame, most: int = 10) -> DataFrame:
    """(site, url, pos) against (url, status): checked and broken links of the first ``most`` distinct of a site."""
    distinct = links.groupBy("site", "url").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("site").orderBy("pos", "url")
    checked = distinct.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).join(status, "url", "left")
    bad = F.col("status").isNotNull() & (F.col("status") != 405) & ((F.col("status") < 200) | (F.col("status") >= 400))
    return checked.groupBy("site").agg(F.count("*").alias("checked"), F.count_if(bad).alias("broken")).withColumn("rate", F.col("broken") / F.col("checked"))


def officialness(businesses: DataFrame, pages: DataFrame) -> DataFrame:
    """businesses (id, name, phone, postal_code, city, site) joined with pages (site, title, text, html) on the site.

    id, confidence (0 to 1), total (0.35 + 0.65 confidence) and official (total >= 0.6) of the best page.
    """
    word = F.regexp_replace(normalize_text(F.split("site", "\\.")[0]), " ", "")
    name, glued = normalize_text(F.col("name")), F.regexp_replace(normalize_text(F.col("name")), " ", "")
    hay = normalize_text(F.concat_ws(" ", "title", "text"))
    tokens = F.filter(F.split(name, " "), lambda t: F.length(t) > 3)
    hits = F.size(F.filter(tokens, lambda t: F.contains(hay, t)))
    digits = F.regexp_replace(strip_diacritics(F.col("html")), "[^0-9]", "")
    national = phone(F.col("phone"))["national"]
    score = (
        F.when((F.length(word) >= 4) & F.contains(glued, word), 0.3).when(name_similarity(word, glued) > 0.6, 0.2).otherwise(0.0)
        + F.when((F.length(name) > 3) & F.contains(hay, name), 0.4).when((F.size(tokens) > 0) & (hits / F.size(tokens) >= 0.6), 0.22).otherwise(0.0)
        + F.when(national.isNotNull() & F.contains(digits, national), 0.3).otherwise(0.0)
        + F.when(F.contains("html", F.col("postal_code")), 0.12).when(F.contains(normalize_text(F.col("text")), normalize_text(F.col("city"))) & (F.col("city") != ""), 0.08).otherwise(0.0)
    )
    best = businesses.join(pages, "site").groupBy("id").agg(F.max(F.least(F.lit(1.0), score)).alias("confidence"))
    return best.withColumn("total", 0.35 + 0.65 * F.col("confidence")).withColumn("official", F.col("total") >= 0.6)


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, text) of robots files to (host, allow, prefix): the rules of the group that names the agent, else of ``*``.

    A line of agents opens a group; rules before any agent count for nothing.
    """
    line = F.trim(F.split(F.col("line"), "#")[0])
    rows = robots.select("host", F.posexplode(F.split("text", "\\r?\\n")).alias("pos", "line")).select(
        "host", "pos", F.lower(F.trim(F.split(line, ":", 2)[0])).alias("field"), F.trim(F.split(line, ":", 2)[1]).alias("value")
    ).where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    w = Window.partitionBy("host").orderBy("pos")
    opens = (F.col("field") == "user-agent") & (F.lag("field").over(w).isNull() | (F.lag("field").over(w) != "user-agent"))
    grouped = rows.withColumn("opens", opens.cast("int")).withColumn("grp", F.sum("opens").over(w)).where("grp > 0")
    token = agent.lower()
    kind = F.when((F.lower("value") != "*") & F.contains(F.lit(token), F.lower("value")), 0).when(F.col("value") == "*", 1)
    chosen = (
        grouped.where("field = 'user-agent'").withColumn("kind", kind).where("kind is not null")
        .groupBy("host").agg(F.min(F.struct("kind", "grp")).alias("x")).select("host", F.col("x.grp").alias("grp"))
    )
    return grouped.where("field in ('allow', 'disallow') and value <> ''").join(chosen, ["host", "grp"]).select(
        "host", (F.col("field") == "allow").alias("allow"), F.col("value").alias("prefix")
    )


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, host, path) with ``allowed``: the longest prefix wins, allow wins a tie, no rule allows."""
    matched = urls.join(rules, "host", "left")
    hit = F.startswith("path", F.regexp_replace("prefix", "\\*$", ""))
    longest = lambda cond: F.coalesce(F.max(F.when(hit & cond, F.length("prefix"))), F.lit(-1))
    out = matched.groupBy("url", "host", "path").agg(longest(~F.col("allow")).alias("no"), longest(F.col("allow")).alias("yes"))
    return out.select("url", "host", "path", ((F.col("no") == -1) | (F.col("yes") >= F.col("no"))).alias("allowed"))


def canonical_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("canonical_url", canonical_url(F.col("url")))
