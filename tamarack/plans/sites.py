"""Queries over the pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.functions.contact import domain
from tamarack.functions import html
from tamarack.functions.html import page_type, strip_tags
from tamarack.operators import outreach, scoring, sites
from tamarack.plans.fields import DOMAIN_SQL, HOST_SQL
from tamarack.plans.registry import query, table

YEAR = 2026
CODES = [code for code, *_ in sites.ISSUES]
WEIGHT_SQL = "MAP {" + ", ".join(f"'{c}': {w}" for c, w in sites.WEIGHTS.items()) + "}"

#: The driver's pages have no forms, images, scripts with a source or meta tags of a name. So that every signal comes in
#: both ways, their markup gets some by page_id, in front, and each host a registrable domain of its own.
MARKUP = """concat(
  CASE page_id % 3 WHEN 0 THEN '<meta name="viewport" content="width=device-width">' ELSE '' END,
  CASE page_id % 4 WHEN 0 THEN '<meta content="dental &amp; more" name=description>' WHEN 1 THEN '<meta property="og:image" content="/hero.jpg"><meta name=generator content=Maker>' ELSE '' END,
  CASE page_id % 5 WHEN 0 THEN '<link rel="Icon" href="fav.ico"><link rel=canonical href="/c">' ELSE '' END,
  CASE page_id % 6 WHEN 0 THEN '<img src="/a.jpg" alt="x"><img data-src="../b/c.jpg"><img src="/spacer.gif" alt="">' WHEN 1 THEN '<img src="/1.jpg"><img src="/2.jpg"><img src="/3.jpg"><img src="/4.jpg" alt="y">' ELSE '' END,
  CASE page_id % 7 WHEN 0 THEN '<a href="tel:952">Pedir cita</a><a href="https://www.facebook.com/x" rel="me">f</a>' WHEN 1 THEN '<a href="mailto:a@b.es">m</a>' WHEN 2 THEN '<a href="https://wa.me/1">w</a>' ELSE '' END,
  CASE page_id % 8 WHEN 0 THEN '<form><textarea></textarea></form>' WHEN 1 THEN '<button>Contactar</button>' WHEN 2 THEN '<table width=980><tr><td><font>x</font></td></tr></table>' ELSE '' END,
  CASE page_id % 9 WHEN 0 THEN '<script src="https://x.matomo.org/m.js"></script><div class=a id="root"></div>' ELSE '' END,
  CASE page_id % 10 WHEN 0 THEN 'copyright 2012' ELSE '' END,
  CASE page_id % 11 WHEN 0 THEN '<a href="/contacto">c</a><a href="/servicios/x#y">Ortodoncia</a><a href="/nosotros/">n</a><a href="/otra">reserva</a>' ELSE '' END,
  CASE page_id % 12 WHEN 0 THEN '<h1>t</h1><h3>u</h3>' ELSE '' END,
  html)"""
URL = "replace(url, '.example.', '-example.')"

#: Signals of these pages by RE2.
PAGES_SQL = rf"""rp AS (SELECT page_id, {URL} AS url, {MARKUP} AS html FROM pages), pg AS (
  SELECT page_id, url, html, {HOST_SQL} AS h, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM rp
), sg AS (
  SELECT *, string_split(h, '.') AS l, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title,
    list_transform(regexp_extract_all(html, '(?is)<h([1-6])\b[^>]*>.*?</h[1-6]>', 1), lambda x: CAST(x AS INTEGER)) AS levels,
    nullif(regexp_extract(html, '(?i)<html\b[^>]*\slang="([^"]*)"', 1), '') AS lang,
    lower(url) LIKE 'https://%' AS https,
    regexp_extract(html, '(?i)(?:&copy;|copyright|©)[^0-9]{{0,20}}((?:19|20)\d{{2}})', 1) AS year,
    regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]+)"[^>]*>.*?</a>', 1) AS hrefs,
    list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*>(.*?)</a>', 1), lambda x: substr(trim(regexp_replace(replace(replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')), 1, 120)) AS texts,
    regexp_extract_all(html, '(?is)<button\b[^>]*>(.*?)</button>', 1) AS buttons,
    len(regexp_extract_all(html, '(?i)<img\b[^>]*>')) AS images, len(regexp_extract_all(html, '(?i)<img\b[^>]*\salt="[^"]+"[^>]*>')) AS alts,
    regexp_matches(html, '(?i)<meta\b[^>]*name="viewport"') AS viewport, regexp_matches(html, '(?i)<meta\b[^>]*name=description') AS described,
    regexp_matches(html, '(?i)<link\b[^>]*rel=canonical') AS canonical
  FROM pg
), st AS (SELECT *, {DOMAIN_SQL} AS site FROM sg)"""
CTA_SQL = f"least(10, len(list_filter(texts, lambda x: regexp_matches(x, '(?i){html.CTA}')))) + len(list_filter(buttons, lambda x: regexp_matches(x, '(?i){html.CTA}')))"


def _pages(spark, sf):
    return table(spark, sf, "pages").selectExpr("page_id", f"{URL} AS url", f"{MARKUP} AS html")


@query("C22_A10_page_hashes", "SELECT page_id, sha256(html) AS content_hash, CAST(length(html) AS BIGINT) AS n FROM pages")
def hashes(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("content_hash"), F.length("html").cast("long").alias("n"))


@query(
    "I1_page_signals",
    rf"""WITH {PAGES_SQL}, o AS (SELECT *, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract(url, '^https?://[^/?#]+(/(?:[^?#]*/)?)', 1) AS folder FROM st)
    SELECT page_id, title IS NOT NULL AS has_title, CAST(len(list_filter(levels, lambda x: x = 1)) AS BIGINT) AS h1_count, lang, https, CAST(nullif(year, '') AS INTEGER) AS copyright_year,
      array_to_string(levels, ',') AS levels, CASE WHEN viewport THEN 'width=device-width' END AS viewport, CASE WHEN described THEN 'dental & more' END AS description,
      CASE WHEN contains(html, 'name=generator') THEN 'Maker' END AS generator, CASE WHEN contains(html, 'og:image') THEN origin || '/hero.jpg' END AS og_image,
      CASE WHEN canonical THEN origin || CASE WHEN folder = '' THEN '/' ELSE folder END || 'fav.ico' END AS icon, CASE WHEN canonical THEN '/c' END AS canonical,
      CAST(images AS BIGINT) AS images, CAST(alts AS BIGINT) AS alts,
      array_to_string(list_concat(list_transform(regexp_extract_all(html, '<img src="(/[^"]*\.jpg)"', 1), lambda x: origin || x),
        CASE WHEN contains(html, 'data-src') THEN [origin || CASE WHEN folder IN ('', '/') THEN '/' ELSE regexp_replace(folder, '[^/]*/$', '') END || 'b/c.jpg'] ELSE [] END), ' ') AS image_urls,
      sha256(array_to_string(hrefs, ' ')) AS links, sha256(array_to_string(texts, '|')) AS texts, CAST(len(regexp_extract_all(html, '<a\b[^>]* rel="me"')) AS BIGINT) AS n_rels,
      array_to_string(list_filter(hrefs, lambda x: starts_with(x, 'https://www.facebook.com/')), ' ') AS socials,
      len(list_filter(hrefs, lambda x: starts_with(x, 'tel:'))) > 0 AS tel, len(list_filter(hrefs, lambda x: starts_with(x, 'mailto:'))) > 0 AS mailto, len(list_filter(hrefs, lambda x: contains(x, 'wa.me'))) > 0 AS whatsapp,
      contains(html, '<textarea') AS form, array_to_string(regexp_extract_all(html, '<script src="([^"]*)"', 1), ' ') AS scripts, contains(html, 'matomo') AS analytics,
      contains(html, '<font>') AS legacy, contains(html, 'width=980') AS fixed, CAST({CTA_SQL} AS BIGINT) AS ctas
    FROM o""",
)
def signals(spark, sf):
    s, c = sites.pages_with_signals(_pages(spark, sf)), F.col
    joined = lambda name, by=" ": F.concat_ws(by, name)
    return s.select(
        "page_id", c("title").isNotNull().alias("has_title"), c("h1_count").cast("long").alias("h1_count"), "lang", c("uses_https").alias("https"), "copyright_year",
        F.concat_ws(",", F.transform("heading_levels", lambda x: x.cast("string"))).alias("levels"), "viewport", c("meta_description").alias("description"), "generator", "og_image", "icon", "canonical",
        c("image_count").cast("long").alias("images"), c("images_with_alt").cast("long").alias("alts"), joined("image_urls").alias("image_urls"),
        F.sha2(joined("links"), 256).alias("links"), F.sha2(joined("link_texts", "|"), 256).alias("texts"), F.size(F.filter("link_rels", lambda x: x == "me")).cast("long").alias("n_rels"),
        joined("social_urls").alias("socials"), c("has_tel").alias("tel"), c("has_mailto").alias("mailto"), c("has_whatsapp").alias("whatsapp"), c("has_contact_form").alias("form"),
        joined("script_sources").alias("scripts"), c("has_analytics").alias("analytics"), c("uses_legacy").alias("legacy"), c("uses_fixed_width").alias("fixed"), c("cta_count").cast("long").alias("ctas"),
    )


TAG = """concat('<a', CASE page_id % 5 WHEN 0 THEN concat(' href="', url, '"') WHEN 1 THEN concat(' href=\\'', url, '\\'') WHEN 2 THEN concat(' href=', url) WHEN 3 THEN ' data-href="x"' ELSE concat(chr(10), 'HREF = "a &amp; b"') END, ' title="href=no">')"""


@query("I2_tag_attribute", "SELECT page_id, CASE WHEN page_id % 5 < 3 THEN url WHEN page_id % 5 = 4 THEN 'a & b' END AS href, 'href=no' AS title FROM pages")
def attributes(spark, sf):
    tags = table(spark, sf, "pages").selectExpr("page_id", TAG + " AS tag")
    return tags.select("page_id", html.attribute(F.col("tag"), "href").alias("href"), html.attribute(F.col("tag"), "title").alias("title"))


SERVED = f"concat({MARKUP}, '<p>Implantes y implantes, REFORMA o alquiler', cast(page_id % 3 as varchar), CASE page_id % 4 WHEN 0 THEN ' Masaje' ELSE '' END, '</p>')"


@query(
    "I14_service_hints",
    rf"""WITH t AS (SELECT page_id, {SERVED} AS t FROM pages),
    s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM t)
    SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i){html.SERVICES}', 1), lambda x: lower(x)))), '|') AS services FROM s""",
)
def services(spark, sf):
    marked = table(spark, sf, "pages").selectExpr("page_id", SERVED.replace("varchar", "string") + " AS html")
    return marked.select("page_id", F.concat_ws("|", F.sort_array(html.service_hints(strip_tags(F.col("html"))))).alias("services"))


@query(
    "I3_strip_tags",
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
    b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS t FROM a)
    SELECT page_id, sha256(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS text FROM b""",
)
def stripped(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(strip_tags(F.col("html")), 256).alias("text"))


@query(
    "I6_page_type",
    """SELECT page_id, CASE WHEN regexp_matches(url, '(?i)(contacto|contact|donde-estamos|localizacion)') THEN 'contact'
      WHEN regexp_matches(url, '(?i)(servicios|services|tratamientos|treatments|especialidades|productos)') THEN 'services'
      WHEN regexp_matches(url, '(?i)(nosotros|about|quienes-somos|equipo|clinica|empresa)') THEN 'about'
      WHEN regexp_matches(url, '(?i)(cita|reserva|booking|appointment|agendar|book)') THEN 'booking' ELSE 'other' END AS page_type FROM pages""",
)
def types(spark, sf):
    return table(spark, sf, "pages").select("page_id", page_type(F.col("url")).alias("page_type"))


def _codes_sql() -> str:
    """Findings of the home page (or least URL) of each site."""
    return rf"""{PAGES_SQL}, home AS (
      SELECT site, min((CASE WHEN path IN ('', '/') THEN 0 ELSE 1 END, url)) AS k, count(*) AS n_pages,
        bool_or(regexp_matches(path, '(?i)(contacto|contact|donde-estamos|localizacion)')) AS has_contact_page,
        bool_or(len(list_filter(hrefs, lambda x: regexp_matches(x, '(?i)^tel:'))) > 0) AS tel,
        bool_or(len(list_filter(hrefs, lambda x: regexp_matches(x, '(?i)^mailto:'))) > 0) AS mailto,
        bool_or(len(list_filter(hrefs, lambda x: regexp_matches(x, '(?i)wa\.me|api\.whatsapp\.com|whatsapp:'))) > 0) AS whatsapp,
        bool_or(len(list_filter(hrefs, lambda x: regexp_matches(x, '(?i)facebook\.com'))) > 0) AS social,
        bool_or(regexp_matches(html, '(?i){html.ANALYTICS}')) AS analytics,
        bool_or(regexp_matches(html, '(?i){html.LEGACY}')) AS legacy,
        bool_or(regexp_matches(html, '(?is)<form\b.*?<textarea.*?</form>')) AS form,
        bool_or(len(list_filter(list_concat(hrefs, texts), lambda x: regexp_matches(x, '(?i){html.BOOKING}'))) > 0) AS booking,
        max({CTA_SQL}) AS cta
      FROM st WHERE site <> '' GROUP BY site
    ), f AS (
      SELECT home.site, n_pages, st.*, home.* EXCLUDE (site, n_pages, k) FROM home JOIN st ON st.site = home.site
        AND st.url = home.k[2]
    ), c AS (
      SELECT DISTINCT ON (site) site, n_pages, social, list_filter([
        CASE WHEN NOT https THEN 'no_https' END, CASE WHEN NOT viewport THEN 'no_mobile_viewport' END, CASE WHEN viewport AND contains(html, 'width=980') THEN 'fixed_width_layout' END,
        CASE WHEN NOT tel THEN 'no_phone_link' END, CASE WHEN NOT form AND NOT mailto AND NOT has_contact_page THEN 'no_contact_path' END, CASE WHEN NOT booking THEN 'no_booking_path' END,
        CASE WHEN NOT whatsapp THEN 'no_whatsapp' END, CASE WHEN cta = 0 THEN 'weak_cta' END, CASE WHEN length(coalesce(title, '')) < 10 THEN 'missing_title' END,
        CASE WHEN NOT described THEN 'missing_meta_description' END, CASE WHEN NOT list_contains(levels, 1) THEN 'missing_h1' END,
        CASE WHEN len(list_filter(range(1, len(levels)), lambda i: levels[i + 1] - levels[i] > 1)) > 0 THEN 'broken_heading_structure' END,
        CASE WHEN NOT canonical THEN 'missing_canonical' END, CASE WHEN images >= 4 AND alts / images::DOUBLE < 0.6 THEN 'low_image_alt_coverage' END,
        CASE WHEN lang IS NULL THEN 'no_lang_attribute' END, CASE WHEN NOT social THEN 'no_social_links' END,
        CASE WHEN year <> '' AND TRY_CAST(year AS INTEGER) < {YEAR - 1} THEN 'stale_copyright' END, CASE WHEN legacy THEN 'legacy_markup' END,
        CASE WHEN regexp_matches(h, '(\.wixsite\.com|\.wordpress\.com|business\.site)$') THEN 'free_site_builder' END,
        CASE WHEN NOT analytics THEN 'no_analytics' END], lambda x: x IS NOT NULL) AS codes
      FROM f ORDER BY site
    )"""


def _issues(spark, sf):
    return sites.site_issues(sites.site_rollup(sites.pages_with_signals(_pages(spark, sf))), YEAR)


@query("I7_I8_site_issues", f"WITH {_codes_sql()} SELECT site, CAST(n_pages AS BIGINT) AS n_pages, array_to_string(codes, '|') AS codes FROM c")
def issues(spark, sf):
    return _issues(spark, sf).select("site", "n_pages", F.concat_ws("|", "issue_codes").alias("codes"))


REACH_SQL = "CASE page_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN NULL ELSE 200 END"
SPEED_SQL = "CASE page_id % 5 WHEN 0 THEN 1800 WHEN 1 THEN 1801 WHEN 2 THEN 3500 WHEN 3 THEN 3501 END"


@query(
    "I8_I13_reach_issues",
    f"""WITH {_codes_sql()}, links AS (SELECT site, page_id, row_number() OVER (PARTITION BY site ORDER BY page_id, url) AS pos FROM st WHERE site <> ''),
    broken AS (SELECT site, count(*) FILTER (WHERE page_id % 7 = 3) AS broken FROM links WHERE pos <= 10 GROUP BY site),
    r AS (SELECT DISTINCT ON (f.site) f.site, {REACH_SQL} AS status, {SPEED_SQL} AS ms, broken FROM f JOIN broken USING (site))
    SELECT site, broken, array_to_string(list_filter([CASE WHEN status >= 400 THEN 'http_error_status' END, CASE WHEN ms > 3500 THEN 'very_slow_response' END,
      CASE WHEN ms > 1800 AND ms <= 3500 THEN 'slow_response' END, CASE WHEN broken > 0 THEN 'broken_links' END], lambda x: x IS NOT NULL), '|') AS codes FROM r""",
)
def reach_issues(spark, sf):
    """Findings of how sites answer: status and speed of the home page, and the first ten pages of a site as links with a status."""
    pages = _pages(spark, sf).withColumns({"http_status": F.expr(REACH_SQL), "response_time_ms": F.expr(SPEED_SQL)})
    rolled = sites.site_rollup(sites.pages_with_signals(pages))
    links = pages.select(domain(F.col("url")).alias("site"), "url", F.col("page_id").alias("pos")).where("site IS NOT NULL")
    status = pages.select("url", F.expr("CASE WHEN page_id % 7 = 3 THEN 500 WHEN page_id % 7 = 4 THEN 405 ELSE 200 END").alias("status"))
    broken = sites.broken_link_rate(links, status).select("site", F.col("broken").alias("broken_links"))
    found = sites.site_issues(rolled.join(broken, "site", "left"), YEAR)
    wanted = F.filter("issue_codes", lambda c: c.isin("http_error_status", "very_slow_response", "slow_response", "broken_links"))
    return found.select("site", F.col("broken_links").alias("broken"), F.concat_ws("|", wanted).alias("codes"))


SCORE_SQL = f"least(100.0, 8 + list_sum(list_transform(codes, lambda x: {WEIGHT_SQL}[x])))"


@query(
    "flagship_weakest_sites",
    f"""WITH {_codes_sql()} SELECT site, CAST(n_pages AS BIGINT) AS n_pages, CAST({SCORE_SQL} AS DOUBLE) AS digital, array_to_string(codes, '|') AS codes
    FROM c ORDER BY digital DESC, site LIMIT 10""",
)
def flagship(spark, sf):
    c = F.col
    scored = _issues(spark, sf).withColumn(
        "digital", scoring.digital_opportunity(F.lit(True), F.lit(True), F.lit(None).cast("int"), F.lit(False), c("issue_codes"), F.size("social_platforms"))
    )
    return scored.select("site", "n_pages", "digital", F.concat_ws("|", "issue_codes").alias("codes")).orderBy(F.desc("digital"), "site").limit(10)


SEVERITY = "MAP {" + ", ".join(f"'{c}': '{k}/{s}'" for c, k, s, _ in sites.ISSUES) + "}"


@query(
    "I9_J14_issue_rollup",
    f"""WITH {_codes_sql()}, e AS (SELECT unnest(codes) AS code FROM c), x AS (SELECT string_split({SEVERITY}[code], '/') AS ks, {WEIGHT_SQL}[code] AS w FROM e)
    SELECT ks[1] AS category, ks[2] AS severity, count(*) AS n, CAST(sum(w) AS BIGINT) AS weight FROM x GROUP BY ROLLUP (ks[1], ks[2])""",
)
def issue_rollup(spark, sf):
    return sites.exploded_issues(_issues(spark, sf)).rollup("category", "severity").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


VERDICT_SQL = """CASE WHEN list_has_any(codes, ['no_mobile_viewport', 'fixed_width_layout']) THEN 'weak mobile experience'
  WHEN list_has_any(codes, ['legacy_markup', 'stale_copyright', 'free_site_builder']) THEN 'outdated'
  WHEN list_has_any(codes, ['no_contact_path', 'no_booking_path', 'no_phone_link']) THEN 'weak conversion path'
  WHEN len(codes) = 0 THEN 'solid' ELSE 'minor issues' END"""


@query("I11_verdict", f"WITH {_codes_sql()} SELECT site, {VERDICT_SQL} AS verdict FROM c")
def verdict(spark, sf):
    return _issues(spark, sf).select(
        "site", sites.verdict(F.lit(True), F.lit(True), F.lit(None).cast("int"), F.lit(False), F.col("issue_codes"), F.size("social_platforms")).alias("verdict")
    )


@query(
    "I5_priority_pages",
    rf"""WITH {PAGES_SQL}, l AS (SELECT page_id, h AS site, unnest(hrefs) AS href, unnest(texts) AS text, generate_subscripts(hrefs, 1) AS i FROM st),
    t AS (SELECT site, page_id * 10000 + i AS pos, regexp_replace(href, '#.*$', '') || ' ' || text AS said FROM l WHERE href LIKE '/%'),
    y AS (SELECT *, CASE WHEN regexp_matches(said, '(?i){html.PAGE_TYPES['contact']}') THEN 'contact' WHEN regexp_matches(said, '(?i){html.PAGE_TYPES['services']}') THEN 'services'
        WHEN regexp_matches(said, '(?i){html.PAGE_TYPES['about']}') THEN 'about' WHEN regexp_matches(said, '(?i){html.PAGE_TYPES['booking']}') THEN 'booking' END AS page_type FROM t)
    SELECT site, page_type, min(pos) AS pos FROM y WHERE page_type IS NOT NULL GROUP BY site, page_type""",
)
def priority(spark, sf):
    from tamarack.functions.contact import host

    s = sites.pages_with_signals(_pages(spark, sf)).select("page_id", "url", F.posexplode(F.arrays_zip("links", "link_texts")).alias("i", "l"))
    links = s.select(
        host(F.col("url")).alias("site"), html.resolved(F.col("l.links"), F.col("url")).alias("url"),
        (F.col("page_id") * 10000 + F.col("i") + 1).alias("pos"), F.col("l.link_texts").alias("link_text"),
    ).where("url is not null")
    return sites.priority_pages(links).select("site", "page_type", "pos")


@query(
    "I13_broken_links",
    """WITH l AS (SELECT o_custkey AS site, o_orderkey % 50 AS url, min(o_orderkey) AS pos FROM orders GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY pos, url) AS k FROM l)
    SELECT site, count(*) AS checked, count(*) FILTER (WHERE url % 7 = 3) AS broken, count(*) FILTER (WHERE url % 7 = 3) / count(*)::DOUBLE AS rate FROM k WHERE k <= 10 GROUP BY site""",
)
def broken(spark, sf):
    links = table(spark, sf, "orders").select(F.col("o_custkey").alias("site"), (F.col("o_orderkey") % 50).alias("url"), F.col("o_orderkey").alias("pos"))
    status = links.select("url").distinct().withColumn("status", F.expr("CASE WHEN url % 7 = 3 THEN 404 WHEN url % 7 = 4 THEN 405 ELSE 200 END"))
    return sites.broken_link_rate(links, status)


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /fr\nDisallow: /de/*\nAllow: /fr/8\nDisallow:\n# end"


@query(
    "F17_robots",
    rf"""WITH p AS (SELECT DISTINCT url, {HOST_SQL} AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)
    SELECT url, CASE WHEN starts_with(path, '/fr/8') THEN true WHEN starts_with(path, '/fr') OR starts_with(path, '/de/') THEN false ELSE true END AS allowed FROM p""",
)
def robots(spark, sf):
    from tamarack.functions.contact import host

    urls = table(spark, sf, "pages").select("url", host(F.col("url")).alias("host"), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")).alias("path")).distinct()
    rules = sites.robots_rules(urls.select("host").distinct().withColumn("text", F.lit(ROBOTS)), "shortlist-bot")
    return sites.robots_allowed(urls, rules).select("url", "allowed")


ANGLE_SQL = "CASE " + " ".join(
    f"WHEN list_has_any(codes, {list(rule)}) THEN '{angle}/' || array_to_string(list_filter({list(rule)}, lambda x: list_contains(codes, x)), '|')" for angle, rule in outreach.ANGLES
) + " WHEN n_pages % 2 = 1 THEN 'unaudited/' ELSE 'polish/' END"
#: Sites by their number of pages and name: some have findings left out, some have no site of their own, some weren't audited.
LEADS_SQL = """leads AS (SELECT site, n_pages, length(site) % 5 AS k, social, codes AS every FROM c),
  lead_codes AS (SELECT site, n_pages, k, CASE k WHEN 0 THEN every WHEN 1 THEN list_filter(every, lambda x: x IN ('missing_title', 'missing_meta_description', 'missing_h1'))
    WHEN 2 THEN list_filter(every, lambda x: x IN ('no_https', 'stale_copyright', 'legacy_markup')) WHEN 3 THEN [] ELSE CASE WHEN social THEN ['social_only_presence'] ELSE ['no_website'] END END AS codes FROM leads)"""


def _leads(spark, sf):
    c, k = F.col, F.length("site") % 5
    only = lambda *names: F.filter("issue_codes", lambda x: x.isin(*names))
    none = F.array().cast("array<string>")
    codes = F.when(k == 0, c("issue_codes")).when(k == 1, only("missing_title", "missing_meta_description", "missing_h1")).when(k == 2, only("no_https", "stale_copyright", "legacy_markup")).otherwise(none)
    audited = (k == 4) | (c("n_pages") % 2 == 0)
    spoken = outreach.evidence_codes(k != 4, audited, codes, F.size("social_platforms"))
    return _issues(spark, sf).select("site", "n_pages", outreach.lead_angle(spoken, audited).alias("a"))


@query("N1_N2_lead_angle", f"""WITH {_codes_sql()}, {LEADS_SQL}, x AS (SELECT site, {ANGLE_SQL} AS a FROM lead_codes) SELECT site, string_split(a, '/')[1] AS angle, string_split(a, '/')[2] AS supporting FROM x""")
def angle(spark, sf):
    return _leads(spark, sf).select("site", "a.angle", F.concat_ws("|", "a.supporting").alias("supporting"))


@query(
    "N3_N4_drafts",
    f"""WITH {_codes_sql()}, {LEADS_SQL}, x AS (SELECT site, n_pages, {ANGLE_SQL} AS a FROM lead_codes), ch AS (SELECT unnest(['email', 'message']) AS channel),
    y AS (SELECT site, n_pages, string_split(a, '/')[1] AS angle, list_filter(string_split(string_split(a, '/')[2], '|'), lambda x: x <> '')[1:4] AS s FROM x)
    SELECT site, channel, 'Hello ' || site || ' (' || angle || '), rated ' || CASE WHEN n_pages >= 2 THEN format('4.5/5 ({{}})', n_pages * 3) ELSE '' END || chr(10)
      || array_to_string(list_transform(s, lambda x: '- ' || CASE WHEN length(site) % 2 = 0 THEN 'Falta: ' ELSE 'Missing: ' END || replace(x, '_', ' ')), chr(10))
      || CASE WHEN channel = 'email' THEN chr(10) || 'Reply stop to opt out' ELSE '' END AS message FROM y, ch""",
)
def drafts(spark, sf):
    leads = _leads(spark, sf).select(
        F.col("site").alias("id"), F.col("site").alias("name"), F.when(F.length("site") % 2 == 0, "es").otherwise("en").alias("language"),
        F.explode(F.array(F.lit("email"), F.lit("message"))).alias("channel"), "a.angle", "a.supporting", F.lit(4.5).alias("rating"), (F.col("n_pages") * 3).alias("reviews"),
    )
    angles = [a for a, _ in outreach.ANGLES] + ["unaudited", "polish"]
    templates = spark.createDataFrame(
        [(lang, a, ch, f"Hello {{name}} ({a}), rated {{reputation}}\n{{findings}}", "Reply stop to opt out") for lang in ("en", "es") for a in angles for ch in ("email", "message")],
        "language string, angle string, channel string, body string, opt_out string",
    )
    titles = spark.createDataFrame([(c, lang, said + c.replace("_", " ")) for c in CODES for lang, said in (("en", "Missing: "), ("es", "Falta: "))], "code string, language string, title string")
    return outreach.compose(leads, templates, titles).select(F.col("id").alias("site"), "channel", "message")


@query(
    "I12_audit_summary",
    f"""WITH {_codes_sql()}, p AS (SELECT site, n_pages, list_filter([CASE WHEN list_contains(codes, 'no_mobile_viewport') THEN 'no responsive mobile layout' END,
      CASE WHEN list_contains(codes, 'no_contact_path') THEN 'no usable contact path' END, CASE WHEN list_contains(codes, 'no_booking_path') THEN 'no online booking' END,
      CASE WHEN list_has_any(codes, ['legacy_markup', 'stale_copyright']) THEN 'dated build' END], lambda x: x IS NOT NULL) AS found FROM c)
    SELECT site, 'Audited ' || n_pages || ' pages' || CASE WHEN len(found) = 0 THEN '; the site is technically sound with only minor findings.' ELSE '. Key problems: ' || array_to_string(found, ', ') || '.' END AS summary FROM p""",
)
def summary(spark, sf):
    return _issues(spark, sf).select("site", sites.summary(F.col("issue_codes"), F.col("n_pages"), F.lit(None).cast("int")).alias("summary"))


#: Whole pages; those of two in three are shells, whose own text is behind a script, with an app root or without.
SHELL = """CASE page_id % 3 WHEN 0 THEN concat('<div id="app"></div><script src="b.js"></script><script>', html, '</script>') WHEN 1 THEN concat('<script src=a.js></script><style>', html, '</style><p>', url, '</p>') ELSE concat('<div id="app"></div><script src="b.js"></script>', html) END"""


@query(
    "I4_needs_rendering",
    rf"""WITH s AS (SELECT page_id, {SHELL} AS html FROM pages), t AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM s),
    d AS (SELECT *, replace(replace(replace(replace(replace(text, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"') AS said FROM t)
    SELECT page_id, length(trim(regexp_replace(said, '\s+', ' ', 'g'))) < 400 AND regexp_matches(html, '(?i)<script\b[^>]*\ssrc=') AND (regexp_matches(html, '(?i)<div[^>]+id="app"') OR NOT regexp_matches(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>')) AS shell FROM d""",
)
def shells(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.expr(SHELL).alias("html"))
    parted = html.with_parts(rows)
    named = html.page_signals()
    wanted = ("text", "script_count", "has_app_root", "heading_levels")
    return parted.select("page_id", *(named[n].alias(n) for n in wanted)).select("page_id", html.needs_rendering().alias("shell"))


#: Businesses of the hosts of pages: named as the page is (its title), by words of it, or otherwise; phones, codes and cities by page.
OFFICIAL = """concat(html, CASE page_id % 4 WHEN 0 THEN concat('<p>Tel. 952 10 ', lpad(cast(page_id % 10000 as varchar), 4, '0'), '</p>') WHEN 1 THEN '<p>29005</p>' WHEN 2 THEN '<p>Estamos en Malaga</p>' ELSE '' END)"""


@query(
    "I10_officialness",
    rf"""WITH p AS (SELECT page_id AS id, {HOST_SQL} AS host, {OFFICIAL} AS html FROM pages), s AS (SELECT *, string_split(host, '.')[1] AS word FROM p)
    SELECT id, least(1.0, CASE WHEN length(word) >= 4 AND id % 3 < 2 THEN 0.3::DOUBLE ELSE 0 END + CASE id % 3 WHEN 0 THEN 0.4::DOUBLE WHEN 1 THEN 0.22::DOUBLE ELSE 0 END
      + CASE WHEN id % 4 = 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN id % 4 = 1 OR contains(html, '29005') THEN 0.12::DOUBLE WHEN id % 4 = 2 OR contains(lower(html), 'malaga') THEN 0.08::DOUBLE ELSE 0 END)::DOUBLE AS confidence FROM s""",
)
def official(spark, sf):
    from tamarack.functions.contact import host

    c = F.col
    p = table(spark, sf, "pages").select("page_id", host(c("url")).alias("host"), F.expr(OFFICIAL.replace("varchar", "string")).alias("html"))
    word = F.split("host", "\\.")[0]
    # a site to each page, by a domain that begins with the host's first label
    site = F.concat(word, F.lit(".p"), c("page_id").cast("string"), F.lit(".es"))
    name = F.when(c("page_id") % 3 == 0, F.concat(F.lit("casa "), word)).when(c("page_id") % 3 == 1, F.concat(F.lit("zzgrupo zzclinica zzdental "), word)).otherwise("qqqq 12")
    businesses = p.select(
        c("page_id").alias("id"), name.alias("name"), F.when(c("page_id") % 4 == 0, F.concat(F.lit("95210"), F.lpad((c("page_id") % 10000).cast("string"), 4, "0"))).alias("phone"),
        F.lit("29005").alias("postal_code"), F.lit("Málaga").alias("city"), site.alias("site"),
    )
    title = F.when(c("page_id") % 3 == 0, F.concat(F.lit("Casa "), word, F.lit(" inicio"))).when(c("page_id") % 3 == 1, F.lit("zzgrupo y zzclinica, zzdental")).otherwise("inicio")
    pages = p.select(site.alias("site"), title.alias("title"), strip_tags(c("html")).alias("text"), "html")
    return sites.officialness(businesses, pages).select("id", "confidence")
