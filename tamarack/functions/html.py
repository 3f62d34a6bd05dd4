"""Signals of an HTML page as Column expressions over its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What links, texts and sources are recognised by.
SOCIAL = {
    "facebook": r"facebook\.com",
    "instagram": r"instagram\.com",
    "twitter": r"(twitter\.com|x\.com)",
    "linkedin": r"linkedin\.com",
    "youtube": r"youtube\.com|youtu\.be",
    "tiktok": r"tiktok\.com",
}
BOOKING = (
    "(booking|reserva|reservar|cita|citas|appointment|book-now|agendar|calendly|doctoralia|treatwell|thefork"
    "|eltenedor|bookitit)"
)
CTA = (
    "(pedir cita|reservar|reserva|contactar|contacto|llamar|solicitar|presupuesto|book now|get in touch|request"
    "|comprar|agendar)"
)
ANALYTICS = (
    r"(googletagmanager\.com|google-analytics\.com|gtag\(|analytics\.js|plausible\.io|matomo|hotjar|clarity\.ms"
    r"|fbevents\.js|segment\.com)"
)
WHATSAPP = r"(wa\.me|api\.whatsapp\.com|whatsapp:)"
LEGACY = r"<frameset|<frame\b|<marquee|<center\b|<font\b"
FIXED_WIDTH = r"width\s*:\s*(9[0-9][0-9]|1[0-9]{3})px"
FIXED_TABLE = r"""<table[^>]+width\s*=\s*["']?\d{3,}"""
COPYRIGHT = r"(?:&copy;|copyright|©)[^0-9]{0,20}((?:19|20)\d{2})"
JUNK_IMAGE = (
    r"(sprite|spacer|pixel|1x1|blank|placeholder|loader|loading|icon-|[/]icons?[/]|badge|avatar|captcha|tracking)"
)
PAGE_TYPES = {
    "contact": "(contacto|contact|donde-estamos|localizacion)",
    "services": "(servicios|services|tratamientos|treatments|especialidades|productos)",
    "about": "(nosotros|about|quienes-somos|equipo|clinica|empresa)",
    "booking": "(cita|reserva|booking|appointment|agendar|book)",
}
SERVICES = (
    "(implantes?|ortodoncia|invisalign|blanqueamiento|endodoncia|periodoncia|estetica dental|cirugia|rehabilitacion"
    "|fisioterapia|masaje|nutricion|asesoria|reformas?|obra nueva|alquiler|venta|tasacion|catering|banquete"
    "|menu degustacion|spa|tratamientos?|consulta|urgencias)"
)


def bound(c: Column, fn) -> Column:
    """``fn`` of a value that is evaluated once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def code_point(digits: Column) -> Column:
    """The character of a decimal number; the replacement character for what is none (zero, surrogates, beyond U+10FFFF)."""
    n = digits.try_cast("long")
    good = n.isNotNull() & (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(good, n).otherwise(0xFFFD)), 8, "0")), "UTF-32")


def decode_entities(c: Column) -> Column:
    """The named entities that matter and decimal ones; others stay as written."""

    def decoded(c: Column) -> Column:
        for pattern, to in (
            ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'),
            ("(?i)&#0?39;|&apos;", "'"),
        ):
            c = F.regexp_replace(c, pattern, to)
        # one regex pass tells the pages apart that hold a numeric entity at all; few do
        one = lambda p: F.when(p.rlike("^&#[0-9]+;"), F.concat(code_point(F.regexp_extract(p, "^&#([0-9]+);", 1)), F.regexp_replace(p, "^&#[0-9]+;", ""))).otherwise(p)
        numeric = lambda c: F.concat_ws("", F.transform(F.split(c, "(?=&#[0-9]+;)"), one))
        return bound(c, lambda c: F.when(F.contains(c, F.lit("&#")), numeric(c)).otherwise(c))

    return bound(c, lambda c: F.when(F.contains(c, F.lit("&")), decoded(c)).otherwise(c))


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a start tag, in any of the three ways of quoting; null if it isn't there."""
    pattern = rf"""(?is)(?:^<|\s){name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*)"""
    inside = lambda v: F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return bound(F.regexp_extract(tag, pattern, 1), lambda v: F.when(v != "", F.trim(decode_entities(inside(v)))))


def strip_tags(c: Column) -> Column:
    """Text without scripts, styles and tags, white space collapsed."""
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", "<[^>]+>"):
        c = F.regexp_replace(c, pattern, " ")
    return F.trim(F.regexp_replace(decode_entities(c), r"\s+", " "))


def resolved(value: Column, base: Column) -> Column:
    """An http(s) address for a reference on the page ``base``; null for others. Dot segments are worked out."""
    origin = F.regexp_extract(base, "(?i)^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, "(?i)^https?://[^/?#]+(/(?:[^?#]*/)?)", 1)
    here = F.regexp_extract(base, "^([^?#]*)", 1)

    def absolute(v: Column) -> Column:
        return (
            F.when(v.rlike("(?i)^https?://"), v)
            .when(v.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
            .when(v.startswith("//"), F.concat(F.regexp_extract(base, "(?i)^(https?:)", 1), v))
            .when(v.startswith("/"), F.concat(origin, v))
            .when(v.startswith("#") | v.startswith("?") | (v == ""), F.concat(here, v))
            .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), v))
        )

    def walked(path: Column) -> Column:
        step = lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).when(p == ".", acc).otherwise(F.concat(acc, F.array(p)))
        return F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")

    def tidy(u: Column) -> Column:
        host, path, tail = (F.regexp_extract(u, "(?i)^(https?://[^/?#]+)([^?#]*)(.*)$", i) for i in (1, 2, 3))
        path = F.when(path == "", "/").when(path.rlike("/\\.{1,2}(/|$)"), walked(path)).otherwise(path)
        return F.when(host != "", F.concat(F.lower(host), path, tail))

    return bound(bound(value, absolute), tidy)


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _last(items: Column, keep, field: str) -> Column:
    return F.try_element_at(F.filter(items, keep), F.lit(-1))[field]


def _some(v: Column) -> Column:
    return F.coalesce(v, F.lit("")) != ""


def page_parts(html: Column, most: int | None = None) -> dict[str, Column]:
    """The tags of a page that signals come from, by family: to be columns below :func:`page_signals`.

    Each is a column of its own, so that families of which no signal is asked for aren't looked for. ``most`` characters
    are read, all if it is None.
    """
    html = F.coalesce(html, F.lit(""))
    html = html if most is None else F.substring(html, 1, most)
    tags = lambda pattern, *names: F.transform(
        _all(html, pattern), lambda t: F.struct(*(attribute(t, n).alias(n) for n in names))
    )
    link = lambda a: F.struct(
        *(attribute(F.regexp_extract(a, r"(?is)^<a\b[^>]*>", 0), n).alias(n) for n in ("href", "rel")), F.substring(strip_tags(a), 1, 120).alias("text")
    )
    return {
        "_html": html,
        "_metas": F.transform(tags(r"(?i)<meta\b[^>]*>", "name", "property", "content"), lambda t: F.struct(F.lower(F.coalesce(t["name"], t["property"], F.lit(""))).alias("name"), t["content"].alias("content"))),
        "_links": F.filter(F.transform(_all(html, r"(?is)<a\b[^>]*>.*?</a>"), link), lambda a: _some(a["href"])),
        "_rels": tags(r"(?i)<link\b[^>]*>", "rel", "href"),
        "_images": _all(html, r"(?i)<img\b[^>]*>"),
        "_headings": _all(html, r"(?is)<h([1-6])\b[^>]*>.*?</h\1>"),
        "_forms": F.transform(_all(html, r"(?is)<form\b.*?</form>"), F.lower),
        "_scripts": F.filter(F.transform(_all(html, r"(?i)<script\b[^>]*>"), lambda t: attribute(t, "src")), lambda u: u.isNotNull()),
        "_buttons": F.filter(F.transform(_all(html, r"(?is)<button\b[^>]*>.*?</button>"), strip_tags), lambda t: t.rlike("(?i)" + CTA)),
        "_text": strip_tags(html),
    }


PARTS = ("html", "links", "metas", "rels", "images", "headings", "forms", "scripts", "buttons", "text")


def with_parts(pages: DataFrame, html: str = "html", most: int | None = None) -> DataFrame:
    """``pages`` with the columns of :func:`page_parts`, in a projection of their own."""
    return pages.select("*", *(c.alias(n) for n, c in page_parts(F.col(html), most).items()))


def page_signals(url: Column | None = None, text_kept: int | None = None) -> dict[str, Column]:
    """Named columns with the signals of one page, over the columns of :func:`with_parts`.

    ``url`` is what references are resolved against (without it they stay null); ``text_kept`` cuts the column ``text``.
    """
    html, links, metas, rels, images, headings, forms, scripts, buttons, text = (F.col(f"_{n}") for n in PARTS)
    url = F.lit(None).cast("string") if url is None else url
    like = lambda pattern: F.exists(links, lambda a: a["href"].rlike("(?i)" + pattern))
    first = lambda items, keep: F.get(F.filter(items, keep), F.lit(0))
    rel = lambda t: F.lower(F.coalesce(t["rel"], F.lit("")))
    sources = F.transform(images, lambda t: resolved(F.coalesce(*(attribute(t, n) for n in ("src", "data-src", "data-lazy-src"))), url))
    level = lambda h: F.substring(h, 3, 1).cast("int")
    photo = lambda u: u.isNotNull() & ~u.rlike("(?i)" + JUNK_IMAGE) & ~F.lower(F.split(u, "\\?")[0]).endswith(".svg")
    title = strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    year = F.regexp_extract(html, "(?i)" + COPYRIGHT, 1)
    booking = F.filter(links, lambda a: a["href"].rlike("(?i)" + BOOKING) | a["text"].rlike("(?i)" + BOOKING))
    calls = F.filter(F.transform(links, lambda a: a["text"]), lambda t: t.rlike("(?i)" + CTA))
    linked = lambda pattern: first(links, lambda a: a["href"].rlike("(?i)" + pattern))["href"]
    social = F.array(*(F.struct(F.lit(n).alias("platform"), linked(p).alias("href")) for n, p in SOCIAL.items()))
    named = lambda name: lambda m: (m["name"] == name) & _some(m["content"])
    return {
        "title": bound(title, lambda t: F.when(t != "", t)),
        "meta_description": _last(metas, named("description"), "content"),
        "has_viewport": F.exists(metas, lambda m: m["name"] == "viewport"),
        "viewport": _last(metas, lambda m: m["name"] == "viewport", "content"),
        "generator": _last(metas, named("generator"), "content"),
        "og_image": resolved(first(metas, lambda m: m["name"].isin("og:image", "twitter:image") & _some(m["content"]))["content"], url),
        "icon": resolved(first(rels, lambda t: F.contains(rel(t), F.lit("apple-touch-icon")) | rel(t).isin("icon", "shortcut icon"))["href"], url),
        "canonical": first(rels, lambda t: rel(t) == "canonical")["href"],
        "lang": attribute(F.regexp_extract(html, r"(?i)<html\b[^>]*>", 0), "lang"),
        "headings": F.transform(headings, lambda h: F.struct(level(h).alias("level"), F.substring(strip_tags(h), 1, 200).alias("text"))),
        "heading_levels": F.transform(headings, level),
        "h1_count": F.size(F.filter(headings, lambda h: level(h) == 1)),
        "image_count": F.size(images),
        "images_with_alt": F.size(F.filter(images, lambda t: _some(attribute(t, "alt")))),
        "image_urls": F.slice(F.array_distinct(F.filter(sources, photo)), 1, 12),
        "links": F.transform(links, lambda a: a["href"]),
        "link_texts": F.transform(links, lambda a: a["text"]),
        "link_rels": F.transform(links, lambda a: a["rel"]),
        "has_tel": like("^tel:"),
        "has_mailto": like("^mailto:"),
        "has_whatsapp": like(WHATSAPP),
        "has_booking": F.size(booking) > 0,
        "booking_links": F.transform(booking, lambda a: a["href"]),
        "social_platforms": F.transform(F.filter(social, lambda s: s["href"].isNotNull()), lambda s: s["platform"]),
        "social_urls": F.filter(F.transform(social, lambda s: resolved(s["href"], url)), lambda u: u.isNotNull()),
        "form_count": F.size(forms),
        "has_contact_form": F.exists(forms, lambda f: f.rlike("""type\\s*=\\s*["']?email|<textarea|(contacto|contact|mensaje|message|consulta)""")),
        "script_count": F.size(scripts),
        "script_sources": scripts,
        "has_analytics": html.rlike("(?i)" + ANALYTICS),
        "uses_legacy": html.rlike("(?i)" + LEGACY),
        "uses_fixed_width": html.rlike("(?i)" + FIXED_WIDTH) | html.rlike("(?i)" + FIXED_TABLE),
        "copyright_year": bound(year, lambda y: F.when(y != "", y.cast("int"))),
        "cta_texts": F.array_distinct(F.concat(F.slice(calls, 1, 10), F.slice(buttons, 1, 5))),
        "cta_count": F.least(F.lit(10), F.size(calls)) + F.least(F.lit(5), F.size(buttons)),
        "text": text if text_kept is None else F.substring(text, 1, text_kept),
        "has_app_root": html.rlike("""(?i)<div[^>]+id=["'](root|app|__next|__nuxt)["']"""),
    }


def needs_rendering() -> Column:
    """Over the columns of page_signals: little text, scripts, and an app root or no heading."""
    return (F.length("text") < 400) & (F.col("script_count") > 0) & (F.col("has_app_root") | (F.size("heading_levels") == 0))


def page_type(path_and_text: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(PAGE_TYPES.items()):
        out = F.when(path_and_text.rlike("(?i)" + pattern), F.lit(name)).otherwise(out)
    return out


#: The values that service_hints can give, in order.
SERVICE_WORDS = tuple(sorted(w for p in SERVICES.strip("()").split("|") for w in ((p[:-1], p[:-2]) if p.endswith("?") else (p,))))


def service_hints(text: Column) -> Column:
    return F.array_distinct(F.transform(_all(text, "(?i)" + SERVICES, 1), F.lower))
