"""Phones, e-mail addresses and URLs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Providers of personal mailboxes, local parts of role addresses.
CONSUMER_DOMAINS = (
    "gmail.com", "hotmail.com", "hotmail.es", "outlook.com", "outlook.es", "yahoo.com", "yahoo.es", "icloud.com",
    "live.com", "msn.com",
)
ROLE_LOCAL_PARTS = (
    "info", "contacto", "contact", "hola", "cita", "citas", "reservas", "reservations", "admin", "administracion",
    "clinica", "recepcion", "ventas", "comercial", "atencion",
)
# Public suffixes of two labels; hosts that are nobody's own site; endings of free site builders.
MULTI_LABEL_SUFFIXES = (
    "com.es", "org.es", "nom.es", "gob.es", "edu.es", "co.uk", "org.uk", "com.br", "com.ar", "com.mx",
)
NON_OFFICIAL_HOSTS = (
    "facebook.com", "m.facebook.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "youtube.com",
    "tiktok.com", "wa.me", "api.whatsapp.com", "google.com", "maps.google.com", "goo.gl", "maps.app.goo.gl",
    "tripadvisor.com", "tripadvisor.es", "yelp.com", "doctoralia.es", "booking.com", "thefork.com", "eltenedor.es",
    "paginasamarillas.es", "linktr.ee", "bit.ly", "sites.google.com", "business.site", "negocio.site",
)
FREE_BUILDER_SUFFIXES = (
    r"\.wixsite\.com|\.wordpress\.com|\.blogspot\.|\.weebly\.com|\.jimdosite\.com|\.webnode\.|\.godaddysites\.com"
    r"|business\.site|\.square\.site|\.myshopify\.com"
)
TRACKING_PARAMETERS = r"(?i)^(utm_|fbclid|gclid|msclkid|mc_cid|mc_eid|ref)"


def phone(c: Column) -> Column:
    """Struct e164, national, is_mobile, is_landline (province prefix 95); null if it is no Spanish number."""
    digits = F.regexp_replace(F.regexp_replace(c, "[^0-9+]", ""), "^00", "+")
    digits = F.regexp_replace(digits, "(?!^)\\+", "")
    national = (
        F.when(digits.startswith("+34"), F.substring(digits, 4, 64))
        .when(digits.startswith("34") & (F.length(digits) == 11), F.substring(digits, 3, 64))
        .when(~digits.startswith("+"), digits)
    )
    valid = national.rlike("^[6-9][0-9]{8}$")
    return F.when(
        valid,
        F.struct(
            F.concat(F.lit("+34"), national).alias("e164"),
            national.alias("national"),
            F.substring(national, 1, 1).isin("6", "7").alias("is_mobile"),
            national.startswith("95").alias("is_landline"),
        ),
    )


def phone_display(c: Column) -> Column:
    n = phone(c)["national"]
    parts = (F.substring(n, 1, 3), F.substring(n, 4, 2), F.substring(n, 6, 2), F.substring(n, 8, 2))
    return F.when(n.isNotNull(), F.concat_ws(" ", F.lit("+34"), *parts))


def email(c: Column) -> Column:
    """Struct value, domain, is_role, is_consumer; null if it is no address."""
    value = F.split(F.regexp_replace(F.lower(F.trim(c)), "^mailto:", ""), "\\?")[0]
    local, domain = F.split(value, "@")[0], F.split(value, "@")[1]
    return F.when(
        value.rlike(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"),
        F.struct(
            value.alias("value"), domain.alias("domain"), local.isin(*ROLE_LOCAL_PARTS).alias("is_role"),
            domain.isin(*CONSUMER_DOMAINS).alias("is_consumer"),
        ),
    )


def _with_scheme(c: Column) -> Column:
    raw = F.trim(c)
    return F.when(raw.rlike("(?i)^https?://"), raw).when(raw != "", F.concat(F.lit("https://"), raw))


def host(c: Column) -> Column:
    """Lower-cased host without www.; null if it is none or has no dot."""
    found = F.lower(F.try_parse_url(_with_scheme(c), F.lit("HOST")))
    return F.when(found.contains("."), F.regexp_replace(found, "^www\\.", ""))


def domain(c: Column) -> Column:
    """Registrable domain: the last two labels of the host, three under a suffix of two; null if there is no host."""
    h = host(c)
    labels = F.split(h, "\\.")
    two = F.concat_ws(".", F.slice(labels, -2, 2))
    three = F.concat_ws(".", F.slice(labels, -3, 3))
    return F.when(h.isNull() | (F.size(labels) <= 2), h).when(two.isin(*MULTI_LABEL_SUFFIXES), three).otherwise(two)


def canonical_url(c: Column) -> Column:
    """https, no www, no fragment, no tracking parameters (by prefix), no slash at the end of a path."""
    url = _with_scheme(c)
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    query = F.filter(
        F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"),
        lambda p: (p != "") & ~p.rlike(TRACKING_PARAMETERS),
    )
    tail = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.concat_ws("&", query))).otherwise("")
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), "(:[0-9]+)$", 1)
    port = F.when(port.isin(":443"), "").otherwise(port)
    return F.when(host(c).isNotNull(), F.concat(F.lit("https://"), host(c), port, F.when(path == "", "/").otherwise(path), tail))


def is_non_official(c: Column) -> Column:
    return F.coalesce(host(c).isin(*NON_OFFICIAL_HOSTS) | domain(c).isin(*NON_OFFICIAL_HOSTS), F.lit(False))


def is_free_builder(c: Column, anchored: bool = True) -> Column:
    """Hosts of free site builders. Anchored at the end, the endings that close with a dot match no host;
    ``anchored=False`` lets these match any label behind them."""
    pattern = f"({FREE_BUILDER_SUFFIXES})$" if anchored else rf"({FREE_BUILDER_SUFFIXES})([a-z.]*)$"
    return F.coalesce(host(c).rlike(pattern), F.lit(False))


def same_domain(a: Column, b: Column) -> Column:
    return F.coalesce(domain(a) == domain(b), F.lit(False))
