"""Literal cases of the column functions."""

import time

import pytest
from pyspark.sql import functions as F

from tamarack.functions import contact, geo, html, numbers, text


@pytest.fixture(scope="module")
def of(spark):
    def run(fn, value, kind="string"):
        return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("x")).first()["x"]

    return run


@pytest.mark.parametrize(
    "value,want",
    [("Óptica Ñandú del Río S.L.", "optica nandu del rio"), ("Fonda Roble, S.A.", "fonda roble"), ("Tejidos Alba", "tejidos alba"),
     (None, ""), ("X Sociedad Limitada", "x"), ("S.L.", "s l")],
)
def test_names(of, value, want):
    assert of(text.normalize_name, value) == want


def test_text(of):
    assert of(text.normalize_text, "  ÁÉ--ñ\t1 ") == "ae n 1"
    assert of(text.strip_diacritics, "éḀ") == "eA"
    assert of(text.redact, "key sk-abcdefghijklmnop1 x") == "key [REDACTED] x"
    assert of(text.decimal_number, "4,8") == 4.8 and of(text.decimal_number, "x") is None
    assert of(text.street_key, "Calle Larios, 5 Bajo") == "larios 5"
    assert sorted(of(text.trigrams, "word")) == ["  w", " wo", "ord", "rd ", "wor"]


def test_trigram_similarity(spark):
    df = spark.createDataFrame([("word", "two words")], "a string, b string")
    assert df.select(text.trigram_similarity(F.col("a"), F.col("b"))).first()[0] == pytest.approx(4 / 11)


@pytest.mark.parametrize(
    "value,want",
    [("95 140 77 12", "+34951407712"), ("+34 951407712", "+34951407712"), ("0034951407712", "+34951407712"), ("34951407712", "+34951407712"),
     ("+44 951407712", None), ("123", None), ("151407712", None), (None, None)],
)
def test_phone(of, value, want):
    got = of(contact.phone, value)
    assert (got and got["e164"]) == want


@pytest.mark.parametrize(
    "value,want",
    [("http://www.roble.test/carta/vinos/?fbclid=z&mesa=7#tinto", "https://roble.test/carta/vinos?mesa=7"), ("alba.test", "https://alba.test/"),
     ("nodot", None), ("", None), (None, None), ("https://T.alba.co.uk:8080//", "https://t.alba.co.uk:8080/")],
)
def test_canonical(of, value, want):
    assert of(contact.canonical_url, value) == want


def test_hosts(of):
    assert of(contact.domain, "http://a.b.alba.com.es/x") == "alba.com.es"
    assert of(contact.is_non_official, "m.facebook.com/x") and not of(contact.is_non_official, None)
    assert of(contact.is_free_builder, "x.wixsite.com") and not of(contact.is_free_builder, "x.blogspot.com")
    assert of(lambda c: contact.is_free_builder(c, anchored=False), "x.blogspot.com")
    assert of(contact.email, "mailto:Info@Shop.es?x=1")["is_role"] and of(contact.email, "a@b") is None


def test_rounding(of):
    assert of(lambda c: numbers.round_half_up(c), -2.25, "double") == -2.2
    assert of(lambda c: numbers.round_half_up(c, 2), 0.285, "double") == 0.28
    assert of(lambda c: numbers.clamp(c), float("nan"), "double") == 0.0


LOCATION = "address string, postal string, municipality string, city string, province string, country string, lat double, lon double"


@pytest.mark.parametrize(
    "row,ok,against",
    [
        (("Calle Larios 1", "29005", None, "Málaga", "Málaga", "ES", 36.72, -4.42), True, None),
        ((None, "29005", None, "Malaga", None, "ES", None, None), True, None),
        ((None, None, None, "Vélez-Málaga", None, "ES", None, None), False, "municipality_excluded"),
        ((None, "29601", None, "Malaga", None, "ES", None, None), False, "postal_code"),
        ((None, "28013", None, None, None, "ES", None, None), False, "postal_code"),
        ((None, "29005", None, "Malaga", None, "PT", None, None), False, "country"),
        ((None, "29005", None, "Malaga", None, "ES", 40.4, -3.7), False, "coordinates"),
        ((None, None, None, None, "Malaga", None, None, None), False, None),
        ((None, "290", None, "Malaga", None, None, 36.72, -4.42), True, None),
    ],
)
def test_location(spark, row, ok, against):
    df = spark.createDataFrame([row], LOCATION)
    v = df.select(geo.location_verdict(*(F.col(c) for c in df.columns)).alias("v")).first()["v"]
    assert v["in_scope"] == ok
    assert next((e["signal"] for e in v["evidence"] if not e["supports"]), None) == against


def test_unknown_scope():
    assert geo.scope_of(" Malaga ").key == "malaga"
    with pytest.raises(ValueError):
        geo.scope_of("atlantis")


TIDY = """<!doctype html><HTML lang='ca'><head><title> Fonda &amp; Roble </title><meta content=width=device-width name="viewport">
<meta name='description' content="Cuina de mercat"><link href="https://roble.test/ca" rel=canonical></head><body><h1>Benvinguts</h1><h2>Carta</h2><h2>Vins</h2>
<img alt="sala" src=sala.webp><img src='cuina.webp'><img src=pati.webp alt="pati"><a href='tel:+34951407712'>Truca</a><a href=mailto:taula@roble.test>correu</a>
<a href="https://api.whatsapp.com/send?phone=34951407712">xat</a><a href=/reservas>Pedir cita</a><a href="https://www.instagram.com/roble">fotos</a>
<form action=/x><textarea name=t></textarea></form><script src='https://www.google-analytics.com/ga.js'></script><footer>Copyright 2025 catering i banquete &#8211; &#39;nit&#39;</footer></body></HTML>"""
OLD = """<html><body bgcolor=white><blink>Oferta</blink><center><font color=red>Tejidos</font></center><table width=960><tr><td>x</td></tr></table><h2>Telas</h2><h4>Lino</h4>
<img src=a.gif alt="tela"><img src=b.gif><p>&copy; 2009</p></body></html>"""


def test_html(spark):
    df = spark.createDataFrame([(1, TIDY), (2, OLD), (3, None)], "id int, html string")
    rows = {r.id: r for r in html.with_parts(df).select("id", *(c.alias(n) for n, c in html.page_signals().items())).collect()}
    m, d, n = rows[1], rows[2], rows[3]
    assert m.title == "Fonda & Roble" and m.meta_description == "Cuina de mercat" and m.has_viewport and m.lang == "ca" and m.canonical == "https://roble.test/ca"
    assert (m.image_count, m.images_with_alt, m.h1_count, m.heading_levels) == (3, 2, 1, [1, 2, 2])
    assert m.has_tel and m.has_mailto and m.has_whatsapp and m.has_booking and m.has_contact_form and m.has_analytics and m.social_platforms == ["instagram"]
    assert m.copyright_year == 2025 and not m.uses_legacy and "catering i banquete \u2013 'nit'" in m.text
    assert d.uses_legacy and d.uses_fixed_width and d.copyright_year == 2009 and d.heading_levels == [2, 4] and not d.has_viewport and d.title is None
    assert (d.image_count, d.images_with_alt, d.h1_count) == (2, 1, 0)
    assert n.text == "" and n.image_count == 0


def test_families_that_nobody_asks_for_are_not_read(spark):
    """A signal of headings reads headings alone: no other family's pattern is in the plan."""
    df = spark.createDataFrame([(1, TIDY)], "id int, html string")
    plan = html.with_parts(df).select(html.page_signals()["h1_count"].alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "<h([1-6])" in plan and not any(tag in plan for tag in ("<meta", "<img", "<form", "<button", "<script", "<style"))


def test_decimal_entities(spark, of):
    said = of(html.decode_entities, "a &#300; &#8217;x&#128512;&#0;&#55357;&#1114112;&#00000000065;&#99999999999999999999; &#7; &#x41; &#39; &amp;#66;")
    assert said == "a \u012c \u2019x\U0001f600\ufffd\ufffd\ufffdA\ufffd \x07 &#x41; ' B"
    points = spark.range(1, 0x110000, 1, 4).where("id NOT BETWEEN 55296 AND 57343").select("id", html.decode_entities(F.concat(F.lit("&#"), F.col("id").cast("string"), F.lit(";"))).alias("c"))
    plain = points.select(F.col("id"), F.hex(F.encode("c", "UTF-32")).alias("h"))
    assert plain.where(F.conv("h", 16, 10).cast("long") != F.col("id")).count() == 0  # every code point there is


@pytest.mark.parametrize("tag,want", [('<a href="x y">', "x y"), ("<a href='x'>", "x"), ("<a href=x>", "x"), ('<a data-href="no" href = "yes">', "yes"), ("<a data-href=no>", None)])
def test_attribute(of, tag, want):
    assert of(lambda c: html.attribute(c, "href"), tag) == want


def test_verdict_works_its_parts_out_once(spark):
    """A city is folded once, however many fields of the verdict need it: 30 microseconds a row, were it each time 200."""
    rows = lambda n: spark.range(0, n, 1, 1).selectExpr("id", "concat('Malaga', id) AS city", "36.7D + id % 9 AS lat", "-4.4D + id % 9 AS lon")
    none = F.lit(None).cast("string")
    v = geo.location_verdict(none, none, none, F.col("city"), none, none, F.col("lat"), F.col("lon"))
    run = lambda n: rows(n).select(v.alias("v")).select("v.confidence", "v.reason", "v.evidence").write.format("noop").mode("overwrite").save()
    run(2_000)
    begin = time.perf_counter()
    run(40_000)
    assert time.perf_counter() - begin < 5
