"""Listing records from CSV, JSON, map extracts and place extracts, all to one shape."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.functions.geo import MALAGA, Scope, location_verdict, once
from tamarack.functions.hashing import stable_id
from tamarack.functions.text import clean_field, decimal_number

# The names under which sources publish each field, the first that isn't empty counts.
ALIASES: dict[str, tuple[str, ...]] = {
    "name": ("name", "nombre", "business", "business_name", "razon_social", "title"),
    "legal_name": ("legal_name", "razon_social_legal", "legal"),
    "category": ("category", "categoria", "type", "tipo", "sector", "actividad", "rubro"),
    "description": ("description", "descripcion", "about", "notes"),
    "address": ("address", "direccion", "full_address", "formatted_address", "domicilio"),
    "street": ("street", "calle", "street_address", "via"),
    "postal_code": ("postal_code", "postalcode", "codigo_postal", "cp", "zip", "zipcode"),
    "municipality": ("municipality", "municipio"),
    "city": ("city", "ciudad", "localidad", "poblacion", "town"),
    "province": ("province", "provincia", "state", "region"),
    "country": ("country", "pais", "country_code"),
    "latitude": ("latitude", "lat", "latitud"),
    "longitude": ("longitude", "lon", "lng", "long", "longitud"),
    "phone": ("phone", "telefono", "telephone", "tel", "phone_number", "movil"),
    "email": ("email", "correo", "e_mail", "mail", "correo_electronico"),
    "website": ("website", "web", "url", "sitio_web", "website_url", "homepage"),
    "rating": ("rating", "valoracion", "stars", "puntuacion", "score"),
    "review_count": ("review_count", "reviews", "num_reviews", "total_reviews", "numero_resenas", "resenas"),
    "source_url": ("source_url", "url_fuente", "listing_url", "profile_url"),
    "source_id": ("source_id", "id", "external_id", "place_id"),
    "facebook": ("facebook", "facebook_url"),
    "instagram": ("instagram", "instagram_url"),
    "linkedin": ("linkedin", "linkedin_url"),
}
NUMBERS = ("latitude", "longitude", "rating")
PRIMARY_TAGS = ("amenity", "shop", "office", "tourism", "healthcare", "leisure", "craft")


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Listing rows as strings; quotes may hold line breaks, a byte order mark is dropped, rows without any value too."""
    df = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep)
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    )
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    return df.dropna("all") if df.columns else df


def read_json(spark: SparkSession, path: str, fields: list[str], lines: bool = False) -> DataFrame:
    """An array of records, or an object that holds one under businesses, records or data; fields as strings.

    ``lines``: one record or object to a line, which lets Spark split large files.
    """
    record = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    wrapped = [T.StructField(n, T.ArrayType(record)) for n in ("businesses", "records", "data") if n not in fields]
    raw = spark.read.schema(T.StructType([*record.fields, *wrapped])).option("multiLine", not lines).json(path)
    inner = F.coalesce(*(F.col(f.name) for f in wrapped))
    own = F.array(F.struct(*(F.col(f"`{f}`") for f in fields)))
    return raw.select(F.explode(F.when(inner.isNotNull(), inner).otherwise(own)).alias("r")).select("r.*")


def map_fields(rows: DataFrame, source: str, confidence: float, retrieved_at: Column) -> DataFrame:
    """Rows of any columns to the listing shape. Column names are compared in lower case with underscores;
    rows without a name are dropped; the country is ES where it isn't given."""
    named: dict[str, list[str]] = {}
    for c in rows.columns:
        named.setdefault(re.sub(r"[\s-]+", "_", c.strip().lower()), []).append(c)
    pick = lambda field: F.coalesce(
        F.lit(None).cast("string"),
        *(clean_field(F.col(f"`{c}`").cast("string")) for a in ALIASES[field] for c in named.get(a, ())),
    )
    fields = {f: (decimal_number(pick(f)) if f in NUMBERS else pick(f)) for f in ALIASES}
    fields["review_count"] = decimal_number(fields["review_count"]).cast("int")
    fields["postal_code"] = F.regexp_replace(fields["postal_code"], r"\s+", "")
    fields["country"] = F.upper(F.coalesce(fields["country"], F.lit("ES")))
    fields["source_id"] = F.coalesce(fields["source_id"], stable_id(rows))
    out = rows.select(*(c.alias(f) for f, c in fields.items()), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), retrieved_at.alias("retrieved_at"))
    return out.where("name is not null")


def map_extract(elements: DataFrame, retrieved_at: Column) -> DataFrame:
    """Map elements (type, id, lat, lon, center, tags) to the listing shape; confidence 0.75."""
    t = lambda k: F.try_element_at("tags", F.lit(k))
    primary = F.get(F.filter(F.array(*(F.when(t(k).isNotNull(), F.concat(F.lit(k + "="), t(k))) for k in PRIMARY_TAGS)), lambda x: x.isNotNull()), F.lit(0))
    rows = elements.select(
        F.concat_ws("/", "type", F.col("id").cast("string")).alias("id"),
        F.coalesce(t("name"), t("name:es"), t("name:en")).alias("name"), primary.alias("category"),
        F.concat_ws(", ", F.nullif(F.concat_ws(" ", t("addr:street"), t("addr:housenumber")), F.lit("")), t("addr:postcode"), t("addr:city")).alias("address"),
        F.concat_ws(" ", t("addr:street"), t("addr:housenumber")).alias("street"), t("addr:postcode").alias("postal_code"), t("addr:city").alias("city"),
        F.coalesce("lat", "center.lat").cast("string").alias("latitude"), F.coalesce("lon", "center.lon").cast("string").alias("longitude"),
        F.coalesce(t("phone"), t("contact:phone")).alias("phone"), F.coalesce(t("email"), t("contact:email")).alias("email"),
        F.coalesce(t("website"), t("contact:website")).alias("website"),
    )
    return map_fields(rows, "map", 0.75, retrieved_at)


def place_extract(places: DataFrame, retrieved_at: Column) -> DataFrame:
    """Place records to the listing shape; places that don't operate are dropped; confidence 0.9."""
    part = lambda kind: F.get(F.filter("addressComponents", lambda c: F.array_contains(c["types"], kind)), F.lit(0))["longText"]
    rows = places.where(F.coalesce("businessStatus", F.lit("OPERATIONAL")) == "OPERATIONAL").select(
        "id", F.col("displayName.text").alias("name"), F.coalesce("primaryTypeDisplayName.text", "primaryType").alias("category"),
        F.col("formattedAddress").alias("address"), F.concat_ws(" ", part("route"), part("street_number")).alias("street"),
        part("postal_code").alias("postal_code"), part("locality").alias("city"), part("administrative_area_level_2").alias("province"),
        F.col("location.latitude").cast("string").alias("latitude"), F.col("location.longitude").cast("string").alias("longitude"),
        F.coalesce("internationalPhoneNumber", "nationalPhoneNumber").alias("phone"), F.col("websiteUri").alias("website"),
        F.col("rating").cast("string").alias("rating"), F.col("userRatingCount").cast("string").alias("review_count"),
        F.col("googleMapsUri").alias("source_url"),
    )
    return map_fields(rows, "places", 0.9, retrieved_at)


def selected_elements(elements: DataFrame, selectors: DataFrame, categories: list[str]) -> DataFrame:
    """Map elements with a tag that selectors (category, key, value) name for one of the categories."""
    wanted = selectors.where(F.col("category").isin(*categories)).select("key", "value").distinct()
    ids = elements.select("type", "id", F.explode("tags")).join(wanted, ["key", "value"], "left_semi").select("type", "id").distinct()
    return elements.join(ids, ["type", "id"], "left_semi")


def union_sources(*sources: DataFrame) -> DataFrame:
    first, *rest = sources
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def validate(records: DataFrame, scope: Scope = MALAGA) -> DataFrame:
    """records with ``verdict`` (see location_verdict) and ``reasons`` against them; none: accepted.

    Missing evidence doesn't reject a record (its verdict isn't in scope), a contradiction does.
    """
    c = F.col
    v = location_verdict(c("address"), c("postal_code"), c("municipality"), c("city"), c("province"), c("country"), c("latitude"), c("longitude"), scope)
    some = F.coalesce("postal_code", "municipality", "city", "address").isNotNull() | (c("latitude").isNotNull() & c("longitude").isNotNull())
    reasons = lambda verdict: F.filter(
        F.array(
            F.when(F.coalesce(F.length("name"), F.lit(0)) < 2, "missing or unusable name"),
            F.when(c("source").isNull() | c("source_id").isNull(), "missing source"),
            F.when(c("retrieved_at").isNull(), "missing or invalid retrieved_at"),
            F.when(~some, "no geographic evidence"),
            F.when(F.exists(verdict["evidence"], lambda e: ~e["supports"]), verdict["reason"]),
        ),
        lambda r: r.isNotNull(),
    )
    checked = once(v, lambda verdict: F.struct(verdict.alias("verdict"), reasons(verdict).alias("reasons")))
    return records.withColumn("_checked", checked).select(*records.columns, "_checked.verdict", "_checked.reasons")


def source_report(validated: DataFrame) -> DataFrame:
    """Records by source: discovered, accepted, rejected, in one aggregate."""
    ok = F.size("reasons") == 0
    return validated.groupBy("source").agg(F.count("*").alias("discovered"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))
