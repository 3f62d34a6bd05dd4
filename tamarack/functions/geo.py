"""Location evidence against a geographic scope that is an argument."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.text import normalize_text

EARTH_KM = 6371.0
MIN_CONFIDENCE = 0.7


@dataclass(frozen=True)
class Scope:
    key: str
    display: str
    province: str
    postal_codes: tuple[str, ...]
    postal_prefix: str
    aliases: tuple[str, ...]
    excluded: tuple[str, ...]
    box: tuple[float, float, float, float]  # least and greatest latitude, least and greatest longitude
    centre: tuple[float, float]
    radius_km: float
    countries: tuple[str, ...] = ("ES", "ESP", "SPAIN", "ESPANA", "ESPAÑA")
    country: str = "ES"


# The city that the results refer to.
MALAGA = Scope(
    key="malaga",
    display="Malaga",
    province="Malaga",
    postal_codes=tuple(str(code) for code in range(29001, 29019)),
    postal_prefix="29",
    aliases=("malaga", "malaga capital", "ciudad de malaga", "municipio de malaga"),
    excluded=(
        "marbella", "torremolinos", "fuengirola", "benalmadena", "mijas", "rincon de la victoria", "estepona",
        "velez malaga", "antequera", "ronda", "alhaurin de la torre", "alhaurin el grande", "cartama", "coin", "nerja",
        "torrox", "manilva", "casares", "ojen", "istan", "monda", "almogia", "pizarra", "alora", "archidona",
        "campillos", "torre del mar", "san pedro de alcantara", "puerto banus", "la cala de mijas",
        "arroyo de la miel",
    ),
    box=(36.61, 36.87, -4.63, -4.28),
    centre=(36.7213, -4.4214),
    radius_km=16.0,
)
SCOPES = {MALAGA.key: MALAGA}


def scope_of(key: str) -> Scope:
    """The scope of a key; an unknown key is an error."""
    wanted = "".join(key.lower().split())
    if wanted not in SCOPES:
        raise ValueError(f"unknown geographic scope {key!r}")
    return SCOPES[wanted]


def scope_table(spark: SparkSession, scopes: tuple[Scope, ...] = tuple(SCOPES.values())) -> DataFrame:
    """A row for each scope: scope_key, province, postal_codes, least and greatest coordinates, centre, radius_km."""
    rows = [(s.key, s.province, list(s.postal_codes), *map(float, s.box), *map(float, s.centre), float(s.radius_km)) for s in scopes]
    return spark.createDataFrame(rows, "scope_key string, province string, postal_codes array<string>, lat0 double, lat1 double, lon0 double, lon1 double, lat_c double, lon_c double, radius_km double")


def in_scopes(records: DataFrame, scopes: DataFrame, key: str = "scope_key", postal: str = "postal_code", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """records with in_box, in_radius, distance_km and postal_ok against the scope that each names; an unknown key is an error.

    The table of scopes is joined by key; Spark broadcasts it where it is small.
    """
    met = records.join(scopes.withColumnRenamed("scope_key", key), key, "left")
    unknown = F.concat(F.lit("unknown geographic scope "), F.coalesce(F.col(key), F.lit("null")))
    known = F.when(F.col("radius_km").isNull(), F.raise_error(unknown).cast("double")).otherwise(F.col("radius_km"))
    km = haversine_km(F.col("lat_c"), F.col("lon_c"), F.col(lat), F.col(lon))
    return met.select(
        *(records[c] for c in records.columns if c != key), key,
        (F.col(lat).between(F.col("lat0"), F.col("lat1")) & F.col(lon).between(F.col("lon0"), F.col("lon1"))).alias("in_box"),
        (km <= known).alias("in_radius"), km.alias("distance_km"), F.array_contains("postal_codes", F.col(postal)).alias("postal_ok"),
    )


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def longest_term(value: Column, terms: tuple[str, ...]) -> Column:
    """The longest of ``terms`` that a normalised value holds (the first of equal length); null if none."""
    ordered = sorted(terms, key=lambda t: -len(t))
    found = F.filter(F.array(*(F.lit(t) for t in ordered)), lambda t: F.contains(value, t))
    return F.get(found, F.lit(0))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once for a row, however often ``use`` names it.

    Columns are put into the place of their names, so that what is named twice at each of some levels is worked out very
    often; the variable of a function isn't.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def location_verdict(
    address: Column, postal_code: Column, municipality: Column, city: Column, province: Column, country: Column,
    latitude: Column, longitude: Column, scope: Scope = MALAGA, min_confidence: float = MIN_CONFIDENCE,
) -> Column:
    """Struct in_scope, confidence, reason, evidence (array of signal, value, weight, supports), distance_km.

    A contradiction rejects, in the order country, excluded municipality, postal code, coordinates;
    otherwise evidence adds up.
    """
    fields = F.filter(F.array(municipality, city, address), lambda f: F.trim(f) != "")
    matched = F.transform(
        fields,
        lambda f: once(normalize_text(f), lambda n: F.struct(f.alias("field"), longest_term(n, scope.excluded).alias("no"), longest_term(n, scope.aliases).alias("yes"))),
    )
    zero = lambda c: F.coalesce(F.length(c), F.lit(0))
    facts = F.struct(
        F.upper(F.trim(F.coalesce(country, F.lit("")))).alias("land"),
        F.regexp_replace(F.coalesce(postal_code, F.lit("")), "[^0-9]", "").alias("postal"),
        once(matched, lambda ms: F.struct(
            F.get(F.filter(ms, lambda m: m["no"].isNotNull() & (zero(m["no"]) >= zero(m["yes"]))), F.lit(0))["no"].alias("outside"),
            F.get(F.filter(ms, lambda m: m["yes"].isNotNull()), F.lit(0))["field"].alias("inside"),
        )).alias("place"),
        province.alias("province"), latitude.alias("lat"), longitude.alias("lon"),
    )
    return once(facts, lambda x: _judged(x, scope, min_confidence))


def _judged(facts: Column, scope: Scope, min_confidence: float) -> Column:
    """The verdict of what :func:`location_verdict` found: land, postal, place (outside, inside), province, lat, lon."""
    land, postal, province, latitude, longitude = (facts[c] for c in ("land", "postal", "province", "lat", "lon"))
    outside, inside = facts["place"]["outside"], facts["place"]["inside"]
    has_postal = F.length(postal) == 5
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    located = finite(latitude) & finite(longitude)
    km = F.when(located, haversine_km(F.lit(scope.centre[0]), F.lit(scope.centre[1]), latitude, longitude))
    told = F.struct(
        land.alias("land"), postal.alias("postal"), outside.alias("outside"), inside.alias("inside"), province.alias("province"), latitude.alias("lat"), longitude.alias("lon"),
        ((land != "") & ~land.isin(*scope.countries)).alias("foreign"), has_postal.alias("has_postal"),
        (has_postal & ~postal.isin(*scope.postal_codes)).alias("wrong_postal"), located.alias("located"),
        (located & ~in_box(latitude, longitude, scope.box)).alias("off_map"), km.alias("km"),
        (F.contains(normalize_text(province), F.lit(scope.province.lower())) & province.isNotNull()).alias("of_province"),
    )
    return once(told, lambda x: _weighed(x, scope, min_confidence))


def _weighed(told: Column, scope: Scope, min_confidence: float) -> Column:
    """The struct of the verdict, from what :func:`_judged` says of each signal."""
    land, postal, outside, inside, province, latitude, longitude = (told[c] for c in ("land", "postal", "outside", "inside", "province", "lat", "lon"))
    foreign, has_postal, wrong_postal, located, off_map, of_province, km = (told[c] for c in ("foreign", "has_postal", "wrong_postal", "located", "off_map", "of_province", "km"))
    item = lambda signal, value, weight, ok: F.struct(
        F.lit(signal).alias("signal"), value.cast("string").alias("value"), F.lit(float(weight)).alias("weight"), F.lit(ok).alias("supports")
    )
    near = located & (km <= scope.radius_km)
    plus = lambda cond, w: F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
    total = (
        plus(land != "", 0.05) + plus(has_postal, 0.45) + plus(inside.isNotNull(), 0.35) + plus(of_province, 0.10)
        + plus(located, 0.35) + plus(near, 0.10)
    )
    rejected = foreign | outside.isNotNull() | wrong_postal | off_map
    weight = F.when(F.coalesce(rejected, F.lit(False)), F.lit(0.0)).otherwise(F.least(F.lit(1.0), total))
    point = lambda d: F.concat(F.format_number(latitude, d), F.lit(","), F.format_number(longitude, d))
    support = F.filter(
        F.array(
            F.when(land != "", item("country", land, 0.05, True)),
            F.when(has_postal, item("postal_code", postal, 0.45, True)),
            F.when(inside.isNotNull(), item("municipality", F.trim(inside), 0.35, True)),
            F.when(of_province, item("province", F.trim(province), 0.10, True)),
            F.when(located, item("coordinates", point(5), 0.35, True)),
            F.when(near, item("centroid_distance_km", F.format_number(km, 2), 0.10, True)),
        ),
        lambda e: e.isNotNull(),
    )
    against = (
        F.when(foreign, item("country", land, 0, False))
        .when(outside.isNotNull(), item("municipality_excluded", outside, 0, False))
        .when(wrong_postal, item("postal_code", postal, 0, False))
        .when(off_map, item("coordinates", point(5), 0, False))
    )
    reason = lambda w: (
        F.when(foreign, F.concat(F.lit("Country "), land, F.lit(f" is outside {scope.country}")))
        .when(outside.isNotNull(), F.concat(F.lit('Municipality "'), outside, F.lit(f'" is in the province but outside {scope.display} city')))
        .when(wrong_postal & postal.startswith(scope.postal_prefix), F.concat(F.lit("Postal code "), postal, F.lit(f" is in the province but not in {scope.display} city")))
        .when(wrong_postal, F.concat(F.lit("Postal code "), postal, F.lit(f" is outside the {scope.display} province")))
        .when(off_map, F.concat(F.lit("Coordinates "), point(4), F.lit(f" fall outside the {scope.display} bounding box")))
        .when(w["weight"] >= min_confidence, F.concat(F.lit(f"Verified in {scope.display} by "), F.concat_ws(", ", F.transform(w["support"], lambda e: e["signal"]))))
        .otherwise(F.lit(f"Insufficient evidence that this business is in {scope.display}"))
    )
    weighed = F.struct(weight.alias("weight"), support.alias("support"), against.alias("against"))
    return once(
        weighed,
        lambda w: F.struct(
            (w["weight"] >= min_confidence).alias("in_scope"),
            (F.floor(w["weight"] * 1000 + 0.5) / 1000).alias("confidence"),
            reason(w).alias("reason"),
            F.when(w["against"].isNotNull(), F.array(w["against"])).otherwise(w["support"]).alias("evidence"),
            F.when(~F.coalesce(foreign | outside.isNotNull() | wrong_postal, F.lit(False)), km).alias("distance_km"),
        ),
    )
