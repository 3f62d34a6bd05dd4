"""Queries of extracts, scopes, requests, export files and reports of what became of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.functions import geo
from tamarack.operators import relational, resolve, scoring, search
from tamarack.operators.storage import new_path, written
from tamarack.plans.records import AT, NAME, SCORES_SQL, _facts, _keyed, _keyed_sql, _mapped
from tamarack.plans.registry import SQL, query, table
from tamarack.sources import listings, sinks
from tamarack.streaming import jobs

LISTED = ("source_id", "name", "category", "address", "street", "postal_code", "city", "latitude", "longitude", "phone", "website", "confidence")


@query(
    "A4_map_extract",
    """WITH e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'Calle ' || (p_partkey % 40) END AS road, CASE WHEN p_partkey % 6 = 0 THEN CAST(p_partkey % 9 + 1 AS VARCHAR) END AS number,
        CAST(29000 + p_partkey % 23 AS VARCHAR) AS code, CASE WHEN p_partkey % 5 > 0 THEN 'Malaga' END AS city FROM part WHERE p_partkey % 4 < 3),
    s AS (SELECT *, nullif(concat_ws(' ', road, number), '') AS street FROM e)
    SELECT CASE WHEN k % 3 = 0 THEN 'way' ELSE 'node' END || '/' || k AS source_id, CASE k % 4 WHEN 0 THEN 'N ' WHEN 1 THEN 'E ' ELSE 'I ' END || k AS name,
      CASE k % 3 WHEN 0 THEN 'amenity=bar' WHEN 1 THEN 'shop=toys' END AS category, concat_ws(', ', street, code, city) AS address, street, code AS postal_code, city,
      (36.5::DOUBLE + (k % 100) / 1000.0::DOUBLE) AS latitude, (-4.5::DOUBLE + (k % 10) / 100.0::DOUBLE) AS longitude, CASE WHEN k % 2 = 0 THEN '95' ELSE '96' END || k AS phone,
      CASE WHEN k % 3 = 1 THEN 'http://x.es/' || k END AS website, 0.75::DOUBLE AS confidence FROM s""",
)
def map_extract(spark, sf):
    """Elements written and read as JSON: names in three tags, centres of ways, tags in one of two places."""
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    tags = {
        "name": F.when(k % 4 == 0, F.concat(F.lit("N "), text)), "name:es": F.when(k % 4 == 1, F.concat(F.lit("E "), text)), "name:en": F.when(k % 4 == 2, F.concat(F.lit("I "), text)),
        "amenity": F.when(k % 3 == 0, "bar"), "shop": F.when(k % 3 == 1, "toys"), "tourism": F.when(k % 3 == 1, "hotel"), "phone": F.when(k % 2 == 0, F.concat(F.lit("95"), text)),
        "contact:phone": F.when(k % 2 == 1, F.concat(F.lit("96"), text)), "contact:website": F.when(k % 3 == 1, F.concat(F.lit("http://x.es/"), text)),
        "addr:street": F.when(k % 2 == 0, F.concat(F.lit("Calle "), (k % 40).cast("string"))), "addr:housenumber": F.when(k % 6 == 0, (k % 9 + 1).cast("string")),
        "addr:postcode": (29000 + k % 23).cast("string"), "addr:city": F.when(k % 5 > 0, "Malaga"),
    }
    lat, lon = F.expr("36.5D + (p_partkey % 100) / 1000D"), F.expr("-4.5D + (p_partkey % 10) / 100D")
    way = k % 3 == 0
    elements = table(spark, sf, "part").select(
        F.when(way, "way").otherwise("node").alias("type"), k.alias("id"), F.when(~way, lat).alias("lat"), F.when(~way, lon).alias("lon"),
        F.when(way, F.struct(lat.alias("lat"), lon.alias("lon"))).alias("center"),
        F.map_filter(F.create_map(*[x for name, v in tags.items() for x in (F.lit(name), v)]), lambda _, v: v.isNotNull()).alias("tags"),
    )
    path = new_path(spark, "map-json")
    elements.write.json(path)
    schema = "type string, id long, lat double, lon double, center struct<lat: double, lon: double>, tags map<string, string>"
    return listings.map_extract(spark.read.schema(schema).json(path), F.expr(AT)).select(*LISTED)


@query(
    "A5_place_extract",
    """WITH e AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 <> 2)
    SELECT 'p' || k AS source_id, 'Place ' || k AS name, CASE WHEN k % 3 > 0 THEN 'Bar ' || (k % 3) ELSE 'bar' END AS category, 'Calle ' || k || ', 29001 Malaga' AS address,
      CASE WHEN k % 2 = 0 THEN 'Calle ' || k || ' ' || (k % 7) ELSE 'Calle ' || k END AS street, CASE WHEN k % 4 > 0 THEN '2900' || (k % 9) END AS postal_code, 'Malaga' AS city,
      36.5::DOUBLE + (k % 100) / 1000.0::DOUBLE AS latitude, -4.5::DOUBLE AS longitude, CASE WHEN k % 2 = 0 THEN '+34 95' || k ELSE '95' || k END AS phone, 'http://y.es/' || k AS website, 0.9::DOUBLE AS confidence FROM e""",
)
def place_extract(spark, sf):
    """Places written and read as JSON; those that don't operate go."""
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    part = lambda kind, value: F.struct(value.alias("longText"), value.alias("shortText"), F.array(F.lit("x"), F.lit(kind)).alias("types"))
    components = F.array(
        part("locality", F.lit("Malaga")), part("route", F.concat(F.lit("Calle "), text)), F.when(k % 2 == 0, part("street_number", (k % 7).cast("string"))),
        F.when(k % 4 > 0, part("postal_code", F.concat(F.lit("2900"), (k % 9).cast("string")))),
    )
    places = table(spark, sf, "customer").select(
        F.concat(F.lit("p"), text).alias("id"), F.struct(F.concat(F.lit("Place "), text).alias("text")).alias("displayName"), F.concat(F.lit("Calle "), text, F.lit(", 29001 Malaga")).alias("formattedAddress"),
        F.filter(components, lambda c: c.isNotNull()).alias("addressComponents"), F.struct(F.expr("36.5D + (c_custkey % 100) / 1000D").alias("latitude"), F.lit(-4.5).alias("longitude")).alias("location"),
        F.lit(4.5).alias("rating"), (k % 700).cast("int").alias("userRatingCount"), F.concat(F.lit("http://y.es/"), text).alias("websiteUri"),
        F.when(k % 2 == 0, F.concat(F.lit("+34 95"), text)).alias("internationalPhoneNumber"), F.concat(F.lit("95"), text).alias("nationalPhoneNumber"), F.lit("bar").alias("primaryType"),
        F.when(k % 3 > 0, F.struct(F.concat(F.lit("Bar "), (k % 3).cast("string")).alias("text"))).alias("primaryTypeDisplayName"),
        F.when(k % 5 == 2, "CLOSED_PERMANENTLY").when(k % 5 == 1, "OPERATIONAL").alias("businessStatus"), F.lit(None).cast("string").alias("googleMapsUri"),
    )
    path = new_path(spark, "place-json")
    places.write.json(path)
    return listings.place_extract(spark.read.schema(places.schema).json(path), F.expr(AT)).select(*LISTED)


NERJA = geo.Scope(
    key="nerja", display="Nerja", province="Malaga", postal_codes=("29780", "29787"), postal_prefix="297", aliases=("nerja",), excluded=(),
    box=(36.70, 36.80, -3.95, -3.75), centre=(36.75, -3.87), radius_km=9.0,
)


@query(
    "D5_scope_table",
    """WITH s(k, y0, y1, x0, x1, y, x, r, codes) AS (VALUES (0, 36.61::DOUBLE, 36.87::DOUBLE, -4.63::DOUBLE, -4.28::DOUBLE, 36.7213::DOUBLE, -4.4214::DOUBLE, 16.0::DOUBLE, list_transform(range(29001, 29019), lambda c: CAST(c AS VARCHAR))),
        (1, 36.70, 36.80, -3.95, -3.75, 36.75, -3.87, 9.0, ['29780', '29787'])),
    c AS (SELECT c_custkey, s.*, CASE WHEN c_custkey % 3 = 0 THEN '29787' ELSE CAST(29000 + c_custkey % 25 AS VARCHAR) END AS code, 36.5::DOUBLE + (c_custkey % 50) / 100.0::DOUBLE AS lat, -4.7::DOUBLE + (c_custkey % 100) / 100.0::DOUBLE AS lon FROM customer JOIN s ON s.k = c_custkey % 2),
    d AS (SELECT *, 2 * 6371.0::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians(lat - y) / 2), 2) + cos(radians(y)) * cos(radians(lat)) * pow(sin(radians(lon - x) / 2), 2)))) AS km FROM c)
    SELECT c_custkey, CASE WHEN k = 0 THEN 'malaga' ELSE 'nerja' END AS scope_key, lat BETWEEN y0 AND y1 AND lon BETWEEN x0 AND x1 AS in_box, km <= r AS in_radius, list_contains(codes, code) AS postal_ok, floor(km * 1000 + 0.5) / 1000 AS km FROM d""",
)
def scopes(spark, sf):
    records = table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN 'malaga' ELSE 'nerja' END AS scope_key", "CASE WHEN c_custkey % 3 = 0 THEN '29787' ELSE cast(29000 + c_custkey % 25 AS string) END AS postal_code",
        "36.5D + (c_custkey % 50) / 100D AS latitude", "-4.7D + (c_custkey % 100) / 100D AS longitude",
    )
    found = geo.in_scopes(records, geo.scope_table(spark, (geo.MALAGA, NERJA)))
    return found.select("c_custkey", "scope_key", "in_box", "in_radius", "postal_ok", (F.floor(F.col("distance_km") * 1000 + 0.5) / 1000).alias("km"))


@query(
    "E3_request_filters",
    """WITH r AS (SELECT p_partkey AS id, lower(p_type) AS category, CAST(p_size AS DOUBLE) * 2 AS opportunity, p_retailprice AS relevance, CAST(p_partkey % 700 AS BIGINT) AS reviews FROM part),
    a AS (SELECT 'all' AS request, * FROM r ORDER BY opportunity DESC, relevance DESC, reviews DESC, id LIMIT 10), b AS (SELECT 'capped' AS request, * FROM r WHERE category = 'economy' AND opportunity >= 30 ORDER BY opportunity DESC, relevance DESC, reviews DESC, id LIMIT 25),
    c AS (SELECT 'least' AS request, * FROM r WHERE category = 'large' ORDER BY opportunity DESC, relevance DESC, reviews DESC, id LIMIT 1), d AS (SELECT 'floor' AS request, * FROM r WHERE opportunity >= 100 ORDER BY opportunity DESC, relevance DESC, reviews DESC, id LIMIT 7)
    SELECT request, id FROM a UNION ALL SELECT request, id FROM b UNION ALL SELECT request, id FROM c UNION ALL SELECT request, id FROM d""",
)
def request_filters(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey AS id", "lower(p_type) AS category", "cast(p_size AS double) * 2 AS opportunity", "p_retailprice AS relevance", "cast(p_partkey % 700 AS long) AS reviews")
    asked = {"all": {}, "capped": {"limit": 400, "category": " economy ", "least": 30}, "least": {"limit": -3, "category": "large"}, "floor": {"limit": 7.9, "least": 100}}
    parts = [search.requested(rows, **options).select(F.lit(name).alias("request"), "id") for name, options in asked.items()]
    return listings.union_sources(*parts)


def _members(spark, sf):
    """Entities that pass the gate by their scores, active or not, their places as sure or not."""
    from tamarack.operators import scoring

    k = F.col("id")
    scored = scoring.score_entities(_facts(spark, sf).withColumn("location_confidence", F.lit(0.9)))
    return scored.withColumns({"status": F.when(k % 4 == 1, "closed").when(k % 8 > 0, "active"), "location_confidence": F.when(k % 10 > 1, (k % 10) / 10.0)})


MEMBERS_SQL = SQL["J1_J4_E4_scores"].split(" SELECT id, quality")[0].replace("CASE WHEN loc < 0.7 THEN 'location_confidence' END, ", "")
MEMBER = "len(failed_tests) = 0 AND scoped AND id % 4 <> 1 AND id % 8 > 0 AND id % 10 >= 7"


@query("E5_index_membership", f"{MEMBERS_SQL} SELECT id, quality FROM g WHERE {MEMBER}")
def index_membership(spark, sf):
    return search.index_members(_members(spark, sf)).select("id", "quality")


@query(
    "J10_dataset_funnel",
    f"""{MEMBERS_SQL}, m AS (SELECT *, id % 4 <> 1 AND id % 8 > 0 AS active FROM g)
    SELECT 'businesses' AS stage, count(*) FILTER (WHERE active) AS n FROM m UNION ALL SELECT 'in_scope', count(*) FILTER (WHERE active AND scoped) FROM m
    UNION ALL SELECT 'audited', (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'indexed', (SELECT count(*) FROM m WHERE {MEMBER})""",
)
def dataset_funnel(spark, sf):
    entities = _members(spark, sf)
    audits = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("business_id"))
    return relational.funnel(entities, audits, search.index_members(entities))


@query(
    "L5_result_notes",
    """WITH r AS (SELECT n_nationkey AS k, n_name AS place, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 8000) AS found FROM nation), n AS (SELECT *, CASE WHEN k % 5 = 0 THEN 1 ELSE 5 END AS asked FROM r)
    SELECT k, found, CASE WHEN found >= asked THEN NULL WHEN found = 0 THEN 'No ' || place || ' businesses currently meet the quality threshold for this search.'
      ELSE 'Only ' || found || ' ' || place || CASE WHEN found = 1 THEN ' business meets' ELSE ' businesses meet' END || ' the quality threshold, so the list is not padded.' END AS note FROM n""",
)
def result_notes(spark, sf):
    found = table(spark, sf, "supplier").where("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("found"))
    asked = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("place"), F.when(F.col("n_nationkey") % 5 == 0, 1).otherwise(5).alias("asked"))
    rows = asked.join(found, "k", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return rows.select("k", "found", search.result_note(F.col("found"), F.col("asked"), F.col("place")).alias("note"))


DECIDED_SQL = SQL["G1_G5_decisions"]


@query(
    "G8_outcome_report",
    f"""WITH d AS ({DECIDED_SQL}), v AS (SELECT c_custkey AS id, trim({NAME}) AS name, CASE WHEN c_custkey % 2 = 0 THEN 'listing' ELSE 'csv' END AS source, 29000 + c_custkey % 23 AS code FROM customer),
    w AS (SELECT *, length(name) < 2 AS short, code NOT BETWEEN 29001 AND 29018 AS away FROM v),
    x AS (SELECT source, CASE WHEN d.id IS NULL THEN 'inserted' WHEN d.action = 'merge' THEN 'merged' ELSE d.action END AS action, 'rule ' || d.rule AS reason FROM w LEFT JOIN d ON d.id = w.id WHERE NOT short AND NOT away
      UNION ALL SELECT source, 'rejected', 'missing or unusable name' FROM w WHERE short UNION ALL SELECT source, 'rejected', 'location contradicted' FROM w WHERE away)
    SELECT source, action, reason, count(*) AS n FROM x GROUP BY 1, 2, 3""",
)
def outcomes(spark, sf):
    judged = listings.validate(_mapped(spark, sf)).select(
        F.col("source_id").cast("long").alias("id"), F.when(F.col("source_id").cast("long") % 2 == 0, "listing").otherwise("csv").alias("source"),
        F.transform("reasons", lambda r: F.when(r == "missing or unusable name", r).otherwise("location contradicted")).alias("reasons"),
    )
    checked = written(judged, "checked")  # all that follows reads the verdicts, none judges again
    accepted = checked.where(F.size("reasons") == 0).select("id")
    decided = resolve.decisions(_keyed(spark, sf, "record").join(accepted, "id", "left_semi"), _keyed(spark, sf, "entity"))
    return resolve.outcome_report(checked, decided)


REVIEW_SQL = "CASE rule WHEN 2 THEN 'one phone number, names differ' WHEN 3 THEN 'one street, names differ somewhat' ELSE 'one postal code, names nearly alike' END"


@query("G5_review_table", f"SELECT id, entity_id, rule, confidence, {REVIEW_SQL} AS reason FROM ({DECIDED_SQL}) WHERE action = 'ambiguous'")
def review(spark, sf):
    """Ambiguous records, written once and read back."""
    decided = resolve.decisions(_keyed(spark, sf, "record"), _keyed(spark, sf, "entity"))
    return written(resolve.review_table(decided), "review").select("id", "entity_id", "rule", "confidence", "reason")


@query(
    "E4_G5_duplicates",
    f"""WITH {SCORES_SQL}, decided AS ({DECIDED_SQL}),
    same AS (SELECT id, entity_id FROM decided WHERE action = 'merge' OR rule = 3 OR id % 2 = 0),
    dup AS (SELECT id, min(id) OVER (PARTITION BY entity_id) AS first FROM same)
    SELECT g.id, array_to_string(CASE WHEN dup.id <> dup.first THEN ['duplicate'] ELSE [] END || failed_tests, '|') AS failed, CASE WHEN dup.id <> dup.first THEN dup.first END AS duplicate_of FROM g LEFT JOIN dup ON dup.id = g.id""",
)
def duplicates(spark, sf):
    """Pairs that a review confirmed (all of rule 3, the others of even ids), carried along merges to the gate of scores."""
    decided = written(resolve.decisions(_keyed(spark, sf, "record"), _keyed(spark, sf, "entity")), "decided")
    # records and entities are one set of ids: entities behind all records
    behind = F.col("entity_id") + (1 << 40)
    confirmed = resolve.review_table(decided).where("rule = 3 OR id % 2 = 0").select("id", behind.alias("entity_id"))
    merged = decided.where("action = 'merge'").select("id", behind.alias("component"))
    known = resolve.carried_duplicates(confirmed, merged)
    facts = _facts(spark, sf).drop("is_duplicate").join(known, "id", "left").withColumn("is_duplicate", F.col("duplicate_of").isNotNull())
    return scoring.score_entities(facts).select("id", F.concat_ws("|", "failed").alias("failed"), "duplicate_of")


@query(
    "B3_export_file",
    rf"""WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '=' WHEN 1 THEN '@x, ' WHEN 2 THEN '"q" ' ELSE '' END || c_name AS name, c_mktsegment AS category, c_acctbal AS score FROM customer),
    g AS (SELECT *, CASE WHEN regexp_matches(name, '^[=+@-]') THEN '''' || name ELSE name END AS guarded FROM c)
    SELECT CASE WHEN regexp_matches(guarded, '[",]') THEN '"' || replace(guarded, '"', '""') || '"' ELSE guarded END || ',' || category || ',' || CAST(floor(score + 0.5) AS BIGINT) || ',,,,''+34 95' || k || ',,,,4.5,' || (k % 700) || ',,29001,Malaga,,a | b,' || k || ',' AS line FROM g
    UNION ALL SELECT '{",".join(sinks.SHORTLIST)}'""",
)
def export_file(spark, sf):
    """The lines of an exported shortlist as they stand in its files; each file has the header, and the mark, which the reader drops."""
    rows = table(spark, sf, "customer").select(
        F.expr("concat(CASE c_custkey % 4 WHEN 0 THEN '=' WHEN 1 THEN '@x, ' WHEN 2 THEN '\"q\" ' ELSE '' END, c_name)").alias("name"), F.col("c_mktsegment").alias("category"), F.col("c_acctbal").alias("opportunity"),
        F.concat(F.lit("+34 95"), F.col("c_custkey").cast("string")).alias("phone"), F.lit(4.5).alias("rating"), (F.col("c_custkey") % 700).alias("review_count"), F.lit("29001").alias("postal_code"),
        F.lit("Malaga").alias("city"), F.array(F.lit("a"), F.lit("b")).alias("top_reasons"), F.col("c_custkey").alias("prospect_id"),
    )
    path = new_path(spark, "export")
    sinks.write_csv(sinks.shortlist_rows(rows), path, mark=True)
    lines = spark.read.option("lineSep", "\r\n").text(path).select(F.col("value").alias("line"))
    head = F.col("line") == ",".join(sinks.SHORTLIST)
    return lines.where(~head).unionByName(lines.where(head).distinct())


@query(
    "O6_stale_alerts",
    """WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(last) // 1000 AS last_ms FROM l WHERE last <= TIMESTAMP '2024-02-01 12:00:00' - INTERVAL 2 DAY""",
)
def stale_alerts(spark, sf):
    audits = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("at"))
    return jobs.stale_now(audits, 2, F.expr("timestamp '2024-02-01 12:00:00'"))
