"""Queries of records: sources, validation, classification, resolution, scoring, search, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.functions import text
from tamarack.operators import classify, postings, relational, resolve, scoring, search
from tamarack.operators.storage import new_path, spread
from tamarack.plans.fields import GRAMS_SQL, NORM, TOKENS_SQL
from tamarack.plans.registry import query, table
from tamarack.sources import listings, sinks, splittable
from tamarack.sources.snapshots import Keyed, Snapshots

AT = "timestamp '2024-02-01 00:00:00'"
NAME = "concat(CASE c_custkey % 5 WHEN 0 THEN 'Clinica ' WHEN 1 THEN 'Bar ' WHEN 2 THEN 'Bufete ' WHEN 3 THEN 'Taller ' ELSE 'X' END, CASE WHEN c_custkey % 5 = 4 THEN '' ELSE cast(c_custkey // 3 as varchar) END)"


def _spark(sql: str) -> str:
    return sql.replace("c_custkey // 3", "(c_custkey div 3)").replace("as varchar", "as string").replace("AS VARCHAR", "AS STRING")


def _listing_rows(spark, sf):
    """Raw listing rows with the column names of two kinds of sources, derived from customers."""
    c = spread(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"))
    return c.selectExpr(
        _spark(f"{NAME} AS Nombre"), "c_mktsegment AS Tipo", "concat('Calle ', c_custkey % 40) AS `Direccion`",
        "cast(29000 + c_custkey % 23 as string) AS `Codigo-Postal`", "'Málaga' AS ciudad", "concat('95', lpad(cast(c_custkey % 500 as string), 7, '2')) AS Telefono",
        "concat('4,', cast(c_custkey % 10 as string)) AS valoracion", "cast(c_custkey % 700 as string) AS resenas", "cast(c_custkey as string) AS id",
    )


def _mapped(spark, sf):
    return listings.map_fields(_listing_rows(spark, sf), "listing", 0.8, F.expr(AT))


@query(
    "A6_A7_alias_mapping",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS source_id, trim({NAME}) AS name, c_mktsegment AS category, CAST(29000 + c_custkey % 23 AS VARCHAR) AS postal_code,
      CAST('4.' || (c_custkey % 10) AS DOUBLE) AS rating, CAST(c_custkey % 700 AS INTEGER) AS review_count, 'ES' AS country FROM customer""",
)
def aliases(spark, sf):
    return _mapped(spark, sf).select("source_id", "name", "category", "postal_code", "rating", "review_count", "country")


@query(
    "A8_E1_validation",
    f"""WITH v AS (SELECT length(trim({NAME})) >= 2 AND 29000 + c_custkey % 23 BETWEEN 29001 AND 29018 AS ok FROM customer)
    SELECT 'listing' AS source, count(*) AS discovered, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS rejected FROM v""",
)
def validation(spark, sf):
    return listings.source_report(listings.validate(_mapped(spark, sf)))


@query(
    "A9_tag_selector",
    """SELECT p_partkey AS id FROM part WHERE (p_type, p_size) IN (('ECONOMY', 5), ('SMALL', 7), ('SMALL', 8))""",
)
def selector(spark, sf):
    elements = table(spark, sf, "part").select(F.lit("node").alias("type"), F.col("p_partkey").alias("id"), F.create_map("p_type", F.col("p_size").cast("string")).alias("tags"))
    selectors = spark.createDataFrame([("a", "ECONOMY", "5"), ("a", "SMALL", "7"), ("a", "SMALL", "8"), ("b", "SMALL", "9")], "category string, key string, value string")
    return listings.selected_elements(elements, selectors, ["a"]).select("id")


@query("M1_union_of_sources", "SELECT c_custkey AS id, c_nationkey AS nation, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, s_nationkey, 'supplier' FROM supplier")
def union(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.lit("customer").alias("source"))
    b = table(spark, sf, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return listings.union_sources(a, b)


@query(
    "B1_upsert",
    """WITH o AS (SELECT c_custkey AS id, c_acctbal AS balance, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer),
    n AS (SELECT o_custkey AS id, max(o_totalprice) AS balance, min(o_orderpriority) AS segment FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)
    SELECT coalesce(o.id, n.id) AS id, greatest(o.balance, n.balance) AS balance, coalesce(o.segment, n.segment) AS segment, CAST(CASE WHEN n.id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS seq
    FROM o FULL JOIN n ON o.id = n.id""",
)
def upsert(spark, sf):
    old = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_acctbal AS balance", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment", "0 AS seq")
    new = table(spark, sf, "orders").where("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("balance"), F.min("o_orderpriority").alias("segment")).withColumn("seq", F.lit(1))
    return relational.upsert(old, new, ["id"], {"balance": "greatest", "segment": "coalesce_old"})


def _balances(spark, sf):
    """The table of B1 as a versioned one, with the upsert of B1 as its second version."""
    store = Snapshots(spark, new_path(spark, "balances"), {"balances": Keyed("id long, balance double, segment string, seq int", ("id",), 16)})
    old = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_acctbal AS balance", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment", "0 AS seq")
    store.replace("balances", old)
    new = table(spark, sf, "orders").where("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("balance"), F.min("o_orderpriority").alias("segment")).withColumn("seq", F.lit(1))
    batch = ("orders", 0)
    for _ in range(2):  # the batch comes twice and is taken in once
        store.upsert("balances", new, {"balance": "greatest", "segment": "coalesce_old"}, batch=batch)
    return store


BALANCES_SQL = """o AS (SELECT c_custkey AS id, c_acctbal AS balance, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer),
    n AS (SELECT o_custkey AS id, max(o_totalprice) AS balance, min(o_orderpriority) AS segment FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1),
    b AS (SELECT coalesce(o.id, n.id) AS id, greatest(o.balance, n.balance) AS balance, coalesce(o.segment, n.segment) AS segment, CAST(CASE WHEN n.id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS seq FROM o FULL JOIN n ON o.id = n.id)"""


@query("B1_B5_snapshot_upsert", f"WITH {BALANCES_SQL} SELECT 1 AS version, id, balance, segment, 0 AS seq FROM o UNION ALL SELECT 2, id, balance, segment, seq FROM b")
def snapshot_upsert(spark, sf):
    store = _balances(spark, sf)
    return store.read("balances", version=1).select(F.lit(1).alias("version"), "*").unionByName(store.read("balances").select(F.lit(2).alias("version"), "*"))


@query("B2_snapshot_refresh", f"WITH {BALANCES_SQL} SELECT id, balance > 300000 AS kept FROM b")
def snapshot_refresh(spark, sf):
    """Rows that still qualify are a third version; what went is told by comparing the two."""
    store = _balances(spark, sf)
    store.replace("balances", store.read("balances").where("balance > 300000"))
    return store.read("balances").select("id", F.lit(True).alias("kept")).unionByName(store.removed("balances", 2, 3).withColumn("kept", F.lit(False)))


@query("B2_F8_M3_pruned", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def pruned(spark, sf):
    kept = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return relational.pruned(table(spark, sf, "customer").select("c_custkey"), kept, "c_custkey")


EXPORT = "concat(CASE c_custkey % 4 WHEN 0 THEN '=' WHEN 1 THEN '@' WHEN 2 THEN '-' ELSE '' END, c_name)"


@query(
    "B3_F10_export",
    f"""SELECT CASE WHEN regexp_matches(x, '^[=+@-]') THEN '''' || x ELSE x END AS name, CAST(floor(c_acctbal + 0.5) AS BIGINT) AS balance, n_name || ' | ' || c_mktsegment AS tags
    FROM (SELECT *, {EXPORT} AS x FROM customer JOIN nation ON n_nationkey = c_nationkey) WHERE c_acctbal > 5000""",
)
def export(spark, sf):
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).where("c_acctbal > 5000")
    return sinks.export_rows(joined.select(F.expr(EXPORT).alias("name"), F.col("c_acctbal").alias("balance"), F.array("n_name", "c_mktsegment").alias("tags")))


TAXONOMY = [("toys", ["red widget", "widget"]), ("hardware", ["bolt", "ring", "steel"]), ("economy", ["economy"]), ("large", ["large"])]
CLASSES_SQL = """CASE WHEN p_type = 'ECONOMY' THEN 'economy/0.85' WHEN p_type = 'LARGE' THEN 'large/0.85'
  WHEN contains(n, 'red widget') THEN 'toys/0.7' WHEN contains(w, ' economy ') THEN 'economy/0.55' WHEN contains(w, ' widget ') THEN 'toys/0.55'
  WHEN contains(w, ' steel ') THEN 'hardware/0.55' WHEN contains(w, ' large ') THEN 'large/0.55'
  WHEN contains(w, ' bolt ') THEN 'hardware/0.55' WHEN contains(w, ' ring ') THEN 'hardware/0.55' ELSE 'other/0.2' END"""


@query(
    "H1_classify",
    f"""WITH p AS (SELECT *, lower(p_name) AS n, ' ' || lower(p_name) || ' ' AS w FROM part), c AS (SELECT p_partkey, {CLASSES_SQL} AS x FROM p)
    SELECT p_partkey, string_split(x, '/')[1] AS category, CAST(string_split(x, '/')[2] AS DOUBLE) AS confidence FROM c""",
)
def classes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", classify.classify(F.col("p_type"), F.col("p_name"), TAXONOMY).alias("c")).select("p_partkey", "c.category", "c.confidence")


@query(
    "H2_H3_query_category",
    """SELECT p_partkey, CASE WHEN contains(n, 'red widget') OR contains('red widget', n) THEN 'toys' WHEN contains(n, 'widget') OR contains('widget', n) THEN 'toys'
      WHEN contains(n, 'steel') OR contains('steel', n) THEN 'hardware' WHEN contains(n, 'bolt') OR contains(n, 'ring') THEN 'hardware' END AS category,
      CASE WHEN contains(n, 'widget') THEN 3 WHEN contains(n, 'steel') OR contains(n, 'bolt') OR contains(n, 'ring') THEN 4 ELSE 0 END::BIGINT AS n_keywords
    FROM (SELECT p_partkey, lower(p_name) AS n FROM part)""",
)
def query_categories(spark, sf):
    c = classify.query_category(F.col("p_name"), TAXONOMY, ("economy", "large"))
    return table(spark, sf, "part").select("p_partkey", c.alias("category")).withColumn("n_keywords", F.coalesce(F.size(classify.category_keywords(TAXONOMY, F.col("category"))), F.lit(0)).cast("long"))


RESPONSE = """concat(CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Sure: ' WHEN 2 THEN concat('x', chr(10), '```json', chr(10)) ELSE 'nothing' END,
  CASE WHEN c_custkey % 4 = 3 THEN ' here' ELSE concat('{"summary":"s', cast(c_custkey as varchar), '","score":', cast(c_custkey % 300 as varchar), ',"priority":"', CASE WHEN c_custkey % 2 = 0 THEN 'high' ELSE 'huge' END, '","issues":["a"," ","b"]}') END,
  CASE c_custkey % 4 WHEN 2 THEN concat(chr(10), '```') WHEN 1 THEN ' done' ELSE '' END)"""


@query(
    "H4_model_output",
    """SELECT CAST(c_custkey AS VARCHAR) AS request_id, 's' || c_custkey AS summary, least(100.0, c_custkey % 300)::DOUBLE AS score,
      CASE WHEN c_custkey % 2 = 0 THEN 'high' ELSE 'low' END AS priority, 'a|b' AS issues FROM customer WHERE c_custkey % 4 <> 3""",
)
def outputs(spark, sf):
    responses = table(spark, sf, "customer").selectExpr("cast(c_custkey as string) AS request_id", _spark(RESPONSE) + " AS text")
    good, _ = classify.validate_responses(responses)
    return good.select("request_id", "summary", "score", "priority", F.concat_ws("|", "issues").alias("issues"))


@query(
    "E2_F9_suppression",
    """SELECT c_custkey AS id FROM customer WHERE c_custkey % 97 <> 5 AND c_name <> 'Customer#000000003' AND NOT (c_custkey % 3 = 0 AND c_custkey % 89 = 1) AND NOT (c_custkey % 4 = 1 AND c_custkey % 83 = 2)""",
)
def suppression(spark, sf):
    c = table(spark, sf, "customer")
    records = c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("http://www.shop"), F.col("c_custkey").cast("string"), F.lit(".es/x")).alias("website"),
        F.expr("CASE WHEN c_custkey % 3 = 0 THEN concat('+34 6', lpad(cast(c_custkey as string), 8, '0')) END").alias("phone"),
        F.expr("CASE WHEN c_custkey % 4 = 1 THEN concat('mailto:Info', c_custkey, '@Shop.es?subject=x') ELSE 'none' END").alias("email"),
    )
    phones = c.where("c_custkey % 89 = 1").select(F.lit("phone").alias("kind"), F.concat(F.lit("+346"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("value"))
    mails = c.where("c_custkey % 83 = 2").select(F.lit("email").alias("kind"), F.concat(F.lit("info"), F.col("c_custkey").cast("string"), F.lit("@shop.es")).alias("value"))
    entries = c.where("c_custkey % 97 = 5").select(F.lit("domain").alias("kind"), F.concat(F.lit("shop"), F.col("c_custkey").cast("string"), F.lit(".es")).alias("value"))
    named = spark.createDataFrame([("name", "customer 000000003"), ("business", "customer 000000004")], "kind string, value string")
    return resolve.suppressed(records, entries.unionByName(named).unionByName(phones).unionByName(mails)).select("id")


@query(
    "E3_E6_checks",
    """SELECT 'positive_price' AS rule, count(*) FILTER (WHERE NOT o_totalprice > 1000) AS violations FROM orders
    UNION ALL SELECT 'known_status', count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) FROM orders
    UNION ALL SELECT 'dated', count(*) FILTER (WHERE o_orderdate IS NULL) FROM orders""",
)
def checks(spark, sf):
    return relational.check_report(
        table(spark, sf, "orders"),
        {"positive_price": F.col("o_totalprice") > 1000, "known_status": F.col("o_orderstatus").isin("O", "F"), "dated": F.col("o_orderdate").isNotNull()},
    )


PAIRS_SQL = f"""p AS (SELECT p_partkey AS id, p_brand, {NORM.format('p_name')} AS n FROM part),
  g AS (SELECT *, {GRAMS_SQL.format('n')} AS g FROM p),
  x AS (SELECT a.id AS l_id, b.id AS r_id, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))::DOUBLE AS s
        FROM g a JOIN g b ON a.p_brand = b.p_brand)"""


@query("F14_G4_trigram_join", f"WITH {PAIRS_SQL} SELECT l_id, r_id, floor(s * 1e6 + 0.5) / 1e6 AS similarity FROM x WHERE s > 0.5")
def trigram_join(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", text.normalize_text(F.col("p_name")).alias("name_key"))
    return resolve.trigram_pairs(p, p, "p_brand").withColumn("similarity", F.floor(F.col("similarity") * 1e6 + 0.5) / 1e6)


def _keyed(spark, sf, kind: str):
    """Suppliers as entities, customers as records: names of two words, phones and postal codes that collide."""
    k, n, name = ("s_suppkey", "s_nationkey", "supplier") if kind == "entity" else ("c_custkey", "c_nationkey", "customer")
    df = table(spark, sf, name).select(
        F.col(k).alias("id"), F.format_string("%s %d", F.element_at(F.array(F.lit("alpha dental"), F.lit("alfa dental"), F.lit("beta law")), (F.col(k) % 3 + 1).cast("int")), F.col(k) % 20).alias("name_key"),
        F.when(F.col(k) % 10 == 0, F.concat(F.lit("d"), (F.col(k) % 70).cast("string"))).alias("domain"),
        F.when(F.col(k) % 7 == 1, F.concat(F.lit("p"), (F.col(k) % 40).cast("string"))).alias("phone_key"),
        F.col(n).cast("string").alias("postal_code"), F.when(F.col(k) % 3 == 0, F.concat(F.lit("s"), (F.col(k) % 4).cast("string"))).otherwise("").alias("street"),
    )
    return df


def _keyed_sql(k: str, n: str, t: str) -> str:
    return f"""SELECT {k} AS id, CASE {k} % 3 WHEN 0 THEN 'alpha dental' WHEN 1 THEN 'alfa dental' ELSE 'beta law' END || ' ' || ({k} % 20) AS name_key,
      CASE WHEN {k} % 10 = 0 THEN 'd' || ({k} % 70) END AS domain, CASE WHEN {k} % 7 = 1 THEN 'p' || ({k} % 40) END AS phone_key,
      CAST({n} AS VARCHAR) AS postal_code, CASE WHEN {k} % 3 = 0 THEN 's' || ({k} % 4) ELSE '' END AS street FROM {t}"""


@query(
    "G1_G5_decisions",
    f"""WITH r AS ({_keyed_sql('c_custkey', 'c_nationkey', 'customer')}), e AS ({_keyed_sql('s_suppkey', 's_nationkey', 'supplier')}),
    x AS (SELECT r.id, e.id AS entity_id, r.domain = e.domain AS same_domain, r.phone_key = e.phone_key AS same_phone,
            r.postal_code = e.postal_code AS same_postal, r.street = e.street AND r.street <> '' AS same_street, r.name_key AS a, e.name_key AS b,
            {TOKENS_SQL.format('r.name_key')} AS ta, {TOKENS_SQL.format('e.name_key')} AS tb, {GRAMS_SQL.format('r.name_key')} AS ga, {GRAMS_SQL.format('e.name_key')} AS gb FROM r, e
          WHERE r.domain = e.domain OR r.phone_key = e.phone_key OR r.postal_code = e.postal_code),
    s AS (SELECT *, greatest(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb)))::DOUBLE, 0.95 * (1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE)) AS sim,
            len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb)))::DOUBLE AS tri,
            count(*) FILTER (WHERE same_domain) OVER (PARTITION BY id) AS n FROM x),
    d AS (SELECT id, entity_id, 1 AS rule, 'merge' AS action, CASE WHEN n = 1 THEN 0.98 ELSE 0.90 END AS confidence, sim FROM s WHERE same_domain AND (n = 1 OR sim >= 0.82)
      UNION ALL SELECT id, entity_id, 2, CASE WHEN sim >= 0.82 THEN 'merge' ELSE 'ambiguous' END, CASE WHEN sim >= 0.82 THEN 0.94 ELSE 0.5 END, sim FROM s WHERE same_phone
      UNION ALL SELECT id, entity_id, 3, CASE WHEN sim >= 0.82 THEN 'merge' ELSE 'ambiguous' END, CASE WHEN sim >= 0.82 THEN 0.90 ELSE 0.55 END, sim FROM s WHERE same_postal AND same_street AND sim >= 0.62
      UNION ALL SELECT id, entity_id, 4, CASE WHEN sim >= 0.93 THEN 'merge' ELSE 'ambiguous' END, CASE WHEN sim >= 0.93 THEN 0.72 ELSE 0.5 END, sim FROM s WHERE same_postal AND tri > 0.5 AND sim >= 0.82)
    SELECT id, entity_id, CAST(rule AS INTEGER) AS rule, action, CAST(confidence AS DOUBLE) AS confidence FROM d
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY rule, action <> 'merge', sim DESC, entity_id) = 1""",
)
def decided(spark, sf):
    return resolve.decisions(_keyed(spark, sf, "record"), _keyed(spark, sf, "entity")).select("id", "entity_id", "rule", "action", "confidence")


@query(
    "G6_batch_components",
    f"""WITH RECURSIVE r AS ({_keyed_sql('s_suppkey', 's_nationkey', 'supplier')}),
    x AS (SELECT a.id AS l, b.id AS r, a.name_key AS a, b.name_key AS b, a.domain = b.domain AS dom, a.phone_key = b.phone_key AS ph, a.postal_code = b.postal_code AS po, a.street = b.street AND a.street <> '' AS st,
            {TOKENS_SQL.format('a.name_key')} AS ta, {TOKENS_SQL.format('b.name_key')} AS tb, {GRAMS_SQL.format('a.name_key')} AS ga, {GRAMS_SQL.format('b.name_key')} AS gb FROM r a, r b WHERE a.id <> b.id),
    s AS (SELECT *, greatest(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb)))::DOUBLE, 0.95 * (1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE)) AS sim,
            len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb)))::DOUBLE AS tri FROM x),
    e AS (SELECT l, r FROM s WHERE dom OR (ph AND sim >= 0.82) OR (po AND st AND sim >= 0.82) OR (po AND tri > 0.5 AND sim >= 0.93)),
    reach(id, root) AS (SELECT id, id FROM r UNION SELECT e.r, reach.root FROM reach JOIN e ON e.l = reach.id)
    SELECT id, min(root) AS component FROM reach GROUP BY id""",
)
def components(spark, sf):
    return resolve.resolve_batch(_keyed(spark, sf, "entity")).select("id", "component")


@query(
    "G7_G8_golden_records",
    """WITH r AS (SELECT o_custkey AS component, o_orderkey AS id, o_orderdate AS retrieved_at, o_orderstatus AS source,
        o_orderpriority || repeat('x', CAST(o_orderkey % 4 AS INTEGER)) AS name, o_orderpriority AS category, (o_orderkey % 9) / 10.0::DOUBLE AS category_confidence,
        o_totalprice > 300000 AS in_scope, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS phone FROM orders)
    SELECT component, arg_min(name, (-length(name), retrieved_at, source, id)) AS name, arg_min(category, (-category_confidence, retrieved_at, source, id)) AS category,
      bool_or(in_scope) AS in_scope, arg_min(phone, (retrieved_at, source, id)) FILTER (WHERE phone IS NOT NULL) AS phone, count(*) AS n_records FROM r GROUP BY component""",
)
def golden(spark, sf):
    r = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("component"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("retrieved_at"), F.col("o_orderstatus").alias("source"),
        F.expr("concat(o_orderpriority, repeat('x', cast(o_orderkey % 4 as int)))").alias("name"), F.col("o_orderpriority").alias("category"),
        ((F.col("o_orderkey") % 9) / 10.0).alias("category_confidence"), (F.col("o_totalprice") > 300000).alias("in_scope"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END").alias("phone"),
    )
    return resolve.golden_records(r).select("component", "name", "category", "in_scope", "phone", "n_records")


@query(
    "G9_review_merge",
    """WITH r AS (SELECT o_custkey AS business_id, o_orderstatus AS source, o_orderkey AS seq, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice / 100000 END AS rating, CASE WHEN o_orderkey % 5 > 1 THEN o_orderkey % 400 END AS n FROM orders)
    SELECT business_id, source, arg_max(rating, seq) FILTER (WHERE rating IS NOT NULL) AS rating, max(coalesce(n, 0)) AS review_count FROM r WHERE rating IS NOT NULL OR n IS NOT NULL GROUP BY 1, 2""",
)
def reviews(spark, sf):
    r = table(spark, sf, "orders").selectExpr(
        "o_custkey AS business_id", "o_orderstatus AS source", "o_orderkey AS seq", "CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice / 100000 END AS rating",
        "CASE WHEN o_orderkey % 5 > 1 THEN o_orderkey % 400 END AS review_count", "0.5D AS confidence",
    )
    return resolve.merged_reviews(r).select("business_id", "source", "rating", "review_count")


def _facts(spark, sf):
    """Customers as entities, their orders as reviews."""
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("review_count"), (F.avg("o_totalprice") / 100000).alias("rating"), F.count_distinct("o_orderstatus").alias("source_count"))
    c = table(spark, sf, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(
        F.col("c_custkey").alias("id"), (F.coalesce("review_count", F.lit(0)) * 20).alias("review_count"), F.least(F.lit(5.0), F.floor(F.col("rating") * 20 + 0.5) / 10).alias("rating"),
        F.coalesce("source_count", F.lit(0)).alias("source_count"), (F.col("c_custkey") % 3).alias("social_count"), (F.col("c_custkey") % 2 == 0).alias("has_phone"),
        (F.col("c_custkey") % 5 > 0).alias("has_address"), (F.col("c_custkey") % 7 > 0).alias("has_website"), ((F.col("c_custkey") % 10) / 10.0).alias("evidence_score"),
        (F.col("c_custkey") % 90 + 10).cast("double").alias("category_value"), ((F.col("c_custkey") % 4) / 4.0).alias("category_confidence"),
        F.when(F.col("c_custkey") % 6 == 0, F.array(F.lit("Implantes"), F.lit("laser"))).otherwise(F.array().cast("array<string>")).alias("services"), (F.col("c_custkey") % 8 == 0).alias("has_booking"),
        (F.col("c_custkey") % 11 > 0).alias("reachable"), F.when(F.col("c_custkey") % 22 == 0, 404).alias("http_status"), (F.col("c_custkey") % 13 == 0).alias("audit_missing"),
        F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("no_https"), F.lit("weak_cta"))).otherwise(F.array(F.lit("missing_h1"))).alias("issue_codes"),
        F.lit(False).alias("is_duplicate"), (F.col("c_custkey") % 9 > 0).alias("in_scope"), ((F.col("c_custkey") % 6 + 5) / 10.0).alias("location_confidence"),
        (F.col("c_custkey") % 17 == 0).alias("category_excluded"), F.lit(True).alias("name_meaningful"),
    )


_R = lambda x, d="10": f"(floor(({x}) * {d} + 0.5) / {d})"
SCORES_SQL = f"""n AS (SELECT o_custkey, count(*) * 20 AS reviews, least(5.0, floor(avg(o_totalprice) / 100000 * 20 + 0.5) / 10) AS rating, count(DISTINCT o_orderstatus) AS sources FROM orders GROUP BY 1),
f AS (SELECT c_custkey AS id, coalesce(reviews, 0) AS reviews, rating, coalesce(sources, 0) AS sources, c_custkey % 3 AS socials, c_custkey % 2 = 0 AS phone, c_custkey % 5 > 0 AS address,
        c_custkey % 7 > 0 AS site, (c_custkey % 10) / 10.0::DOUBLE AS ev, (c_custkey % 90 + 10)::DOUBLE AS base, (c_custkey % 4) / 4.0::DOUBLE AS sure, c_custkey % 6 = 0 AS srv, c_custkey % 8 = 0 AS booking,
        c_custkey % 11 > 0 AS up, c_custkey % 22 = 0 AS failed, c_custkey % 13 = 0 AS unaudited, c_custkey % 2 = 0 AS even, c_custkey % 9 > 0 AS scoped, (c_custkey % 6 + 5) / 10.0::DOUBLE AS loc, c_custkey % 17 = 0 AS excl
      FROM customer LEFT JOIN n ON o_custkey = c_custkey),
q AS (SELECT *, CASE WHEN reviews > 0 AND rating IS NOT NULL THEN 0.55::DOUBLE * least(100.0::DOUBLE, 33.3::DOUBLE * log10(reviews + 1)) + 0.45::DOUBLE * greatest(0.0, least(100.0, (rating - 3) / 2 * 100)) ELSE 22.0::DOUBLE END AS rep,
        least(100.0, CASE WHEN phone THEN 30 ELSE 0 END + CASE WHEN address THEN 30 ELSE 0 END + CASE WHEN site THEN 25 ELSE 0 END + least(15.0, 7.5 * socials))::DOUBLE AS est FROM f),
s AS (SELECT *, {_R('least(100.0::DOUBLE, 0.55::DOUBLE * rep + 0.3::DOUBLE * (ev * 100) + 0.15::DOUBLE * est)')} AS quality,
        {_R('least(100.0::DOUBLE, base * sure + 45.0::DOUBLE * (1 - sure) + CASE WHEN reviews >= 500 THEN 8 WHEN reviews >= 150 THEN 5 ELSE 0 END + CASE WHEN srv THEN 8 ELSE 0 END + CASE WHEN booking THEN 4 ELSE 0 END)')} AS commercial,
        CASE WHEN NOT site THEN 62 + CASE WHEN socials > 0 THEN 8 ELSE 0 END WHEN NOT up AND failed THEN 84 WHEN NOT up THEN 52 WHEN unaudited THEN 40 WHEN even THEN 31 ELSE 13 END::DOUBLE AS digital FROM q),
t AS (SELECT *, quality * 0.35::DOUBLE + commercial * 0.25::DOUBLE + digital * 0.4::DOUBLE AS total FROM s),
g AS (SELECT *, list_filter([CASE WHEN NOT scoped THEN 'not_in_scope' END, CASE WHEN loc < 0.7 THEN 'location_confidence' END, CASE WHEN excl THEN 'excluded_category' END,
        CASE WHEN ev < 0.35 THEN 'thin_evidence' END, CASE WHEN quality < 28 THEN 'weak_business' END, CASE WHEN commercial < 35 THEN 'low_value' END, CASE WHEN digital < 20 THEN 'no_opportunity' END,
        CASE WHEN total < 45 THEN 'low_total' END], lambda x: x IS NOT NULL) AS failed_tests FROM t)"""


@query(
    "J1_J4_E4_scores",
    f"WITH {SCORES_SQL} SELECT id, quality, commercial, digital, {_R('total')} AS opportunity, array_to_string(failed_tests, '|') AS failed, len(failed_tests) = 0 AS qualified FROM g",
)
def scores(spark, sf):
    return scoring.score_entities(_facts(spark, sf)).select("id", "quality", "commercial", "digital", "opportunity", F.concat_ws("|", "failed").alias("failed"), "qualified")


#: Reasons of each block with their points, in the order of the rules; a block's are ranked by falling points, equal ones in order.
REASONS_SQL = f"""p AS (SELECT *, 0.55::DOUBLE * least(100.0::DOUBLE, 33.3::DOUBLE * log10(reviews + 1)) AS vol, 0.45::DOUBLE * greatest(0.0, least(100.0, (rating - 3) / 2 * 100)) AS qual,
    reviews > 0 AND rating IS NOT NULL AS seen, base * sure + 45.0::DOUBLE * (1 - sure) AS cat FROM g),
b AS (SELECT *, [
    CASE WHEN seen AND reviews >= 400 THEN ('very_high_review_volume', {_R('vol')}) END, CASE WHEN seen AND reviews BETWEEN 100 AND 399 THEN ('high_review_volume', {_R('vol')}) END,
    CASE WHEN seen AND reviews BETWEEN 25 AND 99 THEN ('meaningful_review_volume', {_R('vol')}) END, CASE WHEN seen AND reviews < 25 THEN ('low_review_volume', {_R('vol - 25')}) END,
    CASE WHEN seen AND rating >= 4.7 THEN ('excellent_rating', {_R('qual')}) END, CASE WHEN seen AND rating >= 4.3 AND rating < 4.7 THEN ('strong_rating', {_R('qual')}) END,
    CASE WHEN seen AND rating < 3.8 THEN ('weak_rating', {_R('qual - 30')}) END, CASE WHEN NOT seen THEN ('no_review_evidence', -20.0::DOUBLE) END,
    CASE WHEN sources >= 2 THEN ('corroborated_by_multiple_sources', {_R('0.12::DOUBLE * (ev * 100)')}) END, CASE WHEN sources < 2 AND ev < 0.4 THEN ('thin_public_evidence', -12.0::DOUBLE) END,
    CASE WHEN phone AND address THEN ('established_presence', {_R('0.15::DOUBLE * est')}) END] AS r1,
  [CASE WHEN base >= 85 THEN ('high_value_category', {_R('0.8::DOUBLE * cat')}) END, CASE WHEN base >= 65 AND base < 85 THEN ('solid_value_category', {_R('0.8::DOUBLE * cat')}) END,
    CASE WHEN base < 65 THEN ('low_value_category', {_R('0.8::DOUBLE * cat - 40')}) END, CASE WHEN sure < 0.5 THEN ('uncertain_category', -8.0::DOUBLE) END,
    CASE WHEN reviews >= 500 THEN ('large_operation', 8.0::DOUBLE) END, CASE WHEN reviews BETWEEN 150 AND 499 THEN ('substantial_operation', 5.0::DOUBLE) END,
    CASE WHEN srv THEN ('high_value_services', 8.0::DOUBLE) END, CASE WHEN booking THEN ('transactional_intent', 4.0::DOUBLE) END] AS r2,
  CASE WHEN NOT site THEN [('no_website', 30.0::DOUBLE), CASE WHEN socials > 0 THEN ('social_only_presence', 15.0::DOUBLE) END] WHEN NOT up AND failed THEN [('website_unreachable', 34.0::DOUBLE)]
    WHEN NOT up OR unaudited THEN [] WHEN even THEN [('no_https', 14.0::DOUBLE), ('weak_cta', 9.0::DOUBLE)] ELSE [('missing_h1', 5.0::DOUBLE), ('minor_issues_only', -10.0::DOUBLE)] END AS r3 FROM p),
k AS (SELECT *, list_transform([r1, r2, r3], lambda r: list_transform(list_sort(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i] IS NOT NULL), lambda i: (-abs(r[i][2]), i))), lambda x: r[x[2]][1])) AS own FROM b)"""
VERDICTS_SQL = """CASE WHEN NOT site AND socials > 0 THEN 'social profiles only' WHEN NOT site THEN 'no website' WHEN NOT up AND NOT failed THEN 'did not respond' WHEN NOT up THEN 'unreachable'
  WHEN unaudited THEN 'not audited yet' ELSE 'minor issues' END"""


@query(
    "J5_ranked_reasons",
    f"""WITH {SCORES_SQL}, {REASONS_SQL} SELECT id, array_to_string((CASE WHEN scoped THEN ['location_verified'] ELSE [] END || own[1] || own[2] || own[3])[1:6], '|') AS reasons, {VERDICTS_SQL} AS verdict FROM k""",
)
def reasons(spark, sf):
    return scoring.score_entities(_facts(spark, sf)).select("id", F.concat_ws("|", "reasons").alias("reasons"), "verdict")


@query(
    "K1_E5_shortlist",
    f"WITH {SCORES_SQL} SELECT id, {_R('total')} AS opportunity, quality AS relevance, CAST(reviews AS BIGINT) AS reviews FROM g WHERE len(failed_tests) = 0 ORDER BY 2 DESC, 3 DESC, 4 DESC NULLS LAST, 1 LIMIT 10",
)
def shortlist(spark, sf):
    s = scoring.score_entities(_facts(spark, sf)).where("qualified").select("id", "opportunity", F.col("quality").alias("relevance"), F.col("review_count").alias("reviews"))
    return search.top_k(s, 10)


@query(
    "G10_evidence_score",
    """SELECT c_custkey, least(1.0, floor((least(c_custkey % 5, 3) * 0.1::DOUBLE + CASE WHEN c_custkey % 2 = 0 THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 0.10::DOUBLE ELSE 0 END
      + CASE WHEN c_custkey % 7 = 0 THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN c_custkey % 4 = 0 THEN 0.14::DOUBLE ELSE 0 END + CASE WHEN c_custkey % 6 = 0 THEN 0.10::DOUBLE ELSE 0 END
      + CASE WHEN c_custkey % 50 > 0 THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN c_custkey % 50 >= 20 THEN 0.05::DOUBLE ELSE 0 END + (c_custkey % 10) / 10.0::DOUBLE * 0.09::DOUBLE) * 1000 + 0.5) / 1000)::DOUBLE AS score FROM customer""",
)
def evidence(spark, sf):
    k = F.col("c_custkey")
    s = scoring.evidence_score(k % 5, k % 2 == 0, k % 3 == 0, k % 7 == 0, k % 4 == 0, k % 6 == 0, k % 50, (k % 10) / 10.0)
    return table(spark, sf, "customer").select("c_custkey", s.alias("score"))


#: Queries of every kind: both rules at once, one word, no text with and without a category, a misspelling, stop words only, blanks.
SEARCHES = [
    (1, "blue bolt", None), (2, "Red", None), (3, "", "Brand#3"), (4, "stel rings", None), (5, "", None), (6, " - ", "none"), (7, "de la", None), (8, "the", "Brand#7"), (9, "Hot gear economy", "Brand#3"),
    (10, "small", None), (11, "ringe  SMALL widgets", None),
]
LIGHT_SQL = "CASE WHEN length({0}) > 4 THEN regexp_replace({0}, '(es|s)$', '') ELSE {0} END"
STEM_SQL = f"CASE WHEN length({LIGHT_SQL.format('w')}) > 4 THEN regexp_replace({LIGHT_SQL.format('w')}, '[aeo]$', '') ELSE {LIGHT_SQL.format('w')} END"
STOPS_SQL = "(" + ", ".join(f"'{w}'" for w in search.STOP_WORDS) + ")"
SEARCH_SQL = f"""WITH d AS (SELECT p_partkey AS id, p_brand AS category, {NORM.format("p_name || ' ' || p_type || ' ' || p_name")} AS t, {NORM.format('p_name')} AS n,
      floor(p_retailprice * 10 + 0.5) / 10 AS opportunity, CASE WHEN p_size % 7 > 0 THEN p_size END AS reviews FROM part WHERE p_retailprice >= 45 AND (p_size % 6 + 5) / 10.0 >= 0.7),
    q AS (SELECT query_id, {NORM.format('query')} AS q, category FROM (VALUES {", ".join(f"({i}, '{t}', {'NULL' if c is None else repr(c)})" for i, t, c in SEARCHES)}) q(query_id, query, category)),
    words AS (SELECT id, w, p FROM (SELECT id, unnest(string_split(t, ' ')) AS w, unnest(range(1, len(string_split(t, ' ')) + 1)) AS p FROM d) WHERE w <> '' AND w NOT IN {STOPS_SQL}),
    lexemes AS (SELECT id, {STEM_SQL} AS s, p FROM words),
    asked AS (SELECT DISTINCT query_id, {STEM_SQL} AS s FROM (SELECT query_id, unnest(string_split(q, ' ')) AS w FROM q) WHERE w <> '' AND w NOT IN {STOPS_SQL}),
    places AS (SELECT query_id, s, id, p FROM asked JOIN lexemes USING (s)),
    sizes AS (SELECT query_id, count(*) AS size FROM asked GROUP BY 1),
    whole AS (SELECT query_id, id, count(DISTINCT s) AS n FROM places JOIN sizes USING (query_id) GROUP BY query_id, id, size HAVING count(DISTINCT s) = size),
    one AS (SELECT query_id, id, sum(0.1::DOUBLE / (j * j)) / 1.64493406685::DOUBLE AS rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id, id, s) AS j FROM places) GROUP BY ALL),
    more AS (SELECT a.query_id, a.id, 1 - exp(sum(ln(1 - 0.1::DOUBLE * sqrt(CASE WHEN abs(a.p - b.p) > 100 THEN 1e-30 ELSE 1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs(a.p - b.p) / 1.5::DOUBLE - 2)) END)))) AS rank
      FROM places a JOIN places b ON a.query_id = b.query_id AND a.id = b.id AND a.s < b.s AND a.p <> b.p GROUP BY ALL),
    texts AS (SELECT query_id, id, CASE WHEN n = 1 THEN one.rank ELSE more.rank END AS rank FROM whole LEFT JOIN one USING (query_id, id) LEFT JOIN more USING (query_id, id)),
    x AS (SELECT query_id, id, opportunity, reviews, q = '' AS empty, q.category = d.category AS same, {GRAMS_SQL.format('q')} AS gq, {GRAMS_SQL.format('n')} AS gd, rank FROM q CROSS JOIN d LEFT JOIN texts USING (query_id, id)),
    r AS (SELECT query_id, id, opportunity, reviews, greatest(rank, CASE WHEN empty THEN 0.35 END, CASE WHEN same THEN 0.6 END,
            CASE WHEN len(gq) > 0 AND len(list_intersect(gq, gd)) / len(list_distinct(list_concat(gq, gd)))::DOUBLE >= 0.3 THEN len(list_intersect(gq, gd)) / len(list_distinct(list_concat(gq, gd)))::DOUBLE END) AS rel FROM x)"""


def _index(spark, sf):
    """Parts as a search index at rest."""
    parts = table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "p_name AS name", "p_type", "p_brand AS category", "floor(p_retailprice * 10 + 0.5) / 10 AS opportunity", "CASE WHEN p_size % 7 > 0 THEN p_size END AS reviews",
        "CAST((p_size % 6 + 5) / 10D AS DOUBLE) AS location_confidence",
    )
    return postings.build_index(parts, F.concat_ws(" ", "name", "p_type", "name"), new_path(spark, "search-index"))


@query(
    "L1_L6_batch_search",
    f"""{SEARCH_SQL} SELECT CAST(query_id AS INTEGER) AS query_id, id, opportunity, floor(rel * 1e6 + 0.5) / 1e6 AS relevance,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY opportunity DESC, rel DESC, reviews DESC NULLS LAST, id) AS INTEGER) AS rank
    FROM r WHERE rel IS NOT NULL QUALIFY rank <= 10""",
)
def batch(spark, sf):
    found = postings.search(spark.createDataFrame(SEARCHES, "query_id int, query string, category string"), _index(spark, sf), 10)
    return found.select("query_id", "id", "opportunity", (F.floor(F.col("relevance") * 1e6 + 0.5) / 1e6).alias("relevance"), F.col("rank").cast("int").alias("rank"))


@query(
    "E7_escalation",
    """SELECT o_orderkey AS id, o_totalprice / 5000 AS total FROM orders WHERE o_totalprice / 5000 >= 45 AND (o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 OR o_totalprice / 5000 >= 70) ORDER BY total DESC, id LIMIT 100""",
)
def escalation(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_totalprice / 5000 AS total", "CASE o_orderkey % 3 WHEN 0 THEN true WHEN 2 THEN false END AS recommended")
    return scoring.escalated(rows, 100).select("id", "total")


LISTED_SQL = "SELECT CAST(c_custkey AS VARCHAR) AS source_id, 'A \"' || c_name || '\"; x' AS name, CAST(c_custkey % 700 AS INTEGER) AS review_count, {0}::DOUBLE AS confidence FROM customer"


def _listed(spark, sf):
    return table(spark, sf, "customer").selectExpr("cast(c_custkey as string) AS id", "concat('A \"', c_name, '\"; x') AS nombre", "cast(c_custkey % 700 as string) AS resenas")


@query("A1_csv_source", LISTED_SQL.format("0.8"))
def csv_source(spark, sf):
    path = new_path(spark, "listing-csv")
    _listed(spark, sf).write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return listings.map_fields(listings.read_csv(spark, path, ";"), "csv", 0.8, F.expr(AT)).select("source_id", "name", "review_count", "confidence")


@query("A2_A3_json_source", LISTED_SQL.format("0.9"))
def json_source(spark, sf):
    path = new_path(spark, "listing-json")
    _listed(spark, sf).write.json(path)
    return listings.map_fields(listings.read_json(spark, path, ["id", "nombre", "resenas"], lines=True), "manual", 0.9, F.expr(AT)).select("source_id", "name", "review_count", "confidence")


BROKEN_SQL = "SELECT CAST(c_custkey AS VARCHAR) AS id, 'A \"' || c_name || '\";' || chr(10) || c_mktsegment || chr(10) AS nombre, CAST(c_custkey % 700 AS VARCHAR) AS resenas FROM customer"


def _broken(spark, sf):
    """Rows whose names hold quotes, separators and line breaks."""
    return table(spark, sf, "customer").selectExpr("cast(c_custkey as string) AS id", "concat('A \"', c_name, '\";\n', c_mktsegment, '\n') AS nombre", "cast(c_custkey % 700 as string) AS resenas")


@query("A1_splittable_csv", f"SELECT id, trim(nombre, ' ' || chr(10)) AS nombre, resenas FROM ({BROKEN_SQL})")
def csv_by_blocks(spark, sf):
    """One file, read by blocks."""
    path = new_path(spark, "listing-csv")
    _broken(spark, sf).coalesce(1).write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return splittable.read_csv(spark, path, ";").withColumn("nombre", F.expr("trim(BOTH ' \n' FROM nombre)"))


@query("A2_splittable_json", BROKEN_SQL)
def json_by_blocks(spark, sf):
    """One array in one file, an object to some lines, read by blocks."""
    path = new_path(spark, "listing-json")
    rows = _broken(spark, sf).select(F.concat(F.to_json(F.struct("id", "nombre")).substr(F.lit(1), F.length(F.to_json(F.struct("id", "nombre"))) - 1), F.lit(',\n"resenas": "'), "resenas", F.lit('"},')).alias("value"))
    ends = lambda text: spark.createDataFrame([(text,)], "value string")
    ends("[").unionByName(rows).unionByName(ends('{"id": null}\n]')).coalesce(1).write.text(path)
    return splittable.read_json_array(spark, path, ["id", "nombre", "resenas"]).where("id IS NOT NULL")


@query("B4_B5_timeline", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def timeline(spark, sf):
    path = new_path(spark, "timeline")
    events = table(spark, sf, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    for part in (events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")):
        sinks.append_timeline(part, path)
    again = spark.read.schema(events.schema).parquet(path)
    snapshot = sinks.write_snapshot(again.groupBy("day", "event_type").agg(F.count("*").alias("n")))
    return spark.read.parquet(snapshot)
