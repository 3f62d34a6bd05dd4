"""Queries of relational shapes, reports, windows and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.functions import hashing, text
from tamarack.operators import cache, relational
from tamarack.operators.storage import new_path
from tamarack.plans import fields as text_sql
from tamarack.plans.registry import query, table
from tamarack.streaming import counters as counters_
from tamarack.streaming import jobs, resolution

AS_OF = "timestamp '1998-06-01 00:00:00'"


@query(
    "F1_best_child",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey) = 1""",
)
def best(spark, sf):
    order = [-F.col("o_totalprice"), -F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")]
    return relational.best_child(table(spark, sf, "orders"), "o_custkey", order, ["o_orderkey", "o_totalprice"])


@query(
    "F2_K2_latest",
    """SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest(spark, sf):
    return relational.latest_by(table(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "ts")


@query(
    "F3_F5_J11_J12_assembly",
    """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') AS n_urgent,
      (SELECT count(DISTINCT o_orderstatus) FROM orders WHERE o_custkey = c_custkey) AS n_statuses, coalesce((SELECT string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) FROM orders WHERE o_custkey = c_custkey), '') AS priorities FROM customer""",
)
def assembly(spark, sf):
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n_orders"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("n_urgent"),
        F.count_distinct("o_orderstatus").alias("n_statuses"), F.sort_array(F.collect_set("o_orderpriority")).alias("p"),
    )
    out = relational.with_children(table(spark, sf, "customer").select("c_custkey"), "c_custkey", orders)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("c_custkey", zero("n_orders"), zero("n_urgent"), zero("n_statuses"), F.concat_ws("|", F.coalesce("p", F.array().cast("array<string>"))).alias("priorities"))


@query(
    "F4_F11_F12_listing",
    """SELECT o_orderkey, c_name, n_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 60""",
)
def listing(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(60).select("o_orderkey", "c_name", "n_name", "o_totalprice")


@query(
    "F6_F7_stale",
    """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate > TIMESTAMP '1998-06-01' - INTERVAL 200 DAY)
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 400000)""",
)
def stale(spark, sf):
    orders = table(spark, sf, "orders").withColumn("c_custkey", F.col("o_custkey"))
    jobs_ = orders.where("o_orderstatus = 'P' and o_totalprice > 400000").select("c_custkey", F.lit("queued").alias("status"))
    old = relational.stale(table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey", "o_orderdate", F.expr(AS_OF), 200)
    return relational.without_open_work(old, jobs_, "c_custkey")


def _child_sql(name: str, item: str, order: str, rows: str, key: str) -> str:
    """An array of the first 5 as text, and the count."""
    ranked = f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS pos FROM {rows})"
    return f"coalesce((SELECT string_agg({item}, ',' ORDER BY {order}) FROM {ranked} x WHERE pos <= 5 AND x.{key} = c_custkey), '') AS {name}, (SELECT count(*) FROM {rows} x WHERE x.{key} = c_custkey) AS n_{name}"


LINES = "(SELECT o_custkey, l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')"
SOURCES = "(SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
FINDINGS = "(SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)"


@query(
    "F13_entity_view",
    "SELECT c_custkey, " + ", ".join((
        _child_sql("orders", "o_orderkey || ':' || o_orderstatus", "o_orderkey", "orders", "o_custkey"), _child_sql("returns", "l_orderkey || ':' || l_linenumber", "l_orderkey, l_linenumber", LINES, "o_custkey"),
        _child_sql("suppliers", "l_suppkey", "l_suppkey", SOURCES, "o_custkey"), _child_sql("events", "event_id || ':' || event_type", "event_id", "events", "user_id"),
        _child_sql("priorities", "o_orderpriority || ':' || n", "o_orderpriority", FINDINGS, "o_custkey"),
    )) + " FROM customer",
)
def view(spark, sf):
    """Five children of every customer: the first five of each and how many there are."""
    key = lambda df, c: df.withColumn("c_custkey", F.col(c))
    o = key(table(spark, sf, "orders"), "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "c_custkey"), "l_orderkey")
    children = {
        "orders": (o, ["o_orderkey", "o_orderstatus"]), "returns": (lines.where("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"]), "suppliers": (lines.select("c_custkey", "l_suppkey").distinct(), ["l_suppkey"]),
        "events": (key(table(spark, sf, "events"), "user_id"), ["event_id", "event_type"]), "priorities": (o.groupBy("c_custkey", "o_orderpriority").agg(F.count("*").alias("n")), ["o_orderpriority", "n"]),
    }
    v = relational.entity_view(table(spark, sf, "customer").select("c_custkey"), "c_custkey", children, most=5)
    said = lambda name, columns: F.concat_ws(",", F.transform(name, lambda x: F.concat_ws(":", *(x[c].cast("string") for c in columns)))).alias(name)
    return v.select("c_custkey", *(x for name, (_, columns) in children.items() for x in (said(name, columns), F.col(f"n_{name}"))))


PRICES = {"user": (0.5, 1.5), "assistant": (3.0, 15.0)}


@query(
    "F15_F16_C21_J13_cache",
    """WITH r AS (SELECT role AS model, sha256('p|fast|' || role || '|' || text) AS k, length(text) AS pt, length(role) AS ct, conv_id FROM conversations),
    s AS (SELECT DISTINCT k FROM r WHERE conv_id % 3 = 0),
    x AS (SELECT r.*, s.k IS NOT NULL AS hit FROM r LEFT JOIN s ON s.k = r.k)
    SELECT model, count(*) AS calls, count(*) FILTER (WHERE hit) AS hits, floor(count(*) FILTER (WHERE hit) / count(*)::DOUBLE * 1e6 + 0.5) / 1e6 AS hit_rate,
      sum(CASE WHEN hit THEN 0 ELSE pt END)::BIGINT AS prompt_tokens,
      floor(sum(CASE WHEN hit THEN NULL WHEN model = 'user' THEN round((pt * 0.5 + ct * 1.5) / 1000000, 6) WHEN model = 'assistant' THEN round((pt * 3.0 + ct * 15.0) / 1000000, 6) END) * 1e4 + 0.5) / 1e4 AS cost FROM x GROUP BY model""",
)
def cached(spark, sf):
    c = table(spark, sf, "conversations")
    r = c.select(
        F.col("role").alias("model"), F.sha2(F.concat_ws("|", F.lit("p"), F.lit("fast"), "role", "text"), 256).alias("cache_key"),
        F.length("text").alias("prompt_tokens"), F.length("role").alias("completion_tokens"), "conv_id",
    )
    hits, misses = cache.lookup(r, r.where("conv_id % 3 = 0").select("cache_key").distinct())
    prices = spark.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, input_price double, output_price double")
    usage = hits.withColumn("hit", F.lit(True)).unionByName(misses.withColumn("hit", F.lit(False)))
    own = cache.priced(usage, prices)
    g = own.groupBy("model").agg(
        F.count("*").alias("calls"), F.count_if("hit").alias("hits"), F.sum(F.when(F.col("hit"), 0).otherwise(F.col("prompt_tokens"))).cast("long").alias("prompt_tokens"),
        (F.floor(F.sum(F.when(~F.col("hit"), F.col("cost"))) * 1e4 + 0.5) / 1e4).alias("cost"),
    )
    return g.select("model", "calls", "hits", (F.floor(cache.hit_rate(F.col("hits"), F.col("calls")) * 1e6 + 0.5) / 1e6).alias("hit_rate"), "prompt_tokens", "cost")


@query(
    "J8_J10_counters",
    """SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT user_id) AS users, floor(avg(value) * 1e6 + 0.5) / 1e6 AS mean, max(value) AS most,
      count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 1 DAY AND ts <= TIMESTAMP '2024-01-30') AS last_day FROM events""",
)
def counters(spark, sf):
    at = F.expr("timestamp '2024-01-30 00:00:00'")
    return table(spark, sf, "events").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("user_id").alias("users"),
        (F.floor(F.avg("value") * 1e6 + 0.5) / 1e6).alias("mean"), F.max("value").alias("most"),
        F.count_if((F.col("ts") > at - F.expr("interval 1 day")) & (F.col("ts") <= at)).alias("last_day"),
    )


@query(
    "J9_rollup_zero_fill",
    """SELECT k AS event_type, count(event_id) AS n FROM (SELECT DISTINCT event_type AS k FROM events UNION ALL SELECT 'never') LEFT JOIN events ON event_type = k GROUP BY k""",
)
def zeroes(spark, sf):
    e = table(spark, sf, "events")
    known = e.select("event_type").distinct().unionByName(spark.createDataFrame([("never",)], "event_type string"))
    return relational.rollup_with_zeroes(e, "event_type", known)


@query("K4_top_categories", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def top(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(8)


@query("K5_recent", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts", "event_type")


@query(
    "K6_transitions",
    """SELECT event_id, lag(event_type) OVER w AS from_status, lead(event_type) OVER w AS to_status FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def changes(spark, sf):
    return relational.transitions(table(spark, sf, "events"), "user_id", "ts", "event_type", "event_id").select("event_id", "from_status", "to_status")


@query(
    "K3_K7_top_per_group",
    "SELECT p_brand, p_partkey, p_retailprice, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM part QUALIFY rank <= 5",
)
def per_group(spark, sf):
    return relational.top_per_group(table(spark, sf, "part"), "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 5).select("p_brand", "p_partkey", "p_retailprice", F.col("rank").cast("int").alias("rank"))


@query("L4_substring_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_type), 'econ')")
def substring(spark, sf):
    hit = F.contains(text.normalize_text(F.col("p_name")), F.lit("bolt")) | F.contains(text.normalize_text(F.col("p_type")), F.lit("econ"))
    return table(spark, sf, "part").where(hit).select("p_partkey", "p_name")


@query(
    "M2_M4_sets",
    """WITH a AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT s_nationkey AS k FROM supplier) SELECT DISTINCT k FROM a WHERE k IN (SELECT k FROM b)""",
)
def sets(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("k"))
    return a.dropDuplicates().intersect(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query(
    "A6_stable_ids",
    """SELECT sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS id FROM nation""",
)
def stable_ids(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(hashing.stable_id(n).alias("id"))


@query(
    "O3_window_counts",
    """WITH e AS (SELECT *, unnest(range(0, 24)) AS k FROM events), w AS (SELECT date_trunc('hour', ts) - to_hours(CAST(k AS BIGINT)) AS s, event_type, value FROM e)
    SELECT s AS window_start, s + INTERVAL 24 HOUR AS window_end, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM w GROUP BY 1, 2, 3""",
)
def windows(spark, sf):
    return jobs.window_counts(table(spark, sf, "events")).withColumn("total", F.floor(F.col("total") * 100 + 0.5) / 100)


@query(
    "O4_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 8 HOUR THEN 1 ELSE 0 END AS b FROM events),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 8 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, sid""",
)
def session_runs(spark, sf):
    return jobs.sessions(table(spark, sf, "events"), "user_id", gap="8 hours")


@query(
    "O5_budget_flags",
    """WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    r AS (SELECT user_id, ts, event_id, k, true AS allowed, NULL::TIMESTAMP AS a, ts AS b FROM e WHERE k = 1
      UNION ALL SELECT e.user_id, e.ts, e.event_id, e.k, x.ok, CASE WHEN x.ok THEN r.b ELSE r.a END, CASE WHEN x.ok THEN e.ts ELSE r.b END
      FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1, LATERAL (SELECT r.a IS NULL OR r.a <= e.ts - INTERVAL 86400 SECOND AS ok) x)
    SELECT user_id, ts, event_id, allowed FROM r""",
)
def budget(spark, sf):
    flags = jobs.budget_flags(table(spark, sf, "events"), "user_id", "ts", "event_id", limit=2, window_seconds=86_400)
    return flags.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "O1_O2_incremental_ingest",
    """SELECT o_custkey % 50 AS source_id, min(o_orderdate) AS retrieved_at FROM orders GROUP BY 1""",
)
def ingest(spark, sf):
    """A stream of records, the first of each id within the watermark, written by batch and read as one table."""
    source, out = new_path(spark, "ingest-in"), new_path(spark, "ingest-out")
    records = table(spark, sf, "orders").select(
        F.lit("orders").alias("source"), (F.col("o_custkey") % 50).alias("source_id"), F.col("o_orderdate").cast("timestamp").alias("retrieved_at")
    )
    first = records.groupBy("source", "source_id").agg(F.min("retrieved_at").alias("retrieved_at"))
    first.write.parquet(f"{source}/a")
    first.write.parquet(f"{source}/b")  # the same records come again
    stream = spark.readStream.schema(first.schema).option("recursiveFileLookup", True).parquet(source)
    jobs.ingest(
        jobs.first_seen(stream, delay="20000 days"), lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"), new_path(spark, "ingest-cp")
    ).awaitTermination()
    return spark.read.parquet(out).select("source_id", F.col("retrieved_at").cast("timestamp_ntz").alias("retrieved_at"))


#: Customers as records whose telephone numbers, streets, domains and names collide.
RECORDS = {
    "id": "lpad(cast(c_custkey as string), 9, '0')", "source": "cast(c_custkey % 3 as string)", "retrieved_at": "timestamp '2024-01-01 00:00:00'",
    "name": "concat(element_at(array('alpha dental', 'alfa dental', 'beta law'), cast(c_custkey % 3 + 1 as int)), ' ', c_custkey % 20)",
    "website": "CASE WHEN c_custkey % 10 = 0 THEN concat('http://d', c_custkey % 700, '.es') END", "phone": "CASE WHEN c_custkey % 7 = 1 THEN concat('6', lpad(cast(c_custkey % 400 as string), 8, '0')) END",
    "email": "cast(null as string)", "address": "CASE WHEN c_custkey % 3 = 0 THEN concat('mayor ', c_custkey % 90) END", "postal_code": "cast(29000 + c_nationkey * 40 + c_custkey % 40 as string)",
}


@query(
    "O1_G6_incremental_resolution",
    f"""WITH RECURSIVE r AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id, CASE c_custkey % 3 WHEN 0 THEN 'alpha dental' WHEN 1 THEN 'alfa dental' ELSE 'beta law' END || ' ' || (c_custkey % 20) AS n,
      CASE WHEN c_custkey % 10 = 0 THEN c_custkey % 700 END AS d, CASE WHEN c_custkey % 7 = 1 THEN c_custkey % 400 END AS p, c_nationkey * 40 + c_custkey % 40 AS po, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 90 END AS st FROM customer),
    x AS (SELECT a.id AS l, b.id AS r, a.n AS a, b.n AS b, a.d = b.d AS dom, a.p = b.p AS ph, a.po = b.po AS po, a.st = b.st AS st,
            {text_sql.TOKENS_SQL.format('a.n')} AS ta, {text_sql.TOKENS_SQL.format('b.n')} AS tb, {text_sql.GRAMS_SQL.format('a.n')} AS ga, {text_sql.GRAMS_SQL.format('b.n')} AS gb
          FROM r a JOIN r b ON a.id <> b.id AND (a.d = b.d OR a.p = b.p OR a.po = b.po)),
    s AS (SELECT *, greatest(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb)))::DOUBLE, 0.95 * (1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE)) AS sim,
            len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb)))::DOUBLE AS tri FROM x),
    e AS (SELECT l, r FROM s WHERE dom OR (ph AND sim >= 0.82) OR (po AND st AND sim >= 0.82) OR (po AND tri > 0.5 AND sim >= 0.93)),
    reach(id, root) AS (SELECT id, id FROM r UNION SELECT e.r, reach.root FROM reach JOIN e ON e.l = reach.id),
    c AS (SELECT id, min(root) AS component FROM reach GROUP BY id)
    SELECT component, count(*) AS n_records, arg_min(n, (-length(n), (CAST(id AS BIGINT) % 3), id)) AS name FROM c JOIN r USING (id) GROUP BY component""",
)
def incremental_resolution(spark, sf):
    """A stream of three micro-batches of records, the first of which comes again, resolved into a versioned snapshot."""
    source = new_path(spark, "records-in")
    records = table(spark, sf, "customer").selectExpr(*(f"{sql} AS {c}" for c, sql in RECORDS.items()), "c_custkey % 3 AS part")
    for i in (0, 1, 2, 0):
        records.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(source)
    resolver = resolution.Resolver(spark, new_path(spark, "resolver"), buckets=16)
    stream = spark.readStream.schema(resolution.RECORD).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.ingest(stream, resolver, new_path(spark, "resolver-cp")).awaitTermination()
    return resolver.entities().select("component", "n_records", "name")


@query(
    "J8_J9_O3_mergeable_counters",
    """WITH w AS (SELECT 'week' AS span, DATE '2024-01-08' AS a, DATE '2024-01-14' AS b UNION ALL SELECT 'month', DATE '2024-01-01', DATE '2024-01-31')
    SELECT span, event_type AS kind, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total, true AS near FROM w JOIN events ON CAST(ts AS DATE) BETWEEN a AND b GROUP BY 1, 2""",
)
def mergeable(spark, sf):
    """Events in three micro-batches, of which any day has a part of each, merged by day and kind; two windows over the days.

    ``near``: the distinct users of a window, from its days' sketches, lie within 8 % of the exact number.
    """
    source = new_path(spark, "events-in")
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "value")
    for i in (2, 0, 1):
        events.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(source)
    kept = counters_.Counters(spark, new_path(spark, "counters"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.ingest(stream, kept, new_path(spark, "counters-cp")).awaitTermination()
    out = None
    for span, first, last in (("week", "2024-01-08", "2024-01-14"), ("month", "2024-01-01", "2024-01-31")):
        exact = events.where(F.to_date("ts").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).groupBy(F.col("event_type").alias("kind")).agg(F.count_distinct("user_id").alias("exact"))
        found = counters_.over(kept.days(), first, last).join(exact, "kind").select(
            F.lit(span).alias("span"), "kind", "n", (F.floor(F.col("total") * 100 + 0.5) / 100).alias("total"), (F.abs(F.col("distinct") - F.col("exact")) <= 0.08 * F.col("exact") + 1).alias("near")
        )
        out = found if out is None else out.unionByName(found)
    return out
