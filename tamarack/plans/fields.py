"""Queries of the column functions: text, contacts, hashes, geography, numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.functions import contact, geo, hashing, numbers, text
from tamarack.operators import dictionary, resolve
from tamarack.operators.storage import spread, written
from tamarack.plans.registry import query, table

NORM = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"


@query("C1_strip_diacritics", "SELECT doc_id, sha256(strip_accents(text)) AS folded FROM documents")
def c1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.strip_diacritics(F.col("text")), 256).alias("folded"))


@query(
    "C2_C4_normalize_text",
    f"""WITH t AS (SELECT doc_id, {NORM.format('text')} AS norm FROM documents)
    SELECT doc_id, sha256(norm) AS norm, CAST(length(norm) AS BIGINT) AS n_chars,
      CAST(len(list_filter(string_split(norm, ' '), lambda w: length(w) > 1 AND w NOT IN ({", ".join(f"'{w}'" for w in text.NOISE_WORDS)}))) AS BIGINT) AS n_tokens,
      substr(norm, 1, 40) AS excerpt
    FROM t""",
)
def c2(spark, sf):
    norm = text.normalize_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", norm.alias("n")).select(
        "doc_id", F.sha2("n", 256).alias("norm"), F.length("n").cast("long").alias("n_chars"),
        F.size(text.name_tokens(F.col("n"))).cast("long").alias("n_tokens"), text.excerpt(F.col("n"), 40).alias("excerpt"),
    )


LEGAL = ("Clínica {0} S.L.", "{0} Sociedad Limitada", "Grupo {0}, S.A.", "{0} s.coop.", "Hotel-{0} SLU", "{0} Sala", "The {0} C.B.")


def _named(style: str) -> str:
    """SQL for a name in one of the styles LEGAL, chosen by key."""
    parts = [f"WHEN {i} THEN replace('{s}', '{{0}}', {style})" for i, s in enumerate(LEGAL)]
    return "CASE c_custkey % 7 " + " ".join(parts) + " END"


def _strip_sql(value: str) -> str:
    out = f"trim(lower(strip_accents({value})))"
    for suffix in text.LEGAL_SUFFIXES:
        quoted = suffix.replace(".", r"\.")
        out = rf"regexp_replace({out}, '(?s)^(.+)[ ,.\-]{quoted}$', '\1')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


@query("C3_normalize_name", f"SELECT c_custkey, {_named('c_name')} AS raw, {_strip_sql(_named('c_name'))} AS name_key FROM customer")
def c3(spark, sf):
    raw = F.expr(_named("c_name"))
    return table(spark, sf, "customer").select("c_custkey", raw.alias("raw"), text.normalize_name(raw).alias("name_key"))


TOKENS_SQL = "list_filter(string_split({0}, ' '), lambda w: length(w) > 1 AND w NOT IN (" + ", ".join(f"'{w}'" for w in text.NOISE_WORDS) + "))"
GRAMS_SQL = (
    "list_distinct(flatten(list_transform(list_filter(string_split({0}, ' '), lambda w: w <> ''), "
    "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', CAST(i AS BIGINT), 3)))))"
)


@query(
    "C5_C8_name_similarity",
    f"""WITH p AS (SELECT p_brand, p_size, {NORM.format('p_name')} AS n, count(*) AS k FROM part GROUP BY ALL),
    g AS (SELECT *, {TOKENS_SQL.format('n')} AS t, {GRAMS_SQL.format('n')} AS g FROM p),
    pairs AS (SELECT a.p_brand, a.p_size, a.n AS a, b.n AS b, a.t AS ta, b.t AS tb, a.g AS ga, b.g AS gb, CASE WHEN a.n = b.n THEN a.k * (a.k - 1) // 2 ELSE a.k * b.k END AS pairs
              FROM g a JOIN g b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.n <= b.n WHERE a.n < b.n OR a.k > 1),
    s AS (SELECT *, len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb)))::DOUBLE AS token_overlap,
            1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE AS edit,
            len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb)))::DOUBLE AS trigram
          FROM pairs)
    SELECT p_brand, p_size, a, b, CAST(pairs AS BIGINT) AS pairs, floor(token_overlap * 1e6 + 0.5) / 1e6 AS token_overlap, floor(edit * 1e6 + 0.5) / 1e6 AS edit,
           floor(greatest(token_overlap, 0.95 * edit) * 1e6 + 0.5) / 1e6 AS name_similarity, floor(trigram * 1e6 + 0.5) / 1e6 AS trigram FROM s WHERE trigram > 0.3""",
)
def c5(spark, sf):
    """All pairs of parts of one brand and size by their names: each two different names with how many pairs have them.

    Names that are equal are one; those whose trigrams overlap by more than 0.3 are compared by all four measures.
    """
    name = text.normalize_text(F.col("p_name")).alias("name_key")
    p = table(spark, sf, "part").groupBy("p_brand", "p_size", name).agg(F.min("p_partkey").alias("id"), F.count("*").alias("k"))
    p = written(p.withColumn("block", F.concat_ws("|", "p_brand", "p_size")), "names")
    near = resolve.trigram_pairs(p, p, "block", 0.3).where("l_id <= r_id")
    of = lambda i, n, k: p.select(F.col("id").alias(i), F.col("name_key").alias(n), F.col("k").alias(k))
    pairs = near.join(p.select(F.col("id").alias("l_id"), "p_brand", "p_size", F.col("name_key").alias("l"), F.col("k").alias("l_k")), "l_id").join(of("r_id", "r", "r_k"), "r_id")
    same = F.col("l_id") == F.col("r_id")
    x, y = F.least("l", "r"), F.greatest("l", "r")
    six = lambda c: numbers.round_half_up(c, 6)
    return pairs.where(~same | (F.col("l_k") > 1)).select(
        "p_brand", "p_size", x.alias("a"), y.alias("b"), F.when(same, F.expr("l_k * (l_k - 1) div 2")).otherwise(F.col("l_k") * F.col("r_k")).alias("pairs"),
        six(text.jaccard(text.name_tokens(x), text.name_tokens(y))).alias("token_overlap"),
        six(text.edit_similarity(x, y)).alias("edit"), six(text.name_similarity(x, y)).alias("name_similarity"), six(F.col("similarity")).alias("trigram"),
    )


BENCH_WORDS = r"(SELECT DISTINCT unnest(string_split({0}, ' ')) AS term FROM benchmark)".format(NORM.format("text"))


@query(
    "H1_D2_dictionary",
    f"""WITH terms AS (SELECT term FROM {BENCH_WORDS} WHERE length(term) > 3),
    words AS (SELECT doc_id, unnest(string_split({NORM.format('text')}, ' ')) AS term FROM documents)
    SELECT d.doc_id, arg_min(w.term, (-length(w.term), w.term)) AS term FROM documents d LEFT JOIN (SELECT words.doc_id, term FROM words JOIN terms USING (term)) w ON w.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def many_terms(spark, sf):
    """The longest of all words of the benchmark that each document holds."""
    words = table(spark, sf, "benchmark").select(F.explode(F.split(text.normalize_text(F.col("text")), " ")).alias("term")).where(F.length("term") > 3).distinct()
    # the order of terms is by what they are: their first letters as a number
    terms = words.select(F.conv(F.substring(F.rpad(F.hex("term"), 32, "0"), 1, 15), 16, 10).cast("long").alias("place"), "term", F.lit(None).cast("string").alias("category"))
    docs = table(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("text"))
    return dictionary.longest_matches(docs, ["text"], terms).select("doc_id", F.get("matches", F.lit(0))["term"].alias("term"))


PHONE = """CASE c_custkey % 6 WHEN 0 THEN '+34 ' || n WHEN 1 THEN '0034-' || n WHEN 2 THEN '34' || n WHEN 3 THEN n
           WHEN 4 THEN '+44 ' || n ELSE '(' || substr(n, 1, 3) || ') ' || substr(n, 4) END"""
NUMBER = "CAST(600000000 + (c_custkey * 7919000 + 123457) % 400000000 AS VARCHAR(12))"
DIGITS = r"regexp_replace(regexp_replace(regexp_replace(raw, '[^0-9+]', '', 'g'), '^00', '+'), '(.)\+', '\1', 'g')"


@query(
    "C9_C10_phone",
    f"""WITH r AS (SELECT c_custkey, {PHONE} AS raw FROM (SELECT c_custkey, {NUMBER} AS n FROM customer)),
    d AS (SELECT *, {DIGITS} AS d FROM r),
    n AS (SELECT *, CASE WHEN d LIKE '+34%' THEN substr(d, 4) WHEN d LIKE '34%' AND length(d) = 11 THEN substr(d, 3) WHEN d NOT LIKE '+%' THEN d END AS nat FROM d),
    v AS (SELECT c_custkey, raw, CASE WHEN regexp_matches(nat, '^[6-9][0-9]{{8}}$') THEN nat END AS nat FROM n)
    SELECT c_custkey, raw, '+34' || nat AS e164, substr(nat, 1, 1) IN ('6', '7') AS is_mobile, nat LIKE '95%' AS is_landline,
      '+34 ' || substr(nat, 1, 3) || ' ' || substr(nat, 4, 2) || ' ' || substr(nat, 6, 2) || ' ' || substr(nat, 8, 2) AS display FROM v""",
)
def c9(spark, sf):
    number = F.expr(NUMBER.replace("VARCHAR(12)", "STRING"))
    raw = table(spark, sf, "customer").select("c_custkey", number.alias("n")).selectExpr("c_custkey", f"{PHONE} AS raw")
    p = contact.phone(F.col("raw"))
    return raw.select("c_custkey", "raw", p["e164"].alias("e164"), p["is_mobile"].alias("is_mobile"), p["is_landline"].alias("is_landline"), contact.phone_display(F.col("raw")).alias("display"))


MAIL = """CASE c_custkey % 5 WHEN 0 THEN ' mailto:Info@shop' || c_custkey || '.es?subject=x' WHEN 1 THEN 'Ana' || c_custkey || '@gmail.com'
          WHEN 2 THEN 'no address' WHEN 3 THEN 'citas@clinic' || c_custkey || '.com.es ' ELSE 'x@y' END"""


@query(
    "C11_email",
    rf"""WITH r AS (SELECT c_custkey, {MAIL} AS raw FROM customer),
    v AS (SELECT *, string_split(regexp_replace(lower(trim(raw)), '^mailto:', ''), '?')[1] AS value FROM r),
    ok AS (SELECT c_custkey, raw, CASE WHEN regexp_matches(value, '^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,}}$') THEN value END AS value FROM v)
    SELECT c_custkey, raw, value, string_split(value, '@')[2] AS domain,
      string_split(value, '@')[1] IN ({", ".join(f"'{x}'" for x in contact.ROLE_LOCAL_PARTS)}) AS is_role,
      string_split(value, '@')[2] IN ({", ".join(f"'{x}'" for x in contact.CONSUMER_DOMAINS)}) AS is_consumer FROM ok""",
)
def c11(spark, sf):
    raw = table(spark, sf, "customer").selectExpr("c_custkey", f"{MAIL} AS raw")
    e = contact.email(F.col("raw"))
    return raw.select("c_custkey", "raw", *(e[k].alias(k) for k in ("value", "domain", "is_role", "is_consumer")))


HOST_SQL = r"regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '')"
DOMAIN_SQL = """CASE WHEN len(l) <= 2 THEN h WHEN l[-2] || '.' || l[-1] IN (""" + ", ".join(f"'{s}'" for s in contact.MULTI_LABEL_SUFFIXES) + """)
    THEN l[-3] || '.' || l[-2] || '.' || l[-1] ELSE l[-2] || '.' || l[-1] END"""


@query(
    "C12_C17_urls",
    rf"""WITH h AS (SELECT page_id, url, {HOST_SQL} AS h FROM pages), d AS (SELECT *, string_split(h, '.') AS l FROM h),
    q AS (SELECT *, {DOMAIN_SQL} AS domain, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS path,
            list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_|fbclid|gclid|msclkid|mc_cid|mc_eid|ref)')) AS ps FROM d)
    SELECT page_id, h AS host, domain, 'https://' || h || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS canonical,
      domain IN ({", ".join(f"'{s}'" for s in contact.NON_OFFICIAL_HOSTS)}) OR h IN ({", ".join(f"'{s}'" for s in contact.NON_OFFICIAL_HOSTS)}) AS non_official,
      regexp_matches(h, '({contact.FREE_BUILDER_SUFFIXES})$') AS free_builder, domain = 'example.com' AS same_domain FROM q""",
)
def c12(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", contact.host(u).alias("host"), contact.domain(u).alias("domain"), contact.canonical_url(u).alias("canonical"),
        contact.is_non_official(u).alias("non_official"), contact.is_free_builder(u).alias("free_builder"),
        contact.same_domain(u, F.lit("http://www.example.com/x")).alias("same_domain"),
    )


STREET = "CASE s_suppkey % 4 WHEN 0 THEN 'Calle Larios ' WHEN 1 THEN 'C/ Larios, ' WHEN 2 THEN 'Avda. de la Aurora s/n, local ' ELSE 'Plaza Mayor Nº ' END || s_suppkey"


@query(
    "C18_street_key",
    rf"""SELECT s_suppkey, {STREET} AS raw, trim(regexp_replace(regexp_replace({NORM.format('(' + STREET + ')')}, '\b({"|".join(text.STREET_WORDS)})\b', ' ', 'g'), '\s+', ' ', 'g')) AS street FROM supplier""",
)
def c18(spark, sf):
    raw = F.expr(STREET)
    return table(spark, sf, "supplier").select("s_suppkey", raw.alias("raw"), text.street_key(raw).alias("street"))


@query(
    "C19_field_cleanup",
    r"""WITH r AS (SELECT o_orderkey, '  ' || o_orderpriority || chr(9) || ' x ' AS raw, CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE '4,' || (o_orderkey % 10) END AS num FROM orders)
    SELECT o_orderkey, nullif(trim(regexp_replace(raw, '\s+', ' ', 'g')), '') AS clean, TRY_CAST(replace(nullif(trim(num), ''), ',', '.') AS DOUBLE) AS num FROM r""",
)
def c19(spark, sf):
    raw = F.expr("concat('  ', o_orderpriority, chr(9), ' x ')")
    num = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE concat('4,', o_orderkey % 10) END")
    return table(spark, sf, "orders").select("o_orderkey", text.clean_field(raw).alias("clean"), text.decimal_number(text.clean_field(num)).alias("num"))


@query(
    "C20_C22_hashes",
    """SELECT e.c_custkey, e.evidence, sha256('groq|fast|' || e.c_custkey || '|m1|p3|a2|' || e.evidence) AS cache_key, sha256(c_name) AS content_hash
    FROM (SELECT *, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}') AS evidence FROM customer) e""",
)
def c20(spark, sf):
    df = table(spark, sf, "customer").withColumn("evidence", hashing.evidence_hash("c_nationkey", "c_custkey", "c_mktsegment"))
    key = hashing.cache_key("groq", "fast", F.col("c_custkey"), "m1", 3, 2, F.col("evidence"))
    return df.select("c_custkey", "evidence", key.alias("cache_key"), F.sha2("c_name", 256).alias("content_hash"))


def _redact_sql(value: str) -> str:
    for shape in text.SECRET_SHAPES:
        value = f"regexp_replace({value}, '{shape}', '[REDACTED]', 'g')"
    return value


SECRETS = "concat(c_name, ' sk-', repeat('a', 10 + c_custkey % 12), ' bearer ', repeat('Zz9', 3 + c_custkey % 4), ' postgres://u:p@h/db')"


@query("C23_redact", f"SELECT c_custkey, {_redact_sql(SECRETS)} AS redacted FROM customer")
def c23(spark, sf):
    raw = F.expr(SECRETS.replace("c_custkey % 12", "cast(c_custkey % 12 as int)").replace("c_custkey % 4", "cast(c_custkey % 4 as int)"))
    return table(spark, sf, "customer").select("c_custkey", text.redact(raw).alias("redacted"))


LAT, LON = "36.55 + (c_custkey % 97) * 0.004", "-4.70 + (c_custkey % 89) * 0.005"
KM = "2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians({0} - 36.7213) / 2), 2) + cos(radians(36.7213)) * cos(radians({0})) * pow(sin(radians({1} + 4.4214) / 2), 2))))"


@query(
    "D1_D4_distance",
    f"""WITH p AS (SELECT c_custkey, CAST({LAT} AS DOUBLE) AS lat, CAST({LON} AS DOUBLE) AS lon FROM customer)
    SELECT c_custkey, floor({KM.format('lat', 'lon')} * 1e6 + 0.5) / 1e6 AS km, lat BETWEEN 36.61 AND 36.87 AND lon BETWEEN -4.63 AND -4.28 AS in_box FROM p""",
)
def d1(spark, sf):
    p = table(spark, sf, "customer").select("c_custkey", F.expr(f"cast({LAT} as double)").alias("lat"), F.expr(f"cast({LON} as double)").alias("lon"))
    lat0, lon0 = geo.MALAGA.centre
    km = geo.haversine_km(F.lit(lat0), F.lit(lon0), F.col("lat"), F.col("lon"))
    return p.select("c_custkey", numbers.round_half_up(km, 6).alias("km"), geo.in_box(F.col("lat"), F.col("lon"), geo.MALAGA.box).alias("in_box"))


CITY = "CASE c_custkey % 5 WHEN 0 THEN 'Málaga' WHEN 1 THEN 'Vélez-Málaga' WHEN 2 THEN 'Marbella' WHEN 3 THEN 'Ciudad de Málaga' END"
POSTAL = "CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE CAST(29000 + c_custkey % 23 AS VARCHAR(12)) END"
COUNTRY = "CASE c_custkey % 11 WHEN 0 THEN 'PT' WHEN 1 THEN NULL ELSE 'es' END"


def _term_sql(value: str, terms: tuple[str, ...]) -> str:
    ordered = ", ".join(f"'{t}'" for t in sorted(terms, key=lambda t: -len(t)))
    return f"list_filter([{ordered}], lambda t: contains({value}, t))[1]"


@query(
    "D2_D3_location_verdict",
    f"""WITH p AS (SELECT c_custkey, {CITY} AS city, {POSTAL} AS postal, upper({COUNTRY}) AS land,
                 CASE WHEN c_custkey % 3 > 0 THEN CAST({LAT} AS DOUBLE) END AS lat, CASE WHEN c_custkey % 3 > 0 THEN CAST({LON} AS DOUBLE) END AS lon FROM customer),
    m AS (SELECT *, {_term_sql(NORM.format('city'), geo.MALAGA.excluded)} AS no, {_term_sql(NORM.format('city'), geo.MALAGA.aliases)} AS yes FROM p),
    j AS (SELECT *, coalesce(land <> 'ES', false) AS foreign_land, coalesce(no IS NOT NULL AND length(no) >= coalesce(length(yes), 0), false) AS outside,
            coalesce(postal NOT BETWEEN '29001' AND '29018', false) AS wrong_postal,
            coalesce(NOT (lat BETWEEN 36.61 AND 36.87 AND lon BETWEEN -4.63 AND -4.28), false) AS off_map FROM m),
    s AS (SELECT *, CASE WHEN foreign_land OR outside OR wrong_postal OR off_map THEN 0.0 ELSE least(1.0,
            CASE WHEN land IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN postal IS NOT NULL THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN yes IS NOT NULL THEN 0.35::DOUBLE ELSE 0 END
            + CASE WHEN lat IS NOT NULL THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN {KM.format('lat', 'lon')} <= 16 THEN 0.1::DOUBLE ELSE 0 END) END AS c FROM j)
    SELECT c_custkey, c >= 0.7 AS in_scope, floor(c * 1000 + 0.5) / 1000 AS confidence,
      CASE WHEN foreign_land THEN 'country' WHEN outside THEN 'municipality_excluded' WHEN wrong_postal THEN 'postal_code' WHEN off_map THEN 'coordinates' END AS against FROM s""",
)
def d3(spark, sf):
    string = lambda sql: F.expr(sql.replace("VARCHAR(12)", "STRING"))
    nothing = F.lit(None).cast("string")
    some = F.expr("c_custkey % 3 > 0")
    v = geo.location_verdict(
        nothing, string(POSTAL), nothing, string(CITY), nothing, string(COUNTRY),
        F.when(some, F.expr(f"cast({LAT} as double)")), F.when(some, F.expr(f"cast({LON} as double)")),
    )
    return spread(table(spark, sf, "customer").select("c_custkey")).select("c_custkey", v.alias("v")).select(
        "c_custkey", "v.in_scope", "v.confidence", F.get(F.filter("v.evidence", lambda e: ~e["supports"]), F.lit(0))["signal"].alias("against")
    )


@query(
    "J6_J7_rounding",
    """SELECT l_orderkey, l_linenumber, floor((l_extendedprice * (l_discount - 0.05)) * 10 + 0.5) / 10 AS rounded,
      least(100.0, greatest(0.0, l_extendedprice / 500)) AS clamped FROM lineitem""",
)
def j6(spark, sf):
    x = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.round_half_up(x * (F.col("l_discount") - 0.05)).alias("rounded"), numbers.clamp(x / 500).alias("clamped")
    )
