"""Entity resolution: blocking rules in order of priority, components, golden records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.contact import domain, email, is_non_official, phone
from tamarack.functions.text import name_similarity, normalize_name, street_key, trigrams
from tamarack.operators.components import connected_components

STRONG, WEAK, VERY_STRONG, TRIGRAM = 0.82, 0.62, 0.93, 0.5
KEYS = ("name_key", "domain", "phone_key", "postal_code", "street")


def with_keys(records: DataFrame) -> DataFrame:
    """records (id, name, website, phone, address, postal_code, ...) with the keys that rules block on.

    A page on a site that many share (a social network, a directory) is no website of the record's own.
    """
    return records.withColumns(
        {
            "name_key": normalize_name(F.col("name")),
            "domain": F.when(~is_non_official(F.col("website")), domain(F.col("website"))),
            "phone_key": phone(F.col("phone"))["e164"],
            "street": street_key(F.col("address")),
        }
    )


def _copies(records: DataFrame) -> DataFrame:
    """records with ``alone``: the id of a record that equal keys don't merge with others (it has none, or no name)."""
    merges = (F.col("domain") != "") | ((F.col("name_key") != "") & ((F.col("phone_key") != "") | (F.col("postal_code") != "")))
    return records.withColumn("alone", F.when(~F.coalesce(merges, F.lit(False)), F.col("id")))


def one_of_copies(records: DataFrame) -> DataFrame:
    """(id, the keys, alone): the least id of all records that have the same keys and so merge with each other."""
    return _copies(records).groupBy(*KEYS, "alone").agg(F.min("id").alias("id"))


def of_copies(records: DataFrame, known: DataFrame) -> DataFrame:
    """records with the further columns of ``known``, which has those of :func:`one_of_copies` but the id."""
    same = reduce(Column.__and__, (F.col(f"r.{k}").eqNullSafe(F.col(f"k.{k}")) for k in (*KEYS, "alone")))
    more = [F.col(f"k.{c}") for c in known.columns if c not in (*KEYS, "alone")]
    return _copies(records).alias("r").join(known.alias("k"), same).select(*(F.col(f"r.{c}") for c in records.columns), *more)


def trigram_pairs(left: DataFrame, right: DataFrame, block: str, threshold: float = TRIGRAM) -> DataFrame:
    """Pairs (l_id, r_id, similarity) of one block value whose name trigrams overlap more than ``threshold``.

    Different names of a block are compared once and stand for all rows that have them, so that copies cost no more than the
    pairs they are. Trigrams are ordered by rarity over both sides; names meet on (block, trigram) for the first
    |x| - ceil(threshold |x|) + 1 of them, which loses no pair, and are verified exactly. All joins shuffle: the size of
    a file tells little of its rows, less of their trigrams, so that Spark would broadcast tables that no driver holds.
    """
    side = lambda df, p: df.where(F.col(block).isNotNull()).select(
        F.col("id").alias(f"{p}_id"), F.col(block).alias("block"), F.coalesce("name_key", F.lit("")).alias(f"{p}_name")
    )
    a, b = side(left, "l"), side(right, "r")
    named = lambda df, p: df.select("block", f"{p}_name").distinct().withColumn("grams", trigrams(F.col(f"{p}_name")))
    x, y = named(a, "l"), named(b, "r")
    counts = x.select(F.explode("grams").alias("g")).unionAll(y.select(F.explode("grams").alias("g"))).groupBy("g").agg(F.count("*").alias("n"))

    def prefixes(df: DataFrame, p: str) -> DataFrame:
        rows = df.select(f"{p}_name", "block", F.size("grams").alias("size"), F.explode("grams").alias("g")).join(counts.hint("merge"), "g")
        own = rows.groupBy(f"{p}_name", "block", "size").agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("o"))
        keep = (F.col("size") - F.ceil(F.col("size") * threshold) + 1).cast("int")
        return own.select(f"{p}_name", "block", F.explode(F.slice("o", F.lit(1), keep)).alias("s")).select(f"{p}_name", "block", F.col("s.g").alias("g"))

    met = prefixes(x, "l").join(prefixes(y, "r").hint("merge"), ["block", "g"]).select("block", "l_name", "r_name").distinct()
    shared = F.size(F.array_intersect("l_grams", "r_grams"))
    near = (
        met.withColumns({"l_grams": trigrams(F.col("l_name")), "r_grams": trigrams(F.col("r_name"))})
        .withColumn("similarity", shared / (F.size("l_grams") + F.size("r_grams") - shared))
        .where(F.col("similarity") > threshold).select("block", "l_name", "r_name", "similarity")
    )
    return near.join(a.hint("merge"), ["block", "l_name"]).join(b.hint("merge"), ["block", "r_name"]).select("l_id", "r_id", "similarity")


def _candidates(records: DataFrame, entities: DataFrame, near: DataFrame | None, *keys: str) -> DataFrame:
    """For each key and name of ``records`` the names of ``entities`` with that key: keys, r_name, e_name, entity_id (the least
    that has it), similarity. A number or a street that very many share is a row to each two different names."""
    present = " and ".join(f"{k} <> ''" for k in keys)
    r = records.where(present).select(*keys, F.col("name_key").alias("r_name")).distinct()
    e = entities.where(present).groupBy(*keys, F.col("name_key").alias("e_name")).agg(F.min("id").alias("entity_id"))
    met = r.join(e, list(keys)) if near is None else near.join(e, [*keys, "e_name"])
    return met.withColumn("similarity", name_similarity(F.col("r_name"), F.col("e_name")))


def _near_names(records: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """(key, r_name, e_name) of names of one key whose trigrams overlap by more than 0.5."""
    side = lambda df: df.where(f"{key} <> ''").groupBy(key, "name_key").agg(F.min("id").alias("id"))
    a, b = side(records), side(entities)
    name = lambda df, i, n: df.select(F.col("id").alias(i), F.col("name_key").alias(n))
    # an id has one name in a key, so that it stands for both
    met = trigram_pairs(a, b, key).join(a.select(F.col("id").alias("l_id"), key, F.col("name_key").alias("r_name")), "l_id")
    return met.join(name(b, "r_id", "e_name"), "r_id").select(key, "r_name", "e_name")


def decisions(records: DataFrame, entities: DataFrame) -> DataFrame:
    """The first rule that decides for each record: id, entity_id, rule, action (merge or ambiguous), confidence, similarity.

    1 domain, 2 phone, 3 postal code and street, 4 fuzzy name within the postal code. A record that a
    rule finds ambiguous is decided: later rules aren't asked. Records that no rule decides are absent.
    Both inputs come from with_keys; ties go to the least entity id. Records of one key and name are decided alike, once.
    """
    strong, certain = F.col("similarity") >= STRONG, F.col("similarity") >= VERY_STRONG
    order = F.struct((F.col("action") != "merge").alias("a"), (-F.col("similarity")).alias("s"), "entity_id")

    def decided(pairs: DataFrame, rule: int, action: Column, confidence: Column, *keys: str) -> DataFrame:
        """The best entity for each key and name, given to the records that have them."""
        told = pairs.withColumns({"action": action, "confidence": confidence})
        best = told.groupBy(*keys, "r_name").agg(F.min_by(F.struct("entity_id", "action", "confidence", "similarity"), order).alias("x"))
        own = records.select("id", *keys, F.col("name_key").alias("r_name")).join(best, [*keys, "r_name"])
        return own.select("id", F.lit(rule).alias("rule"), "x.*")

    sizes = entities.where("domain <> ''").groupBy("domain").agg(F.count("*").alias("n"))
    one = F.col("n") == 1
    same_site = _candidates(records, entities, None, "domain").join(sizes, "domain").where(one | strong)
    merge = F.lit("merge")
    every = [
        decided(same_site, 1, merge, F.when(one, 0.98).otherwise(0.90), "domain"),
        decided(_candidates(records, entities, None, "phone_key"), 2, F.when(strong, "merge").otherwise("ambiguous"), F.when(strong, 0.94).otherwise(0.5), "phone_key"),
        decided(_candidates(records, entities, None, "postal_code", "street").where(F.col("similarity") >= WEAK), 3, F.when(strong, "merge").otherwise("ambiguous"), F.when(strong, 0.90).otherwise(0.55), "postal_code", "street"),
        decided(_candidates(records, entities, _near_names(records, entities, "postal_code"), "postal_code").where(strong), 4, F.when(certain, "merge").otherwise("ambiguous"), F.when(certain, 0.72).otherwise(0.5), "postal_code"),
    ]
    first = F.struct("rule", order.alias("o"))
    return reduce(DataFrame.unionByName, every).groupBy("id").agg(F.min_by(F.struct("entity_id", "rule", "action", "confidence", "similarity"), first).alias("x")).select("id", "x.*")


#: Why a pair is not merged by itself, by rule.
REVIEW_REASONS = {2: "one phone number, names differ", 3: "one street, names differ somewhat", 4: "one postal code, names nearly alike"}


def review_table(decided: DataFrame) -> DataFrame:
    """Ambiguous records for a person to look at: id, entity_id, rule, confidence, similarity, reason."""
    reason = F.create_map(*(F.lit(x) for r in REVIEW_REASONS.items() for x in r))
    open_ = decided.where("action = 'ambiguous'")
    return open_.select("id", "entity_id", "rule", "confidence", "similarity", F.element_at(reason, F.col("rule")).alias("reason"))


def carried_duplicates(reviewed: DataFrame, merged: DataFrame) -> DataFrame:
    """(id, duplicate_of): what a review confirmed, along the chains of later merges.

    reviewed: (id, entity_id) pairs found to be one; merged: (id, component) of records that rules merged. All that hang
    together are one; its least id stays, the others are its duplicates.
    """
    links = reviewed.select(F.col("id").alias("src"), F.col("entity_id").alias("dst")).unionByName(merged.select(F.col("id").alias("src"), F.col("component").alias("dst")))
    return connected_components(links).where("node <> component").select(F.col("node").alias("id"), F.col("component").alias("duplicate_of"))


def merge_edges(records: DataFrame) -> DataFrame:
    """Pairs (src, dst) of records of one batch that the rules merge with each other."""
    sim = name_similarity(F.col("l.name_key"), F.col("r.name_key"))

    def named(*keys: str) -> tuple[DataFrame, DataFrame]:
        """A row (the least id) for each different name of a key, and stars of the records whose names are equal.

        A number or a street that very many listings share is one row to each different name.
        """
        own = records.where(" and ".join(f"{k} <> ''" for k in keys))
        names = own.groupBy(*keys, "name_key").agg(F.min("id").alias("id"))
        stars = own.where("name_key <> ''").join(names.withColumnRenamed("id", "dst"), [*keys, "name_key"]).where("id <> dst")
        return names, stars.select(F.col("id").alias("src"), "dst")

    def alike(*keys: str) -> DataFrame:
        """Links of records of one key by names that are equal or alike."""
        names, stars = named(*keys)
        same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
        links = names.alias("l").join(names.alias("r"), [*same, F.col("l.id") < F.col("r.id")]).where(sim >= STRONG)
        return stars.unionByName(links.select(F.col("l.id").alias("src"), F.col("r.id").alias("dst")))

    # equal domains merge without a test of names: a star to the least id says as much as all pairs
    hub = records.where("domain is not null").groupBy("domain").agg(F.min("id").alias("dst"))
    by_domain = records.join(hub, "domain").where("id <> dst").select(F.col("id").alias("src"), "dst")
    by_phone = alike("phone_key")
    by_street = alike("postal_code", "street")
    names, equal = named("postal_code")
    near = trigram_pairs(names, names, "postal_code").where("l_id < r_id")
    name_of = lambda i, c: names.select(F.col("id").alias(i), F.col("name_key").alias(c))
    fuzzy = (
        near.join(name_of("l_id", "a"), "l_id").join(name_of("r_id", "b"), "r_id")
        .where(name_similarity(F.col("a"), F.col("b")) >= VERY_STRONG).select(F.col("l_id").alias("src"), F.col("r_id").alias("dst"))
        .unionByName(equal)
    )
    return by_domain.unionByName(by_phone).unionByName(by_street).unionByName(fuzzy)


def cross_edges(fresh: DataFrame, old: DataFrame) -> DataFrame:
    """Pairs (src, dst) of a record of ``fresh`` and one of ``old`` that the rules merge with each other.

    Both have id, name_key and the blocking keys, null or empty where a row has none of a kind; no id is in both. Links
    within a side are left out: each side's records of one name and key are met by the least of them alone.
    """

    def names(df: DataFrame, keys: tuple[str, ...], side: str) -> DataFrame:
        own = df.where(" and ".join(f"{k} <> ''" for k in keys) + " and name_key <> ''")
        return own.groupBy(*keys, F.col("name_key").alias(f"{side}_name")).agg(F.min("id").alias(f"{side}_id"))

    pair = (F.col("l_id").alias("src"), F.col("r_id").alias("dst"))
    sim = name_similarity(F.col("l_name"), F.col("r_name"))
    hub = lambda df, side: df.where("domain <> ''").groupBy("domain").agg(F.min("id").alias(f"{side}_id"))
    out = hub(fresh, "l").join(hub(old, "r"), "domain").select(*pair)
    for keys in (("phone_key",), ("postal_code", "street")):
        out = out.unionByName(names(fresh, keys, "l").join(names(old, keys, "r"), list(keys)).where(sim >= STRONG).select(*pair))
    left, right = names(fresh, ("postal_code",), "l"), names(old, ("postal_code",), "r")
    sides = (df.withColumnsRenamed({f"{s}_id": "id", f"{s}_name": "name_key"}) for df, s in ((left, "l"), (right, "r")))
    near = trigram_pairs(*sides, "postal_code").join(left.select("l_id", "l_name"), "l_id").join(right.select("r_id", "r_name"), "r_id")
    return out.unionByName(near.where(sim >= VERY_STRONG).select(*pair)).distinct()


def resolve_batch(records: DataFrame) -> DataFrame:
    """records with ``component``: the least id of those that merge with it, directly or through others."""
    found = connected_components(merge_edges(records)).withColumnsRenamed({"node": "id"})
    return records.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def golden_records(resolved: DataFrame, order: tuple[str, ...] = ("retrieved_at", "source", "id")) -> DataFrame:
    """One row for each component: the longest name, the category and location evidence of most confidence
    (ties: the first), in_scope of any, for all else the first value that isn't null in arrival order."""
    at = F.struct(*order)
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), at)).alias(c)
    best = lambda c, by: F.min_by(c, F.struct((-F.coalesce(F.col(by), F.lit(-1.0))).alias("k"), at.alias("o"))).alias(c)
    special = {"component", "id", "name", "category", "category_confidence", "location_confidence", "in_scope"}
    rest = [c for c in resolved.columns if c not in special]
    rules = [
        F.min_by("name", F.struct((-F.length("name")).alias("k"), at.alias("o"))).alias("name"),
        *([best("category", "category_confidence"), F.max("category_confidence").alias("category_confidence")] if "category_confidence" in resolved.columns else []),
        *([F.max("location_confidence").alias("location_confidence")] if "location_confidence" in resolved.columns else []),
        *([F.bool_or("in_scope").alias("in_scope")] if "in_scope" in resolved.columns else []),
        *(first(c) for c in rest),
        F.count("*").alias("n_records"),
    ]
    return resolved.groupBy("component").agg(*rules)


def merged_reviews(reviews: DataFrame) -> DataFrame:
    """(business_id, source, seq, rating, review_count, confidence): the last rating that isn't null, the
    greatest count (0 where all are null, unless rating is null too: then the row is left out) and confidence."""
    usable = reviews.where("rating is not null or review_count is not null")
    return usable.groupBy("business_id", "source").agg(
        F.max_by(F.col("rating"), F.when(F.col("rating").isNotNull(), F.col("seq"))).alias("rating"),
        F.max(F.coalesce("review_count", F.lit(0))).alias("review_count"),
        F.max("confidence").alias("confidence"),
    )


def suppressed(records: DataFrame, suppression: DataFrame) -> DataFrame:
    """records (id, name, website, phone, email) that no entry (kind, value) names by domain, phone, e-mail or name.

    The list is joined by key; Spark broadcasts it where it is small.
    """
    keys = F.array(
        F.struct(F.lit("domain").alias("kind"), domain(F.col("website")).alias("value")),
        F.struct(F.lit("phone").alias("kind"), phone(F.col("phone"))["e164"].alias("value")),
        F.struct(F.lit("email").alias("kind"), email(F.col("email"))["value"].alias("value")),
        F.struct(F.lit("name").alias("kind"), normalize_name(F.col("name")).alias("value")),
    )
    hit = records.select("id", F.explode(keys).alias("k")).select("id", "k.*").where("value is not null").join(suppression, ["kind", "value"], "left_semi")
    return records.join(hit.select("id").distinct(), "id", "left_anti")


def outcome_report(validated: DataFrame, decided: DataFrame) -> DataFrame:
    """(source, action, reason) -> counts of records, from what validation and the rules say of each.

    validated: (id, source, reasons); decided: the result of :func:`decisions` for the records that were accepted. A record is
    rejected for each of its reasons, merged or ambiguous as the rules decide (reason: the rule), else inserted.
    """
    accepted = validated.where(F.size("reasons") == 0).select("id", "source").join(decided.select("id", "rule", "action"), "id", "left")
    taken = accepted.select(
        "source", F.when(F.col("action").isNull(), "inserted").when(F.col("action") == "merge", "merged").otherwise(F.col("action")).alias("action"),
        F.concat(F.lit("rule "), F.col("rule").cast("string")).alias("reason"),
    )
    refused = validated.select("source", F.lit("rejected").alias("action"), F.explode("reasons").alias("reason"))
    return taken.unionByName(refused).groupBy("source", "action", "reason").agg(F.count("*").alias("n"))
