"""Resolution of records as they come: micro-batches against a versioned snapshot of what was resolved before.

A batch's records meet older ones by the blocking keys that they share, whose buckets alone are read. Links within the
batch and across it join components; records of components that grew or met are written again, and so are their golden
records; all else stays as it is. Links depend on two records at a time, so batches in any number and order end in what one
batch of all of them gives. Everything a batch changes becomes visible in one version, which also holds the batch's
number: a batch that comes again after a crash finds itself taken in, or repeats a version that nobody saw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.text import normalize_name
from tamarack.operators.components import connected_components
from tamarack.operators.resolve import cross_edges, golden_records, merge_edges, of_copies, one_of_copies, suppressed, with_keys
from tamarack.operators.storage import drop, written
from tamarack.sources.snapshots import Change, Keyed, Snapshots

#: The fields of a record that resolution needs; more may follow.
RECORD = "id string, source string, retrieved_at timestamp, name string, website string, phone string, email string, address string, postal_code string"
KEYED = "name_key string, domain string, phone_key string, street string"


class Resolver:
    """Records resolved batch by batch below ``root``.

    ``fields`` is the schema of further fields of a record (DDL). Tables: ``records`` (each with its component),
    ``entities`` (a golden record for each component), ``members`` (the component of each id), ``keys`` (blocking keys).
    """

    def __init__(self, spark: SparkSession, root: str, fields: str = "", suppression: DataFrame | None = None, buckets: int = 64):
        self.spark, self.suppression = spark, suppression
        self.record = f"{RECORD}, {fields}" if fields else RECORD
        records = spark.createDataFrame([], f"{self.record}, {KEYED}, component string")
        entities = golden_records(records).schema
        ddl = lambda schema: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self.store = Snapshots(spark, root, {
            "records": Keyed(ddl(records.schema), ("component",), buckets),
            "entities": Keyed(ddl(entities), ("component",), buckets),
            "members": Keyed("id string, component string", ("id",), buckets),
            "keys": Keyed("kind string, value string, id string, name_key string, postal_code string", ("kind", "value"), buckets),
        })

    def entities(self, version: int | None = None) -> DataFrame:
        return self.store.read("entities", version=version)

    def members(self, version: int | None = None) -> DataFrame:
        return self.store.read("members", version=version)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        self.apply(batch, batch_id)

    def apply(self, batch: DataFrame, batch_id: int, stream: str = "records") -> int:
        """Take in a batch of records and return the version that has it.

        Records without an id or a name, those that the suppression list names, and those whose id came before are left
        out; of records of one id in a batch the first by time and source stays.
        """
        version = self.store.manifest()["version"]
        if self.store.done(stream, batch_id):
            return version
        usable = batch.select(*self.spark.createDataFrame([], self.record).columns).where("id IS NOT NULL AND trim(name) <> ''")
        columns = [c for c in usable.columns if c != "id"]
        once = usable.groupBy("id").agg(F.min_by(F.struct(*columns), F.struct("retrieved_at", "source", "name")).alias("r")).select("id", "r.*").select(*usable.columns)
        if self.suppression is not None:
            once = suppressed(once, self.suppression)
        known = self.store.read("members", self.store.touched("members", once), version)
        fresh = written(with_keys(once).join(known.select("id"), "id", "left_anti"), "fresh")
        copies = written(one_of_copies(fresh), "copies")
        new_keys = written(_block_keys(copies), "keys")
        placed, moved = self._components(fresh, copies, new_keys, version)
        changes = self._changes(placed, new_keys, moved, version)
        out = self.store.commit(changes, version, (stream, batch_id))
        for t in (fresh, copies, new_keys, placed, moved):
            drop(t)
        return out

    def _components(self, fresh: DataFrame, copies: DataFrame, new_keys: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
        """The batch's records with their ``component``, and (old, component) of older components that they meet.

        One of all records whose keys are the same stands for them in every join but the last, which gives them its component.
        """
        buckets = self.store.touched("keys", new_keys)
        met = self.store.read("keys", buckets, version).join(new_keys.select("kind", "value").distinct(), ["kind", "value"], "left_semi")
        across = written(cross_edges(copies, _as_records(met)), "across")
        own = self.store.read("members", self.store.touched("members", across.select(F.col("dst").alias("id"))), version)
        to_old = across.join(own.select(F.col("id").alias("dst"), F.col("component").alias("old")), "dst").select("src", "old")
        # nodes are ids of the batch and older components by their least id; the least of all is the component's name
        links = merge_edges(copies).unionByName(to_old.select("src", F.col("old").alias("dst")))
        found = connected_components(links)
        named = copies.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        placed = of_copies(fresh, named.drop("id"))
        old = to_old.select("old").distinct().join(found.withColumnRenamed("node", "old"), "old").select("old", "component")
        out = written(placed, "placed"), written(old, "moved")
        drop(across)
        return out

    def _changes(self, fresh: DataFrame, new_keys: DataFrame, moved: DataFrame, version: int) -> dict[str, Change]:
        components = fresh.select("id", "component")
        # what is written again: the buckets of the batch's components and of those they met
        of = components.select("component").unionByName(moved.select("component")).unionByName(moved.select(F.col("old").alias("component"))).distinct()
        buckets = self.store.touched("records", of)
        renamed = moved.withColumnRenamed("component", "new").withColumnRenamed("old", "component")
        before = self.store.read("records", buckets, version)
        kept = before.join(renamed, "component", "left").withColumn("component", F.coalesce("new", "component")).select(*before.columns)
        records = kept.unionByName(fresh.select(*before.columns))
        changed = components.select("component").unionByName(moved.select("component")).distinct()
        golden = golden_records(records.join(changed, "component", "left_semi")).withColumn("name_key", normalize_name(F.col("name")))
        entities = self.store.read("entities", buckets, version).join(of, "component", "left_anti")
        # ids whose component has another name now
        again = before.join(renamed.where("new <> component"), "component").select("id", F.col("new").alias("component"))
        placed = components.unionByName(again)
        places = self.store.touched("members", placed)
        members = self.store.read("members", places, version).join(placed.select("id"), "id", "left_anti").unionByName(placed)
        return {
            "records": Change(records, buckets), "entities": Change(entities.unionByName(golden), buckets),
            "members": Change(members, places), "keys": Change(new_keys, self.store.touched("keys", new_keys), append=True),
        }


def _block_keys(records: DataFrame) -> DataFrame:
    """(kind, value, id, name_key, postal_code) of the keys that a record can meet others by.

    Records of one batch that have a key and a name in common, or a domain, merge: the least id has the key for all of them.
    """
    keys = F.array(
        F.struct(F.lit("domain").alias("kind"), F.col("domain").alias("value")),
        F.struct(F.lit("phone").alias("kind"), F.col("phone_key").alias("value")),
        F.struct(F.lit("street").alias("kind"), F.when(F.col("street") != "", F.concat_ws("|", "postal_code", "street")).alias("value")),
        F.struct(F.lit("postal").alias("kind"), F.col("postal_code").alias("value")),
    )
    by_domain = F.col("kind") == "domain"
    rows = records.select("id", "name_key", "postal_code", F.explode(keys).alias("k")).where("k.value <> ''").select("k.*", "id", "name_key", "postal_code")
    return (
        rows.where(by_domain | (F.col("name_key") != ""))
        .groupBy("kind", "value", F.when(~by_domain, F.col("name_key")).alias("name_key"), F.when(F.col("kind").isin("street", "postal"), F.col("postal_code")).alias("postal_code"))
        .agg(F.min("id").alias("id")).select("kind", "value", "id", "name_key", "postal_code")
    )


def _as_records(keys: DataFrame) -> DataFrame:
    """Rows of ``keys`` as records that hold just that key."""
    of = lambda kind, c, name: F.when(F.col("kind") == kind, c).alias(name)
    street = F.expr("substr(value, length(postal_code) + 2)")
    return keys.select(
        "id", "name_key", of("domain", F.col("value"), "domain"), of("phone", F.col("value"), "phone_key"), of("street", street, "street"),
        F.when(F.col("kind").isin("street", "postal"), F.col("postal_code")).alias("postal_code"), "kind",
    )
