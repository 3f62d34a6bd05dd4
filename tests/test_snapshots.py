"""Versioned tables and the resolution of records batch by batch."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tamarack.operators.resolve import golden_records, merge_edges, resolve_batch, with_keys
from tamarack.operators.storage import new_path
from tamarack.sources.snapshots import Change, Conflict, Keyed, Snapshots
from tamarack.streaming.resolution import Resolver

T0 = datetime(2024, 3, 1, tzinfo=UTC)
TABLE = Keyed("id long, balance double, segment string, seq int", ("id",), 8)
RULES = {"balance": "greatest", "segment": "coalesce_old"}


@pytest.fixture
def store(spark):
    return Snapshots(spark, new_path(spark, "store"), {"t": TABLE})


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions_and_as_of(spark, store):
    assert store.read("t").collect() == [] and store.versions() == []
    first = spark.createDataFrame([(i, float(i), None, 0) for i in range(20)], TABLE.schema)
    assert store.replace("t", first, at=T0) == 1
    new = spark.createDataFrame([(3, 1.0, "a", 1), (3, 9.0, "b", 2), (99, 5.0, None, 1)], TABLE.schema)
    assert store.upsert("t", new, RULES, at=T0 + timedelta(days=1)) == 2
    now = {r.id: r for r in store.read("t").collect()}
    assert len(now) == 21 and tuple(now[3]) == (3, 9.0, "a", 2) and tuple(now[99]) == (99, 5.0, None, 1) and tuple(now[4]) == (4, 4.0, None, 0)
    assert rows(store.read("t", version=1)) == rows(first)
    assert rows(store.read("t", as_of=T0 + timedelta(hours=5))) == rows(first) and len(rows(store.read("t", as_of=T0 + timedelta(days=2)))) == 21
    assert store.read("t", as_of=T0 - timedelta(days=1)).collect() == []
    with pytest.raises(ValueError):
        store.manifest(7)


def test_only_touched_buckets_are_written_and_read(spark, store):
    store.replace("t", spark.range(200).selectExpr("id", "double(id) AS balance", "'s' AS segment", "0 AS seq"))
    before = store.manifest()["tables"]["t"]
    store.upsert("t", spark.createDataFrame([(5, 1e9, None, 1)], TABLE.schema), RULES)
    after = store.manifest()["tables"]["t"]
    assert len(before) == 8 and [b for b in before if before[b] != after[b]] == [str(store.touched("t", spark.createDataFrame([(5,)], "id long"))[0])]
    part = store.read("t", (0, 3))
    assert all(f"_bucket={b}/" in f for f in part.inputFiles() for b in [f.split("_bucket=")[1].split("/")[0]] if b in "03") and len({f.split("_bucket=")[1].split("/")[0] for f in part.inputFiles()}) == 2


def test_a_crash_before_the_swap_leaves_the_old_version(spark, store, monkeypatch):
    store.replace("t", spark.createDataFrame([(1, 1.0, "a", 0)], TABLE.schema))
    new = spark.createDataFrame([(1, 2.0, "b", 1), (2, 2.0, "b", 1)], TABLE.schema)

    def crash(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_swap", crash)
        with pytest.raises(OSError):
            store.upsert("t", new, RULES, batch=("s", 0))
    assert rows(store.read("t")) == [(1, 1.0, "a", 0)] and store.versions() == [1]
    assert store.upsert("t", new, RULES, batch=("s", 0)) == 2 and store.upsert("t", new, RULES, batch=("s", 0)) == 2
    assert rows(store.read("t")) == [(1, 2.0, "a", 1), (2, 2.0, "b", 1)]
    assert len(store.expire(1)) == 2  # what the crash left, and what only the first version named
    assert rows(store.read("t")) == [(1, 2.0, "a", 1), (2, 2.0, "b", 1)] and store.versions() == [2]


def test_two_writers_of_one_version(spark, store):
    one = spark.createDataFrame([(1, 1.0, "a", 0)], TABLE.schema)
    store.replace("t", one)
    assert store.commit({"t": Change(one.withColumn("balance", F.lit(7.0)))}, parent=1) == 2
    with pytest.raises(Conflict):
        store.commit({"t": Change(one.withColumn("balance", F.lit(8.0)))}, parent=1)
    assert rows(store.read("t")) == [(1, 7.0, "a", 0)]
    assert not [n for n in store._names("manifests") if n.startswith(".") and not n.endswith(".crc")]


def test_refresh_tells_what_went(spark, store):
    store.replace("t", spark.range(30).selectExpr("id", "1D AS balance", "'s' AS segment", "0 AS seq"))
    store.replace("t", spark.range(10, 40).selectExpr("id", "2D AS balance", "'s' AS segment", "0 AS seq"))
    assert rows(store.removed("t", 1, 2)) == [(i,) for i in range(10)] and rows(store.removed("t", 2, 2)) == []
    store.replace("t", spark.createDataFrame([], TABLE.schema))
    assert store.read("t").collect() == [] and store.removed("t", 2, 3).count() == 30


FIELDS = "id string, source string, retrieved_at timestamp, name string, website string, phone string, email string, address string, postal_code string, category string, category_confidence double"


def listings(n):
    """Records whose keys collide: chains through domains, telephone numbers, streets and names alike."""
    out = []
    for i in range(n):
        name = ["Clínica Alfa", "Clinica Alfa Dental", "Bufete Gómez", "Taller Mecánico Ruiz", "Panadería La Espiga"][i % 5] + (f" {i % 9}" if i % 4 else "")
        out.append((
            f"r{i * 7919 % 1009:04d}", f"s{i % 3}", T0.replace(tzinfo=None) + timedelta(minutes=i * 37 % 100), name, f"https://w{i % 17}.es/x" if i % 6 == 0 else None, f"95{i % 23:07d}" if i % 5 == 1 else None,
            None, f"Calle Mayor {i % 6}" if i % 3 else None, str(29000 + i % 4) if i % 8 else None, f"c{i % 4}", (i % 10) / 10,
        ))
    return out


def resolved(resolver):
    return rows(resolver.members()), sorted(map(str, resolver.entities().collect()))


def test_batches_in_any_number_give_what_one_gives(spark):
    records = listings(90)
    frame = lambda part: spark.createDataFrame(part, FIELDS)
    extra = "category string, category_confidence double"
    make = lambda: Resolver(spark, new_path(spark, "resolver"), extra, buckets=4)
    one, three = make(), make()
    one.apply(frame(records), 0)
    for i, part in enumerate((records[60:], records[:25], records[25:60] + records[:5])):
        three.apply(frame(part), i)
    assert resolved(one) == resolved(three)
    version = three.store.versions()[-1]
    assert three.apply(frame(records[25:60]), 2) == version  # a replay, known by its number
    three.apply(frame(records[:40]), 3)  # and one known by its ids
    assert resolved(one) == resolved(three)
    # against all pairs at once
    whole = resolve_batch(with_keys(frame(records)))
    members = rows(whole.select("id", "component"))
    assert rows(one.members()) == members
    assert 1 < len({c for _, c in members}) < 80
    golden = {r.component: r for r in golden_records(whole).collect()}
    got = {r.component: r for r in one.entities().collect()}
    assert got.keys() == golden.keys() and all(got[c].name == golden[c].name and got[c].n_records == golden[c].n_records and got[c].phone == golden[c].phone for c in got)


def test_a_crashed_batch_is_taken_in_once(spark, monkeypatch):
    records = spark.createDataFrame(listings(30), FIELDS)
    resolver = Resolver(spark, new_path(spark, "resolver"), "category string, category_confidence double", buckets=4)
    resolver.apply(records.where("source = 's0'"), 0)
    before = resolved(resolver)

    def crash(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_swap", crash)
        with pytest.raises(OSError):
            resolver.apply(records, 1)
    assert resolved(resolver) == before
    resolver.apply(records, 1)
    assert resolver.members().count() == 30 and resolver.entities().agg(F.sum("n_records")).first()[0] == 30


def test_suppressed_and_nameless_records(spark):
    suppression = spark.createDataFrame([("phone", "+34950000001"), ("email", "no@shop.es")], "kind string, value string")
    base = ("s", T0.replace(tzinfo=None), "Bar Uno", None, None, None, None, "29001", None, None)
    records = [("a", *base[:4], "950000001", *base[5:]), ("b", *base[:5], "no@shop.es", *base[6:]), ("c", *base), ("d", *base[:2], " ", *base[3:]), (None, *base)]
    resolver = Resolver(spark, new_path(spark, "resolver"), "category string, category_confidence double", suppression, buckets=2)
    resolver.apply(spark.createDataFrame(records, FIELDS), 0)
    assert rows(resolver.members()) == [("c", "c")]
    resolver.apply(spark.createDataFrame([], FIELDS), 1)
    assert rows(resolver.members()) == [("c", "c")]


def test_records_without_a_website_of_their_own_do_not_meet_by_it(spark):
    base = ("s", T0.replace(tzinfo=None))
    sites = [None, "", "no host", "https://www.facebook.com/a", "https://facebook.com/b", "https://own.es/1", "http://www.own.es"]
    records = [(f"r{i}", *base, f"{'abcdefg'[i] * 9} {i}", w, None, None, None, None, None, None) for i, w in enumerate(sites)]
    found = resolve_batch(with_keys(spark.createDataFrame(records, FIELDS)))
    assert rows(found.select("id", "component")) == [("r0", "r0"), ("r1", "r1"), ("r2", "r2"), ("r3", "r3"), ("r4", "r4"), ("r5", "r5"), ("r6", "r5")]


def test_copies_are_one_node_and_one_key(spark, monkeypatch):
    """Records with the same keys take one place in the graph and one in each list of a key, however many they are."""
    from tamarack.operators.components import connected_components
    from tamarack.streaming import resolution

    links = []

    def counted(edges):
        links.append(edges.count())
        return connected_components(edges)

    monkeypatch.setattr(resolution, "connected_components", counted)
    at = T0.replace(tzinfo=None)
    # three kinds of copies, and records that equal keys don't merge: without any, and of a phone but no name of their own
    kinds = [("Bar Uno", "https://uno.es", "950000001", "Calle A 1", "29001"), ("Bar Dos", None, "950000002", None, "29002"), ("Bar Tres", "https://uno.es", None, "Calle B 1", None),
             ("Bar Solo", None, None, "Calle C 1", None), ("--", None, "950000004", None, "29004")]
    records = [(f"r{i:04d}", "s", at, n, w, p, None, a, c, None, None) for i, (n, w, p, a, c) in ((i, kinds[i % 5]) for i in range(600))]
    resolver = Resolver(spark, new_path(spark, "resolver"), "category string, category_confidence double", buckets=2)
    for batch_id, part in ((0, records[:400]), (1, records[400:])):
        resolver.apply(spark.createDataFrame(part, FIELDS), batch_id)
    assert len(links) == 2 and max(links) < 10
    assert resolver.store.read("keys").count() <= 2 * 8
    whole = resolve_batch(with_keys(spark.createDataFrame(records, FIELDS)))
    assert rows(resolver.members()) == rows(whole.select("id", "component"))
    assert sorted(r.n_records for r in resolver.entities().collect()) == [1] * 240 + [120, 240]


def test_cross_edges_and_own_edges_are_all_edges(spark):
    keyed = with_keys(spark.createDataFrame(listings(60), FIELDS))
    from tamarack.operators.components import connected_components
    from tamarack.operators.resolve import cross_edges

    new, old = keyed.where("id < 'r0500'"), keyed.where("id >= 'r0500'")
    parts = merge_edges(new).unionByName(merge_edges(old)).unionByName(cross_edges(new, old))
    assert rows(connected_components(parts)) == rows(connected_components(merge_edges(keyed)))


def test_counters_merge_in_any_order(spark):
    """Late rows update their day, a batch counts once, and windows come close to exact distinct numbers."""
    from tamarack.streaming import counters

    events = spark.range(6_000).selectExpr("id", "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 9 as int)) AS ts", "concat('k', id % 2) AS event_type", "(id * 7919) % 1500 AS user_id", "double(id % 5) AS value")
    kept = counters.Counters(spark, new_path(spark, "counters"), buckets=4)
    for batch_id, part in ((0, "id >= 4000"), (1, "id < 1000"), (1, "id < 1000"), (2, "id BETWEEN 1000 AND 3999")):
        kept(events.where(part), batch_id)
    plain = counters.daily(events)
    assert rows(kept.days().select("day", "kind", "n", "total")) == rows(plain.select("day", "kind", "n", "total"))
    sketch = F.hll_sketch_estimate("who").alias("d")
    assert rows(kept.days().select("day", "kind", sketch)) == rows(plain.select("day", "kind", sketch))
    for first, last in (("2024-01-02", "2024-01-04"), ("2023-01-01", "2025-01-01")):
        exact = {r.event_type: r.d for r in events.where(f"to_date(ts) BETWEEN '{first}' AND '{last}'").groupBy("event_type").agg(F.count_distinct("user_id").alias("d")).collect()}
        for r in counters.over(kept.days(), first, last).collect():
            assert abs(r["distinct"] - exact[r.kind]) <= 4 * 1.04 / 2 ** (counters.LOG_K / 2) * exact[r.kind]
