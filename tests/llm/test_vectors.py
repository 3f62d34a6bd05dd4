import numpy as np
import pytest

from tamarack.llm import vectors as V
from tamarack.llm.common import table


def brute(rows):
    """rows: (id, unit or None) -> {id: (n_links, component)} with distinct ids."""
    ids = [i for i, u in rows if u is not None]
    x = np.stack([u for _, u in rows if u is not None])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        after = np.array([min(label[i], label[near[i]].min()) if near[i].any() else label[i] for i in range(len(ids))])
        if (after == label).all():
            break
        label = after
    out = {i: (int(n), int(c)) for i, n, c in zip(ids, near.sum(axis=1), label)}
    return out | {i: (0, i) for i, u in rows if u is None}


def planted(seed=0, n=900, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for a in range(0, 120):
        x[a] = x[0] + rng.normal(size=dim) * 0.05  # one large group of near copies
    for a in range(200, 400, 2):
        x[a + 1] = x[a] + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.3])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(spark, x, **options):
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in V.near_duplicates(docs, **options).collect()}
    want = brute(list(enumerate(x)))
    true = sum(n for n, _ in want.values())
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= want[i][0] for i in want)
    return found / true, sum(got[i].component_id == want[i][1] for i in want) / len(want), got


def test_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 150)
    recall, same, got = compare(spark, planted())
    assert recall > 0.97 and same > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_crowded_shards_are_exact(spark, monkeypatch):
    monkeypatch.setattr(V, "MAX_SHARD", 64)
    monkeypatch.setattr(V, "SHARD", 10_000)
    recall, same, _ = compare(spark, planted(1, 400))
    assert recall == 1 and same == 1


def test_large_shards_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(V, "MAX_CENTROIDS", 4)
    monkeypatch.setattr(V, "PARTS", 4)
    monkeypatch.setattr(V, "SHARD", 60)
    monkeypatch.setattr(V, "MAX_SHARD", 150)
    monkeypatch.setattr(V, "SALT_ROWS", 100)
    monkeypatch.setattr(V, "ROWS", 37)
    dealt = []
    real = V.deal_again
    monkeypatch.setattr(V, "deal_again", lambda *a: dealt.append(1) or real(*a))
    recall, same, got = compare(spark, planted(5))
    assert len(dealt) >= 2 and recall > 0.95 and same > 0.97
    assert all(r.recall >= V.TARGET for r in got.values())


def test_shards_that_cannot_be_parted_are_compared_exactly(spark, monkeypatch):
    monkeypatch.setattr(V, "MAX_CENTROIDS", 4)
    monkeypatch.setattr(V, "PARTS", 4)
    monkeypatch.setattr(V, "SHARD", 40)
    monkeypatch.setattr(V, "MAX_SHARD", 64)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1, 12)) + rng.normal(size=(400, 12)) * 0.02  # all within reach of each other
    recall, same, _ = compare(spark, x / np.linalg.norm(x, axis=1, keepdims=True))
    assert recall > 0.97 and same == 1


def sparse_links(n=900, dim=24):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    x[:300] = x[0]  # equal copies, found by construction
    x[401:441:2] = x[400:440:2] + rng.normal(size=(20, dim)) * 0.01
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_lost_links_are_found_by_the_audit(spark, monkeypatch):
    real, exacts = V.linked, []

    def lossy(nodes, count, threshold, overlap, exact=False):
        exacts.append(exact)
        if exact:
            return real(nodes, count, threshold, overlap, exact)
        return real(nodes, count, threshold, overlap).selectExpr("node", "0L AS n", "0L AS m", "node AS root")

    monkeypatch.setattr(V, "linked", lossy)
    monkeypatch.setattr(V, "SHARD", 30)  # 21 shards: overlaps of 2 and 4, then all pairs
    recall, same, _ = compare(spark, sparse_links())
    assert recall == 1 and same == 1 and exacts == [False, False, True]


def test_audit_draws_until_links_are_seen(spark, monkeypatch):
    x = np.unique(sparse_links(), axis=0)
    nodes = spark.createDataFrame([(i, v.astype("<f8").tobytes(), 1) for i, v in enumerate(x)], "node long, unit binary, copies long")
    totals = V.linked(nodes, len(x), exact=True).groupBy("node").agg(V.F.sum("m").alias("m"))
    monkeypatch.setattr(V, "BLOCK", 20)
    monkeypatch.setattr(V, "LINKED", 10)
    recall, seen, drawn = V.audit(nodes, len(x), totals)
    assert recall == 1 and 10 <= seen <= 40 and drawn < len(x)
    assert V.audit(nodes, len(x), totals.where("m < 0"))[0] == 0
    assert V.audit(nodes, len(x), totals, 1.1) == (1.0, 0, len(x))  # all drawn: there are no links
    monkeypatch.setattr(V, "MAX_AUDITED", 40)
    monkeypatch.setattr(V, "LINKED", 1000)
    assert V.audit(nodes, len(x), totals, 1.1)[0] is None
    with pytest.raises(RuntimeError, match="allow_unproven"):
        compare(spark, sparse_links())
    with np.testing.assert_warns(RuntimeWarning):
        compare(spark, sparse_links(), allow_unproven=True)


def test_skewed_clusters_go_through_the_graph(spark):
    """12,000 vectors in clusters of very unequal sizes: shards are dealt until their graphs are searched."""
    rng = np.random.default_rng(12)
    sizes = 1 / np.arange(1, 61)
    own = rng.choice(60, size=12_000, p=sizes / sizes.sum())
    x = rng.normal(size=(60, 32))[own] + rng.normal(size=(12_000, 32)) * 0.6
    x[1::40] = x[::40] + rng.normal(size=(300, 32)) * 0.03
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, v.astype("<f8").tobytes(), 1) for i, v in enumerate(x)], "node long, unit binary, copies long")
    members, crowded = V._dealt(nodes, len(x), V.OVERLAP, False)
    inside = members.join(crowded.select("shard"), "shard", "left_semi").count()
    assert members.groupBy("shard").count().agg({"count": "max"}).first()[0] <= V.MAX_SHARD or inside < 0.05 * members.count()
    assert inside < 0.05 * members.count()
    recall, same, got = compare(spark, x)
    assert recall >= 0.95 and same > 0.97 and {r.recall for r in got.values()}.pop() >= 0.95


def test_vectors_of_several_lengths_and_ids_of_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.01]), (4, [0.0, 1.0, 0.0]), (5, [0.0, 1.0, 0.01]), (4, [0.0, 1.0]), (6, [1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r)[:4] for r in V.near_duplicates(docs).collect())
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (4, 1, 4, True), (5, 1, 4, False), (4, 0, 4, True), (6, 0, 6, True)])
    with pytest.raises(ValueError):
        V.near_duplicates(spark.createDataFrame([(i, [1.0] * (i + 1)) for i in range(70)], docs.schema))


def test_query(spark, sf_dir):
    rows = [(r.vec_id, np.array(r.embedding) / np.linalg.norm(r.embedding)) for r in table(spark, sf_dir, "embeddings").collect()]
    assert {r.vec_id: (r.n_links, r.component_id) for r in V.op8_vectors(spark, sf_dir).collect()} == brute(rows)


def test_cases(spark):
    a, b = [1.0, 2.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, a), (3, a), (3, a), (9, [2.0, 4.0, 0.0]), (1, None), (2, [0.0, 0.0, 0.0]), (4, [float("nan"), 1.0, 1.0]), (6, [None, 1.0, 1.0]), (7, b), (None, a), (8, [])]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, n int")
    rows = V.near_duplicates(docs).collect()
    got = sorted((tuple(r)[:4] for r in rows), key=str)
    assert {r.recall for r in rows} == {1.0}  # one distinct pair of directions, without a link between them, both drawn
    assert got == sorted(
        [(5, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (9, 3, 3, False), (7, 0, 7, True), (None, 0, None, False)]
        + [(i, 0, i, True) for i in (1, 2, 4, 6, 8)],
        key=str,
    )
    assert V.near_duplicates(docs.limit(0)).count() == 0
    assert V.near_duplicates(docs.where("vec_id = 1")).count() == 1
