"""Files whose records cross lines and blocks, against Spark's own readers of whole files."""

import json
import random

import pytest

from tamarack.sources import listings, splittable


@pytest.fixture(params=[40, 333, 1 << 20])
def blocks(spark, request):
    """Blocks of so many bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def cell(rnd):
    text = rnd.choice(["", "a", "Bar Sol", 'say ""hi""', "x;y", "two\nlines", "three\n\nlines\n", '""', "tail\n"])
    return f'"{text}"' if any(c in text for c in '\n";') or rnd.random() < 0.2 else text


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_csv(spark, tmp_path, blocks):
    rnd = random.Random(blocks)
    for name, n in (("a", 60), ("b", 1), ("c", 0)):
        body = "".join(";".join(cell(rnd) for _ in range(3)) + rnd.choice(["\n", "\r\n"]) for _ in range(n))
        (tmp_path / f"{name}.csv").write_text("﻿name;note;\"last one\"\n" + body + "end;of;file", encoding="utf-8", newline="")
    path = f"file://{tmp_path}/*.csv"
    got, want = splittable.read_csv(spark, path, ";"), listings.read_csv(spark, path, ";")
    assert got.columns == want.columns == ["name", "note", "last one"]
    assert rows(got) == rows(want) and got.count() > 50
    if blocks == 40:
        assert splittable._lines(spark, path).select("file", "block").distinct().count() > 10


def test_json(spark, tmp_path, blocks):
    rnd = random.Random(blocks)
    strings = ["a", "[", "}{", 'q"q', "back\\", '\\"', "é", "", "{[\"x\"]}"]
    for name, n in (("a", 50), ("b", 1), ("c", 0)):
        records = [{"name": rnd.choice(strings), "id": str(i), "more": {"l": [1, [2], {"k": rnd.choice(strings)}]}} for i in range(n)]
        (tmp_path / f"{name}.json").write_text(json.dumps(records, indent=rnd.choice([1, 4]), ensure_ascii=False) + "\n", encoding="utf-8")
    (tmp_path / "d.json").write_text('[\n{"id": "x1"}, {"id": "x2"},\n{"id":\n"x3"}\n]')
    (tmp_path / "e.json").write_text('[{"id": "y1"}, {"id": "y2"}]')
    path = f"file://{tmp_path}/*.json"
    got, want = splittable.read_json_array(spark, path, ["id", "name", "more"]), listings.read_json(spark, path, ["id", "name", "more"])
    squeeze = lambda df: sorted((r.id, r.name, json.dumps(json.loads(r.more)) if r.more else None) for r in df.collect() if r.id)
    assert squeeze(got) == squeeze(want) and got.count() == 56


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    """Line breaks within quotes all over a file: every core has blocks of it, and the records are whole."""
    with open(tmp_path / "big.csv", "w") as f:
        f.write("id,text\n")
        for i in range(60_000):
            f.write(f'{i},"first {i}\nsecond ""{i}""\nthird {"x" * (i % 90)}"\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(500_000))
    try:
        df = splittable.read_csv(spark, f"file://{tmp_path}/big.csv")
        assert splittable._lines(spark, f"file://{tmp_path}/big.csv").select("block").distinct().count() >= 8
        assert df.where("text = concat('first ', id, '\\nsecond \"', id, '\"\\nthird ', repeat('x', cast(id as int) % 90))").count() == 60_000 == df.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
