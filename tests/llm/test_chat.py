import duckdb

from tamarack.llm import chat as C


def rendered(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def test_query_against_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        path = f"/root/testdata/{sf}"
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/conversations.parquet')")
        want = sorted(con.execute(C.OP1_SQL).fetchall())
        assert sorted(map(tuple, C.op1_chat_snapshots(spark, path).collect())) == want


def test_cases(spark):
    convs = {
        1: [("user", "a")], 2: [("user", "a"), ("bot", "b")], 3: [("user", "a"), ("bot", "b"), ("user", "c")],
        4: [("user", "a"), ("bot", "b"), ("user", "c")], 5: [("user", "b"), ("bot", "b")], 6: [(None, None)],
        7: [("user", "a"), ("bot", "x" * 200_000)], 8: [("user", "a")],
    }
    rows = [(i, k, r, t, 0) for i, turns in convs.items() for k, (r, t) in enumerate(turns)] + [(None, 0, "user", "a", 0), (1, 0, "user", "a", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    got = {r.conv_id: r for r in C.collapse_and_render(turns).collect()}
    assert {i: (r.n_turns, r.n_copies, r.n_collapsed) for i, r in got.items()} == {
        3: (3, 2, 3), 5: (2, 1, 0), 6: (1, 1, 0), 7: (2, 1, 2)
    }
    assert all(r.rendered == rendered(convs[i]) for i, r in got.items())
    assert C.collapse_and_render(turns.limit(0)).count() == 0
