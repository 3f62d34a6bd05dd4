import zlib
from array import array
from collections import defaultdict

from tokenizers import Tokenizer

import corpus_pipeline as P
from tamarack.llm.common import table, tokenizer_path
from tamarack.llm.packing import TOKENIZER
from tests_llm_plain import brute_components, brute_lines, plain_fingerprint

SF = "/root/testdata/sf0.01"


def test_stages_against_plain_versions(spark):
    docs = table(spark, SF, "documents")
    columns, stages = docs.columns, dict(P.STAGES)
    truth = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    before = {r.doc_id: r for r in docs.collect()}

    clean = P.written(stages["toxicity"](spark, docs, SF), "t")
    left = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == columns and all(before[i] == r for i, r in left.items())
    gone = set(before) - set(left)
    assert sum(truth.get(i, 0) for i in gone) > 0.5 * sum(truth.values())
    assert sum(1 for i in gone if truth.get(i) == 0) <= 0.02 * len(before)

    spoken = P.written(stages["language"](spark, clean, SF), "l")
    assert spoken.columns == columns and set(spoken.collect()) == set(clean.collect())

    cut = P.written(stages["lines"](spark, spoken, SF), "c")
    want = brute_lines([(r.doc_id, r.text) for r in spoken.collect()])
    rows = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == columns and {i: r.text for i, r in rows.items()} == {i: w[0] for i, w in want.items()}
    assert all(r.n_chars == len(r.text) for i, r in rows.items() if want[i][2])

    single = P.written(stages["near_duplicates"](spark, cut, SF), "s")
    comp = brute_components({i: plain_fingerprint(r.text) for i, r in rows.items()})
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {i for i, c in comp.items() if i == c}

    library = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    pieces = defaultdict(list)
    for r in stages["packing"](spark, single, SF).collect():
        pieces[r.doc_id].append(r)
    for r in single.collect():
        ids, at = array("I", [*library.encode(r.text, add_special_tokens=False).ids, 1]).tobytes(), 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)])
            at += p.length
        assert 4 * at == len(ids)


def odd_documents(spark):
    """Rows of the small table with nulls in every column, empty and very long texts, repeats, and clashing extra columns."""
    docs = table(spark, SF, "documents").where("doc_id < 150")
    long = "une phrase qui revient sans cesse et qui ne finit pas " * 6_000
    rows = [
        (None, None, None, None, None), (9_001, None, "fr", "a", 0), (9_002, "", "fr", "a", 0), (9_003, "  \n\n ", None, None, 4), (9_004, long, "fr", "a", len(long)),
        (9_005, long + "\nautre ligne ici", "fr", None, None), (None, "une phrase qui revient sans cesse", None, "b", 33), (9_006, "12345 !!! 678", None, None, 13),
        (9_007, "the same row comes again here", "en", "a", 29), (9_007, "the same row comes again here", "en", "a", 29), (9_007, "another text with the same number", "en", "a", 33),
    ]
    odd = docs.unionByName(spark.createDataFrame(rows, docs.schema)).repartition(3)
    for name in ("row", "score", "vector", "cut", "_keep", "_n_lines_", "ids", "id", "pos", "lost"):
        odd = odd.withColumn(name, odd["source"])
    return odd


def test_stages_on_odd_documents(spark):
    odd = P.written(odd_documents(spark), "odd")
    key = lambda r: (str(r.doc_id), r.text or "", str(r.source))
    before = sorted(map(key, odd.collect()))
    out = {}
    for name, stage in P.STAGES[:-1]:
        done = stage(spark, odd, SF)
        assert done.columns == odd.columns, name
        out[name] = sorted(map(key, done.collect()))
        assert sorted(map(key, stage(spark, odd, SF).collect())) == out[name], f"{name} isn't the same twice"
        assert stage(spark, odd.limit(0), SF).count() == 0
    # toxicity and language take rows away and change none; the odd ones: null and empty texts aren't toxic, and have no language
    for name in ("toxicity", "language"):
        left = list(before)
        for r in out[name]:
            left.remove(r)
    ids = lambda name: {i for i, _, _ in out[name]}
    assert {"9001", "9002", "9003", "9004", "9007", "None"} <= ids("toxicity")
    assert not {"9001", "9002", "9003", "9006"} & ids("language") and {"9004", "9007"} <= ids("language")
    # lines: every row stays; of the long line its second place goes
    assert len(out["lines"]) == len(before) and any(i == "9005" and t == "autre ligne ici" for i, t, _ in out["lines"])
    assert sum(i == "9007" for i, _, _ in out["lines"]) == 3
    # near duplicates: null ids stay, texts without words are one group, a repeated id is one row
    singles = out["near_duplicates"]
    assert sum(i == "None" for i, _, _ in singles) == 2 and sum(i == "9007" for i, _, _ in singles) == 1
    assert sum(i in ("9001", "9002", "9003") for i, _, _ in singles) <= 1
    pieces = P.STAGES[-1][1](spark, odd, SF)
    assert sum(r.length for r in pieces.where("doc_id = 9001").collect()) == 1 and pieces.where("doc_id is null").count() >= 2
    assert P.STAGES[-1][1](spark, odd.limit(0), SF).count() == 0


def test_run_is_its_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in P.STAGES:
        docs = P.written(stage(spark, docs, sf_dir), name)
    key = lambda r: (r.doc_id, r.start)
    got = {key(r): (r.length, r.ids_crc32, r.doc_tokens) for r in P.run(spark, sf_dir).collect()}
    assert {k[0] for k in got} == {r.doc_id for r in docs.collect()}
    assert sum(v[0] for v in got.values()) == sum(r.length for r in docs.collect())
