import math
import zlib

import pytest
from pyspark.sql import functions as F

from tamarack.llm import toxicity as T
from tamarack.llm.common import table

SF = "/root/testdata/sf0.1"


def auc(pairs):
    pairs = sorted(pairs)
    rank, i, total, pos = 0.0, 0, 0.0, sum(y for _, y in pairs)
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            j += 1
        total += sum(y for _, y in pairs[i:j]) * (i + 1 + j) / 2
        i = j
    return (total - pos * (pos + 1) / 2) / (pos * (len(pairs) - pos))


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in T.op7_toxicity(spark, SF).collect()}


def test_held_out_quality(spark, scored):
    truth = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(scored[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in scored)
    found = auc([(scored[i].score, truth[i]) for i in held])
    hit = sum(scored[i].predicted for i in held if truth[i]) / sum(truth[i] for i in held)
    false = sum(scored[i].predicted for i in held if not truth[i]) / sum(1 - truth[i] for i in held)
    print(found, hit, false)
    assert found > 0.9 and false < 0.01


def test_features():
    reader = T.Reader({"w:idiot": 3.0, "p:lowe": 2.0})
    of = lambda t: dict(zip(T.FEATURES, reader.features(t)))
    assert of(None) == of("") == dict.fromkeys(T.FEATURES, 0.0)
    assert of("you IDIOT!")["near_second_person"] == 0.5 and of("you IDIOT!")["hit_density"] == 0.5
    assert of("an 1d1ot here")["hidden_hits"] > 0 and of("so lowerx")["best_weight"] == 2.0
    assert of("i.d.i.o.t")["obfuscated"] == 1.0 and of("HI THERE")["capital_tokens"] == 1.0


def plain_features(text, lexicon):
    """The same numbers, one token after the other."""
    text = text or ""
    words = text.split()
    tokens = text.lower().split()
    n = len(tokens)
    if not n:
        return [0.0] * len(T.FEATURES)
    size = len(text.encode())

    def weight(word):
        keys = ["w:" + word] + ["p:" + word[:k] for k in T.PREFIXES if len(word) >= k]
        return max(lexicon.get(k, 0.0) for k in keys) if len(word) >= 3 else 0.0

    def of(token):
        plain, behind = T.cores(token)
        return weight(plain) or weight(behind), not weight(plain) and weight(behind) > 0, plain in T.SECOND_PERSON, bool(T._INSIDE.search(token))

    found = [of(t) for t in tokens]
    hits = [i for i, f in enumerate(found) if f[0]]
    persons = [i for i, f in enumerate(found) if f[2]]
    total = sum(f[0] for f in found)
    count = lambda chars: sum(text.count(c) for c in chars) / size
    return [
        math.log1p(n), len(hits) / n, math.log1p(len(hits)), len({tokens[i] for i in hits}), max(f[0] for f in found), total / n,
        sum(f[1] for f in found) / n, sum(any(abs(i - j) <= T.NEAR_TOKENS for j in persons) for i in hits) / n, len(persons) / n,
        sum(c.isupper() for c in text) / size, sum(w.isupper() for w in words) / n, count("!"), count("?"), count("#$%&*@^|"),
        count("0123456789"), sum(f[3] for f in found) / n, size / n, 1 - len(set(tokens)) / n,
    ]


def test_features_against_a_plain_version(spark):
    lexicon = {"w:idiot": 3.0, "p:lowe": 2.0, "w:the": 1.0, "p:sto": 0.5, "p:ver": 1.5}
    odd = [None, "", " \n", "É ÀB you 1d1ot idiot's TÚ", "IDIOT " * 2000 + "you", "x" * 5000, "@lowe! sto sto you?? ÉÉ"]
    texts = odd + [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").limit(150).collect()]
    reader = T.Reader(lexicon, limit=50)
    for text in texts:
        assert reader.features(text) == pytest.approx(plain_features(text, lexicon), rel=1e-9, abs=1e-12), text


def test_rows_of_one_id_go_by_their_own_text(spark):
    texts = [("idiot " if i % 2 == 0 else "fine ") + "so it goes on" for i in range(80)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(500, "idiot so it goes on", 1), (500, "fine so it goes on", 2), (None, "idiot it goes", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, vector int").withColumn("row", F.lit("x")).withColumn("raw", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id long, toxic int")
    left = T.filter_toxic(docs, labels)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or -1, r.vector) for r in left.collect()) == sorted([(i, i) for i in range(1, 80, 2)] + [(500, 2)])


def test_cases(spark):
    texts = [("idiot " if i % 2 == 0 else "fine ") + " ".join(["a day out", "", "x y", "so it goes on"][i // 2 % 4].split()) for i in range(80)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(900, None, 1), (None, "", 1), (901, "x", 1), (901, "x", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(80)] + [(3, None, 0), (None, 1, 0)], "doc_id long, toxic int, text int")
    got = T.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == 1 - r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 80)
    kept = T.filter_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 44
    assert {r.score for r in T.score(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert T.score(docs.limit(0), labels).count() == 0
