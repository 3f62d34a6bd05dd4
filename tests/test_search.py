"""The index at rest and searches over it, and the Spanish stemmer, each against a plain version."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tamarack.functions.stems import spanish_stems
from tamarack.operators import postings
from tamarack.operators.search import STOP_WORDS
from tamarack.operators.storage import new_path

# a plain Snowball stemmer for words without diacritics, letter by letter
VOWELS = "aeiou"


def region(word, start=0):
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def rv_of(w):
    if len(w) < 3:
        return len(w)
    if w[1] not in VOWELS:
        return next((i + 1 for i in range(2, len(w)) if w[i] in VOWELS), len(w))
    if w[0] in VOWELS:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in VOWELS), len(w))
    return 3


def longest(w, endings, start=0):
    return max((e for e in endings.split() if w.endswith(e) and len(w) - len(e) >= start), key=len, default="")


def plain_stem(w):
    v, p1 = rv_of(w), region(w)
    p2 = region(w, p1) if p1 < len(w) else len(w)
    e = longest(w, "me se sela selo selas selos la le lo las les los nos")
    if e:
        left = w[: -len(e)]
        if any(left.endswith(b) and len(left) - len(b) >= v for b in ("ando", "iendo", "ar", "er", "ir")) or (left.endswith("uyendo") and len(left) - 5 >= v):
            w = left
    done, r1, r2 = None, len(w) - p1, len(w) - p2
    groups = {
        "del": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos",
        "ic": "adora ador acion adoras adores aciones ante antes ancia ancias", "log": "logia logias", "u": "ucion uciones", "ente": "encia encias", "amente": "amente", "mente": "mente",
        "idad": "idad idades", "ivo": "iva ivo ivas ivos",
    }
    e = longest(w, " ".join(groups.values()))
    if e:
        kind = next(k for k, v_ in groups.items() if e in v_.split())
        left, k = w[: -len(e)], len(e)

        def less(*ends):
            for x in sorted(ends, key=len, reverse=True):
                if left.endswith(x):
                    return left[: -len(x)] if k + len(x) <= r2 else left
            return left

        if kind == "amente":
            if k <= r1:
                done = less("iv")
                if done != left:
                    done = done[:-2] if done.endswith("at") and k + 4 <= r2 else done
                else:
                    done = less("os", "ic", "ad")
        elif k <= r2:
            done = {"del": lambda: left, "ic": lambda: less("ic"), "log": lambda: left + "log", "u": lambda: left + "u", "ente": lambda: left + "ente", "mente": lambda: less("ante", "able", "ible"), "idad": lambda: less("abil", "ic", "iv"), "ivo": lambda: less("at")}[kind]()
    if done is not None:
        w = done
    else:
        y = longest(w, "ya ye yan yen yeron yendo yo yas yes yais yamos", v)
        if y and w[: -len(y)].endswith("u"):
            w = w[: -len(y)]
        else:
            verbs = "aremos eremos iremos aba ada ida ara iera ad ed id ase iese aste iste an aban aran ieran asen iesen aron ieron ado ido ando iendo ar er ir as abas adas idas aras ieras ases ieses abais arais ierais aseis ieseis asteis isteis ados idos amos imos"
            e = longest(w, "en es eis emos " + verbs, v)
            if e:
                w = w[: -len(e)]
                if e in ("en", "es", "eis", "emos") and w.endswith("gu"):
                    w = w[:-1]
    e = longest(w, "os a o e", v)
    if e:
        w = w[: -len(e)]
        if e == "e" and w.endswith("gu") and len(w) > v:
            w = w[:-1]
    return w


FAMILIES = {
    "dental": "dental dentales", "clinic": "clinica clinicas clinico", "abog": "abogado abogada abogados abogadas", "fontaner": "fontanero fontaneria fontaneros", "cas": "casa casas",
    "peluqu": "peluque peluques", "rap": "rapamente", "implant": "implante implantes implantar implantando", "restaur": "restaurante restaurantes restaurar", "econom": "economico economica economicos",
    "constru": "construyendo construyeron", "activ": "activamente actividad activo activas", "tecnolog": "tecnologia tecnologias", "solu": "solucion soluciones", "frecuent": "frecuencia frecuente frecuencias",
    "pag": "pagar pague pagues paguemos", "compr": "comprarlo comprandolas comprar compramos", "facil": "facilidad facilidades", "odontolog": "odontologia odontologo", "sol": "sol", "y": "y",
}


def test_word_families(spark):
    words = [w for family in FAMILIES.values() for w in family.split()]
    (row,) = spark.createDataFrame([(words,)], "w array<string>").select(spanish_stems(F.col("w")).alias("s")).collect()
    got = dict(zip(words, row.s))
    assert {w: plain_stem(w) for w in words} == got
    for family in ("dental", "clinic", "abog", "cas", "implant", "econom", "activ", "tecnolog", "solu", "pag", "facil"):
        assert len({got[w] for w in FAMILIES[family].split()}) == 1, family


def test_stems_of_made_up_words(spark):
    rnd = random.Random(4)
    endings = "amente ativamente idad abilidad icidad ivo ativas acion icacion ucion logia encia osos imiento ando iendolas uyendo arlos iria guen gue yeron amos ases o e a os s es mente ablemente ible".split()
    words = ["".join(rnd.choice("aeioubcdglmnrstuyv") for _ in range(rnd.randrange(0, 7))) + rnd.choice(endings) for _ in range(3_000)]
    words += ["".join(rnd.choice("aeioulmnrstd") for _ in range(rnd.randrange(1, 9))) for _ in range(1_000)] + ["", "a", "b", "29001", "la", "gue"]
    (row,) = spark.createDataFrame([(words,)], "w array<string>").select(spanish_stems(F.col("w")).alias("s")).collect()
    assert [(w, plain_stem(w)) for w in words] == list(zip(words, row.s))


def grams(text):
    return {f"  {w} "[i : i + 3] for w in text.split() for i in range(len(w) + 1)}


def plain_rank(places):
    """The text rank from the positions of each lexeme."""
    if len(places) == 1:
        return sum(0.1 / j**2 for j in range(1, len(places[0]) + 1)) / 1.64493406685
    missed = 1.0
    for i, own in enumerate(places):
        for other in places[:i]:
            for a in own:
                for b in other:
                    d = abs(a - b)
                    missed *= 1 - 0.1 * math.sqrt(1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
    return 1 - missed


def plain_search(docs, queries, k, stem):
    norm = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    out = []
    for q, text, category in queries:
        text = norm(text)
        asked = {stem(w) for w in text.split() if w not in STOP_WORDS}
        rows = []
        for i, name, cat, opportunity, reviews, location, body in docs:
            if opportunity is None or opportunity < 45 or location is None or location < 0.7:
                continue
            places = {}
            for p, w in enumerate(norm(body).split(), 1):
                if w not in STOP_WORDS:
                    places.setdefault(stem(w), []).append(p)
            a, b = grams(text), grams(norm(name))
            ranks = [len(a & b) / len(a | b)] if a and len(a & b) >= 0.3 * len(a | b) else []
            ranks += [0.35] if text == "" else [plain_rank([places[s] for s in sorted(asked)])] if asked and asked <= places.keys() else []
            ranks += [0.6] if category is not None and category == cat else []
            if ranks:
                rows.append((-opportunity, -round(max(ranks), 9), reviews is None, -(reviews or 0), i))
        out += [(q, r, x[4], -x[1]) for r, x in enumerate(sorted(rows)[:k], 1)]
    return out


@pytest.mark.parametrize("stems, plain, first", [(spanish_stems, plain_stem, 30), (spanish_stems, plain_stem, 10_000), (None, None, 200)])
def test_search_against_plain(spark, stems, plain, first):
    rnd = random.Random(9)
    words = "clinica dental dentales implantes bar taller mecanico mecanica abogados la de casa casas rapida reparacion reparaciones sonrisa centro".split()
    docs = []
    for i in range(1_000):
        name = " ".join(rnd.choices(words, k=rnd.randrange(1, 4)))
        body = name + " " + " ".join(rnd.choices(words, k=rnd.choice([0, 3, 150])))
        docs.append((i, name.title(), rnd.choice(["bar", "dental", None]), rnd.choice([None, 40.0, 45.0, *range(50, 95)]), rnd.choice([None, 3, 200, rnd.randrange(999)]), rnd.choice([None, 0.5, 0.7, 0.9, 1.0]), body))
    docs = [(*d[:3], None if d[3] is None else float(d[3]), *d[4:]) for d in docs]
    queries = [(1, "Clínica dental", None), (2, "reparar casa", None), (3, "", None), (4, "", "bar"), (5, "la de", None), (6, "dentales", "dental"), (7, "mecanica taller sonrisa", None), (8, "!!", "none"), (9, "xyz", None), (10, "implanets", None)]
    queries = [(q, t.replace("í", "i"), c) for q, t, c in queries]
    table = spark.createDataFrame(docs, "id long, name string, category string, opportunity double, reviews int, location_confidence double, body string")
    options = {"stems": stems} if stems else {}
    built = postings.build_index(table, F.col("body"), new_path(spark, "index"), first_tier=first, buckets=4, **options)
    index = postings.open_index(spark, built.root)
    assert index.bounds == built.bounds and (len(index.tiers) > 1) == (first < 1_000)
    found = postings.search(spark.createDataFrame(queries, "query_id int, query string, category string"), index, 10, **options)
    got = sorted((r.query_id, r.rank, r.id, round(r.relevance, 9)) for r in found.collect())

    def light(w):
        w = re.sub("(es|s)$", "", w) if len(w) > 4 else w
        return re.sub("[aeo]$", "", w) if len(w) > 4 else w

    want = plain_search(docs, queries, 10, plain or light)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-7 for g, w in zip(got, want))
    assert len({q for q, *_ in got}) >= 7


def test_a_search_reads_the_buckets_of_its_terms_alone(spark):
    table = spark.range(500).selectExpr("id", "concat('word', id % 50, ' shop') AS name", "concat('c', id % 5) AS category", "50D + id % 40 AS opportunity", "id AS reviews", "0.9D AS location_confidence")
    index = postings.build_index(table, F.col("name"), new_path(spark, "index"), first_tier=100, buckets=8)
    scans = index.postings.where((F.col("tier") == 0) & F.col("bucket").isin([3])).where(F.col("term").isin(["x"]))
    plan = scans._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*tier[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)
    # one query that the first tier answers: the second isn't looked at
    seen = []
    tier = postings._search_tier
    try:
        postings._search_tier = lambda *a: seen.append(a[2]) or tier(*a)
        rows = postings.search(spark.createDataFrame([(1, "shop", None)], "query_id int, query string, category string"), index, 5).collect()
    finally:
        postings._search_tier = tier
    assert seen == [0] and [r.opportunity for r in rows] == [89.0] * 5


def test_no_queries_and_no_documents(spark):
    table = spark.createDataFrame([], "id long, name string, category string, opportunity double, reviews int, location_confidence double")
    index = postings.build_index(table.unionByName(spark.createDataFrame([(1, "a", None, 80.0, None, 1.0)], table.schema)), F.col("name"), new_path(spark, "index"))
    asked = spark.createDataFrame([(1, "a", None), (2, "", None)], "query_id int, query string, category string")
    assert postings.search(asked.limit(0), index, 5).collect() == []
    none = postings.open_index(spark, postings.build_index(table, F.col("name"), new_path(spark, "index")).root)
    assert postings.search(asked, none, 5).collect() == []


def test_postings_of_a_row_are_those_of_a_shuffle(spark, tmp_path):
    rows = [(1, "red bolt the red ring", 3.0), (2, "", 2.0), (3, "bolts of bolt", 1.0), (4, "the of", 4.0), (5, "ring " * 70 + "bolt", 5.0)]
    df = spark.createDataFrame(rows, "id long, name string, opportunity double").selectExpr("*", "'c' AS category", "1 AS reviews", "0.9D AS location_confidence")
    made = []
    for words in (0, 3, 64, 100):
        index = postings.build_index(df, F.col("name"), f"file://{tmp_path}/{words}", row_words=words)
        made.append(sorted((r.kind, r.term, r.id, r.positions) for r in index.postings.where("kind = 't'").collect()))
    assert made[0] and made[0] == made[1] == made[2] == made[3]
    assert ("t", "bolt", 5, [71]) in made[2]
