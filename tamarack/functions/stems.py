"""Stems of Spanish words, as column expressions over arrays of words.

The rules are those of the published Snowball stemmer for Spanish, over words without diacritics (see ``normalize_text``):
endings are cut where they lie in the regions RV, R1 and R2 of a word. Each step is one ``transform`` over the array, so
that expressions stay as long as there are steps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of the stemmer's steps, without diacritics.
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
BEFORE_PRONOUN = "ando iendo ar er ir".split()
IN_R2 = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
IC_BEFORE = "adora ador acion adoras adores aciones ante antes ancia ancias".split()
LOG, U, ENTE = "logia logias".split(), "ucion uciones".split(), "encia encias".split()
IDAD, IVO = "idad idades".split(), "iva ivo ivas ivos".split()
Y_VERBS = "ya ye yan yen yeron yendo yo yas yes yais yamos".split()
GU_VERBS = "en es eis emos".split()
VERBS = (
    "aremos eremos iremos aba ada ida ara iera ad ed id ase iese aste iste an aban aran ieran asen iesen aron ieron ado ido ando iendo ar er ir as "
    "abas adas idas aras ieras ases ieses abais arais ierais aseis ieseis asteis isteis ados idos amos imos"
).split()
RESIDUAL = "os a o e".split()


def _end(word: Column, endings: list[str]) -> Column:
    """The longest of ``endings`` that ``word`` has, else ''."""
    return F.regexp_extract(word, f"({'|'.join(endings)})$", 1)


def _cut(word: Column, n: Column | int) -> Column:
    return word.substr(F.lit(1), F.length(word) - n)


def _last(word: Column, n: Column) -> Column:
    """The last ``n`` letters."""
    return F.when(n > 0, word.substr(F.length(word) - n + 1, n)).otherwise("")


def spanish_stems(words: Column) -> Column:
    """An array of words (a-z0-9) to the array of their stems, place by place."""

    def marked(w: Column) -> Column:
        """With where RV, R1 and R2 begin."""
        rv = F.coalesce(
            *(F.nullif(F.regexp_extract(w, p, 1), F.lit("")) for p in ("^.[^aeiou].*?[aeiou](.*)$", "^[aeiou][aeiou].*?[^aeiou](.*)$", "^[^aeiou][aeiou].(.*)$")), F.lit("")
        )
        r1 = F.regexp_extract(w, "^.*?[aeiou][^aeiou](.*)$", 1)
        r2 = F.regexp_extract(r1, "^.*?[aeiou][^aeiou](.*)$", 1)
        n = F.length(w)
        return F.struct(w.alias("w"), (n - F.length(rv)).alias("v"), (n - F.length(r1)).alias("p1"), (n - F.length(r2)).alias("p2"))

    def stepped(x: Column, word: Column, done: Column | None = None) -> Column:
        return F.struct(word.alias("w"), x["v"].alias("v"), x["p1"].alias("p1"), x["p2"].alias("p2"), (F.lit(False) if done is None else done).alias("done"))

    def pronoun(x: Column) -> Column:
        w, n = x["w"], F.length(x["w"])
        end = _end(w, PRONOUNS)
        left = _cut(w, F.length(end))
        in_rv = F.length(left) >= x["v"]
        verb = _end(F.when(in_rv, left.substr(x["v"] + 1, n)).otherwise(""), BEFORE_PRONOUN)
        yendo = F.when(in_rv, left.rlike("uyendo$") & (F.length(left) - 5 >= x["v"])).otherwise(False)
        return stepped(x, F.when((end != "") & ((verb != "") | yendo), left).otherwise(w))

    def standard(x: Column) -> Column:
        """One ending of nouns, adjectives and adverbs, and what may stand before it."""
        w, n = x["w"], F.length(x["w"])
        r1, r2 = n - x["p1"], n - x["p2"]
        end = _end(w, [*IN_R2, *IC_BEFORE, *LOG, *U, *ENTE, "amente", "mente", *IDAD, *IVO])
        k = F.length(end)
        left, fits = _cut(w, k), k <= r2

        def before(pattern: str) -> Column:
            """``left`` without what stands before the ending, where that lies in R2 too."""
            more = F.length(F.regexp_extract(left, f"({pattern})$", 1))
            return F.when((more > 0) & (k + more <= r2), _cut(left, more)).otherwise(left)

        iv = before("iv")
        amente = F.when(iv != left, F.when(iv.endswith("at") & (k + 4 <= r2), _cut(iv, 2)).otherwise(iv)).otherwise(before("os|ic|ad"))
        out = (
            F.when(end == "", None).when(end == "amente", F.when(k <= r1, amente)).when(~fits, None).when(end.isin(*IN_R2), left).when(end.isin(*IC_BEFORE), before("ic"))
            .when(end.isin(*LOG), F.concat(left, F.lit("log"))).when(end.isin(*U), F.concat(left, F.lit("u"))).when(end.isin(*ENTE), F.concat(left, F.lit("ente")))
            .when(end == "mente", before("ante|able|ible")).when(end.isin(*IDAD), before("abil|ic|iv")).otherwise(before("at"))
        )
        return stepped(x, F.coalesce(out, w), out.isNotNull())

    def verb(x: Column) -> Column:
        """Endings of verbs, where no other ending went; the longest that lies in RV."""
        w, n = x["w"], F.length(x["w"])
        rv = F.when(n > x["v"], w.substr(x["v"] + 1, n)).otherwise("")
        y, other = _end(rv, Y_VERBS), _end(rv, [*GU_VERBS, *VERBS])
        y_left, left = _cut(w, F.length(y)), _cut(w, F.length(other))
        gu = F.when(other.isin(*GU_VERBS) & left.endswith("gu"), _cut(left, 1)).otherwise(left)
        return stepped(x, F.when(x["done"], w).when((y != "") & y_left.endswith("u"), y_left).otherwise(gu))

    def residual(x: Column) -> Column:
        w, n = x["w"], F.length(x["w"])
        end = _end(F.when(n > x["v"], w.substr(x["v"] + 1, n)).otherwise(""), RESIDUAL)
        left = _cut(w, F.length(end))
        return F.when((end == "e") & left.endswith("gu") & (F.length(left) > x["v"]), _cut(left, 1)).otherwise(left)

    steps = F.transform(words, marked)
    for step in (pronoun, standard, verb):
        steps = F.transform(steps, step)
    return F.transform(steps, residual)
