"""Very many terms looked for at once: an Aho-Corasick automaton over Arrow batches.

The expressions of ``classify`` and ``geo`` ask for one term after the other, which suits the hundreds of terms of a taxonomy.
With an automaton a text is read once, however many terms there are. The terms are counted; up to ``MOST_BYTES`` they are
broadcast whole, beyond that in blocks, each a pass of its own, and the best of all blocks counts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from tamarack.functions.text import normalize_text
from tamarack.operators.storage import drop, written

#: Bytes of terms, with 100 for each, of one broadcast.
MOST_BYTES = 64 << 20
MATCH = StructType([StructField("term", StringType()), StructField("category", StringType()), StructField("many", BooleanType()), StructField("place", LongType())])
_ARROW = pa.struct([("term", pa.string()), ("category", pa.string()), ("many", pa.bool_()), ("place", pa.int64())])


_built: dict[str, object] = {}


def _automaton(key: str, spread):
    """The automaton of a broadcast, built once in a worker; the last few are kept."""
    import ahocorasick

    if key in _built:
        return _built[key]
    found = ahocorasick.Automaton()
    for place, term, category in spread.value:
        many = " " in term
        wanted = term if many else f" {term} "
        best = found.get(wanted, None)
        if best is None or place < best[1]:
            found.add_word(wanted, (-len(term), place, term, category, many))
    if len(found):
        found.make_automaton()
    while len(_built) >= 2:
        _built.pop(next(iter(_built)))
    _built[key] = found
    return found


def longest_matches(rows: DataFrame, texts: list[str], terms: DataFrame, name: str = "matches", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``rows`` with the array ``name``: for each of the columns ``texts`` (normalised) its longest term, or null.

    terms: (place, term, category), terms normalised; of equally long ones the least place counts, of one place the first
    term by its letters. A term of one word matches a whole word, one of several words matches anywhere. Null texts match
    nothing, nor do empty terms. Narrow.
    """
    known = written(terms.select(F.col("place").cast("long").alias("place"), "term", "category").where("term <> ''"), "terms")
    size = known.agg(F.coalesce(F.sum(F.octet_length("term") + 100), F.lit(0)).alias("s")).first()["s"]
    blocks = max(1, math.ceil(size / most_bytes))
    columns = [f"{name}_{b}" for b in range(blocks)]
    out = rows
    for b, column in enumerate(columns):
        part = known.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b) if blocks > 1 else known
        spread = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])  # about most_bytes
        out = _matched(out, texts, spread, column)
    drop(known)
    # of all blocks the longest term of each text, of equal ones the one of the least place, then by its letters
    order = lambda m: F.struct((-F.length(m["term"])).alias("k"), m["place"].alias("p"), m["term"].alias("t"))
    better = lambda a, b: F.when(a.isNull() | (b.isNotNull() & (order(b) < order(a))), b).otherwise(a)
    best = F.col(columns[0])
    for column in columns[1:]:
        best = F.zip_with(best, F.col(column), better)
    return out.select(*rows.columns, best.alias(name))


def _matched(rows: DataFrame, texts: list[str], spread, column: str) -> DataFrame:
    schema = StructType([*rows.schema.fields, StructField(column, ArrayType(MATCH))])
    at, key = [rows.columns.index(t) for t in texts], uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, spread)
        for batch in batches:
            found = [[_longest(automaton, t) for t in row] for row in zip(*(batch.column(i).to_pylist() for i in at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(_ARROW))], names=[*batch.schema.names, column])

    return rows.mapInArrow(run, schema)


def _longest(automaton, text: str | None) -> dict | None:
    if not text or not len(automaton):
        return None
    best = min((hit for _, hit in automaton.iter(f" {text} ")), default=None, key=lambda h: h[:3])
    return best and {"term": best[2], "category": best[3], "many": best[4], "place": best[1]}


def classify_rows(rows: DataFrame, category_text: Column, name: Column, terms: DataFrame, out: str = "classified", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``rows`` with the struct ``out``: category, confidence and term as ``classify.classify`` gives them, for any number of terms."""
    asked = rows.withColumns({"_category_text": normalize_text(category_text), "_name": normalize_text(name)})
    found = longest_matches(asked, ["_category_text", "_name"], terms, "_matches", most_bytes)
    result = lambda m, many, one: F.struct(m["category"].alias("category"), F.when(m["many"], many).otherwise(one).alias("confidence"), m["term"].alias("term"))
    first, second = F.get("_matches", F.lit(0)), F.get("_matches", F.lit(1))
    none = F.struct(F.lit("other").alias("category"), F.lit(0.2).alias("confidence"), F.lit(None).cast("string").alias("term"))
    kind = F.when(first.isNotNull(), result(first, 0.95, 0.85)).when(second.isNotNull(), result(second, 0.70, 0.55)).otherwise(none)
    return found.select(*rows.columns, kind.alias(out))
