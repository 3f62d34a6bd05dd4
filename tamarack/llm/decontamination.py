"""Benchmark decontamination by a broadcast hash set of test n-grams (operator 11).

Every window of ``n`` words of a benchmark item (the whole item, where it has fewer) is hashed. The hashes are broadcast
with the windows themselves; one narrow pass rolls over the words of every document, looks each window up and verifies a
hit byte by byte, so that two windows of one hash are never taken for each other. Hit words make spans, which
``decontaminate`` cuts out, or for which it drops the document.

The windows are counted before they are broadcast. Beyond ``MOST_BYTES`` a bitmap of fixed size takes their place:
windows that pass it meet those of the benchmark in a join, whose rows are put together by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tamarack.llm.common import release, table
from tamarack.llm.terms import HashSet, Terms, column_bytes, joined, terms_of
from tamarack.llm.words import mix
from tamarack.operators.storage import drop, written

WINDOW = 10
#: Bytes of windows, with 64 for each, up to which they are broadcast whole.
MOST_BYTES = 32 << 20
#: Bits of the bitmap that stands for more of them: 32 MB.
BITMAP = 28
_BASE = np.uint64(0x9E3779B97F4A7C15)

SPANS = ArrayType(StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())]))
OVERLAP = StructType([
    StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType())), StructField("spans", SPANS),
])


def rolled(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    n = max(0, len(hashes) - length + 1)
    out = hashes[:n].copy()
    for k in range(1, length):
        out *= _BASE
        out += hashes[k : n + k]
    return mix(out)


def benchmark_windows(items: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The distinct windows of every item: length, hash, window (its words, a space between two), item (id as text).

    Null texts and texts without words have none; items of a null id have windows with a null item.
    """
    source = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # an item is short
                column = batch.column(1).slice(i, 1)
                data, _ = column_bytes(column)
                parts = list(terms_of(column))
                hashes, start, length = (np.concatenate([getattr(p, f) for p in parts]) if parts else np.empty(0, dtype=np.int64) for f in ("hash", "start", "length"))
                if not len(hashes):
                    continue
                wide = min(n, len(hashes))
                found = rolled(hashes.astype(np.uint64), wide)
                text, begins = joined(data, start, length)
                ends = begins[wide - 1 :] + length[wide - 1 :]
                windows = {text[a:b].tobytes(): int(h) for a, b, h in zip(begins, ends, found.view(np.int64))}
                k = len(windows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([wide] * k, pa.int32()), pa.array(list(windows.values()), pa.int64()), pa.array(list(windows), pa.binary()), pa.array([batch.column(0)[i].as_py()] * k, pa.string())],
                    names=["length", "hash", "window", "item"],
                )

    return source.mapInArrow(run, "length int, hash long, window binary, item string").distinct()


class Known(NamedTuple):
    """What is broadcast: for each length of windows the set of their hashes, by place in it the windows, and the items
    of each; or, where they are too many, a bitmap for each length."""

    lengths: dict[int, tuple[HashSet, list[dict[bytes, list[str | None]]]]]
    bitmap: np.ndarray | None

    @property
    def longest(self) -> int:
        return max(self.lengths, default=1)


def _known(windows: DataFrame, most_bytes: int) -> Known:
    """``windows``: a written table of :func:`benchmark_windows`."""
    size = windows.agg(F.sum(F.length("window") + F.coalesce(F.length("item"), F.lit(0)) + 64).alias("s")).first()["s"] or 0
    if size > most_bytes:
        # OR-ed by Spark into words of 64 bits: 2 ** (BITMAP - 6) rows at most, whatever the benchmark holds
        slot = F.shiftrightunsigned("hash", 64 - BITMAP)
        bits = windows.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITMAP}) & 63 as int))")).alias("b"))
        got = bits.toArrow()
        bitmap = np.zeros(1 << (BITMAP - 6), dtype=np.uint64)
        bitmap[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
        return Known({int(r["length"]): None for r in windows.select("length").distinct().collect()}, bitmap)
    by: dict[int, dict[int, dict[bytes, list]]] = {}
    for r in windows.toArrow().to_pylist():
        by.setdefault(r["length"], {}).setdefault(r["hash"] & 0xFFFFFFFFFFFFFFFF, {}).setdefault(r["window"], []).append(r["item"])
    lengths = {}
    for length, found in by.items():
        hashes = HashSet.of(np.array(sorted(found), dtype=np.uint64))
        lengths[length] = (hashes, [found[int(h)] for h in hashes.hashes])
    return Known(lengths, None)


class Hit(NamedTuple):
    """A window of a document: row in the column, its words (first, behind the last) and bytes in the column's data."""

    row: int
    first: int
    behind: int
    begin: int
    end: int
    window: bytes


def _candidates(column: pa.Array, known: Known, counts: np.ndarray) -> Iterator[tuple[Hit, int, int]]:
    """Windows of the column whose hash is known, with that place in the set, or the hash; counts each row's words."""
    data, _ = column_bytes(column)
    before = Terms(*(np.empty(0, dtype=np.int64) for _ in range(4)), np.empty(0, dtype=np.uint64))
    for block in terms_of(column):
        np.add.at(counts, block.row, 1)
        # a long text comes in several blocks, which windows may cross
        kept = min(len(before.row), known.longest - 1)
        words = Terms(*(np.concatenate([b[len(b) - kept :], x]) for b, x in zip(before, block)))
        text = None
        for length in known.lengths:
            hashes = rolled(words.hash, length)
            if not len(hashes):
                continue
            last = np.arange(length - 1, length - 1 + len(hashes))
            whole = (words.row[last] == words.row[: len(hashes)]) & (last >= kept)
            if known.bitmap is None:
                at, place = known.lengths[length][0].find(hashes, whole)
            else:
                slot = hashes >> np.uint64(64 - BITMAP)
                at = np.flatnonzero(whole & ((known.bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool))
                place = hashes.view(np.int64)[at]
            if len(at) and text is None:
                text, begins = joined(data, words.start, words.length)
            for i, p in zip(at.tolist(), place.tolist()):
                j = i + length - 1
                window = text[begins[i] : begins[j] + words.length[j]].tobytes()
                yield Hit(int(words.row[i]), int(words.place[i]), int(words.place[j]) + 1, int(words.start[i]), int(words.start[j] + words.length[j]), window), length, p
        before = words


def _spans(hits: list[tuple[int, int, int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """Words hit, and the byte ranges of hits (first, behind, begin, end) that follow or overlap each other."""
    n, reach, spans = 0, -1, []
    for first, behind, begin, end in sorted(hits):
        n += max(0, behind - max(first, reach))
        if spans and first < reach:
            spans[-1] = (spans[-1][0], max(spans[-1][1], end))
        else:
            spans.append((begin, end))
        reach = max(reach, behind)
    return n, spans


def _characters(data: np.ndarray, begin: int, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Byte ranges as ranges of characters of the text that begins at ``begin``."""
    out, at, n = [], begin, 0
    for a, b in spans:
        n += int(np.count_nonzero((data[at:a] & 0xC0) != 0x80))
        wide = int(np.count_nonzero((data[a:b] & 0xC0) != 0x80))
        out.append({"begin": n, "end": n + wide})
        at, n = b, n + wide
    return out


def _without(data: np.ndarray, begin: int, end: int, spans: list[tuple[int, int]]) -> str:
    edges = [begin, *(x for s in spans for x in s), end]
    return b"".join(data[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])).decode("utf-8", "surrogatepass")


def free_name(columns: list[str], name: str) -> str:
    """``name`` with as many underscores behind it as it takes to be none of ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _scan(docs: DataFrame, known, name: str, text_col: str, cut: bool) -> DataFrame:
    """Narrow: the columns of ``docs`` (the text without its spans, if ``cut``) and the overlap."""
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(name, OVERLAP)])
    kind = pa.struct([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Known = known.value
        for batch in batches:
            column = batch.column(at)
            data, ends = column_bytes(column)
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            hits: dict[int, list] = {}
            items: dict[int, set] = {}
            for hit, length, place in _candidates(column, own, counts):
                of = own.lengths[length][1][place].get(hit.window)
                if of is not None:
                    hits.setdefault(hit.row, []).append(hit[1:5])
                    items.setdefault(hit.row, set()).update(i for i in of if i is not None)
            found, texts = [], {}
            for i, n in enumerate(counts.tolist()):
                words, spans = _spans(hits[i]) if i in hits else (0, [])
                found.append({"n_words": n, "n_hit": words, "items": sorted(items.get(i, ()), key=str.encode), "spans": _characters(data, int(ends[i]), spans)})
                if cut and spans:
                    texts[i] = _without(data, int(ends[i]), int(ends[i + 1]), spans)
            columns = list(batch.columns)
            if texts:
                columns[at] = pa.array([texts.get(i, v) for i, v in enumerate(column.to_pylist())], column.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=[*batch.schema.names, name])
        release()

    return docs.mapInArrow(run, schema)


def _met(docs: DataFrame, windows: DataFrame, known, text_col: str) -> DataFrame:
    """key (of a text), n_words, n_hit, items, spans, by joining the windows that pass the bitmap."""
    source = docs.select(F.sha2(F.col(text_col), 256).alias("key"), F.col(text_col).alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            data, ends = column_bytes(column)
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            rows = []
            for hit, length, hashed in _candidates(column, known.value, counts):
                begin = _characters(data, int(ends[hit.row]), [(hit.begin, hit.end)])[0]
                rows.append((hit.row, length, hashed, hit.window, hit.first, begin["begin"], begin["end"]))
                if len(rows) >= 20_000:
                    yield out(batch, rows)
                    rows = []
            if rows:
                yield out(batch, rows)

    def out(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        row, *rest = zip(*rows)
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(v, k) for v, k in zip(rest, kinds))], names=["key", "length", "hash", "window", "first", "begin", "end"])

    passed = source.mapInArrow(run, "key string, length int, hash long, window binary, first long, begin int, end int")
    hits = passed.join(windows, ["length", "hash", "window"])
    items = hits.where("item is not null").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    places = hits.select("key", "first", (F.col("first") + F.col("length")).alias("behind"), "begin", "end").distinct()
    rows = places.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "behind", "begin", "end"))).alias("h"))
    # hits in order: a span goes on while the next word range begins before it ends
    step = """
      CASE WHEN size(acc.spans) > 0 AND x.first < acc.reach
        THEN named_struct('n', acc.n + greatest(0L, x.behind - greatest(x.first, acc.reach)), 'reach', greatest(acc.reach, x.behind),
          'spans', concat(slice(acc.spans, 1, size(acc.spans) - 1), array(named_struct('begin', element_at(acc.spans, -1).begin, 'end', greatest(element_at(acc.spans, -1).end, x.end)))))
        ELSE named_struct('n', acc.n + x.behind - x.first, 'reach', x.behind, 'spans', concat(acc.spans, array(named_struct('begin', x.begin, 'end', x.end)))) END"""
    start = "named_struct('n', 0L, 'reach', -1L, 'spans', cast(array() as array<struct<begin:int,end:int>>))"
    merged = rows.select("key", F.expr(f"aggregate(h, {start}, (acc, x) -> {step})").alias("m"))
    return merged.select("key", F.col("m.n").alias("n_hit"), F.col("m.spans").alias("spans")).join(items, "key", "left")


def _cut_text(text: Column, spans: Column) -> Column:
    """``text`` without the ranges ``spans`` of its characters."""
    begin = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    end = F.concat(F.transform(spans, lambda s: s["begin"]), F.array(F.length(text)))
    return F.array_join(F.transform(F.arrays_zip(begin.alias("a"), end.alias("b")), lambda p: text.substr(p["a"] + 1, p["b"] - p["a"])), "")


def overlaps(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, name: str = "overlap", id_col: str = "item_id", text_col: str = "text", cut: bool = False, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """Every row of ``docs`` with its columns and ``overlap``: n_words, n_hit, items, spans.

    n_words counts the words of the text, n_hit those inside an occurrence of a window of the benchmark; ``items`` are
    the ids (as text, sorted, once each) of the items with such a window, ``spans`` the ranges of characters that are hit.
    With ``cut`` the text comes without them. Null and empty texts have no words; repeated rows and null ids give a row
    each. Items that share an id are one item; windows of items with a null id hit, but are not listed. An empty
    benchmark hits nothing, an empty table gives none. A column of the name ``overlap`` stays: the new one then gets an
    underscore. Texts of any length are read whole.
    """
    name = free_name(docs.columns, name)
    windows = written(benchmark_windows(benchmark, n, id_col, text_col), "windows")
    known = _known(windows, most_bytes)
    spread = docs.sparkSession.sparkContext.broadcast(known)  # windows of most_bytes at most, or a bitmap of 32 MB
    if known.bitmap is None:
        drop(windows)
        return _scan(docs, spread, name, text_col, cut)
    met = written(_met(docs, windows, spread, text_col), "met")
    drop(windows)
    key, n_words = free_name(docs.columns, "key"), F.size(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    both = docs.withColumn(key, F.sha2(F.col(text_col), 256)).join(met.select(F.col("key").alias(key), F.struct("n_hit", "items", "spans").alias(name)), key, "left")
    of = F.struct(
        n_words.cast("long").alias("n_words"), F.coalesce(f"{name}.n_hit", F.lit(0)).alias("n_hit"), F.coalesce(f"{name}.items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(f"{name}.spans", F.array().cast(SPANS)).alias("spans"),
    )
    text = F.when(F.col(name).isNull(), F.col(text_col)).otherwise(_cut_text(F.col(text_col), F.col(f"{name}.spans"))).alias(text_col)
    return both.select(*(text if cut and c == text_col else F.col(f"`{c}`") for c in docs.columns), of.alias(name))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", n: int = WINDOW, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with its columns, without what it shares with the benchmark: ``remove`` the "spans", or the "documents".

    Rows without a hit stay as they are; ``options`` are those of :func:`overlaps`, which says what it does with odd rows.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove spans or documents")
    name = free_name(docs.columns, "overlap")
    found = overlaps(docs, benchmark, n, name, text_col=text_col, cut=remove == "spans", **options)
    return (found if remove == "spans" else found.where(F.col(f"{name}.n_hit") == 0)).drop(name)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "overlap.n_words", "overlap.n_hit", F.size("overlap.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("overlap.items", ","), 256).alias("items_sha256"), (F.col("overlap.n_hit") > 0).alias("contaminated"),
    )


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS l, array_to_string(w[p : p + least(len(w), {WINDOW}) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, least(len(w), 1)) + 1)) AS p FROM b)),
lengths AS (SELECT DISTINCT l FROM windows),
own AS (
  SELECT r, l, p, array_to_string(w[p : p + l - 1], ' ') AS t
  FROM (SELECT r, l, w, unnest(range(1, len(w) - l + 2)) AS p FROM d, lengths)),
hits AS (SELECT own.r, own.l, own.p, item_id FROM own JOIN windows ON own.l = windows.l AND own.t = windows.t),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + l)) AS q FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
