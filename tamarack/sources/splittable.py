"""Large CSV and JSON files whose records cross lines, read by all cores.

Spark's readers take such a file whole, in one task. Here its lines are read in blocks, as of any text. A first pass counts,
for each block, what carries over to the next: whether a quote stays open (CSV), how many brackets do (JSON; a string never
crosses a line there). Summed up in the order of blocks this is the state in which each begins. A second pass cuts
records; those that cross blocks come in pieces, a few to a block, which are put together by their place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Blocks of all files whose states are broadcast, about 100 bytes each; with blocks of 128 MB these are 250 TB.
MOST_BLOCKS = 2_000_000
_PIECE = "file string, block long, at int, kind string, first boolean, record string"
_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]')

Cutter = Callable[[int], Callable[[str], Iterator[tuple[str, bool]]]]


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, value: lines in the order of each block; a block is what one task reads of a file in one go."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _records(lines: DataFrame, carried: Column, opened: Column, cut: Cutter) -> DataFrame:
    """file, first (of its file), record. ``carried`` is what a line adds to the state, ``opened`` the state from the sum of
    what was carried before; ``cut(state)`` takes the lines of a block and gives pieces of text, each with whether a record
    ends with it; what remains open is asked for by an empty call at the block's end."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lines.groupBy("file", "block").agg(F.sum(carried).alias("s"))
    states = sums.select("file", "block", opened(F.coalesce(F.sum("s").over(before), F.lit(0))).cast("int").alias("state"))
    if sums.count() > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} blocks; raise spark.sql.files.maxPartitionBytes")
    placed = lines.join(F.broadcast(states), ["file", "block"])  # counted; a hash join keeps the lines' order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step, held, inside, n = None, None, [], False, 0

        def piece(kind: str) -> tuple:
            return (now[0], now[1], n, kind, now[1] == 0 and n == 0, "\n".join(held))

        for batch in batches:
            out = []
            for file, block, line, state in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (file, block):
                    if held:
                        out.append(piece("through" if inside else "tail"))
                    now, step, held, inside, n = (file, block), cut(state), [], state > 0 and state != cut.rest, 0
                for part, ends in step(line):
                    held.append(part)
                    if ends:
                        out.append(piece("head" if inside else "whole"))
                        held, inside, n = [], False, n + 1
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out) if out else [[]] * 6, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string()))], names=["file", "block", "at", "kind", "first", "record"])
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "at", "kind", "first", "record"), piece("through" if inside else "tail")))], schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int32()), ("kind", pa.string()), ("first", pa.bool_()), ("record", pa.string())]))

    pieces = placed.select("file", "block", "value", "state").mapInArrow(run, _PIECE)
    whole = pieces.where("kind = 'whole'").select("file", "first", "record")
    # pieces of a file in order: a tail begins a record, what follows goes on with it
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == "tail")
    chained = pieces.where("kind <> 'whole'").withColumn("chain", F.count_if(F.col("kind") == "tail").over(order))
    own = chained.groupBy("file", "chain").agg(F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("block", (F.col("kind") == "tail").alias("t"), "record"))).alias("p"))
    return whole.unionByName(own.select("file", "first", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record")))


class _Csv:
    """Records end with a line in which no quote stays open."""

    rest = 0

    def __call__(self, state: int) -> Callable[[str], Iterator[tuple[str, bool]]]:
        open_ = state

        def step(line: str) -> Iterator[tuple[str, bool]]:
            nonlocal open_
            open_ ^= line.count('"') & 1
            yield line, not open_

        return step


class _Json:
    """Records are the objects of one array: they begin and end where one bracket is open."""

    rest = 1

    def __call__(self, state: int) -> Callable[[str], Iterator[tuple[str, bool]]]:
        depth = state

        def step(line: str) -> Iterator[tuple[str, bool]]:
            nonlocal depth
            begin = 0 if depth > 1 else None
            for m in _TOKENS.finditer(line):
                c = m.group()
                if c in "[{":
                    if depth == 1:
                        begin = m.start()
                    depth += 1
                elif c in "]}":
                    depth -= 1
                    if depth == 1 and begin is not None:
                        yield line[begin : m.end()], True
                        begin = None
            if begin is not None:
                yield line[begin:], False

        return step


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """Rows of CSV files as strings, as ``listings.read_csv`` gives them, but by blocks.

    Quotes may hold line breaks and doubled quotes. Every file begins with the header of the first by name; a byte order
    mark is dropped, cells are trimmed, rows without any value go.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    records = _records(_lines(spark, path), quotes, lambda s: s % 2, _Csv())
    # a line may end in a carriage return; the last line feed of a file has nothing behind it
    records = records.withColumn("record", F.regexp_replace(F.regexp_replace("record", "\r$", ""), "^﻿", ""))
    header = records.where("first").orderBy("file").select("record").limit(1).collect()
    if not header:
        return spark.createDataFrame([], "value string").select()
    options = {"sep": sep, "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    sized = F.size(F.split(F.regexp_replace(F.lit(header[0]["record"]), '"([^"]|"")*"', ""), re.escape(sep)))
    width = spark.range(1).select(sized).first()[0]
    ddl = ", ".join(f"c{i} string" for i in range(width))
    names = spark.range(1).select(F.from_csv(F.lit(header[0]["record"]), ddl, options).alias("r")).select("r.*").first()
    rows = records.where("NOT first AND record <> ''").select(F.from_csv("record", ddl, options).alias("r")).select("r.*")
    return rows.toDF(*(v if v is not None else f"_c{i}" for i, v in enumerate(names))).dropna("all")


def read_json_array(spark: SparkSession, path: str | list[str], fields: list[str]) -> DataFrame:
    """The objects of files that hold one array each, by blocks; ``fields`` as strings.

    An array that stands on one line is one record to Spark and read by one task. Files that hold an object around the array
    are for ``listings.read_json``.
    """
    bare = F.regexp_replace(F.regexp_replace("value", r"\\.", ""), '"[^"]*"', "")
    count = lambda chars: F.length(F.regexp_replace(bare, f"[^{chars}]", ""))
    records = _records(_lines(spark, path), count(r"\[{") - count(r"\]}"), lambda s: s, _Json())
    schema = ", ".join(f"`{f}` string" for f in fields)
    return records.select(F.from_json("record", schema).alias("r")).select("r.*")
