"""What several operators share: tables, text batches, tokenizer files."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A vocabulary file: in ``folder``, else where the public_tokenizers package has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def release() -> None:
    """Give back what a worker's allocators hold; for the end of a task, as workers are used again."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


@contextmanager
def without_gc() -> Iterator[None]:
    """No cycle collection inside: for loops that make many small objects and no cycles among them."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def map_texts(
    docs: DataFrame, fn: Callable[[list, list], dict], schema: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Narrow Arrow pass: ``fn(ids, texts)`` gives the columns of ``schema`` for each batch.

    A null text reaches ``fn`` as None. Batches are cut so that one holds at most about 4 MB
    of text besides a single longer document.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out_schema = pa_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with without_gc():
            for ids, texts in text_batches(batches):
                yield pa.RecordBatch.from_pydict(fn(ids, texts), schema=out_schema)
        release()

    return source.mapInArrow(run, schema)


def pa_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def text_batches(batches: Iterator[pa.RecordBatch], limit: int = 4_000_000) -> Iterator[tuple[list, list]]:
    """Ids and texts of (id, text) record batches, in pieces of bounded text size."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        begin = size = 0
        part: list = []
        for i in range(len(ids)):
            text = texts[i].as_py()
            part.append(text)
            size += len(text) if text else 0
            if size >= limit:
                yield ids[begin : i + 1], part
                begin, size, part = i + 1, 0, []
        if part:
            yield ids[begin:], part
