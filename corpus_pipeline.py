"""A corpus from documents to packed sequences, one stage after the other.

Each stage reads what the one before wrote. The first four keep the columns of ``documents``, and any more that there
are, whatever their names; the last returns the pieces of the packed sequences. An empty table gives an empty one at
every stage. Each stage says what it does with null and empty texts, null and repeated doc_ids; texts of any length are
read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm.common import table
from tamarack.llm.language import filter_languages
from tamarack.llm.line_dedup import dedup_lines
from tamarack.llm.packing import pack
from tamarack.llm.simhash import deduplicate
from tamarack.llm.toxicity import filter_toxic
from tamarack.operators.storage import written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 7, fitted on these documents' labels, doesn't predict toxic.

    Each row by its own text; null and empty texts are as a text without any feature, which isn't toxic where clean
    texts prevail. Rows with a null or repeated doc_id are no exception.
    """
    return filter_toxic(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 10, fitted on these documents, doesn't reject: null and empty texts and those without a
    letter go; each row by its own text, whatever its doc_id."""
    return filter_languages(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that operator 2 finds in an earlier place; n_chars follows the text.

    No row goes: a text of which every line is repeated is empty afterwards. Null texts stay null; rows with a null
    doc_id stay as they are; equal rows of one doc_id are cut alike.
    """
    cut = dedup_lines(docs)
    if "n_chars" in docs.columns:
        cut = cut.selectExpr(*("CASE WHEN _n_removed > 0 THEN CAST(length(text) AS BIGINT) ELSE n_chars END AS n_chars" if c == "n_chars" else c for c in docs.columns))
    return cut.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group that operator 3 links, with its three-word shingles and two bits.

    Null and empty texts are one group; rows with a null doc_id stay; of rows that share a doc_id one stays, the same
    each time.
    """
    return deduplicate(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that operator 5 packs. Null and empty texts are the end id alone; null and repeated
    doc_ids are documents of their own."""
    return pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]
#: Tokenizers, trees and centroids have no SQL; tests compare the stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
