"""Exports, snapshots and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.operators.storage import new_path


def guarded(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula: what begins with = + - @ tab or CR gets a quote."""
    return F.when(c.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def export_rows(df: DataFrame) -> DataFrame:
    """Columns as an export shows them: arrays joined by ' | ', doubles rounded to integers, strings guarded."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "array<string>":
            c = guarded(F.concat_ws(" | ", c))
        elif kind == "string":
            c = guarded(c)
        elif kind in ("double", "float"):
            c = F.floor(c + 0.5).cast("long")
        out.append(c.alias(name))
    return df.select(*out)


#: The columns of an exported shortlist, in order.
SHORTLIST = (
    "name", "category", "opportunity", "business_quality", "commercial_value", "digital_opportunity", "phone", "email", "website", "website_verdict",
    "rating", "review_count", "address", "postal_code", "city", "crm_status", "top_reasons", "prospect_id", "indexed_at",
)
MARK = "\ufeff"


def shortlist_rows(df: DataFrame) -> DataFrame:
    """The columns SHORTLIST of ``df`` as an export shows them; those that it lacks are empty. Ratings keep their decimals."""
    kinds = dict(df.dtypes)
    cells = [F.col(c).cast("string") if c == "rating" and c in kinds else F.col(c) if c in kinds else F.lit(None).cast("string") for c in SHORTLIST]
    return export_rows(df.select(*(v.alias(c) for c, v in zip(SHORTLIST, cells))))


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """Rows as an export shows them, with a header, CRLF and, with ``mark``, a byte order mark at the head of each file."""
    out = export_rows(df)
    if mark and out.columns:
        out = out.withColumnRenamed(out.columns[0], MARK + out.columns[0])
    out.write.option("header", True).option("lineSep", "\r\n").option("escape", '"').option("emptyValue", "").csv(path)


def append_timeline(rows: DataFrame, path: str, day: str = "day") -> None:
    """Rows are added, never changed; files are kept by day."""
    rows.write.mode("append").partitionBy(day).parquet(path)


def write_snapshot(df: DataFrame, root: str | None = None, name: str = "snapshot") -> str:
    """Write a whole new snapshot beside the old ones and return its path; readers move when they are told."""
    path = new_path(df.sparkSession, name) if root is None else f"{root.rstrip('/')}/{name}"
    df.write.mode("errorifexists").parquet(path)
    return path
