"""Hashes that key caches and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evidence_hash(*names: str) -> Column:
    """sha256 of the columns as JSON with sorted keys; a null column leaves its key out."""
    return F.sha2(F.to_json(F.struct(*(F.col(n) for n in sorted(names)))), 256)


def cache_key(provider, stage, entity, model, prompt_version, audit_version, evidence) -> Column:
    """sha256 of provider|stage|id|model|p<version>|a<version>|evidence hash."""
    parts = [F.lit(p) if isinstance(p, (str, int)) else p for p in (provider, stage, entity, model)]
    p, a = (F.concat(F.lit(x), (v if isinstance(v, Column) else F.lit(v)).cast("string")) for x, v in (("p", prompt_version), ("a", audit_version)))
    return F.sha2(F.concat_ws("|", *(c.cast("string") for c in parts), p, a, evidence), 256)


def stable_id(df: DataFrame, explicit: str | None = None) -> Column:
    """The explicit id where there is one, else a hash of the row: equal rows have equal ids."""
    whole = F.sha2(F.to_json(F.struct(*(F.col(f"`{n}`") for n in sorted(df.columns)))), 256)
    return whole if explicit is None else F.coalesce(F.nullif(F.trim(F.col(explicit).cast("string")), F.lit("")), whole)
