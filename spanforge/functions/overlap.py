"""Interval arithmetic on half-open character spans [start, end)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_chars(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared characters of two spans of one document; touching spans share none."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2)).cast("long")


def overlap_score(mode: str, shared: Column, chunk_len: Column, truth_len: Column) -> Column:
    """coverage: of the truth; precision: of the chunk; iou: of both. 0 where the base is empty."""
    base = {"coverage": truth_len, "precision": chunk_len, "iou": chunk_len + truth_len - shared}[mode]
    return F.coalesce(F.try_divide(shared.cast("double"), F.nullif(base, F.lit(0))), F.lit(0.0))
