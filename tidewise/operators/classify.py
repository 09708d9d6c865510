"""Totals by class label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_totals(rows: DataFrame, label: Column, length: Column | None = None) -> DataFrame:
    """(class, n, metres)."""
    return rows.groupBy(label.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(length if length is not None else F.lit(0.0)), 3).alias("metres"))
