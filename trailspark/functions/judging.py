"""Thresholds and confidences of judgments (FP13, FP14, AG17). A missing probability stays unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def verdict(p: Column, yes: float = 0.8, no: float = 0.2) -> Column:
    if not 0 <= no < yes <= 1:
        raise ValueError("thresholds must be 0 <= no < yes <= 1")
    return F.when(p.isNull(), "unanswered").when(p >= yes, "yes").when(p <= no, "no").otherwise("unsure")


def band(p: Column, low: float = 0.35, high: float = 0.7) -> Column:
    return F.when(p >= high, "high").when(p < low, "low").when(p.isNotNull(), "middle")


def choice_confidence(probabilities: Column) -> Column:
    """(n max - 1) / (n - 1) of an array; 1 for fewer than two options."""
    n = F.size(probabilities).cast("double")
    return F.when(n < 2, F.lit(1.0)).otherwise((n * F.array_max(probabilities) - 1.0) / (n - 1.0))
