"""Scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def consensus(notes: Column) -> Column:
    """1 less 0.3 for each high and 0.1 for each medium disagreement, from whole tenths."""
    def many(severity: str) -> Column:
        return F.size(F.filter(F.coalesce(notes, F.array()), lambda n: n["severity"] == severity))

    return F.greatest(F.lit(0), 10 - 3 * many("high") - many("medium")) / F.lit(10.0)


def entropy_proxy(samples: Column, distinct: Column) -> Column:
    """0 for one sample, else the share of further answers among further samples."""
    return F.when(samples <= 1, F.lit(0.0)).otherwise(clamp01((distinct - 1) / (samples - 1)))


def share(condition: Column) -> Column:
    """Aggregate: the share of rows that meet the condition, 0 of none."""
    return F.coalesce(F.avg(F.when(condition, 1.0).otherwise(0.0)), F.lit(0.0))


def author_named(author: Column, families: Column) -> Column:
    """Whether a family name of more than two letters stands in the claimed author."""
    return F.coalesce(F.exists(families, lambda f: (F.length(f) > 2) & F.contains(F.lower(author), F.lower(f))), F.lit(False))


def tone(score: Column) -> Column:
    return F.when(score >= 0.85, "High").when(score >= 0.6, "Medium").otherwise("Low")


def reciprocal_rank(rank: Column, constant: int = 60) -> Column:
    return F.lit(1.0).cast("double") / (F.lit(constant) + rank)
