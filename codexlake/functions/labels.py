"""Labels, marks and number formats of answers, as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plural labels of entity types, and marks of verdicts and of citation statuses.
TYPE_LABELS = {"person": "People", "place": "Places", "event": "Events", "concept": "Concepts", "work": "Works", "organization": "Organizations", "species": "Species", "artifact": "Artifacts", "other": "Other"}
VERDICT_MARKS = {"corroborated": "✓", "uncertain": "?", "contradicted": "✗"}
STATUS_MARKS = {"verified": "✓", "ambiguous": "~", "not_found": "", "unchecked": ""}


def looked_up(key: Column, labels: dict[str, str]) -> Column:
    """The label of a key; null for a key without one."""
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in labels.items())), key)


def fixed(number: Column, decimals: int) -> Column:
    """A number with so many decimals and no thousands separators; null for null."""
    return F.when(number.isNotNull(), F.format_string(f"%.{decimals}f", number.cast("double")))


def percent(share: Column, decimals: int = 0) -> Column:
    return F.concat(fixed(share * 100, decimals), F.lit("%"))
