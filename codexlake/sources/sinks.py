"""Answers as JSON text that always carries its caveat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The note that goes with every answer.
CAVEAT = "Entries were written by models and may be wrong; check them against other sources."


def answers(rows: DataFrame, pretty: bool = False) -> DataFrame:
    """(json), one document for each row, the caveat first."""
    return rows.select(F.to_json(F.struct(F.lit(CAVEAT).alias("caveat"), F.struct(*rows.columns).alias("result")), {"pretty": str(pretty).lower()}).alias("json"))


def listing(rows: DataFrame, order: list[str]) -> DataFrame:
    """(json), one document with all rows of a bounded list, in order."""
    items = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.struct(*rows.columns).alias("__row")))), lambda x: x["__row"])
    return rows.agg(items.alias("results")).select(F.to_json(F.struct(F.lit(CAVEAT).alias("caveat"), "results")).alias("json"))
