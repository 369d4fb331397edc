"""Readers of seed lists and snapshots, and a full dump with a completeness gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexlake.schema import ENTITY_TYPES

SNAPSHOT = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "slug", "canonical_name", "entity_type", "short_description", "summary", "narrative")] + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("aliases", "topics")] + [T.StructField("citations", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("claim", "source", "url", "author", "kind")])))])


def _part(fields: Column, at: int) -> Column:
    value = F.trim(F.regexp_replace(F.get(fields, F.lit(at)), '"', ""))
    return F.when(value != "", value)


def parse_seed_csv(lines: DataFrame) -> DataFrame:
    """(name, hint, entity_type) of lines `name,hint,type`; blank and # lines and those without a name drop out.

    Commas inside quotes do not part fields; a doubled quote is no escape. An unknown type is null. A line of two fields
    keeps the second as its hint, whatever it says.
    """
    line = F.trim(lines["value"])
    kept = lines.select(line.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    fields = F.split("line", ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    kind = _part(fields, 2)
    return kept.select(_part(fields, 0).alias("name"), _part(fields, 1).alias("hint"), F.when(kind.isin(*ENTITY_TYPES), kind).alias("entity_type")).filter("name IS NOT NULL")


def parse_seed_lines(lines: DataFrame) -> DataFrame:
    """(name, hint) of lines `name | hint`; further bars belong to the hint; nameless lines drop out."""
    fields = F.transform(F.split(lines["value"], r"\|"), lambda x: F.trim(x))
    hint = F.array_join(F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0))), " | ")
    return lines.select(F.element_at(fields, 1).alias("name"), F.when(F.size(fields) > 1, hint).alias("hint")).filter("name <> ''")


def read_seed_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_seed_csv(spark.read.text(path))


def read_seed_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_seed_lines(spark.read.text(path))


def read_snapshot(spark: SparkSession, path: str, slugs: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, missing): the records of a JSON array file, of these slugs if given, and the slugs that it lacks."""
    records = spark.read.schema(SNAPSHOT).json(path, multiLine=True)
    if slugs is None:
        return records, spark.createDataFrame([], "slug string")
    asked = spark.createDataFrame([(s,) for s in slugs], "slug string")
    return records.filter(F.col("slug").isin(slugs)), asked.join(records.select("slug"), "slug", "left_anti")


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int = 10) -> DataFrame:
    """A database table in parallel ranges of a numeric column; needs the database's driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load()


def dump(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}.parquet")


def restored(spark: SparkSession, root: str, names: list[str], gate: tuple[str, int]) -> dict[str, DataFrame]:
    """The tables of a dump; raises unless the gate's table has at least so many rows."""
    tables = {name: spark.read.parquet(f"{root}/{name}.parquet") for name in names}
    rows = tables[gate[0]].count()
    if rows < gate[1]:
        raise ValueError(f"incomplete dump: {gate[0]} has {rows} rows, fewer than {gate[1]}")
    return tables
