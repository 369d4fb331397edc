"""Changes to tables as functions from old rows and new rows to the next table; publish() makes one visible at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.runtime import file_system


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing and, of the new rows, the first of each key that is not there yet."""
    return existing.unionByName(new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def inserted(existing: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """(table afterwards, number of rows added) of insert_ignore."""
    added = new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti").select(*existing.columns)
    return existing.unionByName(added), added.count()


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing with rows of equal key replaced by the new ones, and the rest of the new ones added."""
    return existing.join(new.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def update(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """existing with the columns of changes set, to null as well, where the key is found; of repeated keys in changes
    one row counts."""
    columns = [c for c in changes.columns if c != key]
    renamed = changes.dropDuplicates([key]).select(key, F.struct(*(F.col(c).alias(c) for c in columns)).alias("__new"))
    joined = existing.join(renamed, key, "left")
    return joined.select(*(F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in existing.columns))


def replace_children(existing: DataFrame, parents: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing without the children of these parents, and with the new ones."""
    return existing.join(parents.select(key).distinct(), key, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children whose parent was not deleted."""
    return children.join(deleted.select(key).distinct(), key, "left_anti").select(*children.columns)


def set_null(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children with their key emptied where the parent was deleted."""
    gone = deleted.select(key).distinct().withColumn("__gone", F.lit(True))
    return children.join(gone, key, "left").withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).select(*children.columns)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): the keys that break uniqueness."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def publish(tables: dict[str, DataFrame], root: str) -> str:
    """Write all tables into a new version folder, then point CURRENT at it: readers see all of the change or none.

    The pointer is written beside and renamed over the old one by the file system that holds the tables.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}.parquet")
    system, fresh = file_system(spark, f"{root}/CURRENT.{version}")
    out = system.create(fresh)
    out.write(bytearray(json.dumps({"version": version, "tables": sorted(tables)}), "utf-8"))
    out.close()
    jvm = spark.sparkContext._jvm
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri()).rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT"), over)
    return version


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    pointer = json.loads(spark.read.text(f"{root}/CURRENT", wholetext=True).first()[0])
    return spark.read.parquet(f"{root}/{pointer['version']}/{name}.parquet")


def keep_better(before: DataFrame, after: DataFrame, key: str, scores: list[str]) -> DataFrame:
    """(key, kept): whether every score after is at least that before."""
    joined = before.select(key, *(F.col(s).alias(f"b_{s}") for s in scores)).join(after.select(key, *scores), key)
    kept = F.lit(True)
    for s in scores:
        kept = kept & (F.col(s) >= F.col(f"b_{s}"))
    return joined.select(key, F.coalesce(kept, F.lit(False)).alias("kept"))
