"""Mixing sources to target weights by nested hash thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexlake.runtime import staged

#: Bits of a record's hash that each histogram level resolves; together the whole 62-bit hash.
LEVELS = (16, 23, 23)
BITS = sum(LEVELS)


def _plan(records: DataFrame, targets: DataFrame, total_size: int | None) -> DataFrame:
    """A row per source: its target, size, what it is to give, the copies of every record, and the size left for one more."""
    available = records.groupBy("source").agg(F.sum("size").alias("available"), F.count(F.lit(1)).alias("n_records"))
    goals = targets.filter("source IS NOT NULL").groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    total = F.lit(total_size) if total_size is not None else F.coalesce(F.lit(records.agg(F.sum("size")).first()[0] or 0), F.lit(0))
    plan = available.join(goals, "source", "full").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("n_records", F.lit(0)).alias("n_records"))
    plan = plan.withColumn("wanted", F.floor(F.col("target_share") * total).cast("bigint"))
    plan = plan.withColumn("given", F.least("wanted", F.col("available") * F.col("max_repeats")))
    plan = plan.withColumn("full_copies", F.when(F.col("available") > 0, F.expr("given div available")).otherwise(F.lit(0)).cast("int"))
    return plan.withColumn("rest", F.col("given") - F.col("full_copies") * F.col("available"))


def _thresholds(records: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, below): records whose hash is less than `below` fill the rest of the source's budget without passing it.

    A histogram of sizes by source and leading hash bits finds the bucket in which the budget ends; only that bucket's
    records enter the next, finer histogram. Records that share one whole hash are taken or left together.
    """
    state = plan.select("source", "rest", F.lit(0).cast("bigint").alias("below"))
    left = BITS
    inside = records
    for bits in LEVELS:
        left -= bits
        bucket = F.shiftright("hash", left)
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        running = sums.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))).join(state, "source")
        fits = F.col("upto") <= F.col("rest")
        ends = running.groupBy("source").agg(F.min(F.when(~fits, F.col("bucket"))).alias("bucket"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("taken"), F.first("rest").alias("rest"))
        state = ends.select("source", (F.col("rest") - F.col("taken")).alias("rest"), F.coalesce(F.col("bucket") * F.lit(1 << left), F.lit(1 << BITS)).alias("below"))
        inside = records.join(state.select("source", F.shiftright("below", left).alias("__bucket")), "source").filter(F.shiftright("hash", left) == F.col("__bucket")).drop("__bucket")
    return state.select("source", "below")


def mix(records: DataFrame, targets: DataFrame, *, id_col: str = "id", source_col: str = "source", size_col: str = "size", total_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, shares) of a mixture in which each source gives its target share of total_size, as far as it can.

    copies: (id, source, size, copies), a row for each record used at least once. shares: (source, target_share,
    max_repeats, n_records, available, wanted, drawn, actual_share), a row for each source of either table; total_size
    defaults to the size of all records. A source gives all of its records as often as its budget holds them whole,
    at most max_repeats times, and for the rest the records of lowest hash, which grow with the budget and never pass
    it. Sources without a target, and records whose source is null, have share 0; a target without records, or with
    too few, stays short, as its actual_share says. A null size counts 0; a null id hashes like any value; repeated
    rows are records of their own with one hash; empty tables give empty results; other columns are ignored. Nothing
    is sorted: two passes over (source, hash, size) sums beyond the first resolve the boundary.
    """
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col(id_col)), 2)
    records = staged(records.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint").alias("size"), hashed.alias("hash")), "mix-records")
    plan = staged(_plan(records, targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")), total_size), "mix-plan")
    below = _thresholds(records, plan.filter("rest > 0"))
    rule = staged(plan.select("source", "full_copies").join(below, "source", "left").select("source", "full_copies", F.coalesce("below", F.lit(0)).alias("below")), "mix-rule")
    copies = records.join(rule, "source").withColumn("copies", F.col("full_copies") + (F.col("hash") < F.col("below")).cast("int")).filter("copies > 0").select("id", "source", "size", "copies")
    drawn = copies.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("drawn"))
    shares = plan.join(drawn, plan["source"].eqNullSafe(drawn["source"]), "left").select(plan["source"], "target_share", "max_repeats", "n_records", "available", "wanted", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    whole = shares.agg(F.sum("drawn").alias("whole"))
    return copies, shares.join(F.broadcast(whole)).withColumn("actual_share", F.when(F.col("whole") > 0, F.col("drawn") / F.col("whole")).otherwise(F.lit(0.0))).drop("whole")
