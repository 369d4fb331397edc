"""Heads of work queues, random pools with exclusions, and the latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.operators.lists import page
from codexlake.operators.mutations import update, upsert
from codexlake.schema import NOTES


def today_utc() -> Column:
    """The current date in UTC, whatever the session's time zone."""
    return F.to_date(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))


def head(queue: DataFrame, status: str = "pending", limit: int = 1) -> DataFrame:
    """The waiting rows of highest priority, the oldest of equals."""
    return page(queue.filter(F.col("status") == status), (F.desc("priority"), "id"), limit)


def claimed(queue: DataFrame, now: Column, status: str = "pending", marked: str = "generating") -> tuple[DataFrame, DataFrame]:
    """(row, queue afterwards): the head of the queue, and the queue with it marked and its last attempt set to now."""
    first = head(queue, status)
    marks = first.select("id", F.lit(marked).alias("status"), now.alias("last_attempted_at"))
    return first, update(queue, marks, "id")


def weakest(scored: DataFrame, score: str, below: float, limit: int) -> DataFrame:
    return page(scored.filter(F.col(score) < below), (F.col(score).asc_nulls_last(), "id"), limit)


def oldest_unscored(entities: DataFrame, limit: int, slug: str | None = None, rescore: bool = False) -> DataFrame:
    """The oldest entities without scores, or with any if they are to be scored again; with a slug only that entity."""
    chosen = entities if rescore else entities.filter(F.col("claims_scored_at").isNull())
    if slug is not None:
        chosen = chosen.filter(F.lower("slug") == slug.lower())
    return page(chosen, (F.col("created_at").asc_nulls_last(), "id"), limit)


def latest(df: DataFrame, limit: int) -> DataFrame:
    return page(df, (F.desc("id"),), limit)


def open_reviews(reviews: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """Unresolved reviews with their entity's names, notes and score, the most severe and then the latest first."""
    waiting = page(reviews.filter(F.col("resolved_at").isNull()).join(entities.select(F.col("id").alias("entity_id"), "slug", "canonical_name", "disagreement_notes", "consensus_score"), "entity_id"), (F.desc("severity"), F.desc("id")), limit)
    notes = F.coalesce(F.from_json("disagreement_notes", NOTES), F.array().cast(NOTES))
    return waiting.select(F.col("id").alias("review_id"), "entity_id", "slug", "canonical_name", "reason", "severity", notes.alias("disagreements"), "consensus_score")


def with_problems(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """Entities with the sorted claims that were not corroborated, empty where there are none."""
    problems = claims.filter("verdict <> 'corroborated'").groupBy("entity_id").agg(F.sort_array(F.collect_list("claim")).alias("problems"))
    return entities.join(problems.withColumnRenamed("entity_id", "id"), "id", "left").withColumn("problems", F.coalesce("problems", F.array().cast("array<string>")))


def shuffled(df: DataFrame, order: Column, limit: int) -> DataFrame:
    """limit rows in an order that a hash gives, the same anywhere."""
    return page(df.withColumn("draw", order), ("draw", "id"), limit)


def topped_up(pool: DataFrame, recent: DataFrame, limit: int) -> DataFrame:
    """limit rows of the pool, those not recent first, each part in its drawn order: one sort does both passes."""
    marked = pool.join(recent.select("id").distinct().withColumn("recent", F.lit(1)), "id", "left").withColumn("recent", F.coalesce("recent", F.lit(0)))
    return page(marked, ("recent", "draw", "id"), limit)


def recent_ids(rotation: DataFrame, since: Column) -> DataFrame:
    """The ids in rotations from a date on."""
    return rotation.filter(F.col("date") >= since).select(F.explode("entity_ids").alias("id")).distinct()


def rotation_of(rotation: DataFrame, date: str) -> DataFrame:
    """(id) of the rotation of a date, else of the latest one."""
    chosen = page(rotation.withColumn("other", (F.col("date") != F.lit(date).cast("date")).cast("int")), ("other", F.desc("date")), 1)
    return chosen.select(F.explode("entity_ids").alias("id"))


def refreshed(rotation: DataFrame, pool: DataFrame, date: Column, count: int, days: int = 7) -> DataFrame:
    """rotation with the row of the date set to `count` ids of the pool: (id, draw), in drawn order, those first that
    stood in no rotation of the last days."""
    recent = recent_ids(rotation, F.date_sub(date, days))
    picked = topped_up(pool, recent, count)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("recent", "draw", "id"))), lambda x: x["id"])
    return upsert(rotation, picked.agg(ordered.alias("entity_ids")).select(date.alias("date"), "entity_ids"), ["date"])
