"""Counts, conditional averages, pivots and top lists of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexlake.functions.scoring import share
from codexlake.operators.lists import page
from codexlake.runtime import staged


def counts(df: DataFrame, *by: str, limit: int | None = None) -> DataFrame:
    """(by, n), most frequent first, then by key."""
    grouped = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return grouped if limit is None else page(grouped, (F.desc("n"), *by), limit)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def mean_if(value: Column, condition: Column) -> Column:
    return F.coalesce(F.avg(F.when(condition, value)), F.lit(0.0))


def entity_totals(entities: DataFrame) -> DataFrame:
    """One row of all totals over entities, in one scan."""
    published, scored = F.col("status") == "published", F.col("claims_scored_at").isNotNull()
    return entities.agg(
        count_if(published).alias("n_published"),
        mean_if(F.col("consensus_score"), published).alias("avg_consensus"),
        count_if(F.col("status") == "flagged").alias("n_flagged"),
        count_if(scored).alias("n_scored"),
        mean_if(F.col("claim_factuality_score"), scored).alias("avg_factuality"),
    )


def pivoted(df: DataFrame, key: str, values: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """A column of counts for each of the values, 0 where there are none; others are ignored."""
    return df.groupBy(*by).agg(*(count_if(F.col(key) == v).alias(v) for v in values))


def as_map(counted: DataFrame, key: str, value: str) -> DataFrame:
    """One row with a map from key to value."""
    return counted.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias("counts"))


def topic_counts(published: DataFrame, topics: DataFrame, limit: int, entity_type: str | None = None) -> DataFrame:
    chosen = published if entity_type is None else published.filter(F.col("entity_type") == entity_type)
    return counts(topics.join(chosen.select(F.col("id").alias("entity_id")), "entity_id", "left_semi"), "topic", limit=limit)


def related_topics(published: DataFrame, topics: DataFrame, topic: str, limit: int) -> DataFrame:
    """Topics that stand on the entities of one topic: a semi-join in place of a self-join and distinct."""
    peers = topics.filter(F.col("topic") == topic).select("entity_id")
    beside = topics.filter(F.col("topic") != topic).join(peers, "entity_id", "left_semi")
    return counts(beside.join(published.select(F.col("id").alias("entity_id")), "entity_id", "left_semi"), "topic", limit=limit)


def citation_summary(citations: DataFrame) -> DataFrame:
    """(entity_id, total, checked, verified)."""
    return citations.groupBy("entity_id").agg(F.count(F.lit(1)).alias("total"), count_if(F.col("resolution_status") != "unchecked").alias("checked"), count_if(F.col("resolution_status") == "verified").alias("verified"))


def factuality(claims: DataFrame) -> DataFrame:
    """(entity_id, n_claims, factuality)."""
    return claims.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_claims"), share(F.col("verdict") == "corroborated").alias("factuality"))


def windows_spend(runs: DataFrame, as_of: Column, statuses: tuple[str, ...] = ("completed", "running")) -> DataFrame:
    """Sums of cost in as_of's calendar month, its day and the hour before it, in one scan."""
    now, at = as_of, F.col("started_at")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("api_cost_usd"))), F.lit(0).cast("decimal(22,6)"))

    return runs.filter(F.col("status").isin(*statuses)).agg(
        total(F.date_trunc("month", at) == F.date_trunc("month", now)).alias("monthly"),
        total(F.to_date(at) == F.to_date(now)).alias("daily"),
        total((at > now - F.expr("INTERVAL 1 HOUR")) & (at <= now)).alias("hourly"),
    )


def answer_agreement(samples: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, n_samples, distinct_answers, majority_answer): answers compared without case, marks and outer spaces; of
    equally frequent ones the smallest is the majority. Two aggregations, so that no key's answers are collected."""
    plain = F.trim(F.regexp_replace(F.lower(answer), r"[^\p{L}\p{N}]+", " "))
    each = samples.filter(F.col(answer).isNotNull()).groupBy(key, plain.alias("plain")).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("plain")))
    return each.groupBy(key).agg(F.sum("n").alias("n_samples"), F.count(F.lit(1)).alias("distinct_answers"), best["plain"].alias("majority_answer"))


def drained(queue: DataFrame, cost: str, budget: float, order: tuple[str, ...]) -> DataFrame:
    """Rows of a queue, in order, while their running cost, of costs of 0 or more, stays within the budget.

    Rows are dealt to ranges of the order; each range's sum is added up, and running sums begin in each range behind
    those before it, so that no task sees the whole queue. A null cost counts 0.
    """
    ranged = staged(queue.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "queue")
    sums = ranged.groupBy("__range").agg(F.sum(cost).alias("sum"))
    before = sums.withColumn("before", F.coalesce(F.sum("sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__range", "before")
    own = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("__own", F.coalesce(F.sum(cost).over(own), F.lit(0))).join(F.broadcast(before), "__range")
    return summed.withColumn("running", F.col("before") + F.col("__own")).filter(F.col("running") <= budget).drop("__range", "__own", "before")


def quality_summary(entities: DataFrame, reviews: DataFrame, claims: DataFrame, citations: DataFrame, topics: DataFrame, runs: DataFrame) -> DataFrame:
    """One row with the whole dashboard: totals, claim verdicts, citation statuses, and the lists by type, model, topic
    and run, as arrays of structs in their order.

    Each part is aggregated or cut to its list before the one-row results meet; entities are scanned once for totals.
    """
    published = entities.filter(F.col("status") == "published")

    def ordered(rows: DataFrame, order: tuple[Column, ...], name: str) -> DataFrame:
        keys = [o.alias(f"k{i}") for i, o in enumerate(order)]
        return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct(*keys, F.struct(*rows.columns).alias("row")))), lambda x: x["row"]).alias(name))

    n, as_struct = -F.col("n"), F.struct
    totals = entity_totals(entities)
    statuses = ("verified", "ambiguous", "not_found")
    cited = citations.agg(F.count(F.lit(1)).alias("total"), *(count_if(F.col("resolution_status") == s).alias(s) for s in statuses))
    verdicts = pivoted(claims, "verdict", ("corroborated", "uncertain", "contradicted"))
    by_type = published.groupBy("entity_type").agg(F.avg("consensus_score").alias("avg_consensus"), F.count(F.lit(1)).alias("n"))
    parts = [
        reviews.agg(count_if(F.col("resolved_at").isNull()).alias("n_open_reviews")),
        verdicts.select(as_struct(*verdicts.columns).alias("claim_verdicts")),
        cited.select(as_struct(*cited.columns).alias("citations")),
        ordered(by_type, (n, F.col("entity_type")), "consensus_by_type"),
        ordered(counts(entities, "generator_model"), (n, F.col("generator_model")), "model_coverage"),
        ordered(topic_counts(published, topics, 20), (n, F.col("topic")), "top_topics"),
        ordered(page(runs.select("id", "model", "job_kind", "api_cost_usd", "status", "finished_at"), (F.desc("id"),), 10), (-F.col("id"),), "latest_runs"),
    ]
    for part in parts:
        totals = totals.join(F.broadcast(part))
    return totals
