"""Scoring of claims by sampled answers of a service."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.functions.scoring import entropy_proxy
from codexlake.operators.aggregates import factuality
from codexlake.operators.mutations import update
from codexlake.sources.providers import Service, served

#: From this entropy on answers are too scattered to decide.
SCATTERED = 0.5


def plain(answer: Column) -> Column:
    """An answer without case, marks and outer spaces."""
    return F.trim(F.regexp_replace(F.lower(answer), r"[^\p{L}\p{N}]+", " "))


def scored(claims: DataFrame, service: Callable[[], Service]) -> DataFrame:
    """(id, entity_id, claim, question, n_samples, distinct_answers, entropy, verdict, majority_answer, agrees_with_claim).

    claims: (id, entity_id, claim, question, expected). The service answers each question with a list of samples, which
    are compared in their plain form; nulls among them are no samples, and of equally frequent answers the smallest is
    the majority. A claim agrees with a majority equal to its expected answer; its verdict is corroborated if it agrees,
    uncertain if there is no sample or the entropy is SCATTERED or more, else contradicted. Each row's samples are counted
    inside the row; other columns are ignored.
    """
    asked = served(claims.select("id", "entity_id", "claim", "question", "expected"), "question", service, "samples", "array<string>")
    answers = F.filter(F.transform(F.coalesce("samples", F.array().cast("array<string>")), plain), lambda x: x.isNotNull())
    counted = asked.withColumn("answers", answers).withColumns({"n_samples": F.size("answers"), "distinct_answers": F.size(F.array_distinct("answers"))})
    ranked = F.transform(F.array_distinct("answers"), lambda a: F.struct((-F.size(F.filter("answers", lambda x: x == a))).alias("less"), a.alias("answer")))
    counted = counted.withColumn("majority_answer", F.when(F.col("n_samples") > 0, F.array_min(ranked)["answer"]))
    agrees = F.coalesce(F.col("majority_answer") == plain(F.col("expected")), F.lit(False))
    counted = counted.withColumn("entropy", entropy_proxy(F.col("n_samples"), F.col("distinct_answers"))).withColumn("agrees_with_claim", agrees)
    verdict = F.when(F.col("n_samples") == 0, "uncertain").when(F.col("entropy") >= SCATTERED, "uncertain").when(F.col("agrees_with_claim"), "corroborated").otherwise("contradicted")
    return counted.select("id", "entity_id", "claim", "question", "n_samples", "distinct_answers", "entropy", verdict.alias("verdict"), "majority_answer", "agrees_with_claim")


def with_factuality(entities: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """entities with the share of corroborated claims and the time of scoring set where claims are given."""
    shares = factuality(claims).select(F.col("entity_id").alias("id"), F.col("factuality").cast(entities.schema["claim_factuality_score"].dataType).alias("claim_factuality_score"), now.alias("claims_scored_at"))
    return update(entities, shares, "id")
