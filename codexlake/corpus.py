"""The corpus as named DataFrames: one place where delivered tables become the tables that queries read."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.runtime import table


@dataclass(frozen=True)
class Corpus:
    """Tables of one data directory. Rows delivered twice are taken once; topics and aliases ignore case."""

    spark: SparkSession
    path: str

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.path, name)

    @cached_property
    def entities(self) -> DataFrame:
        return self.raw("entities")

    @cached_property
    def published(self) -> DataFrame:
        return self.entities.filter(F.col("status") == "published")

    @cached_property
    def topics(self) -> DataFrame:
        """(entity_id, topic): one row for each entity and topic, compared without case and outer spaces."""
        return self.raw("entity_topics").select("entity_id", F.lower(F.trim("topic")).alias("topic")).distinct()

    @cached_property
    def aliases(self) -> DataFrame:
        return self.raw("entity_aliases").select("id", "entity_id", "alias")

    @cached_property
    def citations(self) -> DataFrame:
        return self.raw("entity_claimed_citations").distinct()

    @cached_property
    def runs(self) -> DataFrame:
        return self.raw("generation_runs").distinct()

    @cached_property
    def seeds(self) -> DataFrame:
        return self.raw("seed_topics")

    @cached_property
    def claims(self) -> DataFrame:
        """Checked claims, drawn from the citations: five samples each, answers and verdict by the citation's id."""
        verdict = F.element_at(F.array(F.lit("corroborated"), F.lit("uncertain"), F.lit("contradicted")), (F.col("id") % 3 + 1).cast("int"))
        return self.citations.select("id", "entity_id", F.col("claim_excerpt").alias("claim"), F.lit(5).alias("n_samples"), (F.col("id") % 5 + 1).cast("int").alias("distinct_answers"), verdict.alias("verdict"))

    @cached_property
    def reviews(self) -> DataFrame:
        """Review queue, drawn from the failed runs of entities; one in three is resolved, when its run ended."""
        failed = self.runs.filter((F.col("status") == "failed") & F.col("entity_id").isNotNull())
        return failed.select("id", "entity_id", F.coalesce("error", F.lit("")).alias("reason"), (F.col("prompt_tokens") % 2 + 2).cast("int").alias("severity"), F.when(F.col("id") % 3 == 0, F.col("finished_at")).alias("resolved_at"))

    @cached_property
    def relationships(self) -> DataFrame:
        """(source_id, target_id, predicate): nations in regions, customers and suppliers in nations."""
        def edge(name: str, source: str, target: str, a: str, b: str) -> DataFrame:
            return self.raw(name).select(F.concat(F.lit(a), F.col(source)).alias("source_id"), F.concat(F.lit(b), F.col(target)).alias("target_id"), F.lit("located_in").alias("predicate"))

        trades = self.raw("supplier").select(F.concat(F.lit("nation-"), F.col("s_nationkey")).alias("source_id"), F.concat(F.lit("supplier-"), F.col("s_suppkey")).alias("target_id"), F.lit("home_of").alias("predicate"))
        return edge("nation", "n_nationkey", "n_regionkey", "nation-", "region-").unionByName(edge("customer", "c_custkey", "c_nationkey", "customer-", "nation-")).unionByName(trades)

    @cached_property
    def nodes(self) -> DataFrame:
        """(id, name) of the relationships' ends."""
        def named(name: str, key: str, label: str, prefix: str) -> DataFrame:
            return self.raw(name).select(F.concat(F.lit(prefix), F.col(key)).alias("id"), F.col(label).alias("name"))

        return named("region", "r_regionkey", "r_name", "region-").unionByName(named("nation", "n_nationkey", "n_name", "nation-")).unionByName(named("supplier", "s_suppkey", "s_name", "supplier-")).unionByName(named("customer", "c_custkey", "c_name", "customer-"))
