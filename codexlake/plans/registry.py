"""Registration of queries with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codexlake.corpus import Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Corpus], DataFrame]], Callable[[Corpus], DataFrame]]:
    """Register a function of a Corpus under its name."""

    def register(run: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        QUERIES[run.__name__] = lambda spark, sf_dir: run(Corpus(spark, sf_dir))
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


#: The corpus tables of Corpus, in SQL.
VIEWS = {
    "topics": "topics AS (SELECT DISTINCT entity_id, lower(trim(topic, ' ')) AS topic FROM entity_topics)",
    "citations": "citations AS (SELECT DISTINCT * FROM entity_claimed_citations)",
    "runs": "runs AS (SELECT DISTINCT * FROM generation_runs)",
    "published": "published AS (SELECT * FROM entities WHERE status = 'published')",
    "claims": "claims AS (SELECT id, entity_id, claim_excerpt AS claim, 5 AS n_samples, (id % 5 + 1)::INT AS distinct_answers, ['corroborated', 'uncertain', 'contradicted'][(id % 3 + 1)::INT] AS verdict FROM (SELECT DISTINCT * FROM entity_claimed_citations))",
    "reviews": "reviews AS (SELECT id, entity_id, coalesce(error, '') AS reason, (prompt_tokens % 2 + 2)::INT AS severity, CASE WHEN id % 3 = 0 THEN finished_at END AS resolved_at FROM (SELECT DISTINCT * FROM generation_runs) WHERE status = 'failed' AND entity_id IS NOT NULL)",
    "edges": "edges AS (SELECT 'nation-' || n_nationkey AS source_id, 'region-' || n_regionkey AS target_id, 'located_in' AS predicate FROM nation UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey, 'located_in' FROM customer UNION ALL SELECT 'nation-' || s_nationkey, 'supplier-' || s_suppkey, 'home_of' FROM supplier)",
    "nodes": "nodes AS (SELECT 'region-' || r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 'nation-' || n_nationkey, n_name FROM nation UNION ALL SELECT 'supplier-' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer-' || c_custkey, c_name FROM customer)",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(VIEWS[n] for n in names) + "\n"
