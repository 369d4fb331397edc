"""The contract of generated and verified records as rules whose violations are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.schema import DATE_PRECISIONS, ENTITY_TYPES, FACTS, KEY_DATES, NOTES, SEVERITIES

# Lengths, counts, shapes and closed sets that the contract states.
SLUG = "^[a-z0-9-]+$"
SHORT, SUMMARY, NARRATIVE = (20, 220), (400, 1500), 2500
MOST_DATES, MOST_ALIASES, TOPICS, MOST_RELATIONSHIPS, MOST_CITATIONS, MOST_DISAGREEMENTS = 15, 20, (3, 7), 20, 20, 15
CITATION_KINDS = ("book", "journal", "web", "other")
VERDICTS = ("agree", "disagree", "uncertain")


def _every(items: Column, rule) -> Column:
    """Whether all items meet the rule; an unknown outcome is none."""
    return F.forall(items, lambda x: F.coalesce(rule(x), F.lit(False)))


def generated_rules() -> dict[str, Column]:
    """Rule -> condition on a record with the columns of an entity, and aliases, topics ARRAY<STRING>, citations
    ARRAY<STRUCT<claim, source, kind>>, relationships ARRAY<STRUCT<target_name, predicate>>."""
    c = F.col
    dates, facts = F.from_json("key_dates", KEY_DATES), F.from_json("structured_facts", FACTS)
    coords = c("coords")
    return {
        "canonical_name.length": F.length("canonical_name") >= 1,
        "slug.shape": c("slug").rlike(SLUG),
        "entity_type.set": c("entity_type").isin(*ENTITY_TYPES),
        "short_description.length": F.length("short_description").between(*SHORT),
        "summary.length": F.length("summary").between(*SUMMARY),
        "narrative.length": F.length("narrative") >= NARRATIVE,
        "structured_facts.object": facts.isNotNull(),
        "structured_facts.flat": _every(F.map_values(facts), lambda v: ~F.substring(F.trim(v), 1, 1).isin("{", "[")),
        "key_dates.list": dates.isNotNull(),
        "key_dates.count": F.size(dates) <= MOST_DATES,
        "key_dates.year": _every(dates, lambda d: d["year"].isNotNull()),
        "key_dates.precision": _every(dates, lambda d: F.coalesce(d["precision"], F.lit("year")).isin(*DATE_PRECISIONS)),
        "key_dates.label": _every(dates, lambda d: d["label"].isNotNull()),
        "key_dates.kind": _every(dates, lambda d: d["kind"].isNotNull()),
        "coords.whole": coords.isNull() | (coords["lat"].isNotNull() & coords["lng"].isNotNull() & ~F.isnan(coords["lat"]) & ~F.isnan(coords["lng"])),
        "aliases.count": F.size("aliases") <= MOST_ALIASES,
        "aliases.text": _every(c("aliases"), lambda a: a.isNotNull()),
        "topics.count": F.size("topics").between(*TOPICS),
        "topics.shape": _every(c("topics"), lambda t: t.rlike(SLUG)),
        "relationships.count": F.size("relationships") <= MOST_RELATIONSHIPS,
        "relationships.named": _every(c("relationships"), lambda r: r["target_name"].isNotNull() & r["predicate"].isNotNull()),
        "citations.count": F.size("citations") <= MOST_CITATIONS,
        "citations.claim": _every(c("citations"), lambda x: x["claim"].isNotNull()),
        "citations.source": _every(c("citations"), lambda x: x["source"].isNotNull()),
        "citations.kind": _every(c("citations"), lambda x: F.coalesce(x["kind"], F.lit("other")).isin(*CITATION_KINDS)),
    }


def verified_rules() -> dict[str, Column]:
    """Rule -> condition on a verifier's answer: verdict STRING, disagreements STRING (JSON array)."""
    notes = F.from_json("disagreements", NOTES)
    return {
        "verdict.set": F.col("verdict").isin(*VERDICTS),
        "disagreements.list": notes.isNotNull(),
        "disagreements.count": F.size(notes) <= MOST_DISAGREEMENTS,
        "disagreements.text": _every(notes, lambda n: n["claim"].isNotNull() & n["why"].isNotNull()),
        "disagreements.severity": _every(notes, lambda n: F.coalesce(n["severity"], F.lit("medium")).isin(*SEVERITIES)),
    }


def violations(records: DataFrame, rules: dict[str, Column], key: str = "id") -> DataFrame:
    """(key, rule), a row for each rule that a record does not meet; an unknown outcome is a violation. Where a list is
    missing its own rule and those on its items are all violated."""
    checks = F.array(*(F.when(~F.coalesce(condition, F.lit(False)), F.lit(name)) for name, condition in rules.items()))
    return records.select(key, F.explode(F.array_compact(checks)).alias("rule"))


def record(entities: DataFrame, aliases: DataFrame, topics: DataFrame, citations: DataFrame, relationships: DataFrame) -> DataFrame:
    """Entities with their children as arrays, as the contract reads them; children are gathered before the join."""
    def gathered(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
        return rows.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(value)).alias(name))

    parts = {
        "aliases": (gathered(aliases, "entity_id", F.col("alias"), "aliases"), "array<string>"),
        "topics": (gathered(topics, "entity_id", F.col("topic"), "topics"), "array<string>"),
        "citations": (gathered(citations, "entity_id", F.struct(F.col("claim_excerpt").alias("claim"), F.col("claimed_source").alias("source"), F.col("claim_kind").alias("kind")), "citations"), "array<struct<claim: string, source: string, kind: string>>"),
        "relationships": (gathered(relationships, "source_id", F.struct("target_name", "predicate"), "relationships"), "array<struct<target_name: string, predicate: string>>"),
    }
    for name, (rows, kind) in parts.items():
        entities = entities.join(rows, "id", "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))
    return entities
