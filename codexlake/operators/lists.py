"""Lookups, filtered lists, pages, nested records and one-hop relationships."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.functions import text
from codexlake.schema import ENTITY_TYPES, FACTS, KEY_DATES, PUBLISHED, STUB

UUID = re.compile(r"^[0-9a-f-]{36}$", re.I)
PAGE = 30


def page(df: DataFrame, order: tuple[str | Column, ...], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order: the plan keeps limit + offset rows a task, not a global sort."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page_offset(number: int, size: int = PAGE) -> int:
    return (max(1, number) - 1) * size


def has_next(returned: int, size: int = PAGE) -> bool:
    return returned == size


def by_key(entities: DataFrame, key: str) -> DataFrame:
    """The entity with this id, if the key looks like one, else with this slug in any case."""
    return entities.filter(F.col("id") == key) if UUID.match(key) else entities.filter(F.lower("slug") == key.lower())


def by_type(published: DataFrame, entity_type: str, limit: int, offset: int = 0) -> DataFrame:
    return page(published.filter(F.col("entity_type") == entity_type).select(*STUB), ("canonical_name", "id"), limit, offset)


def by_topic(published: DataFrame, topics: DataFrame, topic: str, limit: int, offset: int = 0) -> DataFrame:
    """The topic's rows are few beside the entities: they become the semi-join's side, and no duplicates arise."""
    chosen = topics.filter(F.col("topic") == topic.strip().lower()).select(F.col("entity_id").alias("id"))
    return page(published.join(chosen, "id", "left_semi").select(*STUB), ("canonical_name", "id"), limit, offset)


def key_years(entities: DataFrame) -> DataFrame:
    """(id, year, precision, label, kind), a row for each key date; entities without any give none."""
    return entities.select("id", F.explode(F.from_json("key_dates", KEY_DATES)).alias("d")).select("id", "d.*")


def by_years(published: DataFrame, first: int, last: int, limit: int, entity_type: str | None = None) -> DataFrame:
    """Entities with a key date in first..last, earliest matching year first."""
    chosen = published if entity_type is None else published.filter(F.col("entity_type") == entity_type)
    earliest = key_years(chosen).filter(F.col("year").between(first, last)).groupBy("id").agg(F.min("year").alias("first_year"))
    return page(chosen.select(*STUB).join(earliest, "id"), ("first_year", "id"), limit)


def facts(entities: DataFrame) -> DataFrame:
    """(id, key, value), a row for each structured fact, values as text."""
    return entities.select("id", F.explode(F.from_json("structured_facts", FACTS)).alias("key", "value"))


def related(edges: DataFrame, nodes: DataFrame, source: str, predicate: str | None = None, limit: int = 50) -> DataFrame:
    """(predicate, entity STRUCT), outbound, in order of predicate and target; of nodes with a status only published ones."""
    if "status" in nodes.columns:
        nodes = nodes.filter(F.col("status") == PUBLISHED)
    out = edges.filter(F.col("source_id") == source)
    if predicate is not None:
        out = out.filter(F.col("predicate") == predicate)
    joined = out.join(nodes.withColumnRenamed("id", "target_id"), "target_id")
    return page(joined, ("predicate", "target_id"), limit).select("predicate", F.struct(F.col("target_id").alias("id"), *(c for c in nodes.columns if c not in ("id", "status"))).alias("entity"))


def children(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name ARRAY): the sorted values of each key, aggregated before any join to the parent."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(name))


def full(entities: DataFrame, aliases: DataFrame, topics: DataFrame) -> DataFrame:
    """Entities with their aliases and topics as arrays, empty where there are none."""
    one = entities.join(children(aliases, "entity_id", "alias", "aliases").withColumnRenamed("entity_id", "id"), "id", "left")
    two = one.join(children(topics, "entity_id", "topic", "topics").withColumnRenamed("entity_id", "id"), "id", "left")
    return two.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("aliases", "topics")})


def by_ids(published: DataFrame, ids: list[str]) -> DataFrame:
    return published.filter(F.col("id").isin(ids)).select(*STUB)


def by_rows(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """Stubs of the entities, of any status, whose id stands in ids: (id); a semi-join, as ids may be a table."""
    return entities.join(ids.select("id"), "id", "left_semi").select(*STUB)


def find(published: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """The published entity whose slug or name is this, else one with such an alias; the smallest id of several."""
    slug = re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", name.lower()))
    direct = published.filter((F.lower("slug") == slug) | (F.lower("canonical_name") == name.lower())).select(*STUB, F.lit(0).alias("rank"))
    named = aliases.filter(F.lower("alias") == name.lower()).select(F.col("entity_id").alias("id")).distinct()
    other = published.join(named, "id", "left_semi").select(*STUB, F.lit(1).alias("rank"))
    return page(direct.unionByName(other), ("rank", "id"), 1).drop("rank")


def sitemap(published: DataFrame, topics: DataFrame, static: dict[str, tuple[float, str]], now: Column, base: str = "") -> DataFrame:
    """(url, last_modified, priority, change_frequency) of fixed pages, types, entities and topics.

    static: path -> (priority, change frequency). Entities were last changed when updated, else when published; what has
    no time of its own changed now.
    """
    spark = published.sparkSession

    def rows(df: DataFrame, url: Column, changed: Column, priority: Column, often: Column) -> DataFrame:
        return df.select(F.concat(F.lit(base), url).alias("url"), changed.alias("last_modified"), priority.alias("priority"), often.alias("change_frequency"))

    weekly = F.lit("weekly")
    fixed = rows(spark.createDataFrame([(p, *how) for p, how in static.items()], "p string, priority double, often string"), F.col("p"), now, F.col("priority"), F.col("often"))
    kinds = rows(spark.createDataFrame([(t,) for t in ENTITY_TYPES], "t string"), F.concat(F.lit("/browse/"), "t"), now, F.lit(0.6), weekly)
    each = rows(published, F.concat(F.lit("/entity/"), text.url_encoded(F.col("slug"))), F.coalesce("updated_at", "published_at", now), F.lit(0.9), weekly)
    named = rows(topics.filter("topic IS NOT NULL").select("topic").distinct(), F.concat(F.lit("/topic/"), text.url_encoded(F.col("topic"))), now, F.lit(0.5), weekly)
    return fixed.unionByName(kinds).unionByName(each).unionByName(named)


def latest_published(published: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of (slug, published_at, updated_at), the latest published first, those without a time before them."""
    return page(published.select("slug", "published_at", "updated_at", "id"), (F.col("published_at").desc_nulls_first(), "id"), limit, offset).drop("id")


def resolve_targets(edges: DataFrame, named: DataFrame) -> DataFrame:
    """(source_id, target_id, predicate): proposed edges whose target name, as a slug, is an entity's; others drop out."""
    slugged = edges.withColumn("slug", text.slugify(F.col("target_name")))
    return slugged.join(named.select(F.col("id").alias("target_id"), F.lower("slug").alias("slug")), "slug").select("source_id", "target_id", "predicate").distinct()
