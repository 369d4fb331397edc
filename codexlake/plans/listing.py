"""Lookup, list, relationship and mutation queries."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.corpus import Corpus
from codexlake.functions import text
from codexlake.operators import contract, lists, mutations, queues, snapshots
from codexlake.schema import ENTITY_TYPES, STUB

from .registry import query, with_views

TOPIC, YEARS, KIND = "regional-history", (1200, 1400), "place"
_STUB = "id, slug, canonical_name, entity_type, short_description, round(consensus_score::DOUBLE, 4) AS consensus_score"


def stub(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*STUB[:-1], F.round(F.col("consensus_score").cast("double"), 4).alias("consensus_score"), *more)


@query(with_views("published") + f"SELECT {_STUB} FROM published WHERE entity_type = '{KIND}' ORDER BY canonical_name, id LIMIT 30 OFFSET 30")
def list_by_type_page(c: Corpus) -> DataFrame:
    return stub(lists.by_type(c.published, KIND, lists.PAGE, lists.page_offset(2)))


@query(with_views("published", "topics") + f"SELECT {_STUB} FROM published WHERE id IN (SELECT entity_id FROM topics WHERE topic = '{TOPIC}') ORDER BY canonical_name, id LIMIT 20 OFFSET 5")
def list_by_topic(c: Corpus) -> DataFrame:
    return stub(lists.by_topic(c.published, c.topics, TOPIC, 20, 5))


@query(
    with_views("published")
    + f"""SELECT {_STUB}, first_year FROM published JOIN (
        SELECT id AS key, min(y)::INT AS first_year FROM (SELECT id, unnest(from_json(key_dates, '[{{"year":"INTEGER"}}]')).year AS y FROM published)
        WHERE y BETWEEN {YEARS[0]} AND {YEARS[1]} GROUP BY id) ON key = id ORDER BY first_year, id LIMIT 20"""
)
def list_by_date_range(c: Corpus) -> DataFrame:
    return stub(lists.by_years(c.published, *YEARS, 20), "first_year")


@query(
    """SELECT d.kind AS kind, d.precision AS precision, count(*) AS n, min(d.year)::INT AS first_year, max(d.year)::INT AS last_year
       FROM (SELECT unnest(from_json(key_dates, '[{"year":"INTEGER","precision":"VARCHAR","kind":"VARCHAR"}]')) AS d FROM entities) GROUP BY ALL"""
)
def key_dates_by_kind(c: Corpus) -> DataFrame:
    return lists.key_years(c.entities).groupBy("kind", "precision").agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("SELECT key, count(*) AS n, count(DISTINCT value) AS n_values FROM (SELECT unnest(map_entries(from_json(structured_facts, '\"MAP(VARCHAR, VARCHAR)\"')), recursive := true) FROM entities) GROUP BY key")
def fact_keys(c: Corpus) -> DataFrame:
    return lists.facts(c.entities).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


@query("SELECT e.id, e.slug, e.status, length(e.narrative)::BIGINT AS n_chars FROM entities e WHERE lower(slug) = (SELECT lower(min(slug)) FROM entities)")
def entity_by_slug(c: Corpus) -> DataFrame:
    first = c.entities.agg(F.min("slug")).first()[0]
    return lists.by_key(c.entities, (first or "").upper()).select("id", "slug", "status", F.length("narrative").cast("bigint").alias("n_chars"))


@query(
    with_views("topics")
    + """SELECT e.id, e.canonical_name, coalesce(array_to_string(a.names, '|'), '') AS aliases, coalesce(array_to_string(t.names, '|'), '') AS topics
         FROM entities e LEFT JOIN (SELECT entity_id, list(alias ORDER BY alias) AS names FROM entity_aliases GROUP BY entity_id) a ON a.entity_id = e.id
         LEFT JOIN (SELECT entity_id, list(topic ORDER BY topic) AS names FROM topics GROUP BY entity_id) t ON t.entity_id = e.id"""
)
def entity_full(c: Corpus) -> DataFrame:
    return lists.full(c.entities, c.aliases, c.topics).select("id", "canonical_name", F.array_join("aliases", "|").alias("aliases"), F.array_join("topics", "|").alias("topics"))


@query(
    with_views("published")
    + f"""SELECT {_STUB} FROM (SELECT p.*, CASE WHEN lower(canonical_name) = a.name THEN 0 ELSE 1 END AS rank
          FROM published p, (SELECT lower(min(alias)) AS name FROM entity_aliases WHERE length(alias) > 8) a
          WHERE lower(canonical_name) = a.name OR lower(slug) = trim(regexp_replace(a.name, '[^a-z0-9]+', '-', 'g'), '-') OR id IN (SELECT entity_id FROM entity_aliases WHERE lower(alias) = a.name)) ORDER BY rank, id LIMIT 1"""
)
def find_by_slug_or_alias(c: Corpus) -> DataFrame:
    name = c.aliases.filter(F.length("alias") > 8).agg(F.min("alias")).first()[0] or ""
    return stub(lists.find(c.published, c.aliases, name))


@query(with_views("published") + f"SELECT {_STUB} FROM published WHERE id IN (SELECT id FROM entities ORDER BY id LIMIT 50)")
def entities_by_ids(c: Corpus) -> DataFrame:
    ids = [r.id for r in c.entities.select("id").orderBy("id").limit(50).collect()]
    return stub(lists.by_ids(c.published, ids))


@query(with_views("citations") + "SELECT id, claim_kind, claimed_source, resolution_status FROM citations WHERE entity_id = (SELECT min(entity_id) FROM entity_claimed_citations)")
def citations_of_entity(c: Corpus) -> DataFrame:
    first = c.citations.agg(F.min("entity_id")).first()[0]
    return c.citations.filter(F.col("entity_id") == first).select("id", "claim_kind", "claimed_source", "resolution_status")


@query(with_views("edges", "nodes") + "SELECT predicate, e.target_id, name FROM edges e JOIN nodes n ON n.id = e.target_id WHERE source_id = 'nation-3' ORDER BY predicate, e.target_id LIMIT 50")
def related_entities(c: Corpus) -> DataFrame:
    return lists.related(c.relationships, c.nodes, "nation-3").select("predicate", F.col("entity.id").alias("target_id"), F.col("entity.name").alias("name"))


_CITES = """edges AS (SELECT DISTINCT s.entity_id AS source_id, e.id AS target_id, 'cites' AS predicate FROM entity_aliases s JOIN entities e
    ON trim(regexp_replace(lower(s.alias), '[^a-z0-9]+', '-', 'g'), '-') = regexp_replace(lower(e.slug), '-[0-9]+$', ''))"""


def _cites(c: Corpus) -> DataFrame:
    """Edges from entities to those whose slug, without its number, an alias of theirs spells."""
    proposed = c.aliases.select(F.col("entity_id").alias("source_id"), F.col("alias").alias("target_name"), F.lit("cites").alias("predicate"))
    return lists.resolve_targets(proposed, c.entities.select("id", F.regexp_replace(F.lower("slug"), "-[0-9]+$", "").alias("slug")))


@query(
    with_views("published")
    + f""", {_CITES}, n AS (SELECT source_id, count(*) AS n FROM edges JOIN published ON id = target_id GROUP BY 1)
       SELECT predicate, target_id, canonical_name FROM edges JOIN published ON id = target_id WHERE source_id = (SELECT source_id FROM n ORDER BY n DESC, source_id LIMIT 1) ORDER BY predicate, target_id LIMIT 50"""
)
def related_published(c: Corpus) -> DataFrame:
    """The published entities that the entity with most of them points to."""
    edges = _cites(c)
    most = edges.join(c.published.select(F.col("id").alias("target_id")), "target_id", "left_semi").groupBy("source_id").count().orderBy(F.desc("count"), "source_id").first()
    found = lists.related(edges, c.entities.select("id", "canonical_name", "status"), most["source_id"] if most else "")
    return found.select("predicate", F.col("entity.id").alias("target_id"), F.col("entity.canonical_name").alias("canonical_name"))


@query(with_views("edges", "nodes") + "SELECT source_id, predicate, count(*) AS n, array_to_string(list(e.target_id ORDER BY e.target_id), '|') AS targets FROM edges e JOIN nodes n ON n.id = e.target_id WHERE source_id LIKE 'nation-%' GROUP BY ALL")
def related_grouped(c: Corpus) -> DataFrame:
    joined = c.relationships.filter(F.col("source_id").startswith("nation-")).join(c.nodes.withColumnRenamed("id", "target_id"), "target_id")
    return joined.groupBy("source_id", "predicate").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("target_id")), "|").alias("targets"))


@query(f"WITH {_CITES} SELECT * FROM edges")
def relationship_resolution(c: Corpus) -> DataFrame:
    return _cites(c)


@query("SELECT id, trim(regexp_replace(lower(canonical_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM entities")
def slugify(c: Corpus) -> DataFrame:
    return c.entities.select("id", text.slugify(F.col("canonical_name")).alias("slug"))


STATIC = {"/": (1.0, "daily"), "/search": (0.4, "weekly"), "/browse": (0.8, "daily"), "/quality": (0.4, "daily"), "/about": (0.6, "monthly")}
NOW = "2026-05-01 12:00:00"
_NOW = f"TIMESTAMP '{NOW}'"


@query(
    with_views("published", "topics")
    + "SELECT url, strftime(changed, '%Y-%m-%d %H:%M:%S') AS last_modified, priority, change_frequency FROM ("
    + " UNION ALL ".join(f"SELECT '{p}' AS url, {_NOW} AS changed, {n}::DOUBLE AS priority, '{often}' AS change_frequency" for p, (n, often) in STATIC.items())
    + f""" UNION ALL SELECT '/browse/' || unnest(['{"', '".join(ENTITY_TYPES)}']), {_NOW}, 0.6, 'weekly'
         UNION ALL SELECT '/entity/' || url_encode(slug), coalesce(updated_at, published_at)::TIMESTAMP, 0.9, 'weekly' FROM published
         UNION ALL SELECT DISTINCT '/topic/' || url_encode(topic), {_NOW}, 0.5, 'weekly' FROM topics)"""
)
def sitemap_union(c: Corpus) -> DataFrame:
    found = lists.sitemap(c.published, c.topics, STATIC, F.to_timestamp(F.lit(NOW)))
    return found.withColumn("last_modified", F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss"))


@query(with_views("published") + "SELECT slug, strftime(published_at::TIMESTAMP, '%Y-%m-%d %H:%M') AS published FROM published ORDER BY published_at DESC NULLS FIRST, id LIMIT 50 OFFSET 50")
def sitemap_entities_page(c: Corpus) -> DataFrame:
    return lists.latest_published(c.published, 50, 50).select("slug", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published"))


#: All customers, and as new rows all suppliers under keys of which most are customers' and some are not.
_NEW = "new AS (SELECT s_suppkey * 3 AS c_custkey, s_name AS c_name, s_nationkey AS c_nationkey, s_acctbal AS c_acctbal, NULL::VARCHAR AS c_mktsegment FROM supplier UNION ALL SELECT -1 - s_suppkey, s_name, s_nationkey, s_acctbal, 'NEW' FROM supplier)"


def _customers(c: Corpus) -> tuple[DataFrame, DataFrame]:
    supplier = c.raw("supplier")
    rest = (F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"))
    new = supplier.select((F.col("s_suppkey") * 3).alias("c_custkey"), *rest, F.lit(None).cast("string").alias("c_mktsegment"))
    return c.raw("customer"), new.unionByName(supplier.select((-1 - F.col("s_suppkey")).alias("c_custkey"), *rest, F.lit("NEW").alias("c_mktsegment")))


@query(f"WITH {_NEW} SELECT c_custkey, c_name, c_mktsegment FROM customer UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def insert_ignore(c: Corpus) -> DataFrame:
    return mutations.insert_ignore(*_customers(c), ["c_custkey"]).select("c_custkey", "c_name", "c_mktsegment")


@query(f"WITH {_NEW} SELECT count(*) AS n FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def inserted_count(c: Corpus) -> DataFrame:
    return c.spark.createDataFrame([(mutations.inserted(*_customers(c), ["c_custkey"])[1],)], "n bigint")


@query(f"WITH {_NEW} SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM new) UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM new")
def upsert(c: Corpus) -> DataFrame:
    return mutations.upsert(*_customers(c), ["c_custkey"]).select("c_custkey", "c_name", "c_mktsegment")


@query(f"WITH {_NEW} SELECT c.c_custkey, CASE WHEN n.c_custkey IS NULL THEN c.c_name ELSE n.c_name END AS c_name, CASE WHEN n.c_custkey IS NULL THEN c.c_mktsegment ELSE n.c_mktsegment END AS c_mktsegment FROM customer c LEFT JOIN new n ON n.c_custkey = c.c_custkey")
def update_by_key(c: Corpus) -> DataFrame:
    """Values are set to null as well."""
    old, new = _customers(c)
    return mutations.update(old, new.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").select("c_custkey", "c_name", "c_mktsegment")


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
       UNION ALL SELECT o_orderkey, 1, 0.0 FROM orders WHERE o_orderstatus = 'P'"""
)
def replace_children(c: Corpus) -> DataFrame:
    lines = c.raw("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    parents = c.raw("orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return mutations.replace_children(lines, parents, parents.select("l_orderkey", F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity")), "l_orderkey")


@query("SELECT id, entity_id, alias FROM entity_aliases WHERE entity_id NOT IN (SELECT id FROM entities WHERE status = 'draft')")
def cascade_delete(c: Corpus) -> DataFrame:
    return mutations.cascade(c.aliases, c.entities.filter("status = 'draft'").select(F.col("id").alias("entity_id")), "entity_id")


@query(with_views("runs") + "SELECT id, CASE WHEN entity_id IN (SELECT id FROM entities WHERE status = 'draft') THEN NULL ELSE entity_id END AS entity_id, job_kind FROM runs")
def set_null_on_delete(c: Corpus) -> DataFrame:
    return mutations.set_null(c.runs.select("id", "entity_id", "job_kind"), c.entities.filter("status = 'draft'").select(F.col("id").alias("entity_id")), "entity_id")


@query("SELECT lower(alias) AS alias, entity_id, count(*) AS n FROM entity_aliases GROUP BY ALL HAVING count(*) > 1")
def duplicate_aliases(c: Corpus) -> DataFrame:
    return mutations.duplicates(c.aliases.select(F.lower("alias").alias("alias"), "entity_id"), ["alias", "entity_id"])


def _tables(c: Corpus) -> dict[str, DataFrame]:
    return {"entities": c.entities, "aliases": c.aliases, "topics": c.topics, "citations": c.citations, "claims": c.claims, "reviews": c.reviews}


def _spoiled(c: Corpus) -> dict[str, DataFrame]:
    """All tables with every flagged entity rewritten, its children changed, and a new open review."""
    flagged = c.entities.filter("status = 'flagged'").select("id")
    parents = flagged.withColumnRenamed("id", "entity_id")
    tables = _tables(c)
    entities = c.entities.withColumns({"summary": F.when(F.col("status") == "flagged", "spoiled").otherwise(F.col("summary")), "consensus_score": F.when(F.col("status") == "flagged", F.lit(None)).otherwise(F.col("consensus_score"))})
    fresh = {
        "aliases": parents.select(F.lit(-1).cast("bigint").alias("id"), "entity_id", F.lit("spoiled").alias("alias")),
        "topics": parents.select("entity_id", F.lit("spoiled").alias("topic")),
    }
    out = tables | {"entities": entities} | {n: mutations.replace_children(tables[n], parents, rows, "entity_id") for n, rows in fresh.items()}
    out["citations"] = mutations.cascade(tables["citations"], parents, "entity_id")
    out["claims"] = tables["claims"].withColumn("verdict", F.lit("contradicted"))
    extra = parents.select(F.lit(-1).cast("bigint").alias("id"), "entity_id", F.lit("spoiled").alias("reason"), F.lit(3).alias("severity"), F.lit(None).cast("timestamp").alias("resolved_at"))
    out["reviews"] = tables["reviews"].unionByName(extra.select(*tables["reviews"].columns))
    return out


def _listed(tables: dict[str, DataFrame], values: dict[str, str]) -> DataFrame:
    """(table_name, entity_id, value) of all rows."""
    each = [rows.select(F.lit(name).alias("table_name"), F.col("id" if name == "entities" else "entity_id").alias("entity_id"), F.expr(values[name]).alias("value")) for name, rows in tables.items()]
    return functools.reduce(DataFrame.unionByName, each)


_VALUES = {
    "entities": "concat_ws('|', summary, date_format(updated_at, 'yyyy-MM-dd'), date_format(created_at, 'yyyy-MM-dd'), if(consensus_score IS NULL, 'none', 'some'))",
    "aliases": "alias",
    "topics": "topic",
    "citations": "claimed_source",
    "claims": "verdict",
    "reviews": "reason",
}
_CHILD_ROWS = """UNION ALL SELECT 'aliases', entity_id, alias FROM entity_aliases UNION ALL SELECT 'topics', entity_id, topic FROM topics UNION ALL SELECT 'citations', entity_id, claimed_source FROM citations
       UNION ALL SELECT 'reviews', entity_id, reason FROM reviews"""
_ENTITY_ROWS = "SELECT 'entities' AS table_name, id AS entity_id, concat_ws('|', summary, CASE WHEN status = 'flagged' THEN '2026-05-01' ELSE strftime(updated_at::TIMESTAMP, '%Y-%m-%d') END, strftime(created_at::TIMESTAMP, '%Y-%m-%d'), CASE WHEN consensus_score IS NULL THEN 'none' ELSE 'some' END) AS value FROM entities"


@query(
    with_views("topics", "citations", "claims", "reviews")
    + f"""{_ENTITY_ROWS} {_CHILD_ROWS} UNION ALL SELECT 'claims', entity_id, CASE WHEN entity_id IN (SELECT id FROM entities WHERE status = 'flagged') THEN verdict ELSE 'contradicted' END FROM claims"""
)
def snapshot_restored(c: Corpus) -> DataFrame:
    """Flagged entities are captured with all that belongs to them, spoiled, and restored: they are as they were, but
    for updated_at; what else was changed stays changed."""
    taken = snapshots.captured(_tables(c), c.entities.filter("status = 'flagged'").select("id"))
    return _listed(snapshots.restored(_spoiled(c), taken, F.to_timestamp(F.lit(NOW))), _VALUES)


@query(
    with_views("topics", "citations", "claims", "reviews")
    + f"""{_ENTITY_ROWS} UNION ALL SELECT DISTINCT 'aliases', entity_id, alias FROM entity_aliases WHERE entity_id IN (SELECT id FROM entities WHERE status = 'flagged') UNION ALL SELECT 'aliases', entity_id, alias FROM entity_aliases WHERE entity_id NOT IN (SELECT id FROM entities WHERE status = 'flagged')
       UNION ALL SELECT 'topics', entity_id, topic FROM topics
       UNION ALL SELECT 'citations', entity_id, claimed_source FROM (SELECT DISTINCT entity_id, claim_excerpt, claimed_source, claimed_url, claimed_author, claim_kind FROM citations WHERE entity_id IN (SELECT id FROM entities WHERE status = 'flagged'))
       UNION ALL SELECT 'citations', entity_id, claimed_source FROM citations WHERE entity_id NOT IN (SELECT id FROM entities WHERE status = 'flagged')
       UNION ALL SELECT 'claims', entity_id, 'contradicted' FROM claims WHERE entity_id NOT IN (SELECT id FROM entities WHERE status = 'flagged')
       UNION ALL SELECT 'reviews', entity_id, reason FROM reviews UNION ALL SELECT 'reviews', id, 'spoiled' FROM entities WHERE status = 'flagged'"""
)
def snapshot_applied(c: Corpus) -> DataFrame:
    """Records as a snapshot file has them, of the flagged entities, applied to the spoiled tables."""
    def gathered(rows: DataFrame, value: F.Column, name: str) -> DataFrame:
        return rows.groupBy(F.col("entity_id").alias("id")).agg(F.collect_list(value).alias(name))

    cited = F.struct(F.col("claim_excerpt").alias("claim"), F.col("claimed_source").alias("source"), F.col("claimed_url").alias("url"), F.col("claimed_author").alias("author"), F.col("claim_kind").alias("kind"))
    records = c.entities.filter("status = 'flagged'")
    for rows, value, name in ((c.aliases, F.col("alias"), "aliases"), (c.topics, F.col("topic"), "topics"), (c.citations, cited, "citations")):
        records = records.join(gathered(rows, value, name), "id", "left")
    tables = snapshots.applied(_spoiled(c), records, F.to_timestamp(F.lit(NOW)))
    return _listed({n: tables[n] for n in _VALUES}, _VALUES)


@query(
    """WITH after AS (SELECT id, consensus_score::DOUBLE + CASE WHEN length(slug) % 2 = 0 THEN 0.1 ELSE -0.1 END AS consensus_score, claim_factuality_score AS claim_factuality_score FROM entities)
       SELECT b.id, coalesce(a.consensus_score >= b.consensus_score::DOUBLE AND a.claim_factuality_score >= b.claim_factuality_score, false) AS kept FROM entities b JOIN after a ON a.id = b.id"""
)
def keep_if_better(c: Corpus) -> DataFrame:
    before = c.entities.select("id", F.col("consensus_score").cast("double").alias("consensus_score"), "claim_factuality_score")
    step = F.when(F.length(c.entities["slug"]) % 2 == 0, 0.1).otherwise(-0.1)
    after = c.entities.select("id", (F.col("consensus_score").cast("double") + step).alias("consensus_score"), "claim_factuality_score")
    return mutations.keep_better(before, after, "id", ["consensus_score", "claim_factuality_score"])


_DATES = """from_json(key_dates, '[{"year":"INTEGER","precision":"VARCHAR","label":"VARCHAR","kind":"VARCHAR"}]')"""
#: The contract once more, in SQL over the record r.
_RULES = {
    "canonical_name.length": "length(canonical_name) >= 1",
    "slug.shape": "regexp_matches(slug, '^[a-z0-9-]+$')",
    "entity_type.set": "entity_type IN ('person', 'place', 'event', 'concept', 'work', 'organization', 'species', 'artifact', 'other')",
    "short_description.length": "length(short_description) BETWEEN 20 AND 220",
    "summary.length": "length(summary) BETWEEN 400 AND 1500",
    "narrative.length": "length(narrative) >= 2500",
    "structured_facts.object": "json_type(structured_facts) = 'OBJECT'",
    "structured_facts.flat": "len(list_filter(json_extract(structured_facts, '$.*'), lambda v: json_type(v) IN ('OBJECT', 'ARRAY'))) = 0",
    "key_dates.list": "dates IS NOT NULL",
    "key_dates.count": "len(dates) <= 15",
    "key_dates.year": "len(list_filter(dates, lambda d: d.year IS NULL)) = 0",
    "key_dates.precision": "len(list_filter(dates, lambda d: coalesce(d.precision, 'year') NOT IN ('year', 'decade', 'century'))) = 0",
    "key_dates.label": "len(list_filter(dates, lambda d: d.label IS NULL)) = 0",
    "key_dates.kind": "len(list_filter(dates, lambda d: d.kind IS NULL)) = 0",
    "coords.whole": "coords IS NULL OR (coords.lat IS NOT NULL AND coords.lng IS NOT NULL AND NOT isnan(coords.lat) AND NOT isnan(coords.lng))",
    "aliases.count": "n_aliases <= 20",
    "aliases.text": "n_null_aliases = 0",
    "topics.count": "n_topics BETWEEN 3 AND 7",
    "topics.shape": "n_odd_topics = 0",
    "relationships.count": "n_edges <= 20",
    "relationships.named": "true",
    "citations.count": "n_citations <= 20",
    "citations.claim": "n_null_claims = 0",
    "citations.source": "n_null_sources = 0",
    "citations.kind": "n_odd_kinds = 0",
}


@query(
    with_views("topics", "citations")
    + f""", {_CITES}, r AS (SELECT e.*, {_DATES} AS dates, coalesce(a.n, 0) AS n_aliases, coalesce(a.nulls, 0) AS n_null_aliases, coalesce(t.n, 0) AS n_topics, coalesce(t.odd, 0) AS n_odd_topics,
         coalesce(g.n, 0) AS n_edges, coalesce(k.n, 0) AS n_citations, coalesce(k.no_claim, 0) AS n_null_claims, coalesce(k.no_source, 0) AS n_null_sources, coalesce(k.odd, 0) AS n_odd_kinds
       FROM entities e LEFT JOIN (SELECT entity_id, count(alias) AS n, count(*) - count(alias) AS nulls FROM entity_aliases GROUP BY 1) a ON a.entity_id = e.id
       LEFT JOIN (SELECT entity_id, count(topic) AS n, count(*) FILTER (WHERE NOT regexp_matches(topic, '^[a-z0-9-]+$')) AS odd FROM topics GROUP BY 1) t ON t.entity_id = e.id
       LEFT JOIN (SELECT source_id, count(*) AS n FROM edges GROUP BY 1) g ON g.source_id = e.id
       LEFT JOIN (SELECT entity_id, count(*) AS n, count(*) FILTER (WHERE claim_excerpt IS NULL) AS no_claim, count(*) FILTER (WHERE claimed_source IS NULL) AS no_source,
                  count(*) FILTER (WHERE coalesce(claim_kind, 'other') NOT IN ('book', 'journal', 'web', 'other')) AS odd FROM citations GROUP BY 1) k ON k.entity_id = e.id) """
    + " UNION ALL ".join(f"SELECT id, '{name}' AS rule FROM r WHERE NOT coalesce({rule}, false)" for name, rule in _RULES.items())
)
def generated_record_violations(c: Corpus) -> DataFrame:
    edges = _cites(c).select("source_id", F.col("target_id").alias("target_name"), "predicate")
    return contract.violations(contract.record(c.entities, c.aliases, c.topics, c.citations, edges), contract.generated_rules())


@query(
    """WITH n AS (SELECT id, from_json(disagreement_notes, '[{"claim":"VARCHAR","why":"VARCHAR","severity":"VARCHAR"}]') AS d FROM entities)
       SELECT id, 'disagreements.count' AS rule FROM n WHERE len(d) > 15 UNION ALL SELECT id, 'disagreements.text' FROM n WHERE len(list_filter(d, lambda x: x.claim IS NULL OR x.why IS NULL)) > 0
       UNION ALL SELECT id, 'disagreements.severity' FROM n WHERE len(list_filter(d, lambda x: coalesce(x.severity, 'medium') NOT IN ('low', 'medium', 'high'))) > 0
       UNION ALL SELECT id, 'verdict.set' FROM entities WHERE status NOT IN ('agree', 'disagree', 'uncertain')"""
)
def verified_record_violations(c: Corpus) -> DataFrame:
    """The notes of entities as verifiers' answers; their status stands in for the verdict, and never is one."""
    return contract.violations(c.entities.select("id", F.col("status").alias("verdict"), F.col("disagreement_notes").alias("disagreements")), contract.verified_rules())


@query("SELECT id, name, priority::INT AS priority FROM seed_topics WHERE status = 'pending' ORDER BY priority DESC, id LIMIT 1")
def next_pending_seed(c: Corpus) -> DataFrame:
    return queues.head(c.seeds).select("id", "name", F.col("priority").cast("int").alias("priority"))


@query(
    f"""WITH h AS (SELECT id FROM seed_topics WHERE status = 'pending' ORDER BY priority DESC, id LIMIT 1)
       SELECT id, CASE WHEN id IN (FROM h) THEN 'generating' ELSE status END AS status, strftime(CASE WHEN id IN (FROM h) THEN {_NOW} ELSE last_attempted_at::TIMESTAMP END, '%Y-%m-%d %H:%M') AS attempted FROM seed_topics"""
)
def seed_claimed(c: Corpus) -> DataFrame:
    """The seed table after its head was claimed."""
    after = queues.claimed(c.seeds, F.to_timestamp(F.lit(NOW)))[1]
    return after.select("id", "status", F.date_format("last_attempted_at", "yyyy-MM-dd HH:mm").alias("attempted"))


@query("SELECT id, name, status FROM seed_topics ORDER BY id DESC LIMIT 20")
def recent_seeds(c: Corpus) -> DataFrame:
    return queues.latest(c.seeds, 20).select("id", "name", "status")


@query("SELECT id, name FROM seed_topics WHERE status = 'generating'")
def stuck_seeds(c: Corpus) -> DataFrame:
    return c.seeds.filter("status = 'generating'").select("id", "name")


@query("SELECT id, slug FROM entities WHERE claims_scored_at IS NULL ORDER BY created_at, id LIMIT 10")
def entities_to_score(c: Corpus) -> DataFrame:
    return queues.oldest_unscored(c.entities, 10).select("id", "slug")


@query("SELECT id, slug FROM entities ORDER BY created_at, id LIMIT 10")
def entities_to_score_again(c: Corpus) -> DataFrame:
    return queues.oldest_unscored(c.entities, 10, rescore=True).select("id", "slug")


@query(with_views("citations") + "SELECT id, claimed_source, claimed_author FROM citations WHERE resolution_status = 'unchecked' ORDER BY id LIMIT 1000")
def citations_to_resolve(c: Corpus) -> DataFrame:
    return lists.page(c.citations.filter("resolution_status = 'unchecked'"), ("id",), 1000).select("id", "claimed_source", "claimed_author")


@query(
    with_views("claims")
    + """SELECT e.id, round(e.claim_factuality_score::DOUBLE, 4) AS factuality, coalesce(array_to_string(p.problems, '|'), '') AS problems
         FROM entities e LEFT JOIN (SELECT entity_id, list(claim ORDER BY claim) AS problems FROM claims WHERE verdict <> 'corroborated' GROUP BY entity_id) p ON p.entity_id = e.id
         WHERE e.claim_factuality_score < 0.8 ORDER BY e.claim_factuality_score, e.id LIMIT 50"""
)
def weak_entities(c: Corpus) -> DataFrame:
    weak = queues.weakest(c.entities.select("id", "claim_factuality_score"), "claim_factuality_score", 0.8, 50)
    return queues.with_problems(weak, c.claims).select("id", F.round(F.col("claim_factuality_score").cast("double"), 4).alias("factuality"), F.array_join("problems", "|").alias("problems"))


_POOL = "pool AS (SELECT id, md5('day' || id) AS draw FROM published WHERE consensus_score >= 0.7::DOUBLE ORDER BY draw, id LIMIT 32)"
_ROTATION = "rotation AS (SELECT published_at::DATE AS date, list(id) AS ids FROM published WHERE published_at IS NOT NULL GROUP BY 1)"


def _rotation(c: Corpus) -> DataFrame:
    return c.published.filter("published_at IS NOT NULL").groupBy(F.to_date("published_at").alias("date")).agg(F.collect_list("id").alias("entity_ids"))


def _pool(c: Corpus) -> DataFrame:
    return queues.shuffled(c.published.filter(F.col("consensus_score").cast("double") >= 0.7), F.md5(F.concat(F.lit("day"), "id")), 32).select("id", "draw")


@query(with_views("published") + f", {_POOL} SELECT id, draw FROM pool".replace("\n,", ","))
def featured_pool(c: Corpus) -> DataFrame:
    return _pool(c)


_RECENT = "recent AS (SELECT DISTINCT unnest(ids) AS id FROM rotation WHERE date >= (SELECT max(date) FROM rotation) - INTERVAL 7 DAY)"


@query(with_views("published") + f", {_POOL}, {_ROTATION}, {_RECENT} SELECT p.id, (r.id IS NOT NULL)::INT AS recent FROM pool p LEFT JOIN recent r ON r.id = p.id ORDER BY recent, draw, p.id LIMIT 8")
def featured_topup(c: Corpus) -> DataFrame:
    rotation = _rotation(c)
    last = rotation.agg(F.max("date")).first()[0]
    recent = queues.recent_ids(rotation, F.date_sub(F.lit(last), 7))
    return queues.topped_up(_pool(c), recent, 8).select("id", "recent")


@query(
    with_views("published")
    + f""", {_POOL}, {_ROTATION}, {_RECENT}, picks AS (SELECT p.id, r.id IS NOT NULL AS recent, draw FROM pool p LEFT JOIN recent r ON r.id = p.id ORDER BY recent, draw, p.id LIMIT 30)
       SELECT strftime(date, '%Y-%m-%d') AS date, list_sort(ids)[1] AS first_id, len(ids) AS n FROM rotation WHERE date < (SELECT max(date) FROM rotation)
       UNION ALL SELECT strftime((SELECT max(date) FROM rotation), '%Y-%m-%d'), (SELECT id FROM picks ORDER BY recent, draw, id LIMIT 1), (SELECT count(*) FROM picks)"""
)
def featured_refreshed(c: Corpus) -> DataFrame:
    """The rotation after the latest day was drawn again; its first id is the first drawn, elsewhere the smallest."""
    rotation = _rotation(c)
    last = rotation.agg(F.max("date")).first()[0]
    after = queues.refreshed(rotation, _pool(c), F.lit(last), 30)
    first = F.when(F.col("date") == F.lit(last), F.get("entity_ids", F.lit(0))).otherwise(F.array_min("entity_ids"))
    return after.select(F.date_format("date", "yyyy-MM-dd").alias("date"), first.alias("first_id"), F.size("entity_ids").cast("bigint").alias("n"))


@query(with_views("published") + f", {_ROTATION} SELECT {_STUB} FROM entities WHERE id IN (SELECT unnest(ids) FROM (SELECT * FROM rotation ORDER BY (date <> DATE '1999-01-01'), date DESC LIMIT 1))")
def featured_today(c: Corpus) -> DataFrame:
    return stub(lists.by_rows(c.entities, queues.rotation_of(_rotation(c), "1999-01-01")))
