"""The tools' answers as tables, and round trips through sinks, dumps and readers."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.api import Tools
from codexlake.corpus import Corpus
from codexlake.functions.text import blank_wildcards
from codexlake.operators import lists, queues
from codexlake.runtime import shared_dir
from codexlake.sources import readers, sinks

from .listing import _POOL, _STUB, KIND, TOPIC, YEARS
from .registry import query, with_views
from .searching import _BARG, _VECTOR, BEGINNING, QUERY, _found, _query_vector

_STUB_SCHEMA = "id string, slug string, canonical_name string, entity_type string, short_description string, consensus_score double"
_TYPED = f"published AS (SELECT * FROM entities WHERE status = 'published' AND entity_type = '{KIND}')"


def _rows(c: Corpus, answer: dict, schema: str) -> DataFrame:
    """The bounded results of an answer, with its scores rounded."""
    names = [f.split()[0] for f in schema.split(", ")]
    made = c.spark.createDataFrame([tuple(r[n] for n in names) for r in answer["results"]], schema)
    return made.withColumn("consensus_score", F.round("consensus_score", 4)) if "consensus_score" in names else made


@query(
    f"WITH {_TYPED}"
    + _found(_BARG)
    + ", t AS (SELECT id, round(sum(w), 6) AS text_rank FROM found GROUP BY id ORDER BY text_rank DESC, id LIMIT 60)"
    + _VECTOR.replace("q AS (SELECT embedding AS asked FROM u ORDER BY id LIMIT 1)", "q AS (SELECT embedding::DOUBLE[] AS asked FROM entities WHERE status = 'published' AND len(embedding) = 1024 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 ORDER BY id LIMIT 1)")
    + f""", f AS (SELECT id AS key, round(sum(s), 9) AS fused_score FROM (SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY text_rank DESC, id)) AS s FROM t
          UNION ALL SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY distance, id)) FROM v) GROUP BY id ORDER BY fused_score DESC, id LIMIT 15)
       SELECT {_STUB}, fused_score FROM f JOIN published ON id = key"""
)
def tool_search_by_type(c: Corpus) -> DataFrame:
    return _rows(c, Tools(c).search_entities(QUERY, _query_vector(c), KIND, 15), _STUB_SCHEMA + ", fused_score double")


@query(
    with_views("published")
    + f""", a AS (SELECT entity_id, max(CASE WHEN starts_with(lower(alias), '{BEGINNING}v') THEN 2 WHEN contains(lower(alias), '{BEGINNING}v') THEN 1 ELSE 0 END) AS m FROM entity_aliases GROUP BY 1),
       s AS (SELECT p.*, greatest(CASE WHEN starts_with(lower(canonical_name), '{BEGINNING}v') THEN 2 WHEN contains(lower(canonical_name), '{BEGINNING}v') THEN 1 ELSE 0 END, coalesce(a.m, 0))::INT AS match FROM published p LEFT JOIN a ON a.entity_id = p.id)
       SELECT min(match) >= 0 AS known, '{BEGINNING}v' AS asked FROM s"""
)
def tool_suggest_asked(c: Corpus) -> DataFrame:
    """What a typed beginning with wildcards is asked as, and that each suggestion is a known entity."""
    typed = f" {BEGINNING}v%_ "
    known = c.entities.filter(F.col("id").isin([r["id"] for r in Tools(c).suggest(typed)["results"]])).count() == len(Tools(c).suggest(typed)["results"])
    return c.spark.createDataFrame([(known, blank_wildcards(typed))], "known boolean, asked string")


@query(
    with_views("topics")
    + """, e AS (SELECT * FROM entities ORDER BY slug LIMIT 1) SELECT id, slug, status, narrative, coalesce((SELECT string_agg(alias, '|' ORDER BY alias) FROM entity_aliases WHERE entity_id = e.id), '') AS aliases,
         coalesce((SELECT string_agg(topic, '|' ORDER BY topic) FROM topics WHERE entity_id = e.id), '') AS topics FROM e"""
)
def tool_get_entity(c: Corpus) -> DataFrame:
    slug = c.entities.agg(F.min("slug")).first()[0]
    found = Tools(c).get_entity(slug.upper(), "full")["entity"]
    return c.spark.createDataFrame([(found["id"], found["slug"], found["status"], found["narrative"], "|".join(found["aliases"]), "|".join(found["topics"]))], "id string, slug string, status string, narrative string, aliases string, topics string")


@query(with_views("edges", "nodes") + "SELECT predicate, e.target_id AS id, name FROM edges e JOIN nodes n ON n.id = e.target_id WHERE source_id = 'nation-7' AND predicate = 'located_in' ORDER BY predicate, e.target_id LIMIT 50")
def tool_get_related(c: Corpus) -> DataFrame:
    answer = Tools(c).get_related("nation-7", "located_in")
    return c.spark.createDataFrame([(r["predicate"], r["entity"]["id"], r["entity"]["name"]) for r in answer["results"]], "predicate string, id string, name string")


@query(with_views("published") + f"SELECT {_STUB} FROM published WHERE entity_type = 'person' ORDER BY canonical_name, id LIMIT 100 OFFSET 3")
def tool_list_by_type(c: Corpus) -> DataFrame:
    return _rows(c, Tools(c).list_by_type("person", 100, 3), _STUB_SCHEMA)


@query(with_views("published", "topics") + f"SELECT {_STUB} FROM published WHERE id IN (SELECT entity_id FROM topics WHERE topic = '{TOPIC}') ORDER BY canonical_name, id LIMIT 20")
def tool_list_by_topic(c: Corpus) -> DataFrame:
    return _rows(c, Tools(c).list_by_topic(f" {TOPIC.upper()} "), _STUB_SCHEMA)


@query(
    f"WITH {_TYPED}"
    + f""" SELECT {_STUB}, first_year FROM published JOIN (SELECT id AS key, min(y)::INT AS first_year FROM (SELECT id, unnest(from_json(key_dates, '[{{"year":"INTEGER"}}]')).year AS y FROM published)
        WHERE y BETWEEN {YEARS[0]} AND {YEARS[1] + 300} GROUP BY id) ON key = id ORDER BY first_year, id LIMIT 30"""
)
def tool_list_by_date_range(c: Corpus) -> DataFrame:
    return _rows(c, Tools(c).list_by_date_range(YEARS[0], YEARS[1] + 300, KIND, 30), _STUB_SCHEMA + ", first_year int")


@query(with_views("citations") + "SELECT claim_excerpt AS claim, claimed_source AS source, claimed_url AS url, claimed_author AS author, claim_kind AS kind, verified_by_second_model AS verified FROM citations WHERE entity_id = (SELECT max(entity_id) FROM citations)")
def tool_get_citations(c: Corpus) -> DataFrame:
    answer = Tools(c).get_citations(c.citations.agg(F.max("entity_id")).first()[0])
    return _rows(c, answer, "claim string, source string, url string, author string, kind string, verified boolean")


@query(with_views("runs") + "SELECT (SELECT string_agg(status || '=' || n, ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM entities GROUP BY 1)) AS counts, (SELECT max(id) FROM runs WHERE status = 'completed') AS last_run")
def tool_health(c: Corpus) -> DataFrame:
    found = Tools(c).health()
    return c.spark.createDataFrame([(",".join(f"{k}={v}" for k, v in sorted(found["counts"].items())), found["last_run"]["id"])], "counts string, last_run bigint")


@query("SELECT trim(name) AS name, trim(hint) AS hint, 'old' AS origin FROM seed_topics UNION ALL SELECT 'A seed of none', 'x | y', 'new'")
def tool_insert_seeds(c: Corpus) -> DataFrame:
    """The seed table after all of its own names, in capitals, and one new line were put in."""
    names = [r["name"] for r in c.seeds.select("name").collect()]
    after, _ = Tools(c).insert_seeds("\n".join([*(n.upper() for n in names), "A seed of none | x | y"]))
    return after.select(F.trim("name").alias("name"), F.trim("hint").alias("hint"), F.when(F.col("id").isNull(), "new").otherwise("old").alias("origin"))


@query(with_views("published") + ", pool AS (SELECT id, md5('2024-05-01' || id) AS draw FROM published WHERE consensus_score >= 0.7::DOUBLE ORDER BY draw, id LIMIT 24) SELECT id FROM (SELECT * FROM pool ORDER BY draw, id LIMIT 6)")
def tool_refresh_featured(c: Corpus) -> DataFrame:
    rotation = c.spark.createDataFrame([], "date date, entity_ids array<string>")
    return c.spark.createDataFrame([(i,) for i in Tools(c).refresh_featured(rotation, "2024-05-01", 6)[1]], "id string")


@query("SELECT true AS has_caveat, id, slug, round(consensus_score::DOUBLE, 4) AS consensus_score FROM entities")
def answers_as_json(c: Corpus) -> DataFrame:
    """Each entity as a JSON answer, read again."""
    made = sinks.answers(c.entities.select("id", "slug", "consensus_score"), pretty=True)
    back = made.select(F.from_json("json", "caveat string, result struct<id: string, slug: string, consensus_score: double>").alias("j"))
    return back.select((F.col("j.caveat") == sinks.CAVEAT).alias("has_caveat"), "j.result.id", "j.result.slug", F.round("j.result.consensus_score", 4).alias("consensus_score"))


@query("SELECT 'seed_topics' AS name, count(*) AS n FROM seed_topics UNION ALL SELECT 'entity_aliases', count(*) FROM entity_aliases UNION ALL SELECT 'documents', count(*) FROM documents")
def dump_restored(c: Corpus) -> DataFrame:
    """Tables dumped, and restored once the gate has counted them."""
    names = ("seed_topics", "entity_aliases", "documents")
    root = f"{shared_dir(c.spark)}/dump-{dt.datetime.now():%Y%m%d%H%M%S%f}"
    readers.dump({n: c.raw(n) for n in names}, root)
    back = readers.restored(c.spark, root, list(names), ("documents", 1))
    return c.spark.createDataFrame([(n, back[n].count()) for n in names], "name string, n bigint")


@query("SELECT slug FROM entities WHERE lower(slug) = (SELECT min(lower(slug)) FROM entities) UNION ALL SELECT 'no such slug'")
def snapshot_slugs(c: Corpus) -> DataFrame:
    """A snapshot file of one record read again: the slugs it has of those asked for, and those it lacks."""
    first = c.entities.orderBy(F.lower("slug")).select("id", "slug", "canonical_name").limit(1)
    path = f"{shared_dir(c.spark)}/snapshot-{dt.datetime.now():%Y%m%d%H%M%S%f}"
    first.select(F.concat(F.lit("["), F.to_json(F.struct("*")), F.lit("]")).alias("value")).coalesce(1).write.text(path)
    records, missing = readers.read_snapshot(c.spark, path, [first.first()["slug"], "no such slug"])
    return records.select("slug").unionByName(missing)


@query(with_views("published") + f", {_POOL} SELECT p.id, true AS is_whole FROM pool p")
def page_flags(c: Corpus) -> DataFrame:
    """A full page says that there may be another."""
    rows = queues.shuffled(c.published.filter(F.col("consensus_score").cast("double") >= 0.7), F.md5(F.concat(F.lit("day"), "id")), 32).select("id").collect()
    return c.spark.createDataFrame([(r["id"], lists.has_next(len(rows), len(rows))) for r in rows], "id string, is_whole boolean")


