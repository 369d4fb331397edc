"""The tools of the engine: checked arguments in, bounded answers out."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.corpus import Corpus
from codexlake.operators import lists, mutations, queues, search
from codexlake.schema import ENTITY_TYPES, STUB
from codexlake.sources import readers
from codexlake.sources.sinks import CAVEAT


def _limit(value: int, most: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
        raise ValueError(f"limit must be a whole number from 1 to {most}")
    return value


def _offset(value: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError("offset must be a whole number, 0 or more")
    return value


def _kind(value: str | None, needed: bool = False) -> str | None:
    if value is None and not needed:
        return None
    if value not in ENTITY_TYPES:
        raise ValueError(f"entity type must be one of {', '.join(ENTITY_TYPES)}")
    return value


def _answer(rows: DataFrame) -> dict:
    """A bounded list of rows with the caveat."""
    return {"caveat": CAVEAT, "results": [row.asDict(recursive=True) for row in rows.collect()]}


class Tools:
    """Queries over one corpus for a caller that wants plain values; each collects at most its limit of rows."""

    def __init__(self, corpus: Corpus):
        self.corpus = corpus

    def search_entities(self, query: str, vector: list[float], entity_type: str | None = None, limit: int = 10) -> dict:
        return _answer(search.hybrid(self.corpus.published, query, vector, _limit(limit, 50), _kind(entity_type)))

    def suggest(self, query: str, limit: int = 8) -> dict:
        return _answer(search.suggest(self.corpus.published, self.corpus.aliases, query, _limit(limit, 50)))

    def get_entity(self, key: str, depth: str = "light") -> dict:
        if depth not in ("light", "full"):
            raise ValueError("depth must be light or full")
        found = lists.by_key(self.corpus.entities, key)
        if depth == "full":
            found = lists.full(found, self.corpus.aliases, self.corpus.topics).drop("embedding")
        else:
            found = found.select(*STUB, "disambiguator", "status", "summary", "generator_model", "verifier_model", "published_at")
        rows = found.limit(1).collect()
        return {"caveat": CAVEAT, "entity": rows[0].asDict(recursive=True)} if rows else {"caveat": CAVEAT, "error": "not_found"}

    def get_related(self, source: str, predicate: str | None = None) -> dict:
        return _answer(lists.related(self.corpus.relationships, self.corpus.nodes, source, predicate))

    def list_by_type(self, entity_type: str, limit: int = 20, offset: int = 0) -> dict:
        return _answer(lists.by_type(self.corpus.published, _kind(entity_type, needed=True), _limit(limit, 100), _offset(offset)))

    def list_by_topic(self, topic: str, limit: int = 20, offset: int = 0) -> dict:
        return _answer(lists.by_topic(self.corpus.published, self.corpus.topics, topic, _limit(limit, 100), _offset(offset)))

    def list_by_date_range(self, first: int, last: int, entity_type: str | None = None, limit: int = 20) -> dict:
        if first > last:
            raise ValueError("the first year must not be after the last")
        return _answer(lists.by_years(self.corpus.published, first, last, _limit(limit, 100), _kind(entity_type)))

    def get_citations(self, entity_id: str, limit: int = 100) -> dict:
        own = self.corpus.citations.filter(F.col("entity_id") == entity_id)
        rows = lists.page(own, ("id",), _limit(limit, 100))
        return _answer(rows.select(F.col("claim_excerpt").alias("claim"), F.col("claimed_source").alias("source"), F.col("claimed_url").alias("url"), F.col("claimed_author").alias("author"), F.col("claim_kind").alias("kind"), F.col("verified_by_second_model").alias("verified")))

    def insert_seeds(self, text: str) -> tuple[DataFrame, int]:
        """(seed table afterwards, number of seeds added) from lines `name | hint`; names that are there, in any case, stay."""
        spark, seeds = self.corpus.spark, self.corpus.seeds
        lines = readers.parse_seed_lines(spark.createDataFrame([(x,) for x in text.splitlines()], "value string"))
        made = {"name": F.col("name"), "hint": F.col("hint"), "status": F.lit("pending"), "priority": F.lit(0), "created_at": F.current_timestamp()}
        new = lines.select(*((made[f.name] if f.name in made else F.lit(None)).cast(f.dataType).alias(f.name) for f in seeds.schema), F.lower(F.trim("name")).alias("__key"))
        after, added = mutations.inserted(seeds.withColumn("__key", F.lower(F.trim("name"))), new, ["__key"])
        return after.drop("__key"), added

    def refresh_featured(self, rotation: DataFrame, date: str, count: int = 8, draw: str = "") -> tuple[DataFrame, list[str]]:
        """(rotation afterwards, ids of the date): published entities of consensus 0.7 or more, drawn by a hash."""
        pool = queues.shuffled(self.corpus.published.filter(F.col("consensus_score").cast("double") >= 0.7), F.md5(F.concat(F.lit(draw + date), "id")), 4 * _limit(count, 50)).select("id", "draw")
        after = queues.refreshed(rotation, pool, F.lit(date).cast("date"), count)
        return after, after.filter(F.col("date") == F.lit(date).cast("date")).first()["entity_ids"]

    def health(self) -> dict:
        began = time.perf_counter()
        counted = self.corpus.entities.groupBy("status").count().collect()
        last = lists.page(self.corpus.runs.filter("status = 'completed'"), (F.desc("id"),), 1).collect()
        return {"counts": {r["status"]: r["count"] for r in counted}, "last_run": last[0].asDict() if last else None, "latency_ms": round(1000 * (time.perf_counter() - began))}
