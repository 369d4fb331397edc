"""Text ranking, vector ranking, their fusion, and suggestion of names."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexlake.functions import stemming, text, vector
from codexlake.functions.scoring import reciprocal_rank
from codexlake.operators.lists import page
from codexlake.schema import STUB

# The weights of the fields of an entity's search text.
WEIGHTS = {"canonical_name": 1.0, "short_description": 0.4, "summary": 0.2}
POOL = 60
SIMILAR = 0.4


def search_text(entities: DataFrame) -> DataFrame:
    """(id, lexeme, places ARRAY<STRUCT<position, weight>>): the search text of each entity as stemmed lexemes with their
    positions, its fields after each other; stop words have positions but no rows. Other columns are ignored."""
    fields = list(WEIGHTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.struct([("position", pa.int32()), ("weight", pa.float64())])
        for batch in batches:
            ids, lexemes, places = [], [], []
            for i, row in zip(batch.column("id").to_pylist(), zip(*(batch.column(f).to_pylist() for f in fields))):
                for lexeme, own in stemming.positions(list(zip(row, WEIGHTS.values()))).items():
                    ids.append(i)
                    lexemes.append(lexeme)
                    places.append([{"position": p, "weight": w} for p, w in own])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lexemes, pa.string()), pa.array(places, pa.list_(place))], names=["id", "lexeme", "places"])

    return entities.select("id", *fields).mapInArrow(run, "id string, lexeme string, places array<struct<position: int, weight: double>>")


def postings(entities: DataFrame) -> DataFrame:
    """(id, word, field, weight, n): how often each word, unstemmed and no stop word, stands in each field."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(w).alias("weight"), text.lexemes(F.col(f)).alias("words")) for f, w in WEIGHTS.items()))
    each = entities.select("id", F.explode(fields).alias("f")).select("id", "f.field", "f.weight", F.explode("f.words").alias("word"))
    return each.groupBy("id", "word", "field", "weight").agg(F.count(F.lit(1)).alias("n"))


def text_ranked(entities: DataFrame, query: str, limit: int = POOL) -> DataFrame:
    """(id, text_rank): the entities whose text holds every stem of the query, by cover density.

    A built-in test that each stem's beginning occurs goes first, so that Python sees few rows; it stems their words and
    ranks them, and only `limit` rows of each task reach the merge. A query of stop words alone finds nothing; null
    fields hold no words; equal ranks go by id.
    """
    asked = sorted(set(stemming.stems(query)))
    if not asked:
        return entities.select("id", F.lit(0.0).alias("text_rank")).limit(0)
    fields = list(WEIGHTS)
    whole = F.lower(F.concat_ws(" ", *fields))
    may_hold = functools.reduce(Column.__and__, (F.contains(whole, F.lit(stemming.hint(a))) for a in asked))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ranks = [], []
            for i, row in zip(batch.column("id").to_pylist(), zip(*(batch.column(f).to_pylist() for f in fields))):
                score = stemming.cover_density(asked, list(zip(row, WEIGHTS.values())))
                if score > 0:
                    ids.append(i)
                    ranks.append(round(score, 6))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(ranks, pa.float64())], names=["id", "text_rank"])

    ranked = entities.filter(may_hold).select("id", *fields).mapInArrow(rank, "id string, text_rank double")
    return page(ranked, (F.desc("text_rank"), "id"), limit)


def vector_ranked(entities: DataFrame, query: list[float], limit: int = POOL, dim: int = 1024) -> DataFrame:
    """(id, distance): the entities with usable vectors closest by cosine distance, by an exact scan.

    Whole Arrow batches are multiplied at once, as array functions would go element by element; of each batch only rows
    that can be among the closest leave the worker. A query without length is as far from everything.
    """
    asked = np.array(query, np.float64)
    asked /= np.linalg.norm(asked) or 1.0

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, matrix = vector.matrix_of(batch.column("embedding"), dim)
            far = 1 - (matrix @ asked) / np.linalg.norm(matrix, axis=1)
            if len(far) > limit:
                near = np.flatnonzero(far <= np.partition(far, limit - 1)[limit - 1] + 1e-6)
                rows, far = rows[near], far[near]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(far)], names=["id", "distance"])

    scored = entities.select("id", F.col("embedding").cast("array<double>")).filter(F.size("embedding") == dim).mapInArrow(measure, "id string, distance double")
    return page(scored.withColumn("distance", F.round("distance", 6)), ("distance", "id"), limit)


def fused(entities: DataFrame, by_text: DataFrame, by_vector: DataFrame, limit: int) -> DataFrame:
    """Entities by the summed reciprocal ranks of two short lists; the windows see no more rows than the lists hold."""
    one = by_text.select("id", F.row_number().over(Window.orderBy(F.desc("text_rank"), "id")).alias("rank"))
    two = by_vector.select("id", F.row_number().over(Window.orderBy("distance", "id")).alias("rank"))
    scores = one.unionByName(two).groupBy("id").agg(F.round(F.sum(reciprocal_rank(F.col("rank"))), 9).alias("fused_score"))
    best = page(scores, (F.desc("fused_score"), "id"), limit)
    return entities.select(*STUB).join(best, "id")


def hybrid(published: DataFrame, query: str, query_vector: list[float], limit: int = 10, entity_type: str | None = None) -> DataFrame:
    chosen = published if entity_type is None else published.filter(F.col("entity_type") == entity_type)
    return fused(chosen, text_ranked(chosen, query), vector_ranked(chosen, query_vector), limit)


def suggest(published: DataFrame, aliases: DataFrame, query: str, limit: int = 8, fuzzy: bool = True, nulls_as_written: bool = False) -> DataFrame:
    """Names for a typed beginning: prefix before substring before similarity, then short names, then consensus.

    Queries of fewer than two characters give nothing. With nulls_as_written, entities without aliases that match only
    by similarity come before substring matches, as their missing alias match sorts first.
    """
    asked = text.blank_wildcards(query)
    if len(asked) < 2:
        return published.select(*STUB).limit(0)
    low = F.lit(asked.lower())

    def similar(value: Column) -> Column:
        near = text.trigram_overlap(low, value) > SIMILAR
        return F.when(near, text.word_similarity(low, value)).otherwise(F.lit(0.0)) if fuzzy else F.lit(0.0)

    alias = F.lower("alias")
    matches = F.when(alias.startswith(low), 2).when(alias.contains(low), 1).otherwise(0)
    by_alias = aliases.groupBy("entity_id").agg(F.max(matches).alias("alias_match"), F.max(similar(F.col("alias"))).alias("alias_similarity")).withColumnRenamed("entity_id", "id")
    name = F.lower("canonical_name")
    joined = published.select(*STUB).join(by_alias, "id", "left")
    own = F.when(name.startswith(low), 2).when(name.contains(low), 1).otherwise(0)
    scored = joined.withColumn("match", F.greatest(own, F.coalesce("alias_match", F.lit(0)))).withColumn("similarity", F.round(F.greatest(similar(F.col("canonical_name")), F.coalesce("alias_similarity", F.lit(0.0))), 6))
    kept = scored.filter((F.col("match") > 0) | (F.col("similarity") > SIMILAR))
    contains = F.when((F.col("match") == 0) & F.col("alias_match").isNull(), F.lit(None)).otherwise(F.col("match") > 0) if nulls_as_written else F.col("match") > 0
    order = ((F.col("match") == 2).desc(), contains.desc_nulls_first(), F.desc("similarity"), F.length("canonical_name"), F.desc("consensus_score"), F.col("id"))
    return page(kept, order, limit).select(*STUB, "match", "similarity")
