"""Snapshots of entities with all that belongs to them, and their restoration, from tables or from a file's records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.operators.mutations import replace_children

#: Columns that a restoration leaves as they are.
KEPT = ("id", "created_at")
#: Children of an entity; of reviews only open ones are captured and replaced.
CHILDREN = ("aliases", "topics", "citations", "claims", "reviews")


def _open(name: str, rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("resolved_at").isNull()) if name == "reviews" else rows


def captured(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The rows of `entities` and of its children that belong to the ids: (id); relationships are not captured."""
    own = ids.select("id").distinct()
    taken = {"entities": tables["entities"].join(own, "id", "left_semi")}
    for name in CHILDREN:
        taken[name] = _open(name, tables[name]).join(own.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi").select(*tables[name].columns)
    return taken


def _content(entities: DataFrame, taken: DataFrame, now: Column, present: Column | None = None) -> DataFrame:
    """entities with the snapshot's columns where it has the id; `present` says which of its rows count."""
    columns = [c for c in taken.columns if c in entities.columns and c not in (*KEPT, "updated_at")]
    new = (taken if present is None else taken.filter(present)).select("id", F.struct(*columns).alias("__new"))
    joined = entities.join(new, "id", "left")
    held = F.col("__new").isNotNull()
    return joined.select(*(F.when(held, now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.when(held, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in entities.columns))


def restored(tables: dict[str, DataFrame], taken: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """All tables with the captured entities as they were: their content columns set, updated_at now, their children
    replaced, open reviews among them; an entity that is gone is not brought back, nor are its children."""
    ids = taken["entities"].select("id").join(tables["entities"].select("id"), "id", "left_semi")
    out = {"entities": _content(tables["entities"], taken["entities"], now)}
    parents = ids.withColumnRenamed("id", "entity_id")
    for name in CHILDREN:
        back = taken[name].join(parents, "entity_id", "left_semi").select(*tables[name].columns)
        if name == "reviews":
            done = tables[name].filter(F.col("resolved_at").isNotNull())
            out[name] = done.unionByName(replace_children(_open(name, tables[name]), parents, back, "entity_id"))
        else:
            out[name] = replace_children(tables[name], parents, back, "entity_id")
    return out


def applied(tables: dict[str, DataFrame], records: DataFrame, now: Column) -> dict[str, DataFrame]:
    """All tables with the records of a file snapshot applied: entity columns set, updated_at now, aliases, topics and
    citations replaced, each once, and claims, which describe the discarded text, dropped; reviews stay.

    records: (id, content columns, aliases, topics ARRAY<STRING>, citations ARRAY<STRUCT<claim, source, url, author, kind>>).
    Ids of new children are null until the store numbers them; a null list has no children.
    """
    def children(name: str, list_column: str, made: dict[str, Column]) -> DataFrame:
        columns = tables[name].schema
        each = records.select(F.col("id").alias("entity_id"), F.explode(list_column).alias("x")).distinct()
        return each.select(*(F.col("entity_id") if f.name == "entity_id" else (made[f.name] if f.name in made else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns))

    x = F.col("x")
    made = {
        "aliases": ("aliases", {"alias": x}),
        "topics": ("topics", {"topic": x}),
        "citations": ("citations", {"claim_excerpt": x["claim"], "claimed_source": x["source"], "claimed_url": x["url"], "claimed_author": x["author"], "claim_kind": F.coalesce(x["kind"], F.lit("other")), "verified_by_second_model": F.lit(False), "resolution_status": F.lit("unchecked")}),
    }
    parents = records.select(F.col("id").alias("entity_id"))
    out = {"entities": _content(tables["entities"], records.drop("aliases", "topics", "citations"), now), "reviews": tables["reviews"]}
    for name, (column, values) in made.items():
        out[name] = replace_children(tables[name], parents, children(name, column, values), "entity_id")
    out["claims"] = tables["claims"].join(parents.distinct(), "entity_id", "left_anti").select(*tables["claims"].columns)
    return out
