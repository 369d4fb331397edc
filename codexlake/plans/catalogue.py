"""Every registered query of the core engine and the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.corpus import Corpus
from codexlake.operators import nearby

from . import listing, quality, searching, tools  # noqa: F401  registers their queries
from .registry import ORACLES, QUERIES, query

P1_RADIUS_KM = 2.0


def _places(c: Corpus) -> DataFrame:
    return c.entities.select("id", F.col("coords.lat").alias("lat"), F.col("coords.lng").alias("lng"))


_PLACES = """p AS (SELECT id, coords.lat AS lat, CASE WHEN coords.lng > 180 THEN coords.lng - 360 ELSE coords.lng END AS lng FROM entities
    WHERE coords.lat BETWEEN -90 AND 90 AND NOT isnan(coords.lat) AND isfinite(coords.lng) AND NOT (coords.lat = 0 AND coords.lng = 0))"""


@query(
    f"""WITH {_PLACES}, u AS (SELECT id, lat, lng, cos(radians(lat)) * cos(radians(lng)) AS x, cos(radians(lat)) * sin(radians(lng)) AS y, sin(radians(lat)) AS z FROM p),
    e AS (SELECT zone_id, unnest(outline) AS a, unnest(outline[2:] || outline[:1]) AS b FROM map_zones),
    t AS (SELECT id, lat, lng + turn AS lng FROM p, (SELECT unnest([-360, 0, 360]) AS turn))
    SELECT a.id AS id_a, b.id AS id_b FROM u a JOIN u b ON a.id < b.id AND abs(a.z - b.z) < 0.001 AND abs(a.x - b.x) < 0.001
      AND 2 * 6371.0088 * asin(least(1, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / 2)) <= {P1_RADIUS_KM}
    UNION SELECT id, zone_id FROM t JOIN e ON (e.a.lng > t.lng) <> (e.b.lng > t.lng) AND e.a.lat + (t.lng - e.a.lng) * (e.b.lat - e.a.lat) / (e.b.lng - e.a.lng) < t.lat
      GROUP BY id, t.lng, zone_id HAVING count(*) % 2 = 1"""
)
def p1_found(c: Corpus) -> DataFrame:
    return nearby.near_or_inside(_places(c), c.raw("map_zones"), P1_RADIUS_KM)


@query(
    f"""WITH {_PLACES}, s AS (SELECT DISTINCT id, lat, lng FROM p), n AS (SELECT lat, lng, min(id) AS first_id, count(*) AS n_ids FROM s GROUP BY ALL),
    u AS (SELECT *, cos(radians(lat)) * cos(radians(lng)) AS x, cos(radians(lat)) * sin(radians(lng)) AS y, sin(radians(lat)) AS z FROM n),
    k AS (SELECT a.first_id, count(*) AS n_near FROM u a JOIN u b ON a.first_id <> b.first_id AND abs(a.z - b.z) < 0.001 AND abs(a.x - b.x) < 0.001
          AND 2 * 6371.0088 * asin(least(1, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / 2)) <= {P1_RADIUS_KM} GROUP BY 1)
    SELECT s.id, n.first_id, n.n_ids, coalesce(k.n_near, 0) AS n_near FROM s JOIN n ON n.lat = s.lat AND n.lng = s.lng LEFT JOIN k ON k.first_id = n.first_id"""
)
def p1_places(c: Corpus) -> DataFrame:
    """Each entity with the first entity and the number of entities at its place, and how many other places are near."""
    members = nearby.places(_places(c))
    links = nearby.near_places(members, P1_RADIUS_KM)
    near = links.select(F.col("place_a").alias("place_id")).unionByName(links.select(F.col("place_b").alias("place_id"))).groupBy("place_id").agg(F.count(F.lit(1)).alias("n_near"))
    named = members.groupBy("place_id").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_ids"))
    joined = members.join(named, "place_id").join(near, "place_id", "left")
    return joined.select("id", "first_id", "n_ids", F.coalesce("n_near", F.lit(0)).alias("n_near"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
