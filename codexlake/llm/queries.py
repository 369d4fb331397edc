"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.runtime import table

from . import cooccur, knn, matching, mixing, neardup, spans, tokenize, truncation

P2_FIELDS = ("narrative", "summary")
P3_NEIGHBOURS, P3_SIMILARITY = 5, 0.6
P5_MIN_TOGETHER, P5_SHARE_OF, P5_LIFT = 3, 400, 3

P6_FIELDS, P6_WORDS, P6_SIMILARITY = ("narrative", "summary"), 3, 0.5


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_values(table(spark, sf_dir, "entities"), "id", P2_FIELDS, keep=("generator_model",))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).filter("is_cut").select("id", "field")


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_shares(_judged(spark, sf_dir), ("generator_model", "field"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest(table(spark, sf_dir, "entities"), P3_NEIGHBOURS, min_similarity=P3_SIMILARITY)


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.pairs_of(_neighbours(spark, sf_dir))


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    citations = table(spark, sf_dir, "entity_claimed_citations").selectExpr("id AS citation_id", "claimed_source AS source", "claimed_author AS author")
    works = table(spark, sf_dir, "bib_works").selectExpr("work_id", "title", "author_families AS families", "pub_year AS year")
    return matching.match(citations, works)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_matches(spark, sf_dir).select("work_id", "citation_id").distinct()


def _topics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, F.Column]:
    return table(spark, sf_dir, "entity_topics"), "entity_id", F.lower(F.trim("topic"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccur.together(*_topics(spark, sf_dir), min_together=P5_MIN_TOGETHER, min_share_of=P5_SHARE_OF, min_lift=P5_LIFT)
    return pairs.select(F.col("item_a").alias("topic_a"), F.col("item_b").alias("topic_b"))


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccur.together(*_topics(spark, sf_dir))
    return pairs.select(F.col("item_a").alias("topic_a"), F.col("item_b").alias("topic_b"), "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"))


def _copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return neardup.classes_and_links(table(spark, sf_dir, "entities"), "id", P6_FIELDS, words=P6_WORDS, threshold=P6_SIMILARITY)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.pairs_of(*_copies(spark, sf_dir))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups_of(*_copies(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_texts(table(spark, sf_dir, "documents"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = tokenize.encode_texts(table(spark, sf_dir, "documents"), counts_only=True, keep=("source",))
    return mixing.mix(sizes, table(spark, sf_dir, "mix_targets"), id_col="doc_id", size_col="n_tokens")


def p8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0].withColumnsRenamed({"id": "doc_id", "size": "n_tokens"})


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents"))


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return spans.shared_portion(documents, spans.shared_spans(documents)).withColumn("shared_share", F.round("shared_share", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_shares, p3_found, p3_neighbours, p4_found, p4_matches, p5_found, p5_pairs, p6_found, p6_groups, p7_ids, p8_copies, p8_shares, p9_found, p9_shared)}


_TOPIC_COUNTS = """
WITH t AS (SELECT DISTINCT entity_id, lower(trim(topic)) AS topic FROM entity_topics WHERE entity_id IS NOT NULL AND topic IS NOT NULL),
     n AS (SELECT topic, count(*) AS n FROM t GROUP BY topic),
     e AS (SELECT count(DISTINCT entity_id) AS n FROM t),
     p AS (SELECT a.topic AS topic_a, b.topic AS topic_b, count(*) AS n_ab
           FROM t a JOIN t b ON a.entity_id = b.entity_id AND a.topic < b.topic GROUP BY ALL)
"""


_NEAREST = f"""
WITH v AS (SELECT id, embedding::DOUBLE[] AS e FROM entities WHERE len(embedding) = 1024
           AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     u AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
     s AS (SELECT a.id, b.id AS neighbour, list_dot_product(a.e, b.e) / (a.n * b.n) AS similarity FROM u a JOIN u b ON a.id <> b.id),
     r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS k FROM s WHERE similarity >= {P3_SIMILARITY})
"""
_SHINGLES = f"""
WITH t AS (SELECT 'narrative' AS field, id, narrative AS text FROM entities UNION ALL SELECT 'summary', id, summary FROM entities),
     w AS (SELECT field, id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM t),
     g AS (SELECT DISTINCT field, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= {P6_WORDS}),
     n AS (SELECT field, id, count(*) AS n FROM g GROUP BY ALL),
     p AS (SELECT a.field, a.id AS id_a, b.id AS id_b, count(*) AS n FROM g a JOIN g b ON a.field = b.field AND a.s = b.s AND a.id < b.id GROUP BY ALL)
"""
_RECURSIVE_GROUPS = f""", h AS (SELECT field, id, list(s ORDER BY s) AS content FROM g GROUP BY ALL),
     c AS (SELECT field, id, min(id) OVER (PARTITION BY field, content) AS class_id FROM h),
     l AS (SELECT DISTINCT p.field, x.class_id AS a, y.class_id AS b FROM p JOIN n a ON a.field = p.field AND a.id = id_a JOIN n b ON b.field = p.field AND b.id = id_b
           JOIN c x ON x.field = p.field AND x.id = id_a JOIN c y ON y.field = p.field AND y.id = id_b WHERE p.n >= {P6_SIMILARITY} * (a.n + b.n - p.n) AND x.class_id <> y.class_id),
     e AS (SELECT field, a, b FROM l UNION SELECT field, b, a FROM l),
     k AS (SELECT field, a AS class_id, count(*) AS n_links FROM e GROUP BY ALL),
     r AS (SELECT DISTINCT field, a AS x, a AS y FROM e UNION SELECT r.field, r.x, e.b FROM r JOIN e ON e.field = r.field AND e.a = r.y),
     m AS (SELECT field, x AS class_id, min(y) AS group_id FROM r GROUP BY ALL)"""
_SPANS = """
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 120),
     w AS (SELECT doc_id, i, hash(substring(text, (i + 1)::INT, 120)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 119)) AS i FROM d)),
     shared AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
     r AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 120 THEN 0 ELSE 1 END AS fresh FROM w WHERE h IN (SELECT h FROM shared)),
     k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS stretch FROM r),
     spans AS (SELECT doc_id, min(i)::BIGINT AS span_start, (max(i) + 120)::BIGINT AS span_end FROM k GROUP BY doc_id, stretch)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _NEAREST + f"SELECT DISTINCT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM r WHERE k <= {P3_NEIGHBOURS}",
        "p3_neighbours": _NEAREST + f"SELECT id, neighbour, round(similarity, 6) AS similarity FROM r WHERE k <= {P3_NEIGHBOURS}",
        "p6_found": _SHINGLES + f"SELECT p.field, id_a, id_b FROM p JOIN n a ON a.field = p.field AND a.id = id_a JOIN n b ON b.field = p.field AND b.id = id_b WHERE p.n >= {P6_SIMILARITY} * (a.n + b.n - p.n)",
        "p6_groups": _SHINGLES.replace("WITH t", "WITH RECURSIVE t", 1)
        + f"""{_RECURSIVE_GROUPS}
             SELECT c.field, c.id, c.class_id, coalesce(m.group_id, c.class_id) AS group_id, coalesce(k.n_links, 0) AS n_links
             FROM c LEFT JOIN m ON m.field = c.field AND m.class_id = c.class_id LEFT JOIN k ON k.field = c.field AND k.class_id = c.class_id""",
        "p9_found": _SPANS + "SELECT * FROM spans",
        "p9_shared": _SPANS
        + """, s AS (SELECT doc_id, count(*) AS n_spans, sum(span_end - span_start)::BIGINT AS shared_chars FROM spans GROUP BY 1)
             SELECT d.doc_id, coalesce(length(d.text), 0)::BIGINT AS n_chars, coalesce(n_spans, 0) AS n_spans, coalesce(shared_chars, 0) AS shared_chars,
                    CASE WHEN length(d.text) > 0 THEN round(coalesce(shared_chars, 0) / length(d.text)::DOUBLE, 6) ELSE 0.0 END AS shared_share
             FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id""",
        "p5_found": _TOPIC_COUNTS
        + f"""SELECT p.topic_a, p.topic_b FROM p JOIN n a ON a.topic = p.topic_a JOIN n b ON b.topic = p.topic_b, e
              WHERE n_ab >= {P5_MIN_TOGETHER} AND {P5_SHARE_OF} * n_ab >= e.n AND n_ab * e.n >= {P5_LIFT} * a.n * b.n""",
        "p5_pairs": _TOPIC_COUNTS
        + """SELECT p.topic_a, p.topic_b, a.n AS n_a, b.n AS n_b, n_ab, round(n_ab * e.n::DOUBLE / (a.n * b.n), 6) AS lift
             FROM p JOIN n a ON a.topic = p.topic_a JOIN n b ON b.topic = p.topic_b, e""",
    }
