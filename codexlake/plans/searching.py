"""Hybrid search, its branches, and suggestion of names."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.corpus import Corpus
from codexlake.functions.text import STOP_WORDS
from codexlake.operators import search

from .listing import _STUB, stub
from .registry import query, with_views

QUERY, BEGINNING = "the barges", "sil"
_DIM = 1024
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_USABLE = f"embedding IS NOT NULL AND len(embedding) = {_DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


def _query_vector(c: Corpus) -> list[float]:
    """The vector of the first published entity that has a usable one, as a query."""
    from codexlake.functions.vector import usable

    row = c.published.filter(usable(F.col("embedding"), _DIM)).orderBy("id").select("embedding").first()
    return [float(x) for x in row[0]] if row else [0.0] * _DIM


#: The words with each stem that the queries ask for, from the published algorithm.
_BARG, _COURT = "^barg(e|es|ed|ing|edly|ingly)$", "^court(s|ed|ing|ly|edly|ingly)?$"
_TOKENS = r"\d+(?:\.\d+)+|\p{L}[\p{L}\p{N}]*(?:-[\p{L}\p{N}]+)+|[\p{L}\p{N}]+"


def _found(*stems: str) -> str:
    """SQL: (id, p, w, s) of the occurrences of the words of the stems, numbered from 0, in the fields after each other."""
    views, before = [], "0"
    for n, (field, weight) in enumerate(search.WEIGHTS.items()):
        each = f"regexp_extract_all(lower(coalesce({field}, '')), '{_TOKENS}')"
        views.append(f"t{n} AS (SELECT id, flatten(list_transform({each}, lambda x: CASE WHEN contains(x, '-') THEN list_concat([x], string_split(x, '-')) ELSE [x] END)) AS words FROM published)")
        views.append(f"l{n} AS (SELECT t{n}.id, t{n}.words, {before} AS before, coalesce(list_max(list_filter(range(1, len(t{n}.words) + 1), lambda i: t{n}.words[i] NOT IN ({_STOP}))), 0) AS last FROM t{n}{f' JOIN l{n - 1} ON l{n - 1}.id = t{n}.id' if n else ''})")
        before = f"(CASE WHEN l{n}.last > 0 THEN l{n}.before + l{n}.last ELSE l{n}.before END)"
    stem = "CASE " + " ".join(f"WHEN regexp_matches(word, '{pattern}') THEN {k}" for k, pattern in enumerate(stems)) + " END"
    each = " UNION ALL ".join(f"SELECT id, before + i AS p, {weight}::DOUBLE AS w, words[i] AS word FROM (SELECT id, before, words, unnest(range(1, len(words) + 1)) AS i FROM l{n})" for n, weight in enumerate(search.WEIGHTS.values()))
    return ", " + ", ".join(views) + f", found AS (SELECT id, p, w, {stem} AS s FROM ({each}) WHERE {stem} IS NOT NULL)"


_TEXT = _found(_BARG) + ", t AS (SELECT id, round(sum(w), 6) AS text_rank FROM found GROUP BY id ORDER BY text_rank DESC, id LIMIT 60)"
#: With two stems a least span that holds both lies between neighbours of different stems.
_COVERS = (
    _found(_BARG, _COURT)
    + """, n AS (SELECT id, p, w, s, lag(p) OVER o AS p0, lag(w) OVER o AS w0, lag(s) OVER o AS s0 FROM found WINDOW o AS (PARTITION BY id ORDER BY p))
       SELECT id, round(sum(2 / (1 / w + 1 / w0) / (p - p0)), 6) AS text_rank FROM n WHERE s <> s0 GROUP BY id ORDER BY text_rank DESC, id LIMIT 60"""
)
_VECTOR = f""", u AS (SELECT id, embedding::DOUBLE[] AS embedding FROM published WHERE {_USABLE}), q AS (SELECT embedding AS asked FROM u ORDER BY id LIMIT 1),
 v AS (SELECT id, round(1 - list_dot_product(embedding, asked) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(asked, asked))), 6) AS distance FROM u, q ORDER BY distance, id LIMIT 60)"""


@query(with_views("published") + _TEXT + " SELECT * FROM t")
def text_rank_topk(c: Corpus) -> DataFrame:
    return search.text_ranked(c.published, QUERY)


@query(with_views("published") + _VECTOR + " SELECT * FROM v")
def vector_topk(c: Corpus) -> DataFrame:
    return search.vector_ranked(c.published, _query_vector(c))


@query(
    with_views("published")
    + _TEXT
    + _VECTOR
    + f""", f AS (SELECT id AS key, round(sum(s), 9) AS fused_score FROM (SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY text_rank DESC, id)) AS s FROM t
          UNION ALL SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY distance, id)) FROM v) GROUP BY id ORDER BY fused_score DESC, id LIMIT 10)
       SELECT {_STUB}, fused_score FROM f JOIN published ON id = key"""
)
def hybrid_rrf(c: Corpus) -> DataFrame:
    return stub(search.hybrid(c.published, QUERY, _query_vector(c), 10), "fused_score")


@query(with_views("published") + _COVERS)
def cover_density_topk(c: Corpus) -> DataFrame:
    return search.text_ranked(c.published, "barges of the Court")


@query(
    with_views("published")
    + f"""SELECT id, word, field, count(*) AS n FROM ({' UNION ALL '.join(f"SELECT id, '{f}' AS field, unnest(list_filter(string_split_regex(lower({f}), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ({_STOP}))) AS word FROM published" for f in search.WEIGHTS)}) GROUP BY ALL"""
)
def weighted_postings(c: Corpus) -> DataFrame:
    return search.postings(c.published).select("id", "word", "field", "n")


@query(
    with_views("published")
    + f""", a AS (SELECT entity_id, max(CASE WHEN starts_with(lower(alias), '{BEGINNING}') THEN 2 WHEN contains(lower(alias), '{BEGINNING}') THEN 1 ELSE 0 END) AS m FROM entity_aliases GROUP BY 1),
       s AS (SELECT p.*, greatest(CASE WHEN starts_with(lower(canonical_name), '{BEGINNING}') THEN 2 WHEN contains(lower(canonical_name), '{BEGINNING}') THEN 1 ELSE 0 END, coalesce(a.m, 0))::INT AS match FROM published p LEFT JOIN a ON a.entity_id = p.id)
       SELECT {_STUB}, match FROM s WHERE match > 0 ORDER BY match = 2 DESC, match > 0 DESC, length(canonical_name), s.consensus_score DESC, id LIMIT 8"""
)
def suggest_prefix_contains(c: Corpus) -> DataFrame:
    return stub(search.suggest(c.published, c.aliases, BEGINNING, fuzzy=False), "match")


FUZZY = "silvred barge"


def _trigrams(text: str) -> str:
    words = f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))"


def _similar(text: str) -> str:
    held, asked = _trigrams(text), f"list_distinct({_trigrams(chr(39) + FUZZY + chr(39))})"
    extent = "list_slice(h, i, j)"
    score = f"len(list_intersect(q, {extent})) / len(list_distinct(list_concat(q, {extent})))::DOUBLE"
    best = f"list_max(flatten(list_transform(range(1, len(h) + 1), lambda i: list_transform(range(i, len(h) + 1), lambda j: {score}))))"
    return f"(SELECT coalesce({best}, 0) FROM (SELECT {asked} AS q, {held} AS h))"


@query(
    with_views("published")
    + f""", a AS (SELECT entity_id, max(likeness) AS likeness FROM (SELECT entity_id, {_similar('alias')} AS likeness FROM entity_aliases) GROUP BY 1),
       s AS (SELECT p.*, round(greatest({_similar('canonical_name')}, coalesce(a.likeness, 0)), 6) AS similarity FROM published p LEFT JOIN a ON a.entity_id = p.id)
       SELECT {_STUB}, 0 AS match, similarity FROM s WHERE similarity > 0.4 ORDER BY similarity DESC, length(canonical_name), s.consensus_score DESC, id LIMIT 8"""
)
def suggest_trigram(c: Corpus) -> DataFrame:
    return stub(search.suggest(c.published, c.aliases, FUZZY), "match", "similarity")
