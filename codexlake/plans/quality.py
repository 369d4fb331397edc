"""Counts, dashboards, spending windows, scores, and scalar functions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.corpus import Corpus
from codexlake.functions import labels, scoring, text
from codexlake.operators import aggregates, citing, claims, queues
from codexlake.schema import CITATION_STATUSES, CLAIM_VERDICTS, NOTES
from codexlake.sources import readers
from codexlake.streaming import spend

from .listing import KIND, TOPIC
from .registry import query, with_views


@query("SELECT entity_type, count(*) AS n FROM entities WHERE status = 'published' GROUP BY 1")
def type_catalog_counts(c: Corpus) -> DataFrame:
    return aggregates.counts(c.published, "entity_type").orderBy(F.desc("n"), "entity_type")


@query(with_views("published", "topics") + "SELECT topic, count(*) AS n FROM topics WHERE entity_id IN (SELECT id FROM published) GROUP BY 1 ORDER BY n DESC, topic LIMIT 200")
def topic_counts(c: Corpus) -> DataFrame:
    return aggregates.topic_counts(c.published, c.topics, 200)


@query(with_views("published", "topics") + f"SELECT topic, count(*) AS n FROM topics WHERE entity_id IN (SELECT id FROM published WHERE entity_type = '{KIND}') GROUP BY 1 ORDER BY n DESC, topic LIMIT 20")
def topics_for_type(c: Corpus) -> DataFrame:
    return aggregates.topic_counts(c.published, c.topics, 20, KIND)


@query(
    with_views("published", "topics")
    + f"""SELECT t.topic, count(*) AS n FROM topics t WHERE t.topic <> '{TOPIC}' AND t.entity_id IN (SELECT entity_id FROM topics WHERE topic = '{TOPIC}')
          AND t.entity_id IN (SELECT id FROM published) GROUP BY 1 ORDER BY n DESC, t.topic LIMIT 10"""
)
def related_topics(c: Corpus) -> DataFrame:
    return aggregates.related_topics(c.published, c.topics, TOPIC, 10)


@query(
    """SELECT count(*) FILTER (WHERE status = 'published') AS n_published, round(coalesce(avg(consensus_score::DOUBLE) FILTER (WHERE status = 'published'), 0), 6) AS avg_consensus,
       count(*) FILTER (WHERE status = 'flagged') AS n_flagged, count(claims_scored_at) AS n_scored, round(coalesce(avg(claim_factuality_score::DOUBLE) FILTER (WHERE claims_scored_at IS NOT NULL), 0), 6) AS avg_factuality FROM entities"""
)
def quality_totals(c: Corpus) -> DataFrame:
    totals = aggregates.entity_totals(c.entities)
    return totals.withColumns({k: F.round(k, 6) for k in ("avg_consensus", "avg_factuality")})


@query(
    with_views("published", "topics", "citations", "runs", "claims", "reviews")
    + """SELECT (SELECT count(*) FROM published) AS n_published, (SELECT round(avg(consensus_score::DOUBLE), 6) FROM published) AS avg_consensus, (SELECT count(*) FROM entities WHERE status = 'flagged') AS n_flagged,
         (SELECT count(claims_scored_at) FROM entities) AS n_scored, (SELECT round(avg(claim_factuality_score::DOUBLE), 6) FROM entities WHERE claims_scored_at IS NOT NULL) AS avg_factuality,
         (SELECT count(*) FROM reviews WHERE resolved_at IS NULL) AS n_open_reviews,
         (SELECT count(*) FILTER (WHERE verdict = 'corroborated') || '/' || count(*) FILTER (WHERE verdict = 'uncertain') || '/' || count(*) FILTER (WHERE verdict = 'contradicted') FROM claims) AS claim_verdicts,
         (SELECT count(*) || '/' || count(*) FILTER (WHERE resolution_status = 'verified') || '/' || count(*) FILTER (WHERE resolution_status = 'ambiguous') || '/' || count(*) FILTER (WHERE resolution_status = 'not_found') FROM citations) AS citations,
         (SELECT string_agg(entity_type || '=' || n, ',' ORDER BY n DESC, entity_type) FROM (SELECT entity_type, count(*) AS n FROM published GROUP BY 1)) AS by_type,
         (SELECT string_agg(round(a * 1000)::INT, ',' ORDER BY n DESC, entity_type) FROM (SELECT entity_type, count(*) AS n, avg(consensus_score::DOUBLE) AS a FROM published GROUP BY 1)) AS consensus_by_type,
         (SELECT string_agg(generator_model || '=' || n, ',' ORDER BY n DESC, generator_model) FROM (SELECT generator_model, count(*) AS n FROM entities GROUP BY 1)) AS models,
         (SELECT string_agg(topic || '=' || n, ',' ORDER BY n DESC, topic) FROM (SELECT topic, count(*) AS n FROM topics WHERE entity_id IN (SELECT id FROM published) GROUP BY 1 ORDER BY n DESC, topic LIMIT 20)) AS top_topics,
         (SELECT string_agg(id || ':' || status, ',' ORDER BY id DESC) FROM (SELECT id, status FROM runs ORDER BY id DESC LIMIT 10)) AS latest_runs"""
)
def quality_summary(c: Corpus) -> DataFrame:
    """The whole dashboard as one record; its lists are spelled out here."""
    found = aggregates.quality_summary(c.entities, c.reviews, c.claims, c.citations, c.topics, c.runs)

    def spelled(items: str, one) -> F.Column:
        return F.array_join(F.transform(items, one), ",")

    def tallied(struct: str, *fields: str) -> F.Column:
        return F.concat_ws("/", *(F.col(f"{struct}.{f}").cast("string") for f in fields))

    return found.select(
        "n_published", F.round("avg_consensus", 6).alias("avg_consensus"), "n_flagged", "n_scored", F.round("avg_factuality", 6).alias("avg_factuality"), "n_open_reviews",
        tallied("claim_verdicts", "corroborated", "uncertain", "contradicted").alias("claim_verdicts"),
        tallied("citations", "total", "verified", "ambiguous", "not_found").alias("citations"),
        spelled("consensus_by_type", lambda x: F.concat_ws("=", x["entity_type"], x["n"].cast("string"))).alias("by_type"),
        spelled("consensus_by_type", lambda x: F.round(x["avg_consensus"] * 1000).cast("int").cast("string")).alias("consensus_by_type"),
        spelled("model_coverage", lambda x: F.concat_ws("=", x["generator_model"], x["n"].cast("string"))).alias("models"),
        spelled("top_topics", lambda x: F.concat_ws("=", x["topic"], x["n"].cast("string"))).alias("top_topics"),
        spelled("latest_runs", lambda x: F.concat_ws(":", x["id"].cast("string"), x["status"])).alias("latest_runs"),
    )


@query("SELECT entity_type, round(avg(consensus_score::DOUBLE), 6) AS avg_consensus, count(*) AS n FROM entities WHERE status = 'published' GROUP BY 1")
def quality_by_type(c: Corpus) -> DataFrame:
    return c.published.groupBy("entity_type").agg(F.round(F.avg("consensus_score"), 6).alias("avg_consensus"), F.count(F.lit(1)).alias("n"))


@query("SELECT generator_model, count(*) AS n FROM entities GROUP BY 1")
def quality_model_coverage(c: Corpus) -> DataFrame:
    return aggregates.counts(c.entities, "generator_model")


@query(with_views("claims") + "SELECT " + ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in CLAIM_VERDICTS) + " FROM claims")
def quality_verdicts(c: Corpus) -> DataFrame:
    return aggregates.pivoted(c.claims, "verdict", CLAIM_VERDICTS)


@query(with_views("citations") + "SELECT claim_kind, " + ", ".join(f"count(*) FILTER (WHERE resolution_status = '{v}') AS {v}" for v in CITATION_STATUSES) + " FROM citations GROUP BY 1")
def quality_citations(c: Corpus) -> DataFrame:
    return aggregates.pivoted(c.citations, "resolution_status", CITATION_STATUSES, ("claim_kind",))


@query(with_views("published", "topics") + "SELECT topic, count(*) AS n FROM topics WHERE entity_id IN (SELECT id FROM published) GROUP BY 1 ORDER BY n DESC, topic LIMIT 20")
def quality_top_topics(c: Corpus) -> DataFrame:
    return aggregates.topic_counts(c.published, c.topics, 20)


@query(with_views("runs") + "SELECT id, job_kind, model, status FROM runs ORDER BY id DESC LIMIT 10")
def latest_runs(c: Corpus) -> DataFrame:
    return queues.latest(c.runs, 10).select("id", "job_kind", "model", "status")


@query(with_views("reviews") + "SELECT count(*) AS n_open FROM reviews WHERE resolved_at IS NULL")
def open_review_count(c: Corpus) -> DataFrame:
    return c.reviews.filter("resolved_at IS NULL").agg(F.count(F.lit(1)).alias("n_open"))


@query(
    with_views("reviews")
    + """SELECT r.id AS review_id, r.entity_id, e.slug, e.canonical_name, r.reason, r.severity, coalesce(len(from_json(e.disagreement_notes, '[{"severity":"VARCHAR"}]')), 0)::INT AS n_disagreements,
       round(e.consensus_score::DOUBLE, 4) AS consensus_score FROM reviews r JOIN entities e ON e.id = r.entity_id WHERE r.resolved_at IS NULL ORDER BY r.severity DESC, r.id DESC LIMIT 50"""
)
def review_queue_open(c: Corpus) -> DataFrame:
    found = queues.open_reviews(c.reviews, c.entities, 50)
    return found.withColumn("n_disagreements", F.size("disagreements")).withColumn("consensus_score", F.round(F.col("consensus_score").cast("double"), 4)).drop("disagreements")


@query("SELECT status, count(*) AS n FROM entities GROUP BY 1")
def health_status_counts(c: Corpus) -> DataFrame:
    return aggregates.counts(c.entities, "status")


@query("SELECT array_to_string(list(status || '=' || n ORDER BY status), ',') AS counts FROM (SELECT status, count(*) AS n FROM entities GROUP BY 1)")
def health_status_map(c: Corpus) -> DataFrame:
    counted = aggregates.as_map(aggregates.counts(c.entities, "status"), "status", "n")
    return counted.select(F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query(
    with_views("runs")
    + """, t AS (SELECT max(started_at) AS now FROM runs)
       SELECT coalesce(sum(api_cost_usd) FILTER (WHERE date_trunc('month', started_at) = date_trunc('month', now)), 0)::DOUBLE AS monthly,
              coalesce(sum(api_cost_usd) FILTER (WHERE started_at::DATE = now::DATE), 0)::DOUBLE AS daily,
              coalesce(sum(api_cost_usd) FILTER (WHERE started_at > now - INTERVAL 1 HOUR AND started_at <= now), 0)::DOUBLE AS hourly
       FROM runs, t WHERE status IN ('completed', 'running')"""
)
def spend_windows(c: Corpus) -> DataFrame:
    now = c.runs.agg(F.max("started_at")).first()[0]
    totals = aggregates.windows_spend(c.runs, F.lit(now))
    return totals.select(*(F.col(k).cast("double").alias(k) for k in totals.columns))


@query(with_views("runs") + "SELECT model, count(*) AS n, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(api_cost_usd)::DOUBLE AS cost FROM runs GROUP BY 1")
def usage_by_model(c: Corpus) -> DataFrame:
    return c.runs.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("api_cost_usd").cast("double").alias("cost"))


@query(
    """WITH n AS (SELECT id, from_json(disagreement_notes, '[{"severity":"VARCHAR"}]') AS notes FROM entities)
       SELECT id, greatest(0, 10 - 3 * len(list_filter(notes, lambda x: x.severity = 'high')) - len(list_filter(notes, lambda x: x.severity = 'medium'))) / 10.0::DOUBLE AS consensus FROM n"""
)
def consensus_score(c: Corpus) -> DataFrame:
    return c.entities.select("id", scoring.consensus(F.from_json("disagreement_notes", NOTES)).alias("consensus"))


@query(with_views("claims") + "SELECT id, CASE WHEN n_samples <= 1 THEN 0.0 ELSE (distinct_answers - 1) / (n_samples - 1)::DOUBLE END AS entropy FROM claims")
def entropy_proxy(c: Corpus) -> DataFrame:
    return c.claims.select("id", scoring.entropy_proxy(F.col("n_samples"), F.col("distinct_answers")).alias("entropy"))


@query(with_views("claims") + "SELECT id, entity_id, verdict, distinct_answers FROM claims WHERE entity_id = (SELECT min(entity_id) FROM claims)")
def entity_claims(c: Corpus) -> DataFrame:
    first = c.claims.agg(F.min("entity_id")).first()[0]
    return c.claims.filter(F.col("entity_id") == first).orderBy(F.desc("distinct_answers"), "id").select("id", "entity_id", "verdict", "distinct_answers")


@query(with_views("claims") + "SELECT entity_id, count(*) AS n_claims, round(avg((verdict = 'corroborated')::INT), 6) AS factuality FROM claims GROUP BY 1")
def factuality(c: Corpus) -> DataFrame:
    return aggregates.factuality(c.claims).withColumn("factuality", F.round("factuality", 6))


@query(
    r"""WITH e AS (SELECT entity_id, trim(regexp_replace(lower(alias), '[^\p{L}\p{N}]+', ' ', 'g')) AS answer, count(*) AS n FROM entity_aliases GROUP BY ALL)
        SELECT entity_id, sum(n)::BIGINT AS n_samples, count(*) AS distinct_answers, first(answer ORDER BY n DESC, answer) AS majority_answer FROM e GROUP BY 1"""
)
def answer_agreement(c: Corpus) -> DataFrame:
    return aggregates.answer_agreement(c.aliases, "entity_id", "alias")


@query("SELECT id, running::DOUBLE AS running FROM (SELECT id, sum(priority) OVER (ORDER BY priority DESC, id ROWS UNBOUNDED PRECEDING) AS running FROM seed_topics WHERE status = 'pending') WHERE running <= 60")
def queue_within_budget(c: Corpus) -> DataFrame:
    waiting = c.seeds.filter("status = 'pending'").select("id", F.col("priority").cast("double").alias("priority"), (-F.col("priority")).alias("order"))
    return aggregates.drained(waiting, "priority", 60, ("order", "id")).select("id", "running")


@query(
    with_views("citations")
    + """SELECT id, 5 AS n_samples, d AS distinct_answers, round((d - 1) / 4::DOUBLE, 6) AS entropy, CASE WHEN d >= 3 THEN 'uncertain' WHEN id % 2 = 0 THEN 'corroborated' ELSE 'contradicted' END AS verdict,
         'answer 0' AS majority_answer, id % 2 = 0 AS agrees_with_claim FROM (SELECT id, (id % 4 + 1)::INT AS d FROM citations)"""
)
def claims_scored(c: Corpus) -> DataFrame:
    """The excerpts of all citations as claims, put to a service that gives as many different answers as the id says."""
    key = F.col("id").cast("string")
    asked = c.citations.select("id", "entity_id", F.col("claim_excerpt").alias("claim"), key.alias("question"), F.when(F.col("id") % 2 == 0, "Answer 0!").otherwise("something else").alias("expected"))

    def make():
        def answer(questions: list[str | None]) -> list:
            return [None if q is None else [f" Answer {max(0, k - 4 + int(q) % 4)}." for k in range(5)] for q in questions]

        return answer

    return claims.scored(asked, make).select("id", "n_samples", "distinct_answers", F.round("entropy", 6).alias("entropy"), "verdict", "majority_answer", "agrees_with_claim")


@query(
    with_views("claims")
    + "SELECT e.id, round(CASE WHEN f.entity_id IS NULL THEN e.claim_factuality_score ELSE f.share::FLOAT END, 5) AS factuality, f.entity_id IS NOT NULL AS rescored FROM entities e LEFT JOIN (SELECT entity_id, avg((verdict = 'corroborated')::INT) AS share FROM claims GROUP BY 1) f ON f.entity_id = e.id"
)
def factuality_set(c: Corpus) -> DataFrame:
    """Entities after their claims were scored."""
    now = F.to_timestamp(F.lit("2030-01-01 00:00:00"))
    after = claims.with_factuality(c.entities, c.claims, now)
    return after.select("id", F.round("claim_factuality_score", 5).alias("factuality"), F.coalesce(F.col("claims_scored_at") == now, F.lit(False)).alias("rescored"))


@query("SELECT count(*) AS n_entities, count(claim_factuality_score) AS n_scored, round(coalesce(avg(claim_factuality_score::DOUBLE), 0), 6) AS avg_factuality FROM entities")
def scored_corpus_summary(c: Corpus) -> DataFrame:
    scored = F.col("claim_factuality_score").isNotNull()
    return c.entities.agg(F.count(F.lit(1)).alias("n_entities"), aggregates.count_if(scored).alias("n_scored"), F.round(aggregates.mean_if(F.col("claim_factuality_score"), scored), 6).alias("avg_factuality"))


@query(with_views("citations") + "SELECT entity_id, count(*) AS total, count(*) FILTER (WHERE resolution_status <> 'unchecked') AS checked, count(*) FILTER (WHERE resolution_status = 'verified') AS verified FROM citations GROUP BY 1")
def citation_summary(c: Corpus) -> DataFrame:
    return aggregates.citation_summary(c.citations)


@query("SELECT CASE WHEN consensus_score::DOUBLE >= 0.85 THEN 'High' WHEN consensus_score::DOUBLE >= 0.6 THEN 'Medium' ELSE 'Low' END AS tone, round(consensus_score::DOUBLE * 100)::INT AS percent, count(*) AS n FROM entities GROUP BY ALL")
def confidence_histogram(c: Corpus) -> DataFrame:
    score = F.col("consensus_score").cast("double")
    return c.entities.groupBy(scoring.tone(score).alias("tone"), F.round(score * 100).cast("int").alias("percent")).agg(F.count(F.lit(1)).alias("n"))


def _accents(sql: str) -> str:
    for letter, accented in text.accent_classes().items():
        sql = f"regexp_replace({sql}, '[{accented}]', '{letter} ', 'g')"
    return sql


def _words(column: str) -> str:
    return f"list_distinct(list_filter(string_split(regexp_replace({_accents(f'lower({column})')}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 3))"


@query(f"SELECT work_id, array_to_string(list_sort({_words('title')}), ' ') AS words FROM bib_works")
def title_words(c: Corpus) -> DataFrame:
    return c.raw("bib_works").select("work_id", F.array_join(F.sort_array(text.significant_words(F.col("title"))), " ").alias("words"))


def _best(name: str, works: str, citations: str = "c") -> str:
    """SQL of the best candidate of each citation in one source, counted over every shared word."""
    return f""", {name}_w AS (SELECT work_id, author_families, {_words('title')} AS words FROM bib_works WHERE {works}),
    {name}_p AS (SELECT a.id, b.work_id, count(*) AS common FROM (SELECT id, unnest(words) AS word FROM {citations}) a JOIN (SELECT work_id, unnest(words) AS word FROM {name}_w) b USING (word) GROUP BY ALL),
    {name}_s AS (SELECT p.id, p.work_id, common / least(len(c.words), len(w.words))::DOUBLE AS overlap,
                 coalesce(len(list_filter(w.author_families, lambda f: length(f) > 2 AND contains(lower(c.claimed_author), lower(f)))) > 0, false) AS author FROM {name}_p p JOIN c ON c.id = p.id JOIN {name}_w w ON w.work_id = p.work_id),
    {name}_k AS (SELECT *, CASE WHEN overlap >= 0.6 AND author THEN 'verified' ELSE 'ambiguous' END AS status, least(1.0, overlap * CASE WHEN author THEN 1.0 ELSE 0.7 END) AS confidence, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, work_id) AS place FROM {name}_s WHERE overlap >= 0.45),
    {name} AS (SELECT * FROM {name}_k WHERE place = 1)"""


_CITED = with_views("citations") + f", c AS (SELECT id, claimed_author, {_words('claimed_source')} AS words FROM citations)"
_ONE_SOURCE = _CITED + _best("best", "true")
_TWO_SOURCES = (
    _CITED
    + _best("one", "doi IS NOT NULL")
    + _best("two", "doi IS NULL", "(SELECT * FROM c WHERE id NOT IN (SELECT id FROM one WHERE status = 'verified'))")
    + """, u AS (SELECT *, 'primary' AS via FROM one UNION ALL SELECT *, 'fallback' FROM two),
       best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY status = 'verified' DESC, round(confidence, 9) DESC, via = 'primary' DESC) AS rank FROM u)"""
)
_FOUND = "citations.id, b.work_id, coalesce(b.status, 'not_found') AS status, round(b.overlap, 6) AS overlap, round(b.confidence, 6) AS confidence"


@query(_ONE_SOURCE + f" SELECT {_FOUND} FROM citations LEFT JOIN best b ON b.id = citations.id")
def citation_match(c: Corpus) -> DataFrame:
    found = citing.best_matches(c.citations, c.raw("bib_works"))
    return found.withColumns({k: F.round(k, 6) for k in ("overlap", "confidence")}).drop("via")


@query(_TWO_SOURCES + f" SELECT {_FOUND}, b.via FROM citations LEFT JOIN (SELECT * FROM best WHERE rank = 1) b ON b.id = citations.id")
def citation_resolution(c: Corpus) -> DataFrame:
    """Works with a DOI are the first source, the others the fallback."""
    works = c.raw("bib_works")
    found = citing.best_matches(c.citations, works.filter("doi IS NOT NULL"), works.filter("doi IS NULL"))
    return found.withColumns({k: F.round(k, 6) for k in ("overlap", "confidence")})


@query(_ONE_SOURCE + """, n AS (SELECT coalesce(b.status, 'not_found') AS status FROM citations LEFT JOIN best b ON b.id = citations.id)
       SELECT status, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM n), 4) AS percent FROM n GROUP BY 1""")
def citation_tally(c: Corpus) -> DataFrame:
    return citing.tally(citing.best_matches(c.citations, c.raw("bib_works")))


@query(
    r"""SELECT id, regexp_replace(trim(short_description), '\s+', ' ', 'g') AS one_line, len(list_filter(list_transform(string_split_regex(narrative, '\n{2,}'), lambda p: trim(p)), lambda p: p <> ''))::INT AS n_paragraphs,
       string_split_regex(trim(canonical_name), '\s+')[-1] AS surname, left(canonical_name || '. ' || short_description || ' ' || summary, 8000) AS embed_text, ceil(length(summary) / 3.0)::BIGINT AS rough_tokens,
       replace(entity_type, '_', ' ') AS label FROM entities"""
)
def text_functions(c: Corpus) -> DataFrame:
    return c.entities.select(
        "id",
        text.one_line(F.col("short_description")).alias("one_line"),
        F.size(text.paragraphs(F.col("narrative"))).alias("n_paragraphs"),
        text.surname(F.col("canonical_name")).alias("surname"),
        text.embedding_text(F.col("canonical_name"), F.col("short_description"), F.col("summary")).alias("embed_text"),
        text.rough_tokens(F.col("summary")).cast("bigint").alias("rough_tokens"),
        text.humanise(F.col("entity_type")).alias("label"),
    )


@query(
    f"""SELECT id, CASE entity_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.TYPE_LABELS.items())} END AS label, printf('%.2f', consensus_score::DOUBLE) AS consensus, printf('%.0f', round(consensus_score::DOUBLE * 100)) || '%' AS percent,
        slug AS decoded, summary, structured_facts FROM entities"""
)
def labels_and_formats(c: Corpus) -> DataFrame:
    """Labels, fixed decimals, a slug encoded and decoded, and texts sanitised inside arrays and maps after NULs were put in."""
    spoiled = c.entities.select("id", "entity_type", F.col("consensus_score").cast("double").alias("score"), "slug", F.struct(F.array(F.concat("summary", F.lit("\x00"))).alias("texts"), F.create_map(F.lit("\x00facts"), F.col("structured_facts")).alias("facts")).alias("nested"))
    clean = spoiled.withColumn("nested", text.cleaned(F.col("nested"), spoiled.schema["nested"].dataType))
    return clean.select(
        "id",
        labels.looked_up(F.col("entity_type"), labels.TYPE_LABELS).alias("label"),
        labels.fixed(F.col("score"), 2).alias("consensus"),
        labels.percent(F.round(F.col("score"), 2)).alias("percent"),
        text.url_decoded(text.url_encoded(F.col("slug"))).alias("decoded"),
        F.get("nested.texts", F.lit(0)).alias("summary"),
        F.col("nested.facts")["facts"].alias("structured_facts"),
    )


@query("SELECT work_id, 'https://doi.org/' || doi AS url, regexp_replace('https://doi.org/' || doi, '^https?://(dx\\.)?doi\\.org/', '') AS bare FROM bib_works WHERE doi IS NOT NULL")
def doi_links(c: Corpus) -> DataFrame:
    url = text.doi_url(F.col("doi"))
    return c.raw("bib_works").filter("doi IS NOT NULL").select("work_id", url.alias("url"), text.bare_doi(url).alias("bare"))


@query("SELECT id, strftime(coalesce(updated_at, published_at, created_at)::TIMESTAMP, '%Y-%m-%d %H:%M') AS changed, strftime(date_trunc('month', created_at::TIMESTAMP), '%Y-%m') AS month FROM entities")
def time_functions(c: Corpus) -> DataFrame:
    return c.entities.select("id", F.date_format(F.coalesce("updated_at", "published_at", "created_at"), "yyyy-MM-dd HH:mm").alias("changed"), F.date_format(F.date_trunc("month", "created_at"), "yyyy-MM").alias("month"))


@query("SELECT trim(name) AS name, nullif(trim(hint), '') AS hint, entity_type_guess AS entity_type FROM seed_topics")
def seed_csv_lines(c: Corpus) -> DataFrame:
    """Seeds written as quoted CSV lines among comments and blanks, and read again."""
    line = F.concat(F.lit(' "'), "name", F.lit('" ,"'), F.coalesce("hint", F.lit("")), F.lit('",'), F.coalesce("entity_type_guess", F.lit("")))
    rows = c.seeds.select(F.explode(F.array(F.lit("# comment"), F.lit("  "), line)).alias("value"))
    return readers.parse_seed_csv(rows)


@query("SELECT trim(name) AS name, CASE WHEN hint IS NOT NULL THEN trim(hint) || ' | ' || status END AS hint FROM seed_topics")
def seed_pipe_lines(c: Corpus) -> DataFrame:
    line = F.when(F.col("hint").isNull(), F.col("name")).otherwise(F.concat("name", F.lit(" | "), "hint", F.lit("|"), "status"))
    return readers.parse_seed_lines(c.seeds.select(line.alias("value")))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(c: Corpus) -> DataFrame:
    rows = spend.windowed(c.raw("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:00").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
       SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM s GROUP BY user_id, k"""
)
def user_sessions(c: Corpus) -> DataFrame:
    rows = spend.sessions(c.raw("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id")
    return rows.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")
