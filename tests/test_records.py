import datetime as dt
import json

from pyspark.sql import functions as F

from codexlake.api import Tools
from codexlake.corpus import Corpus
from codexlake.functions import labels, text
from codexlake.operators import claims, contract, mutations, queues, snapshots
from codexlake.sources import providers, readers

GOOD = {
    "id": "1", "canonical_name": "Silver Barges", "slug": "silver-barges", "entity_type": "place", "short_description": "A harbour town of barges.", "summary": "s" * 400, "narrative": "n" * 2500,
    "structured_facts": '{"founded": 1200, "open": true}', "key_dates": '[{"year": 1200, "label": "founded", "kind": "founded"}]', "coords": (1.0, 2.0), "aliases": ["x"], "topics": ["a-b", "c", "d"],
    "citations": [("c", "s", None)], "relationships": [("t", "part_of")],
}
SCHEMA = """id string, canonical_name string, slug string, entity_type string, short_description string, summary string, narrative string, structured_facts string, key_dates string,
    coords struct<lat: double, lng: double>, aliases array<string>, topics array<string>, citations array<struct<claim: string, source: string, kind: string>>, relationships array<struct<target_name: string, predicate: string>>"""
BAD = {
    "canonical_name.length": {"canonical_name": ""}, "slug.shape": {"slug": "Silver"}, "entity_type.set": {"entity_type": "dragon"}, "short_description.length": {"short_description": "x" * 221},
    "summary.length": {"summary": "x" * 399}, "narrative.length": {"narrative": None}, "structured_facts.flat": {"structured_facts": '{"a": {"b": 1}}'},
    "key_dates.count": {"key_dates": json.dumps([{"year": 1, "label": "l", "kind": "k"}] * 16)}, "key_dates.year": {"key_dates": '[{"label": "l", "kind": "k"}]'},
    "key_dates.precision": {"key_dates": '[{"year": 1, "precision": "day", "label": "l", "kind": "k"}]'}, "key_dates.label": {"key_dates": '[{"year": 1, "kind": "k"}]'},
    "key_dates.kind": {"key_dates": '[{"year": 1, "label": "l"}]'}, "coords.whole": {"coords": (1.0, None)}, "aliases.count": {"aliases": ["x"] * 21}, "aliases.text": {"aliases": [None]},
    "topics.count": {"topics": ["a", "b"]}, "topics.shape": {"topics": ["a", "b", "C c"]}, "relationships.count": {"relationships": [("t", "p")] * 21}, "relationships.named": {"relationships": [("t", None)]},
    "citations.count": {"citations": [("c", "s", "web")] * 21}, "citations.claim": {"citations": [(None, "s", "web")]}, "citations.source": {"citations": [("c", None, "web")]}, "citations.kind": {"citations": [("c", "s", "poem")]},
}


def test_each_rule_of_the_contract_is_told_apart(spark):
    rows = [GOOD] + [GOOD | change | {"id": rule} for rule, change in BAD.items()] + [GOOD | {"id": "no json", "structured_facts": "no json"}, GOOD | {"id": "no dates", "key_dates": None}]
    table = spark.createDataFrame([tuple(r[f.split()[0]] for f in GOOD) for r in rows], SCHEMA)
    got = [tuple(r) for r in contract.violations(table, contract.generated_rules()).collect()]
    assert sorted(got, key=str) == sorted([(rule, rule) for rule in BAD] + [("no json", "structured_facts.object"), ("no json", "structured_facts.flat")] + [("no dates", f"key_dates.{x}") for x in ("list", "count", "year", "precision", "label", "kind")], key=str)
    assert set(BAD) | {"structured_facts.object", "key_dates.list"} == set(contract.generated_rules())


def test_rules_of_verifiers(spark):
    notes = json.dumps([{"claim": "c", "why": "w", "severity": "low"}])
    rows = [("ok", "agree", notes), ("verdict", "maybe", "[]"), ("none", "agree", None), ("many", "agree", json.dumps([{"claim": "c", "why": "w"}] * 16)), ("odd", "agree", '[{"claim": "c", "severity": "huge"}]')]
    got = {tuple(r) for r in contract.violations(spark.createDataFrame(rows, "id string, verdict string, disagreements string"), contract.verified_rules()).collect()}
    assert got == {("verdict", "verdict.set"), ("many", "disagreements.count"), ("odd", "disagreements.text"), ("odd", "disagreements.severity")} | {("none", f"disagreements.{x}") for x in ("list", "count", "text", "severity")}


def test_claims_are_scored_by_samples(spark):
    rows = [("1", "e", "c", "q", "Yes!"), ("2", "e", "c", "q", "no"), ("3", "e", "c", None, "yes"), ("4", "f", "c", "scattered", "yes")]
    table = spark.createDataFrame(rows, "id string, entity_id string, claim string, question string, expected string")

    def service():
        return lambda questions: [None if q is None else ["a", "b", None, "c"] if q == "scattered" else [" yes.", "YES", "no"] for q in questions]

    got = {r.id: (r.n_samples, r.distinct_answers, r.entropy, r.verdict, r.majority_answer, r.agrees_with_claim) for r in claims.scored(table, service).collect()}
    assert got["1"] == (3, 2, 0.5, "uncertain", "yes", True) and got["2"][3:] == ("uncertain", "yes", False)
    assert got["3"] == (0, 0, 0.0, "uncertain", None, False) and got["4"] == (3, 3, 1.0, "uncertain", "a", False)
    sure = {r.id: r.verdict for r in claims.scored(table, providers.stub_samples(["yes"], 5)).collect()}
    assert sure == {"1": "corroborated", "2": "contradicted", "3": "uncertain", "4": "corroborated"}
    entities = spark.createDataFrame([("e", 0.1, None), ("g", 0.3, None)], "id string, claim_factuality_score float, claims_scored_at timestamp")
    after = {r.id: (round(r.claim_factuality_score, 3), r.claims_scored_at is not None) for r in claims.with_factuality(entities, claims.scored(table, providers.stub_samples(["yes"], 5)), F.current_timestamp()).collect()}
    assert after == {"e": (0.333, True), "g": (0.3, False)}


def test_a_snapshot_file_is_applied(spark, tmp_path, data):
    corpus = Corpus(spark, data)
    first = corpus.entities.orderBy("id").first()
    path = tmp_path / "snapshot.json"
    path.write_text(json.dumps([{"id": first.id, "slug": first.slug, "canonical_name": "Renamed", "summary": "new", "aliases": ["one", "one", "two"], "topics": None, "citations": [{"claim": "c", "source": "s", "kind": None}]}]))
    records, missing = readers.read_snapshot(spark, str(path), [first.slug, "absent"])
    tables = {"entities": corpus.entities, "aliases": corpus.aliases, "topics": corpus.topics, "citations": corpus.citations, "claims": corpus.claims, "reviews": corpus.reviews}
    after = snapshots.applied(tables, records, F.to_timestamp(F.lit("2030-01-01 00:00:00")))
    changed = after["entities"].filter(F.col("id") == first.id).first()
    assert (changed.canonical_name, changed.summary, changed.created_at, changed.status) == ("Renamed", "new", first.created_at, first.status) and changed.updated_at == dt.datetime(2030, 1, 1)
    own = {name: after[name].filter(F.col("entity_id") == first.id).collect() for name in ("aliases", "topics", "citations", "claims")}
    assert sorted(r.alias for r in own["aliases"]) == ["one", "two"] and own["topics"] == own["claims"] == [] and [(r.claimed_source, r.claim_kind) for r in own["citations"]] == [("s", "other")]
    assert after["entities"].count() == corpus.entities.count() and [r.slug for r in missing.collect()] == ["absent"]


def test_an_entity_that_is_gone_is_not_restored(spark, data):
    corpus = Corpus(spark, data)
    tables = {"entities": corpus.entities, "aliases": corpus.aliases, "topics": corpus.topics, "citations": corpus.citations, "claims": corpus.claims, "reviews": corpus.reviews}
    ids = corpus.entities.select("id").orderBy("id").limit(5)
    taken = snapshots.captured(tables, ids)
    gone = {n: (t.join(ids, "id", "left_anti") if n == "entities" else mutations.cascade(t, ids.withColumnRenamed("id", "entity_id"), "entity_id")) for n, t in tables.items()}
    after = snapshots.restored(gone, taken, F.current_timestamp())
    assert all(after[n].count() == gone[n].count() for n in tables)


def test_queue_head_is_marked_and_the_rest_left(spark):
    seeds = spark.createDataFrame([(1, "a", 1, "pending", None), (2, "b", 5, "pending", None), (3, "c", 5, "pending", None), (4, "d", 9, "done", None)], "id long, name string, priority int, status string, last_attempted_at timestamp")
    first, after = queues.claimed(seeds, F.to_timestamp(F.lit("2030-01-01 00:00:00")))
    assert first.first().id == 2 and {(r.id, r.status, r.last_attempted_at is None) for r in after.collect()} == {(1, "pending", True), (2, "generating", False), (3, "pending", True), (4, "done", True)}
    assert queues.claimed(seeds.filter("status = 'done'"), F.current_timestamp())[0].collect() == []


def test_rotation_is_drawn_again_for_one_date(spark):
    rotation = spark.createDataFrame([(dt.date(2024, 1, 1), ["old"]), (dt.date(2024, 1, 9), ["b"]), (dt.date(2024, 1, 10), ["x"])], "date date, entity_ids array<string>")
    pool = spark.createDataFrame([("a", "1"), ("b", "0"), ("old", "2")], "id string, draw string")
    after = {r.date.day: r.entity_ids for r in queues.refreshed(rotation, pool, F.lit("2024-01-10").cast("date"), 3).collect()}
    assert after == {1: ["old"], 9: ["b"], 10: ["a", "old", "b"]}


def test_seeds_and_rotation_by_the_tools(spark, data):
    tools = Tools(Corpus(spark, data))
    name = tools.corpus.seeds.orderBy("id").first().name
    after, added = tools.insert_seeds(f"{name.upper()} | again\nBrand New Seed | hint\n\nbrand new seed\n")
    assert added == 1 and after.count() == tools.corpus.seeds.count() + 1 and after.filter("name ILIKE 'brand new seed'").first().status == "pending"
    rotation = spark.createDataFrame([], "date date, entity_ids array<string>")
    table, ids = tools.refresh_featured(rotation, "2024-03-01", 3)
    assert len(set(ids)) == 3 and table.count() == 1 and tools.refresh_featured(table, "2024-03-02", 3)[1] != ids
    assert tools.health()["latency_ms"] >= 0


def test_nested_texts_are_cleaned(spark):
    rows = spark.sql("SELECT named_struct('a', array('x\\u0000y', NULL), 'm', map('k\\u0000', named_struct('s', 'z\\u0000', 'n', 1))) AS v UNION ALL SELECT NULL")
    got = [r.v for r in rows.select(text.cleaned(F.col("v"), rows.schema["v"].dataType).alias("v")).collect()]
    assert got[0].asDict(recursive=True) == {"a": ["xy", None], "m": {"k": {"s": "z", "n": 1}}} and got[1] is None


def test_labels_and_url_components(spark):
    row = spark.range(1).select(labels.looked_up(F.lit("place"), labels.TYPE_LABELS), labels.looked_up(F.lit("dragon"), labels.TYPE_LABELS), labels.fixed(F.lit(1234.5), 2), labels.fixed(F.lit(None).cast("double"), 2), labels.percent(F.lit(0.375), 1), text.url_encoded(F.lit("a b/ü+")), text.url_decoded(F.lit("a%20b%2F%C3%BC+")), text.url_decoded(F.lit("%zz"))).first()
    assert tuple(row) == ("Places", None, "1234.50", None, "37.5%", "a%20b%2F%C3%BC%2B", "a b/ü+", None)


def test_today_is_that_of_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("Pacific/Kiritimati", "Pacific/Niue", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", name)
            before = dt.datetime.now(dt.timezone.utc).date()
            assert before <= spark.range(1).select(queues.today_utc()).first()[0] <= dt.datetime.now(dt.timezone.utc).date()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
