import datetime as dt
import json

import pytest

from codexlake.api import Tools
from codexlake.corpus import Corpus
from codexlake.operators import lists, mutations, queues, search
from codexlake.sources import readers, sinks
from codexlake.streaming import spend


def test_two_column_csv_rows_keep_the_type_as_hint(spark):
    lines = ["# seeds", "", "Great Wall of China, place", '"A, B",x,person', "Odd,,dragon", ",no name,person"]
    got = {tuple(r) for r in readers.parse_seed_csv(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {("Great Wall of China", "place", None), ("A, B", "x", "person"), ("Odd", None, None)}


def test_pipe_lines(spark):
    got = [tuple(r) for r in readers.parse_seed_lines(spark.createDataFrame([(" a | b | c",), ("d",), ("  ",)], "value string")).collect()]
    assert got == [("a", "b | c"), ("d", None)]


def test_snapshot_reader_and_missing_slugs(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps([{"slug": "a", "aliases": ["x"], "citations": [{"claim": "c"}]}, {"slug": "b"}]))
    records, missing = readers.read_snapshot(spark, str(path), ["a", "z"])
    assert [r.slug for r in records.collect()] == ["a"] and [r.slug for r in missing.collect()] == ["z"]


def test_dump_gate(spark, tmp_path):
    readers.dump({"t": spark.range(3)}, str(tmp_path))
    assert readers.restored(spark, str(tmp_path), ["t"], ("t", 3))["t"].count() == 3
    with pytest.raises(ValueError, match="incomplete"):
        readers.restored(spark, str(tmp_path), ["t"], ("t", 4))


def test_publish_swaps_all_tables_at_once(spark, tmp_path):
    mutations.publish({"a": spark.range(1), "b": spark.range(2)}, str(tmp_path))
    assert mutations.published(spark, str(tmp_path), "b").count() == 2
    mutations.publish({"a": spark.range(5), "b": spark.range(6)}, str(tmp_path))
    assert mutations.published(spark, str(tmp_path), "a").count() == 5


def test_update_sets_nulls_too(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, v string, w string")
    got = {tuple(r) for r in mutations.update(old, spark.createDataFrame([(1, "z")], "id int, v string"), "id").collect()}
    assert got == {(1, "z", None), (2, "b", "x")}
    emptied = mutations.update(old, spark.createDataFrame([(2, None), (2, None), (3, "n")], "id int, w string"), "id")
    assert {tuple(r) for r in emptied.collect()} == {(1, "a", None), (2, "b", None)}


def test_pages_add_up(spark):
    df = spark.createDataFrame([(f"n{i % 7}", i) for i in range(50)], "name string, id int")
    parts = [tuple(r) for k in range(1, 4) for r in lists.page(df, ("name", "id"), 20, lists.page_offset(k, 20)).collect()]
    assert parts == [tuple(r) for r in df.orderBy("name", "id").collect()]
    assert lists.page_offset(0) == 0 and lists.has_next(30) and not lists.has_next(29)


def test_suggest_orders_and_guards(spark):
    rows = spark.createDataFrame([("1", "a", "Silver Barges", "work", "", 0.9), ("2", "b", "The Silver Court", "work", "", 0.9), ("3", "c", "Silvre", "work", "", 0.9), ("4", "d", "Nothing", "work", "", 0.9)], "id string, slug string, canonical_name string, entity_type string, short_description string, consensus_score double")
    aliases = spark.createDataFrame([("4", "silversmith"), ("2", "x")], "entity_id string, alias string")
    assert [r.id for r in search.suggest(rows, aliases, "silver").collect()] == ["1", "4", "2", "3"]
    assert [r.id for r in search.suggest(rows, aliases, "silver", nulls_as_written=True).collect()] == ["1", "4", "3", "2"]
    assert search.suggest(rows, aliases, "%_").collect() == []


def test_rotation_falls_back_to_the_latest(spark):
    rotation = spark.createDataFrame([(dt.date(2024, 1, 1), ["a"]), (dt.date(2024, 1, 2), ["b", "c"])], "date date, entity_ids array<string>")
    assert [r.id for r in queues.rotation_of(rotation, "2024-01-01").collect()] == ["a"]
    assert [r.id for r in queues.rotation_of(rotation, "2024-02-01").collect()] == ["b", "c"]


def test_sinks_carry_the_caveat(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int")
    got = json.loads(sinks.listing(rows, ["k"]).first().json)
    assert got["caveat"] == sinks.CAVEAT and [r["k"] for r in got["results"]] == ["a", "b"]
    assert all(json.loads(r.json)["caveat"] for r in sinks.answers(rows).collect())


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i % 5, 10), "view", 1.0) for i in range(40)]
    spark.createDataFrame(rows, "id int, ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    query = spend.windowed(stream, "ts", "event_type", "value").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    batch = spend.windowed(spark.read.parquet(str(tmp_path / "in")), "ts", "event_type", "value")
    assert {tuple(r) for r in spark.table("w").collect()} == {tuple(r) for r in batch.collect()}


def test_tools_check_their_arguments(spark, data):
    tools = Tools(Corpus(spark, data))
    for call in (lambda: tools.list_by_type("dragon"), lambda: tools.list_by_type("place", limit=0), lambda: tools.list_by_topic("x", offset=-1), lambda: tools.list_by_date_range(2, 1), lambda: tools.get_entity("x", depth="deep"), lambda: tools.search_entities("x", [0.0], limit=51)):
        with pytest.raises(ValueError):
            call()
    assert tools.get_entity("no such")["error"] == "not_found"
    answer = tools.list_by_type("place", limit=3)
    assert answer["caveat"] and 0 < len(answer["results"]) <= 3
    assert tools.get_entity(answer["results"][0]["slug"].upper(), "full")["entity"]["id"] == answer["results"][0]["id"]
    assert sum(tools.health()["counts"].values()) == Corpus(spark, data).entities.count()


def test_fused_scores_are_bounded(spark, data):
    c = Corpus(spark, data)
    vector = [float(i % 7) for i in range(1024)]
    rows = search.hybrid(c.published, "the of", vector, 5).collect()
    assert 0 < len(rows) <= 5 and all(0 < r.fused_score <= 2 / 61 for r in rows)


def test_projection_reaches_the_scan(spark, data):
    c = Corpus(spark, data)
    plan = lists.by_type(c.published, "place", 5)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scan = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "embedding" not in scan and "narrative" not in scan
    assert "TakeOrderedAndProject" in plan and "EqualTo(status,published)" in plan
