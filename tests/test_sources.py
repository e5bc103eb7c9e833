"""Stores, page and file readers, sinks, streams."""

import gzip
import json
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from shipgauge.operators import ingest, refclass, rollup
from shipgauge.settings import Settings
from shipgauge.sources import issues as issue_source, scratch, stores
from shipgauge.streaming import status as streaming
from tests.test_series import entries
from tests.util import NOW, ago, by, item, items, now, one


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_item_store(spark, tmp_path, fmt):
    store = stores.ItemStore(spark, str(tmp_path / "items"), fmt)
    assert store.read().count() == 0 and store.projects().count() == 0
    store.write(items(spark, item("Done", cycle=1.5, created=ago(days=1)), item("To Do", project="Q")))
    store.write(items(spark, item("To Do", project="Q", key="n1"), item("To Do", project="Q", key="n2")))
    got = by(store.read(), "item_id")
    assert set(got) == {"K", "n1", "n2"} and got["K"]["cycle_hours"] == 1.5 and got["K"]["created"] == ago(days=1)
    assert {r[0] for r in store.projects().collect()} == {"P", "Q"}
    assert store.read("Q").count() == 2


def test_item_files(spark, tmp_path):
    rows = [
        {"ID": "T-1", "Type": "Component", "Description": "d", "Size": "M", "Status": "Done", "Created": "2025-12-04T05:24:06.5-08:00",
         "InProgress": None, "Done": "2025-12-05T00:00:00.123456789Z", "CycleTime": 24, "Assignee": "a", "JiraKey": "T-1"},
        {"ID": "T-2", "Type": "", "Description": "", "Size": "", "Status": "To Do", "Created": "0001-01-01T00:00:00Z",
         "InProgress": None, "Done": None, "CycleTime": 0, "Assignee": "", "JiraKey": ""},
    ]
    (tmp_path / "data-mono.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "data.json").write_text(json.dumps(rows[:1]))
    (tmp_path / "database.json").write_text(json.dumps(rows[:1]))
    got = by(stores.read_item_files(spark, str(tmp_path)), "project_key", "item_id")
    assert set(got) == {("mono", "T-1"), ("mono", "T-2"), ("", "T-1")}
    assert got["mono", "T-1"]["created"] == datetime(2025, 12, 4, 13, 24, 6, 500000)
    assert got["mono", "T-1"]["done_ts"] == datetime(2025, 12, 5, 0, 0, 0, 123456)
    assert got["mono", "T-2"]["created"] is None


def test_one_array_is_read_by_several_tasks(spark, tmp_path):
    """An indented array of 2 MB, with braces and breaks in its texts, equals what the multi-line reader gives."""
    rows = [{"ID": f"T-{i}", "Type": "x", "Description": "a \\n  },\n  {\n [\"}]" * (i % 3), "Size": "M", "Status": "Done", "Created": "2025-12-04T05:24:06Z",
             "InProgress": None, "Done": None, "CycleTime": i, "Assignee": "", "JiraKey": "", "More": [{"a": i}, []], "Last": ["]"]} for i in range(6000)]
    (tmp_path / "data-big.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "data-[x],{y}.json").write_text(json.dumps(rows[:2], indent=2))
    for name, text in (("none", "[]"), ("null", "null"), ("tabs", json.dumps(rows[:3], indent="\t")), ("crlf", json.dumps(rows[:4], indent=2).replace("\n", "\r\n"))):
        (tmp_path / f"data-{name}.json").write_text(text, newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200_000)
    try:
        got = stores.read_item_files(spark, str(tmp_path), ["big"])
        parts = got.groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) >= 5 and max(r["count"] for r in parts) < 2500
        whole = spark.read.option("multiLine", True).json(str(tmp_path / "data-big.json"))
        columns = ["ID", "Description", "CycleTime"]
        assert sorted(map(tuple, got.select("item_id", "description", "cycle_hours").collect())) == sorted(map(tuple, whole.select(*columns).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    counts = {r["project_key"]: r["count"] for r in stores.read_item_files(spark, str(tmp_path)).groupBy("project_key").count().collect()}
    assert counts == {"big": 6000, "[x],{y}": 2, "tabs": 3, "crlf": 4}
    assert {r["project_key"] for r in stores.read_item_files(spark, str(tmp_path), ["[x],{y}", "tabs", "gone"]).collect()} == {"[x],{y}", "tabs"}


def test_written_pages_are_compressed_and_bounded(spark, tmp_path):
    """A file holds a bounded number of pages, takes a fraction of its text, and reads back whole."""
    text = F.concat(F.lit('{"issues":[{"key":"X-'), F.col("id").cast("string"), F.lit('","fields":{"summary":"the same words again and again"}}],"isLast":true}'))
    pages = spark.range(0, 2500, 1, 1).select(text.alias("value")).union(spark.createDataFrame([('{"issues":[{"key":"BROKEN',)], "value STRING"))
    issue_source.write_issue_pages(pages, str(tmp_path / "pages"))
    files = list((tmp_path / "pages").glob("part-*"))
    lines = [gzip.decompress(f.read_bytes()).splitlines() for f in files]
    assert max(map(len, lines)) <= 1000 and sum(map(len, lines)) == 2501
    assert sum(f.stat().st_size for f in files) * 5 < sum(len(x) for some in lines for x in some)
    got = issue_source.read_issue_pages(spark, str(tmp_path / "pages"), strict=False)
    assert {r["issue_key"] for r in got.collect()} == {f"X-{n}" for n in range(2500)}
    assert one(issue_source.issue_rejects(spark, str(tmp_path / "pages")))["level"] == "page"


def test_unusable_records_of_an_export(spark, tmp_path):
    """Strict reading fails; otherwise what is usable is kept and the rest is listed with its reason."""
    keyless = {"issues": [{"fields": {"summary": "s"}}, {"key": "X-3", "fields": {"labels": "not a list", "timespent": "x", "summary": "t"}}]}
    (tmp_path / "p.json").write_text("\n".join([json.dumps(PAGE), '{"issues": [{"key": "X-7"', json.dumps(keyless)]))
    with pytest.raises(Exception):
        issue_source.read_issue_pages(spark, str(tmp_path)).collect()
    pages = issue_source.read_issue_pages(spark, str(tmp_path), strict=False)
    got = by(issue_source.issues_table(pages), "issue_key")
    assert set(got) == {"X-1", "X-2", "X-3"}
    assert (got["X-3"]["labels"], got["X-3"]["time_spent_s"], got["X-3"]["summary"]) == ([], 0, "t")  # a field of the wrong kind alone is missing
    rejects = [tuple(r) for r in issue_source.issue_rejects(spark, str(tmp_path)).collect()]
    assert sorted(rejects, key=str) == sorted([
        ("page", None, "not JSON", '{"issues": [{"key": "X-7"'), ("issue", None, "no key", '{"summary":"s"}'), ("change", "X-1", "time not readable", "junk Done")], key=str)


def test_bad_json_fails(spark, tmp_path):
    (tmp_path / "data-x.json").write_text("{not json")
    with pytest.raises(Exception):
        stores.read_item_files(spark, str(tmp_path)).collect()


def test_reference_store(spark, tmp_path):
    store = stores.ReferenceStore(spark, str(tmp_path))
    assert store.projects().count() == 0 and store.items().count() == 0
    projects = spark.createDataFrame([("P", "Alpha", "Migration", "2026-01-01", 3)], "project_key STRING, name STRING, type STRING, completed_at STRING, team_size INT").withColumn("completed_at", F.to_date("completed_at"))
    store.add(projects, refclass.refclass_items(items(spark, item("Done", cycle=4), item("Done", cycle=6), item("To Do"))), "b1")
    got = one(refclass.refclass_summary(store.projects(), store.items()))
    assert (got["project_count"], got["item_count"], got["avg_hours"]) == (1, 2, 5.0)
    orphan = spark.createDataFrame([(99, "x", "S", 1.0)], "project_id BIGINT, item_type STRING, size STRING, cycle_hours DOUBLE")
    orphan.write.parquet(f"{tmp_path}/items/batch=lost")
    assert store.items().count() == 2
    for batch in ("b1", "b2"):
        store.add(projects, refclass.refclass_items(items(spark, item("Done", cycle=4))), batch)
    got = one(refclass.refclass_summary(store.projects(), store.items()))
    assert (got["project_count"], got["item_count"]) == (2, 2)


def test_history_store(spark, tmp_path):
    store = stores.HistoryStore(spark, str(tmp_path / "h"), keep=3)
    assert store.read().count() == 0
    store.append(entries(spark, *[("P", ago(days=d), d, 1.0, {85: float(d)}) for d in range(5)]), "a")
    for _ in range(2):
        store.append(entries(spark, ("Q", ago(days=1), 7, 1.0, {70: 2.0})), "b")
    assert [(r["project_key"], r["completed"]) for r in store.read().collect()] == [("P", 2), ("P", 1), ("P", 0), ("Q", 7)]
    store.clear(spark.createDataFrame([("P",)], "project_key STRING"), F.lit(ago(days=1)))
    assert {(r["project_key"], r["completed"]) for r in store.visible().collect()} == {("P", 0), ("Q", 7)}
    moved = store.compact(str(tmp_path / "h2"))
    assert by(moved.read(), "project_key")["Q"]["percentiles"] == {70: 2.0}


def test_json_sink(spark, tmp_path):
    df = items(spark, item("Done")).select("project_key", "done_ts", F.create_map(F.lit(85), F.lit(2.5)).alias("p"))
    assert json.loads(stores.as_json(df).collect()[0]["json"]) == {"project_key": "P", "done_ts": None, "p": {"85": 2.5}}
    stores.write_json(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


PAGE = {
    "issues": [
        {
            "key": "X-1",
            "fields": {
                "summary": "One", "status": {"name": "Done"}, "issuetype": {"name": "Story"}, "labels": ["size:L", "kind"],
                "assignee": {"displayName": "Ann"}, "created": "2026-04-01T00:00:00.000+0000", "timespent": 7200,
                "parent": {"key": "X-9"}, "customfield_1": 5, "customfield_2": "8",
                "issuelinks": [
                    {"id": "1", "type": {"name": "Blocks", "inward": "is blocked by", "outward": "blocks"}, "outwardIssue": {"key": "X-2", "fields": {"summary": "Two", "status": {"name": "To Do"}}}},
                    {"id": "2", "type": {"name": "Blocks", "inward": "is blocked by", "outward": "blocks"}, "inwardIssue": {"key": "X-3", "fields": {"summary": "", "status": {"name": ""}}}},
                    {"id": "3", "type": {"name": "Blocks", "inward": "is blocked by", "outward": "blocks"}},
                ],
                "attachment": [{"id": "7", "filename": "a.pdf", "size": 10, "created": "2026-04-02T01:00:00.000+0000", "author": None}],
            },
            "changelog": {"histories": [
                {"created": "2026-04-03T00:00:00.000+0000", "author": {"displayName": "Bo"}, "items": [
                    {"field": "status", "fromString": "To Do", "toString": "In Progress"}, {"field": "assignee", "fromString": "", "toString": "Ann"}]},
                {"created": "2026-04-04T12:00:00.000+0000", "items": [{"field": "status", "fromString": "In Progress", "toString": "Done"}]},
                {"created": "junk", "items": [{"field": "status", "toString": "Done"}]},
            ]},
        },
        {"key": "X-2", "fields": {"summary": "Two", "status": {"name": "To Do"}, "created": "bad"}},
    ],
    "isLast": True,
}


@pytest.mark.parametrize("multiline", [False, True])
def test_issue_pages(spark, tmp_path, multiline):
    (tmp_path / "p.json").write_text(json.dumps(PAGE, indent=1 if multiline else None))
    pages = issue_source.read_issue_pages(spark, str(tmp_path), multiline)
    issues = issue_source.issues_table(pages, "customfield_1", "customfield_2")
    got = by(issues, "issue_key")
    assert got["X-1"]["labels"] == ["size:L", "kind"] and got["X-1"]["parent_key"] == "X-9"
    assert (got["X-1"]["override_hours"], got["X-1"]["story_points"], got["X-1"]["time_spent_s"]) == (5.0, None, 7200)
    assert got["X-2"]["created"] is None and got["X-2"]["labels"] == [] and got["X-2"]["project_key"] == "X"
    log = issue_source.transitions_table(pages)
    assert log.count() == 4 and one(ingest.closed_by(log))["closed_by"] == ""
    made = by(ingest.items_from_issues(
        issue_source.issues_table(pages), log, Settings(size_labels=(("size:L", "L"),))
    ), "item_id")
    assert (made["X-1"]["cycle_hours"], made["X-1"]["size"], made["X-1"]["status"]) == (36.0, "L", "Done")
    assert (made["X-2"]["size"], made["X-2"]["item_type"], made["X-2"]["cycle_hours"]) == ("M", "Unknown", 0.0)
    links = {(r["verb"], r["target_key"]) for r in issue_source.links_flat(pages).collect()}
    assert links == {("blocks", "X-2"), ("is blocked by", "X-3")}
    assert one(issue_source.attachments_flat(pages))["created_day"] == "2026-04-02"


def test_a_well_compressed_export_is_not_sent_through_the_driver(spark, tmp_path):
    """Planned by the size of its files, an export looks small; its items come out although no table of 256 KB may be broadcast."""
    head = F.concat(F.lit('{"key":"X-'), F.col("id").cast("string"), F.lit('","fields":{"summary":"s","status":{"name":"Done"}},'))
    issue = F.concat(head, F.lit('"changelog":{"histories":[{"created":"2026-04-03T00:00:00.000+0000","items":[{"field":"status","toString":"Done"}]}]}}'))
    pages = spark.range(20_000).groupBy(F.floor(F.col("id") / 100)).agg(F.concat_ws(",", F.collect_list(issue)).alias("issues"))
    issue_source.write_issue_pages(pages.select(F.concat(F.lit('{"issues":['), "issues", F.lit("]}"))), str(tmp_path / "pages"))
    limits = {"spark.sql.autoBroadcastJoinThreshold": "64k", "spark.sql.maxBroadcastTableSize": "256k"}
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        read = issue_source.read_issue_pages(spark, str(tmp_path / "pages"))
        made = ingest.items_from_issues(issue_source.issues_table(read), issue_source.transitions_table(read))
        got = {tuple(r) for r in made.select("item_id", "done_ts").collect()}
        assert got == {(f"X-{n}", datetime(2026, 4, 3)) for n in range(20_000)}
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in limits:
            spark.conf.unset(name)


def session_like(master, **conf):
    context = SimpleNamespace(master=master, applicationId="x", getConf=lambda: conf)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_scratch_reads_the_session_setting(spark):
    named = session_like("spark://host", **{scratch.CHECKPOINT_DIR: "hdfs:///tmp/work/"})
    assert scratch.shared_dir(named) == "hdfs:///tmp/work"
    with pytest.raises(RuntimeError, match=scratch.CHECKPOINT_DIR):
        scratch.shared_dir(session_like("spark://host"))
    assert scratch.shared_dir(spark) == scratch.shared_dir(spark)


# Streams

CHANGE = "project_key STRING, issue_key STRING, ts TIMESTAMP, seq BIGINT, field STRING, to_status STRING"


def write_changes(spark, path, files):
    for n, rows in enumerate(files):
        data = [(p, k, ago(hours=h), n, "status", s) for p, k, h, s in rows]
        spark.createDataFrame(data, CHANGE).coalesce(1).write.mode("append").parquet(f"{path}/f{n}")


FILES = [
    [("P", "1", 50, "In Progress"), ("P", "2", 40, "To Do"), ("Q", "9", 30, "To Do")],
    [("P", "1", 20, "Done"), ("P", "1", 60, "In Development")],
    [("P", "2", 10, "In Progress"), ("P", "1", 20, "Done")],
    [("P", "2", 5, "Canceled")],
    [("Q", "9", 1, "Done")],
]


def stream_of(spark, path):
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_stream_equals_batch(spark, tmp_path):
    write_changes(spark, tmp_path / "in", FILES)
    out, check = str(tmp_path / "out"), str(tmp_path / "c")
    for _ in range(2):
        streaming.stream_first_transitions(stream_of(spark, tmp_path / "in"), out, check, once=True).awaitTermination()
    batch = ingest.first_transitions(spark.read.schema(CHANGE).parquet(f"{tmp_path}/in/*"))
    assert sorted(map(str, streaming.read_first_transitions(spark, out).collect())) == sorted(map(str, batch.collect()))


@pytest.mark.parametrize("every", [2, 3, 20])
def test_streamed_status_equals_batch(spark, tmp_path, every):
    write_changes(spark, tmp_path / "in", FILES[:3])
    sink = streaming.StatusSink(str(tmp_path / "s"), snapshot_every=every)

    def run():
        streaming.stream_project_status(stream_of(spark, tmp_path / "in"), sink, str(tmp_path / "c"), once=True).awaitTermination()

    run()
    for n in (3, 4):
        data = [(p, k, ago(hours=h), n, "status", s) for p, k, h, s in FILES[n]]
        spark.createDataFrame(data, CHANGE).coalesce(1).write.parquet(f"{tmp_path}/in/f{n}")
        run()
    got = by(streaming.read_project_status(spark, sink), "project_key")
    assert (got["P"]["total"], got["P"]["done"], got["P"]["cycle_n"], got["P"]["avg_cycle_hours"]) == (1, 1, 1, 40.0)
    assert (got["Q"]["total"], got["Q"]["done"], got["Q"]["cycle_n"]) == (1, 1, 0)
    states = streaming.issue_states(spark.read.schema(CHANGE).parquet(f"{tmp_path}/in/*"))
    whole = rollup.status_counts(rollup.project_facts(streaming._as_items(states, sink.cfg), now()))
    assert sorted(map(str, whole.collect())) == sorted(map(str, streaming.read_project_status(spark, sink).select(whole.columns).collect()))


def test_a_repeated_batch_replaces_its_output(spark, tmp_path):
    sink = streaming.StatusSink(str(tmp_path))
    batch = streaming.issue_states(spark.createDataFrame([("P", "1", NOW, 0, "status", "Done")], CHANGE))
    sink(batch, 0)
    sink(batch, 0)
    assert one(streaming.read_project_status(spark, sink))["done"] == 1


def test_bucketed_tables_join_without_a_shuffle(spark):
    log = spark.createDataFrame([(str(i % 50), ago(hours=i), i, "a", "status", "", "Done") for i in range(200)],
                                "issue_key STRING, ts TIMESTAMP, seq INT, author STRING, field STRING, from_status STRING, to_status STRING")
    keys = log.select("issue_key").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        log = stores.save_bucketed(log, "bucketed_log", "issue_key", 4)
        keys = stores.save_bucketed(keys, "bucketed_keys", "issue_key", 4)
        joined = keys.join(ingest.first_transitions(log), "issue_key", "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and joined.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bucketed_log")
        spark.sql("DROP TABLE IF EXISTS bucketed_keys")


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_emptied_projects_and_the_empty_key(spark, tmp_path, fmt):
    store = stores.ItemStore(spark, str(tmp_path / "items"), fmt)
    store.write(items(spark, item("Done", project=""), item("To Do", project="Q"), item("To Do", project="R")))
    assert {r[0] for r in store.projects().collect()} == {"", "Q", "R"}
    assert one(store.read(""))["status"] == "Done"
    keys = spark.createDataFrame([("",), ("Q",)], "project_key STRING")
    store.write(items(spark, item("Done", project="")), keys)
    assert {r["project_key"] for r in store.read().collect()} == {"", "R"} and store.read("Q").count() == 0
    store.write(items(spark, item("Done", project="Q", key="back")), keys)
    assert {(r["project_key"], r["item_id"]) for r in store.read().collect()} == {("R", "K"), ("Q", "back")}


def test_item_files_that_are_not_there(spark, tmp_path):
    assert stores.read_item_files(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "data-x.json").write_text(json.dumps([{"ID": "1", "Status": None}]))
    assert one(stores.read_item_files(spark, str(tmp_path)))["status"] == ""


def test_an_issue_without_a_status_is_to_do(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"issues": [{"key": "X-1", "fields": {"summary": "s"}}], "isLast": True}))
    table = issue_source.issues_table(issue_source.read_issue_pages(spark, str(tmp_path)))
    none = spark.createDataFrame([], "issue_key STRING, ts TIMESTAMP, seq STRUCT<h INT, i INT>, author STRING, field STRING, from_status STRING, to_status STRING")
    got = one(rollup.project_facts(ingest.items_from_issues(table, none, Settings()), now()))
    assert (got["total"], got["to_do"]) == (1, 1)


def test_entries_of_one_time_are_decided_by_their_figures(spark, tmp_path):
    store = stores.HistoryStore(spark, str(tmp_path / "h"), keep=1)
    store.append(entries(spark, *[("P", ago(days=1), n, 1.0, {85: 1.0}) for n in (3, 9, 4)]), "a")
    assert one(store.read())["completed"] == 9
