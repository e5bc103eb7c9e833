"""Issues, changelogs, tasks, selection and planned changes."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shipgauge.functions import labels, status, times
from shipgauge.functions.fields import story_points, value_kind
from shipgauge.operators import audit, ingest, selection, tasks
from shipgauge.settings import Settings
from tests.util import by, one

BOTH_DONE = Settings(done_statuses=("Done", "Awaiting Dev Deployment"))
CHANGE = "issue_key STRING, ts TIMESTAMP, seq INT, author STRING, field STRING, from_status STRING, to_status STRING"


def day(n):
    return datetime(2026, 4, n)


def changes(spark, *rows):
    return spark.createDataFrame(
        [("I-1", day(d), i, a, f, "", to) for i, (d, a, f, to) in enumerate(rows)], CHANGE
    )


LOG = [(10, "ann", "status", "In Development"), (15, "bo", "status", "Awaiting Dev Deployment"), (20, "cy", "status", "Done")]


def test_status_normalized(spark):
    raw = ["Done", "Awaiting Dev Deployment", "In Progress", "In Development", "To Do", "done"]
    df = spark.createDataFrame([(r,) for r in raw], "s STRING")
    got = [r[0] for r in df.select(status.normalize_status(F.col("s"), BOTH_DONE.done_statuses, BOTH_DONE.wip_statuses)).collect()]
    assert got == ["Done", "Done", "In Progress", "In Progress", "To Do", "done"]


def test_task_status_table(spark):
    raw = ["todo", "To Do", "to_do", "", "in_progress", "In Progress", "done", "completed", "blocked", "Custom", " Odd "]
    df = spark.createDataFrame([(r,) for r in raw], "s STRING")
    got = [r[0] for r in df.select(status.normalize_task_status(F.col("s"))).collect()]
    assert got == ["To Do"] * 4 + ["In Progress"] * 2 + ["Done"] * 2 + ["Blocked", "Custom", " Odd "]


@pytest.mark.parametrize("cfg,done", [(BOTH_DONE, 15), (Settings(), 20)])
def test_done_anchor(spark, cfg, done):
    got = one(ingest.first_transitions(changes(spark, *LOG), cfg))
    assert got["in_progress_ts"] == day(10) and got["done_ts"] == day(done)


def test_first_transition_is_earliest_not_first_listed(spark):
    got = one(ingest.first_transitions(changes(spark, *reversed(LOG)), Settings()))
    assert got["in_progress_ts"] == day(10) and got["done_ts"] == day(20)


def test_custom_in_progress_status(spark):
    cfg = Settings(wip_statuses=("Coding",))
    got = one(ingest.first_transitions(changes(spark, (3, "a", "status", "Coding"), (4, "a", "assignee", "Done")), cfg))
    assert got["in_progress_ts"] == day(3) and got["done_ts"] is None


def test_no_changes(spark):
    assert ingest.first_transitions(changes(spark)).count() == 0


def test_closed_by_uses_the_literal_done(spark):
    assert one(ingest.closed_by(changes(spark, *LOG)))["closed_by"] == "cy"
    assert one(ingest.closed_by(changes(spark, (1, None, "status", "Done"), (2, "z", "status", "Done"))))["closed_by"] == ""


@pytest.mark.parametrize("wip,done,override,spent,hours", [
    (day(1), day(2), None, 0, 24.0), (day(2), day(1), None, 7200, -24.0), (day(1), day(2), 5.0, 7200, 5.0),
    (day(1), day(2), 0.0, 7200, 24.0), (None, day(2), None, 7200, 2.0), (day(1), day(1), None, 1800, 0.5),
    (None, None, None, 0, 0.0), (day(1), day(2), -1.0, 0, 24.0),
])
def test_cycle_precedence(spark, wip, done, override, spent, hours):
    df = spark.createDataFrame([(wip, done, override, spent)], "w TIMESTAMP, d TIMESTAMP, o DOUBLE, s BIGINT")
    assert one(df.select(ingest.cycle_hours(*map(F.col, "wdos")).alias("h")))["h"] == hours


def test_changelog_flat(spark):
    got = one(ingest.changelog_flat(changes(spark, (1, "", "status", ""))))
    assert (got["author"], got["from_status"], got["to_status"]) == ("Unknown", "(none)", "(none)")


def test_labels(spark):
    pairs = (("b", "Bee"), ("a", "Ay"), ("a", "Other"))
    df = spark.createDataFrame([(["x", "a", "b"],), (["x"],), ([],)], "l ARRAY<STRING>")
    assert [r[0] for r in df.select(labels.first_mapped(F.col("l"), pairs, "?")).collect()] == ["Ay", "?", "?"]
    sized = spark.createDataFrame([(["x", "size:XL", "size:S"],), (["x"],)], "l ARRAY<STRING>")
    assert [r[0] for r in sized.select(labels.first_prefixed(F.col("l"), "size:")).collect()] == ["XL", None]
    changed = df.select(labels.relabel(F.col("l"), ["new", "x"], ["a"])).collect()
    assert [r[0] for r in changed] == [["x", "b", "new"], ["x", "new"], ["new", "x"]]
    with pytest.raises(ValueError):
        labels.relabel(F.col("l"), [], [])


def test_tracker_times(spark):
    raw = [
        "2025-12-04T05:24:06.077-0800", "2025-12-04T05:24:06.077Z", "2025-12-04T05:24:06Z", "2025-12-04T05:24:06.077-08:00",
        "2025-12-04T05:24:06+02:00", "2025-12-04", "junk", "", "2025-12-04T05:24:06", "2025-13-04T05:24:06Z", "2025-12-04T05:24:06-0800",
    ]
    df = spark.createDataFrame([(r,) for r in raw], "s STRING")
    got = [r[0] for r in df.select(times.parse_tracker_time(F.col("s"))).collect()]
    assert got[0] == got[3] == datetime(2025, 12, 4, 13, 24, 6, 77000)
    assert got[1] == datetime(2025, 12, 4, 5, 24, 6, 77000) and got[2] == datetime(2025, 12, 4, 5, 24, 6)
    assert got[4] == datetime(2025, 12, 4, 3, 24, 6)
    assert got[5:] == [None] * 6


def test_typed_fields(spark):
    text = '{"a": 3, "b": "5", "c": null, "d": [1], "e": {"x": 1}, "f": 2.5, "g": true}'
    df = spark.createDataFrame([(text,)], "t STRING").select(F.parse_json("t").alias("raw"))
    points = one(df.select(*[story_points(F.col("raw"), n).alias(n) for n in "abcdefgh"]))
    assert points == {"a": 3.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": 0.0, "f": 2.5, "g": 0.0, "h": 0.0}
    kinds = one(df.select(*[value_kind(F.variant_get("raw", f"$.{n}", "variant")).alias(n) for n in "abcdefg"]))
    assert kinds == {"a": "number", "b": "string", "c": None, "d": "array", "e": "object", "f": "number", "g": "unknown"}


# Tasks

TASK = (
    "key STRING, tracker_key STRING, summary STRING, type STRING, size STRING, status STRING, labels ARRAY<STRING>, "
    "blocked_by ARRAY<STRING>, created_at STRING, started_at STRING, completed_at STRING, assignee STRING"
)


def task(key, tracker=None, status="todo", size="", blocked_by=(), created=None, started=None, completed=None, kind=""):
    return (key, tracker, "", kind, size, status, [], list(blocked_by), created, started, completed, "")


def task_df(spark, *rows):
    return spark.createDataFrame(list(rows), TASK)


def test_task_conversion(spark):
    got = by(tasks.items_from_tasks(task_df(
        spark, task("A", status="done", size=" s ", started="2026-05-01", completed="2026-05-01"),
        task("B", status="in_progress", started="2026-05-01"),
        task("C", status="done", started="2026-05-01", completed="2026-05-04", created=""),
    )), "item_id")
    assert (got["A"]["status"], got["A"]["size"], got["A"]["cycle_hours"]) == ("Done", "S", 0.0)
    assert got["B"]["status"] == "In Progress" and got["B"]["done_ts"] is None
    assert got["C"]["cycle_hours"] == 72.0 and got["C"]["created"] is None


@pytest.mark.parametrize("bad,text", [
    (task(""), "key is required"), (task("A", created="2026-5-1"), "created_at"), (task("A", completed="soon"), "completed_at"),
])
def test_invalid_task(spark, bad, text):
    df = task_df(spark, bad, task("ok"))
    with pytest.raises(Exception, match=text):
        tasks.items_from_tasks(df).select("status").collect()
    for later in ("item_id = 'ok'", "description = 'none such'"):
        with pytest.raises(Exception, match=text):
            tasks.items_from_tasks(df).where(later).collect()
    assert [r["item_id"] for r in tasks.valid_items_from_tasks(df).collect()] == ["ok"]
    assert text in one(tasks.task_rejects(df))["reject_reason"]


ISSUE = (
    "issue_key STRING, project_key STRING, epic_key STRING, parent_key STRING, summary STRING, raw_status STRING, "
    "labels ARRAY<STRING>, assignee STRING, created TIMESTAMP, updated TIMESTAMP, time_spent_s BIGINT, "
    "override_hours DOUBLE, story_points DOUBLE"
)


def issue(key, raw="To Do", epic=None, parent=None, tags=(), created=1, points=None, spent=0):
    return (key, key.split("-")[0], epic, parent, "", raw, list(tags), "", day(created), day(created), spent, None, points)


def issue_df(spark, *rows):
    return spark.createDataFrame(list(rows), ISSUE)


def test_reconcile(spark):
    plan = tasks.task_reconcile(
        task_df(spark, task("A", "X-1", "todo"), task("B", "X-2"), task("C"), task("D", kind="Bug"), task("E", "X-1", "Done")),
        issue_df(spark, issue("X-1", "Done")),
    )
    got = {k: (v["action"], v["new_status"], v["status_changed"], v["issue_type"]) for k, v in by(plan, "key").items()}
    assert got == {
        "A": ("update", "Done", True, ""), "B": ("skip", "todo", False, ""), "C": ("create", "To Do", True, "Story"),
        "D": ("create", "To Do", True, "Bug"), "E": ("update", "Done", False, ""),
    }
    assert {k: v["n"] for k, v in by(tasks.reconcile_counts(plan), "action").items()} == {"update": 2, "skip": 1, "create": 2}


def test_dependency_edges(spark):
    t = task_df(
        spark, task("FI-336", "T-1"), task("FI-337", "T-2", blocked_by=["FI-336", "gone"]),
        task("FI-338", "T-3", blocked_by=["FI-336", "FI-337"]), task("FI-339", blocked_by=["FI-336"]),
        task("FI-340", "T-4", blocked_by=["FI-339"]),
    )
    links = spark.createDataFrame([("T-1", "T-3")], "blocker STRING, blocked STRING")
    got = {tuple(r) for r in tasks.dependency_edges(t, links).select("blocker", "blocked").collect()}
    assert got == {("T-1", "T-2"), ("T-2", "T-3")}


# Selection

def test_issue_filter(spark):
    df = issue_df(spark, issue("X-2", epic="E", tags=["a"], created=2), issue("X-1", parent="E", tags=["b"]), issue("Y-1", epic="E", tags=["a"]), issue("X-3", epic="F", parent="E", tags=["a"]))
    assert [r["issue_key"] for r in selection.issue_filter(df, "X", "E", ["a", "b"]).collect()] == ["X-1", "X-2"]
    assert selection.issue_filter(df).count() == 4


def test_search_counts_all_and_shows_some(spark):
    rows = selection.issue_search(issue_df(spark, *[issue(f"X-{i}", created=i) for i in range(1, 29)])).collect()
    assert len(rows) == 20 and {r["total_matches"] for r in rows} == {28}


def test_epic_resolution(spark):
    df = spark.createDataFrame([("SMG-1", "C-9"), ("rc1", "CFG-2"), ("rc1", "none"), (None, "AB-1"), ("A-1", None)], "y STRING, c STRING")
    got = [r[0] for r in df.select(selection.resolve_epic(F.col("y"), F.col("c"))).collect()]
    assert got == ["SMG-1", "CFG-2", None, "AB-1", None]


PROJECT = "project_key STRING, epic_key STRING, name STRING, capacity DOUBLE, config_order INT"


def test_project_resolution(spark):
    projects = spark.createDataFrame(
        [("mono", "E-1", "Mono", None, 0), ("api", "E-1", "Api", None, 1), ("", "E-2", "Keyless", None, 2), ("E-2", "x", "Late", None, 3)], PROJECT
    )
    asked = spark.createDataFrame([(i, r) for i, r in enumerate(["api", "E-1", "E-2", "nope", ""])], "id INT, r STRING")
    got = {k: v["resolved_project"] for k, v in by(selection.resolve_projects(asked, projects, "r"), "r").items()}
    assert got == {"api": "api", "E-1": "mono", "E-2": "E-2", "nope": None, "": None}


def test_routing(spark):
    instances = spark.createDataFrame(
        [("default", ["MAIN"], True), ("fsg", ["FSG"], False), ("multi", ["SMG", "ALT", "OTHER", "MAIN"], False)],
        "instance STRING, prefixes ARRAY<STRING>, is_default BOOLEAN",
    )
    expected = {
        "SMG-1689": "multi", "FSG-8348": "fsg", "ALT-42": "multi", "OTHER-7": "multi", "MAIN-1": "default",
        "ZZZ-1": "default", "fsg-8348": "fsg", "no-dash-no-issue": "default", "": "default", "-5": "default",
    }
    keys = spark.createDataFrame([(k,) for k in expected], "k STRING")
    got = {k: v["instance"] for k, v in by(selection.route_instances(keys, instances, "k", "default"), "k").items()}
    assert got == expected


@pytest.mark.parametrize("project,overall,expected", [(5.0, 6.0, 5.0), (None, 6.0, 6.0), (0.0, None, 8.0), (-1.0, 0.0, 8.0)])
def test_capacity(spark, project, overall, expected):
    df = spark.createDataFrame([(project,)], "c DOUBLE")
    assert one(df.select(selection.effective_capacity(F.col("c"), Settings(global_capacity=overall)).alias("c")))["c"] == expected


def test_all_projects(spark):
    configured = spark.createDataFrame([("a", "E", "A", None, 0)], PROJECT)
    files = spark.createDataFrame([("b", "", 1), ("c", "Sea", 2)], "project_key STRING, name STRING, config_order INT")
    got = {k: v["name"] for k, v in by(selection.all_projects(configured, files), "project_key").items()}
    assert got == {"a": "A", "b": "b", "c": "Sea"}


# Audits

def test_missing_times_and_backfill(spark):
    i = issue_df(spark, issue("X-1", "Done", points=3.0), issue("X-2", "Done"), issue("X-3", "Done", spent=60), issue("X-4"), issue("X-5", "Awaiting Dev Deployment"))
    log = spark.createDataFrame([("X-1", day(1), 0, "ann", "status", "", "Done")], CHANGE)
    missing = audit.missing_times(i, log, BOTH_DONE)
    assert {k: v["closed_by"] for k, v in by(missing, "issue_key").items()} == {"X-1": "ann", "X-2": "(unknown)"}
    assert {k: v["seconds"] for k, v in by(audit.time_backfill_plan(missing), "issue_key").items()} == {"X-1": 43200, "X-2": 28800}
    assert {k: (v["level"], v["missing"]) for k, v in by(audit.missing_totals(missing), "project_key").items()} == {"X": ("project", 2), None: ("all", 2)}


def test_bulk_transition(spark):
    flow = spark.createDataFrame(
        [("To Do", "1", "Go", "Done", 2), ("To Do", "2", "Done", "Closed", 1), ("Stuck", "3", "Go", "Open", 1)],
        "status STRING, transition_id STRING, name STRING, to_status STRING, position INT",
    )
    plan = audit.bulk_transition_plan(issue_df(spark, issue("X-1"), issue("X-2", "Stuck")), flow, "Done")
    got = {k: (v["transition_id"], v["outcome"]) for k, v in by(plan, "issue_key").items()}
    assert got == {"X-1": ("2", "accepted"), "X-2": (None, "rejected")}


def test_field_profile(spark):
    raw = ['{"customfield_1": 1, "other": 2}', '{"customfield_1": "x", "customfield_2": null}', '{"customfield_1": 7.5}', "{}"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(raw)], "issue_key STRING, t STRING").select("issue_key", F.parse_json("t").alias("raw"))
    names = spark.createDataFrame([("customfield_1", "Story Points")], "field STRING, name STRING")
    got = {k: (v["n"], v["name"], v["maybe_points"]) for k, v in by(audit.field_profile(df, names), "field", "kind").items()}
    assert got == {("customfield_1", "number"): (2, "Story Points", True), ("customfield_1", "string"): (1, "Story Points", True)}
