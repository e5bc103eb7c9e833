"""Versions, commits and what is stored by them: reference classes, history, streamed tables."""

import threading

import pytest
from pyspark.sql import functions as F

from shipgauge.operators import rollup, trends
from shipgauge.sources import stores
from shipgauge.sources.manifest import Manifest
from shipgauge.sources.schemas import HISTORY
from shipgauge.streaming import status as streaming
from tests.test_sources import CHANGE
from tests.util import NOW, ago, by, now, one


def files(path, suffix=".parquet"):
    return sum(f.is_file() and f.name.endswith(suffix) for f in path.rglob("*"))


def test_two_writers_of_one_version(spark, tmp_path):
    """The slower one starts again from the other's version, so nothing is lost."""
    table, tries = Manifest(spark, str(tmp_path)), []

    def slow(parts, notes):
        tries.append(len(parts))
        if len(tries) == 1:
            assert Manifest(spark, str(tmp_path)).change(lambda p, n: p.update(fast={"path": "a"}))
        parts["slow"] = {"path": "b"}

    assert table.change(slow) and tries == [0, 1]
    assert set(table.parts()) == {"fast", "slow"} and table.current()[0] == 2
    assert not table.change(lambda parts, notes: False) and table.current()[0] == 2


def test_many_writers(spark, tmp_path):
    def add(k):
        Manifest(spark, str(tmp_path)).change(lambda parts, notes: parts.update({str(k): {"path": str(k)}}))

    threads = [threading.Thread(target=add, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert set(Manifest(spark, str(tmp_path)).parts()) == set("012345")


def test_vacuum_keeps_what_versions_list(spark, tmp_path):
    table = Manifest(spark, str(tmp_path))
    for k in range(4):
        path = table.new_folder("p")
        spark.range(k + 1).write.parquet(table.absolute(path))
        table.change(lambda parts, notes: parts.update(only={"path": path}))
    table.vacuum(keep=2)
    assert len(list((tmp_path / "data").iterdir())) == 2 and len(table._numbers()) == 2
    assert table.read([table.parts()["only"]["path"]], "id BIGINT").count() == 4


def classes(spark, *names):
    made = [(n, n, "T", None, 1) for n in names]
    projects = spark.createDataFrame(made, "project_key STRING, name STRING, type STRING, completed_at DATE, team_size INT")
    return projects, spark.createDataFrame([(n, "X", "S", 2.0) for n in names], "project_key STRING, item_type STRING, size STRING, cycle_hours DOUBLE")


def test_a_stopped_writer_leaves_the_old_batch(spark, tmp_path, monkeypatch):
    store = stores.ReferenceStore(spark, str(tmp_path))
    store.add(*classes(spark, "A", "B"), "b1")
    with monkeypatch.context() as m:  # stopped after its data and before its version
        m.setattr(Manifest, "change", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            store.add(*classes(spark, "C"), "b1")
    assert {r.name for r in store.projects().collect()} == {"A", "B"} and store.items().count() == 2
    broken = classes(spark, "C")[1].withColumn("cycle_hours", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):  # stopped within its data
        store.add(classes(spark, "C")[0], broken, "b1")
    assert {r.name for r in store.projects().collect()} == {"A", "B"} and store.items().count() == 2
    readers = store.projects()
    store.add(*classes(spark, "C"), "b1")
    assert {r.name for r in store.projects().collect()} == {"C"} and store.items().count() == 1
    assert {r.name for r in readers.collect()} == {"A", "B"}  # one that began before still has its version


def entries(spark, *rows):
    data = [(p, ts, 10, n, 10 - n, 1.0, 1.0, {70: 1.0, 85: float(n)}) for p, ts, n in rows]
    return spark.createDataFrame(data, HISTORY)


def test_history_of_a_window_reads_its_months_only(spark, tmp_path):
    store = stores.HistoryStore(spark, str(tmp_path))
    store.append(entries(spark, *[(p, ago(days=d), 5) for d in range(90) for p in "PQ"]), "a")
    store.append(entries(spark, ("P", NOW, 9), (None, NOW, 1)), "b")
    window = store.window(now(), 7)
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [" in plan and "GreaterThan(ts" in plan
    assert window.count() == 16 and store.visible().count() == 182
    assert sorted(map(str, window.collect())) == sorted(map(str, trends.in_window(store.visible(), now(), 7).collect()))
    store.clear(spark.createDataFrame([("P",)], "project_key STRING"), F.lit(ago(days=2)))
    assert store.window(now(), 7).where("project_key = 'P'").count() == 3


def changes(spark, rows):
    return spark.createDataFrame([(p, k, ago(hours=h), n, "status", s) for p, k, h, n, s in rows], CHANGE)


def test_runs_stay_few(spark, tmp_path):
    """40 batches in threes leave at most two runs of each of four sizes, and a repeated batch changes nothing."""
    runs = streaming.AnchorRuns(spark, str(tmp_path), fan_in=3)
    log = []
    for n in range(40):
        log.append(("P", str(n % 7), 100 - n, n, "In Progress" if n % 3 else "Done"))
        batch = streaming.first_transitions(changes(spark, log[-1:]).coalesce(1))
        for _ in range(1 + n % 2):
            runs.fold(batch, n)
    parts = runs.table.parts().values()
    assert len(parts) <= 8 and max(p["level"] for p in parts) == 3
    assert len(list((tmp_path / "data").iterdir())) < 20
    whole = streaming.first_transitions(changes(spark, log))
    assert sorted(map(str, runs.read().collect())) == sorted(map(str, whole.collect()))


def test_a_batch_reads_and_rewrites_its_own_parts(spark, tmp_path):
    sink = streaming.StatusSink(str(tmp_path), buckets=64, snapshot_every=2)
    many = [("P" if i % 3 else f"Q{i}", str(i), 50, 0, "In Progress") for i in range(300)]
    sink(streaming.issue_states(changes(spark, many)), 0)
    before = sink.table(spark).parts()
    hot = sink.state(spark).withColumn("bucket", sink.bucket()).where("project_key = 'P'").select("bucket").distinct().count()
    assert 8 <= hot <= streaming.SPREAD  # one project's issues are in several parts
    log = list(many)
    for n in range(1, 5):
        log.append(("P", "1", 20 - n, n, "Done" if n > 1 else "To Do"))
        sink(streaming.issue_states(changes(spark, log[-1:])), n)
    after = sink.table(spark).parts()
    changed = {b for b in after if after[b] != before[b]}
    assert len(changed) == 1  # the part of that issue, of 64
    touched = sink.state(spark, [int(b) for b in changed])
    assert touched.count() < 300 / 8 and len(touched.inputFiles()) <= 2
    assert files(tmp_path) <= 4 * len(after) + 20  # those of the last versions only
    whole = rollup.status_counts(rollup.project_facts(streaming._as_items(streaming.issue_states(changes(spark, log)), sink.cfg), now()))
    got = streaming.read_project_status(spark, sink).select(whole.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    sink(streaming.issue_states(changes(spark, [("P", "1", 0, 9, "Canceled")])), 2)  # run again: folded in already
    assert sorted(map(str, streaming.read_project_status(spark, sink).select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert by(whole, "project_key")["P"]["done"] == 1


def test_an_empty_batch_and_an_empty_table(spark, tmp_path):
    sink = streaming.StatusSink(str(tmp_path / "s"))
    assert sink.state(spark).count() == 0
    sink(streaming.issue_states(changes(spark, [])), 0)
    sink(streaming.issue_states(changes(spark, [("P", "1", 1, 0, "Done")])), 1)
    assert one(streaming.read_project_status(spark, sink))["total"] == 1
    assert streaming.read_first_transitions(spark, str(tmp_path / "none")).count() == 0
