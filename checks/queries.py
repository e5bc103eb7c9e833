"""Every operator as a query over the given tables: name -> f(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks import warehouse as wh
from shipgauge.functions import fields
from shipgauge.functions.labels import first_mapped, first_prefixed
from shipgauge.functions.status import normalize_status, normalize_task_status
from shipgauge.functions.times import parse_tracker_time
from shipgauge.operators import (
    audit, earned, ingest, quantiles, refclass, rollup, selection, series, tasks, trends,
)
from shipgauge.plans import reports
from shipgauge.session import tune
from shipgauge.sources import issues as issue_source, scratch, stores
from shipgauge.streaming import status as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# What a run and a report document; status and compare ask for half of it.
ITERATIONS = 10_000
SAMPLING = reports.Sampling(iterations=ITERATIONS)
ITEM_COLUMNS = (
    "project_key", "item_id", "item_type", "description", "size", "status", "created",
    "in_progress_ts", "done_ts", "cycle_hours", "assignee", "tracker_key",
)


def query(f: Query) -> Query:
    """Registers ``f``, to run with the skew settings and in UTC, as its SQL does."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return f(tune(spark), sf_dir)

    QUERIES[f.__name__] = run
    return f


def items(s: SparkSession, d: str) -> DataFrame:
    return ingest.items_from_issues(wh.issues(s, d), wh.transitions(s, d), wh.CFG)


def project_facts(s: SparkSession, d: str) -> DataFrame:
    return rollup.project_facts(items(s, d), wh.as_of(), wh.CFG)


def size_facts(s: SparkSession, d: str) -> DataFrame:
    return rollup.size_facts(items(s, d), wh.as_of(), wh.CFG)


def plans(s: SparkSession, d: str) -> DataFrame:
    facts = wh.projects(s, d).select("project_key", "capacity").join(project_facts(s, d), "project_key")
    return earned.with_plan(facts, wh.CFG)


def all_projects(s: SparkSession, d: str) -> DataFrame:
    return selection.all_projects(wh.projects(s, d), wh.task_file_projects(s, d))


def text(name: str) -> Column:
    return F.concat_ws(",", name).alias(name)


def page_files(s: SparkSession, d: str) -> str:
    """Issue pages written as JSON lines."""
    path = scratch.new_path(s, "pages")
    issue_source.write_issue_pages(wh.issue_pages(s, d), path)
    return path


def pages(s: SparkSession, d: str) -> DataFrame:
    return issue_source.read_issue_pages(s, page_files(s, d), strict=False)


# Custom fields of the written pages.
PAGE_FIELDS = ("customfield_10001", "customfield_10002", "customfield_10014")


def stored_history(s: SparkSession, d: str) -> stores.HistoryStore:
    store = stores.HistoryStore(s, scratch.new_path(s, "history"))
    store.append(wh.history(s, d), "daily")
    return store


def plain_history(h: DataFrame) -> DataFrame:
    """The percentile map as columns."""
    return h.select(
        "project_key", "ts", "total", "completed", "remaining", "avg_cycle", "throughput",
        trends.level(70).alias("p70"), trends.level(85).alias("p85"), trends.level(95).alias("p95"),
    )


# Sources and sinks


@query
def items_scan(s, d):
    store = stores.ItemStore(s, scratch.new_path(s, "items"), "json")
    store.write(items(s, d))
    return store.read().select(*ITEM_COLUMNS)


@query
def item_files(s, d):
    """Items written as a JSON array per project and read back, those of three projects by their names."""
    folder = scratch.new_path(s, "item-files")
    wh.write_item_files(s, d, items(s, d), folder)
    some = [f"NATION_{n}" for n in (3, 11, 7)]
    named = stores.read_item_files(s, folder, some).withColumn("asked", F.lit(True))
    return stores.read_item_files(s, folder).withColumn("asked", F.lit(False)).union(named)


@query
def items_replaced(s, d):
    """All projects with an even last digit are synchronised again; of theirs only Done components remain."""
    store = stores.ItemStore(s, scratch.new_path(s, "items"))
    everything = items(s, d)
    store.write(everything)
    again = F.substring("project_key", -1, 1).isin("0", "2", "4", "6", "8")
    done = everything.where(again & (F.col("status") == "Done") & (F.col("size") == "M"))
    store.write(done, everything.where(again).select("project_key").distinct())
    return store.read().select(*ITEM_COLUMNS)


@query
def projects_with_data(s, d):
    store = stores.ItemStore(s, scratch.new_path(s, "items"))
    store.write(items(s, d))
    return store.projects()


@query
def issues_scan(s, d):
    return issue_source.issues_table(pages(s, d), *PAGE_FIELDS).withColumn("labels", text("labels"))


@query
def issue_rejects(s, d):
    return issue_source.issue_rejects(s, page_files(s, d))


@query
def links_flat(s, d):
    return issue_source.links_flat(pages(s, d))


@query
def attachments_flat(s, d):
    return issue_source.attachments_flat(pages(s, d))


@query
def pages_to_items(s, d):
    """Export to items without any table in between."""
    p = pages(s, d)
    return ingest.items_from_issues(issue_source.issues_table(p, *PAGE_FIELDS), issue_source.transitions_table(p), wh.CFG)


@query
def refclass_append(s, d):
    """Finished items added to the store as one class per project, and read back."""
    store = stores.ReferenceStore(s, scratch.new_path(s, "reference"))
    classes = wh.projects(s, d).select(
        "project_key", "name", F.col("project_type").alias("type"),
        F.to_date(wh.as_of()).alias("completed_at"), F.lit(5).alias("team_size"),
    )
    store.add(classes, refclass.refclass_items(items(s, d)), "finished")
    return refclass.refclass_summary(store.projects(), store.items())


@query
def history_scan(s, d):
    return plain_history(stores.HistoryStore.read(stored_history(s, d)))


@query
def history_retained(s, d):
    return plain_history(trends.retained(wh.history(s, d)))


@query
def history_cleared(s, d):
    store = stored_history(s, d)
    store.clear(wh.projects(s, d).where(F.col("config_order") == 3), wh.as_of())
    return plain_history(store.visible())


@query
def history_compacted(s, d):
    store = stored_history(s, d)
    return plain_history(store.compact(scratch.new_path(s, "compacted")).visible())


@query
def json_sink(s, d):
    path = scratch.new_path(s, "json")
    dashboard = reports.dashboard(items(s, d), wh.projects(s, d), wh.as_of(), wh.CFG)
    stores.write_json(dashboard, path)
    return s.read.schema(dashboard.schema).json(path)


@query
def sync_summary(s, d):
    return rollup.sync_summary(items(s, d))


# Projections and predicates


@query
def items_from_issues(s, d):
    return items(s, d)


@query
def status_normalized(s, d):
    done, wip = wh.CFG.done_statuses, wh.CFG.wip_statuses
    return (
        wh.transitions(s, d)
        .groupBy(F.col("to_status").alias("raw"), normalize_status(F.col("to_status"), done, wip).alias("status"))
        .agg(F.count("*").alias("n"))
    )


@query
def task_status_normalized(s, d):
    return wh.tasks(s, d).select("key", normalize_task_status(F.col("status")).alias("status"))


@query
def type_from_labels(s, d):
    return wh.issues(s, d).select(
        "issue_key",
        first_mapped(F.col("labels"), wh.CFG.type_labels, wh.CFG.default_type).alias("item_type"),
    )


@query
def size_from_labels(s, d):
    return wh.issues(s, d).select(
        "issue_key",
        first_mapped(F.col("labels"), wh.CFG.size_labels, wh.CFG.default_size).alias("size"),
    )


@query
def size_from_prefix(s, d):
    return wh.tasks(s, d).select("key", first_prefixed(F.col("labels"), "size:").alias("size"))


@query
def synced_task_items(s, d):
    return tasks.items_from_synced_tasks(wh.tasks(s, d))


@query
def ts_parsed(s, d):
    """Order dates written in each accepted layout, and in one that is not."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    tails = (
        "T05:24:06.077-0800", "T05:24:06.077Z", "T05:24:06Z", "T05:24:06.077+02:00", " 05:24:06",
    )
    tail = F.element_at(F.array(*map(F.lit, tails)), (key % 5 + 1).cast("int"))
    return wh.table(s, d, "orders").select(
        key.alias("issue_key"), parse_tracker_time(F.concat(day, tail)).alias("ts")
    )


@query
def cycle_time(s, d):
    return items(s, d).select("item_id", "cycle_hours")


def stored_tasks(s, d):
    """Tasks as a written table, so that their dates are columns, not formulas."""
    return scratch.materialize(wh.tasks(s, d), "tasks")


@query
def items_from_tasks(s, d):
    return tasks.valid_items_from_tasks(stored_tasks(s, d))


@query
def items_from_tasks_strict(s, d):
    good = stored_tasks(s, d).withColumn(
        "created_at", F.when(F.col("key") % 97 != 0, F.col("created_at"))
    )
    return tasks.items_from_tasks(good)


@query
def task_rejects(s, d):
    return tasks.task_rejects(stored_tasks(s, d))


@query
def story_points(s, d):
    return wh.raw_fields(s, d).select(
        "issue_key", fields.story_points(F.col("raw"), "customfield_10002").alias("points")
    )


@query
def issue_filter(s, d):
    return selection.issue_filter(
        wh.issues(s, d), project="NATION_7", epic="ASIA", labels=["size:S", "kind:fix"]
    ).select("issue_key", "raw_status", "created")


@query
def issue_search(s, d):
    return selection.issue_search(wh.issues(s, d).where(F.col("raw_status") == "In Development"))


@query
def epic_resolved(s, d):
    own = F.concat(F.upper(F.substring("p_type", 1, 3)), F.lit("-"), F.col("p_size").cast("string"))
    broken = F.when(F.col("p_partkey") % 3 == 0, F.lower(own)).otherwise(own)
    configured = F.when(F.col("p_partkey") % 2 == 0, "CFG-7").otherwise("none")
    return wh.table(s, d, "part").select(
        F.col("p_partkey").alias("key"), selection.resolve_epic(broken, configured).alias("epic")
    )


@query
def refclass_from_items(s, d):
    return refclass.refclass_items(items(s, d))


@query
def eligibility(s, d):
    base = reports.base_facts(items(s, d), all_projects(s, d), wh.as_of(), wh.CFG)
    return reports.eligibility(base.projects)


# Joins


@query
def task_reconcile(s, d):
    return tasks.task_reconcile(wh.tasks(s, d), wh.issues(s, d))


@query
def task_reconcile_counts(s, d):
    return tasks.reconcile_counts(task_reconcile(s, d))


@query
def dependency_edges_new(s, d):
    return tasks.dependency_edges(wh.tasks(s, d), wh.existing_links(s, d))


@query
def project_resolve(s, d):
    key = F.col("c_custkey")
    asked = wh.table(s, d, "customer").join(
        wh.projects(s, d), F.col("c_nationkey") == F.col("config_order")
    ).select(
        key.alias("request_id"),
        F.when(key % 3 == 0, F.col("project_key")).when(key % 3 == 1, F.col("epic_key"))
        .otherwise("nowhere").alias("request"),
    )
    return selection.resolve_projects(asked, wh.projects(s, d), "request")


@query
def instance_route(s, d):
    key = F.col("o_orderkey")
    number = (key % 7).cast("string")
    name = (
        F.when(key % 4 == 0, F.concat(F.lit("R"), number, F.lit("X-"), key.cast("string")))
        .when(key % 4 == 1, F.concat(F.lit("r"), number, F.lit("y-"), key.cast("string")))
        .when(key % 4 == 2, F.concat(F.lit("-"), key.cast("string")))
        .otherwise(F.concat(F.lit("nodash"), key.cast("string")))
    )
    keys = wh.table(s, d, "orders").select(name.alias("issue_key"))
    return selection.route_instances(keys, wh.instances(s, d), "issue_key", "AFRICA")


@query
def size_distribution_effective(s, d):
    return quantiles.effective_distribution(rollup.size_distribution(size_facts(s, d)))


@query
def size_distribution_backed(s, d):
    """By size and item type, backed by the finished items of all projects of a region; those of two regions have no class."""
    all_items, projects = items(s, d), wh.projects(s, d)
    typed = projects.select("project_key", F.col("project_type").alias("type"), "config_order")
    old = typed.where(~F.col("type").isin("ASIA", "EUROPE")).select(F.col("project_key").alias("project_id"), "type")
    done = refclass.refclass_items(all_items).where("size <> 'XL' AND (item_type <> 'Fix' OR size = 'S')")
    classes = scratch.materialize(refclass.backoff_distribution(old, done.withColumnRenamed("project_key", "project_id")), "classes")
    facts = rollup.group_facts(all_items, wh.as_of(), wh.CFG, ("size", "item_type"))
    return quantiles.backed_distribution(rollup.size_distribution(facts), typed, classes)


@query
def bulk_transition_plan(s, d):
    return audit.bulk_transition_plan(wh.issues(s, d), wh.workflow(s, d), "Done")


# Aggregations


@query
def status_counts(s, d):
    return rollup.status_counts(project_facts(s, d))


@query
def flow_counts(s, d):
    return rollup.flow_counts(project_facts(s, d))


@query
def status_breakdown(s, d):
    named = wh.tasks(s, d).select(
        F.concat(F.lit("FILE_"), (F.col("key") % 20).cast("string")).alias("project_key"),
        normalize_task_status(F.col("status")).alias("status"),
    )
    return rollup.status_breakdown(named)


@query
def size_stats(s, d):
    return rollup.size_stats(size_facts(s, d))


@query
def type_stats(s, d):
    return rollup.type_stats(rollup.group_facts(items(s, d), wh.as_of(), wh.CFG, ("item_type",)))


@query
def avg_cycle(s, d):
    return rollup.average_cycle(project_facts(s, d))


@query
def size_distribution(s, d):
    return rollup.size_distribution(size_facts(s, d))


@query
def refclass_distribution(s, d):
    return refclass.refclass_distribution(wh.reference_projects(s, d), wh.reference_items(s, d))


@query
def refclass_summary(s, d):
    return refclass.refclass_summary(wh.reference_projects(s, d), wh.reference_items(s, d))


@query
def first_transitions(s, d):
    return ingest.first_transitions(wh.transitions(s, d), wh.CFG)


@query
def throughput(s, d):
    return rollup.throughput(project_facts(s, d))


def _quantiles(s, d, iterations=ITERATIONS, rank_mode="nearest"):
    return quantiles.completion_quantiles(
        rollup.size_distribution(size_facts(s, d)), wh.projects(s, d), wh.CFG,
        iterations=iterations, rank_mode=rank_mode,
    )


@query
def completion_quantiles(s, d):
    return _quantiles(s, d)


@query
def completion_quantiles_compat(s, d):
    return _quantiles(s, d, rank_mode="compat")


@query
def percentile_map(s, d):
    """The map as entries again, since a map has no comparable form."""
    return quantiles.percentile_map(_quantiles(s, d)).select(
        "project_key", F.explode("percentiles").alias("pct", "days")
    )


@query
def missing_times(s, d):
    return audit.missing_times(wh.issues(s, d), wh.transitions(s, d), wh.CFG)


@query
def missing_times_totals(s, d):
    return audit.missing_totals(missing_times(s, d))


@query
def time_backfill_plan(s, d):
    return audit.time_backfill_plan(missing_times(s, d), wh.CFG)


@query
def field_profile(s, d):
    names = wh.table(s, d, "region").select(
        F.concat(F.lit("customfield_1000"), F.col("r_regionkey").cast("string")).alias("field"),
        F.concat(F.col("r_name"), F.when(F.col("r_regionkey") == 2, " Story Points").otherwise("")).alias("name"),
    )
    return audit.field_profile(wh.raw_fields(s, d), names)


@query
def closed_by(s, d):
    return ingest.closed_by(wh.transitions(s, d))


@query
def worklog_totals(s, d):
    return rollup.worklog_totals(wh.worklogs(s, d))


# Earned value


@query
def planned_schedule(s, d):
    return earned.planned_schedule(plans(s, d))


@query
def eva_metrics(s, d):
    return earned.eva_metrics(plans(s, d), wh.as_of())


@query
def eva_metrics_zero_after_end(s, d):
    return earned.eva_metrics(plans(s, d), wh.as_of(), "zero")


@query
def earned_schedule(s, d):
    return earned.earned_schedule(plans(s, d))


@query
def dashboard(s, d):
    return reports.dashboard(items(s, d), wh.projects(s, d), wh.as_of(), wh.CFG)


# Series and top-k


@query
def burndown(s, d):
    return series.burndown(items(s, d), wh.as_of())


@query
def history_window(s, d):
    return trends.history_window(stored_history(s, d).window(wh.as_of()), wh.as_of())


@query
def history_trend(s, d):
    return trends.history_trend(stored_history(s, d).window(wh.as_of()), wh.as_of())


@query
def p85_drift(s, d):
    return trends.p85_drift(stored_history(s, d).window(wh.as_of(), 7), wh.as_of())


@query
def history_latest(s, d):
    return plain_history(trends.history_latest(wh.history(s, d)))


@query
def recent_comments(s, d):
    return series.recent_comments(wh.comments(s, d), 2)


@query
def all_comments(s, d):
    return series.recent_comments(wh.comments(s, d))


@query
def recent_items(s, d):
    return series.recent_items(wh.issues(s, d))


@query
def timeline(s, d):
    return quantiles.timeline(_quantiles(s, d), wh.as_of())


# Set operations and nested data


@query
def projects_all(s, d):
    return all_projects(s, d).select("project_key", "name", "epic_key", "capacity")


@query
def changelog_flat(s, d):
    return ingest.changelog_flat(wh.transitions(s, d)).select(
        "issue_key", "ts", F.col("seq.l_linenumber").alias("line"), F.col("seq.l_partkey").alias("part"),
        "author", "field", "from_status", "to_status",
    )


@query
def bulk_label_plan(s, d):
    plan = audit.bulk_label_plan(
        wh.issues(s, d).where(F.col("raw_status") == "Done"), ["reviewed", "team"], ["size:S", "kind:fix"]
    )
    return plan.select("issue_key", text("labels_before"), text("labels_after"))


# Streams


def _change_stream(s, d, files):
    path = scratch.new_path(s, "changes")
    events = wh.table(s, d, "events")
    events.repartition(files, "event_id").write.parquet(path)
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return wh.changes(stream)


@query
def stream_first_transitions(s, d):
    out, checkpoint = scratch.new_path(s, "anchors"), scratch.new_path(s, "checkpoint")
    streaming.stream_first_transitions(
        _change_stream(s, d, 2), out, checkpoint, wh.CFG, once=True
    ).awaitTermination()
    return streaming.read_first_transitions(s, out)


@query
def stream_project_status(s, d):
    sink = streaming.StatusSink(scratch.new_path(s, "status"), wh.CFG, snapshot_every=2)
    streaming.stream_project_status(
        _change_stream(s, d, 3), sink, scratch.new_path(s, "checkpoint"), once=True
    ).awaitTermination()
    return streaming.read_project_status(s, sink)


# Composite reports


@query
def portfolio_run(s, d):
    return reports.portfolio_run(items(s, d), all_projects(s, d), wh.as_of(), wh.CFG, SAMPLING)


@query
def portfolio_history(s, d):
    """A run appended to the history store, and the latest entries read back."""
    store = stored_history(s, d)
    run = reports.portfolio_run(items(s, d), wh.projects(s, d), wh.as_of(), wh.CFG, SAMPLING)
    store.append(reports.history_entries(run, wh.as_of()), "run")
    return plain_history(trends.history_latest(store.visible()))


@query
def project_compare(s, d):
    return reports.project_compare(
        items(s, d), wh.projects(s, d), p85_drift(s, d), wh.as_of(), wh.CFG, SAMPLING
    )


@query
def compare_summary(s, d):
    return reports.compare_summary(project_compare(s, d))


@query
def project_status(s, d):
    return reports.project_status(items(s, d), all_projects(s, d), wh.as_of(), wh.CFG, SAMPLING)


@query
def projects_list(s, d):
    return reports.projects_list(items(s, d), all_projects(s, d), wh.as_of(), wh.CFG)


@query
def report_full(s, d):
    return reports.report_full(
        reports.report_sections(items(s, d), wh.projects(s, d), wh.as_of(), wh.CFG, SAMPLING)
    )
