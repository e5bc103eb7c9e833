"""Order tables read as work-item tables.

Orders stand for issues, line items for their status changes, nations for
projects, suppliers for finished reference projects, parts for planned tasks and
events for a stream of changes. Only ``__spark_entry__``, the bench and the tests
use this mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pyspark.sql.types import StructType

from shipgauge.settings import Settings

CFG = Settings(
    done_statuses=("Done", "Awaiting Dev Deployment"),
    type_labels=(
        ("kind:component", "Component"), ("kind:fix", "Fix"),
        ("kind:migration", "Migration"), ("kind:integration", "Integration"),
    ),
    size_labels=(("size:S", "S"), ("size:M", "M"), ("size:L", "L"), ("size:XL", "XL")),
)
AS_OF = "2001-08-01 00:00:00"
_schemas: dict[str, StructType] = {}


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its zone-less times are instants in the session's zone.

    The schema is read from the file once; later reads of the same table skip
    the job that infers it.
    """
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    df = spark.read.schema(_schemas[path]).parquet(path)
    zoneless = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in zoneless})


def _case(col: str, pairs: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for key, value in pairs.items():
        out = out.when(F.col(col) == key, F.lit(value))
    return out


def projects(spark: SparkSession, d: str) -> DataFrame:
    """Nations; the region is the epic, so several projects share one."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    key = F.col("n_nationkey")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("project_key"), F.col("r_name").alias("epic_key"),
        F.col("n_name").alias("name"), F.col("r_name").alias("project_type"),
        F.when(key % 4 != 0, (F.lit(4) + key % 8).cast("double")).alias("capacity"),
        key.alias("config_order"),
    )


def task_file_projects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(
        F.col("r_name").alias("project_key"), F.lit("").alias("name"),
        (F.lit(1000) + F.col("r_regionkey")).alias("config_order"),
    )


def transitions(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag"
    )
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    flag = F.col("l_returnflag")
    to_status = (
        F.when(F.col("l_linestatus") == "O",
               F.when(flag == "N", "In Progress").when(flag == "A", "In Development").when(flag == "R", "To Do"))
        .when(F.col("l_linestatus") == "F",
              F.when(flag == "N", "Awaiting Dev Deployment").when(flag.isin("A", "R"), "Done"))
    )
    return line.join(orders, "l_orderkey").select(
        F.col("l_orderkey").alias("issue_key"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=F.col("l_quantity").cast("int"))).alias("ts"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
        F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey").cast("string")).alias("author"),
        F.lit("status").alias("field"),
        F.when(F.col("l_linenumber") == 1, "").otherwise("To Do").alias("from_status"),
        to_status.alias("to_status"),
    )


def issues(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    key = F.col("o_orderkey")
    size = _case("o_orderpriority", {
        "1-URGENT": "size:S", "2-HIGH": "size:M", "3-MEDIUM": "size:L", "5-LOW": "size:XL",
    })
    kind = _case("c_mktsegment", {
        "AUTOMOBILE": "kind:component", "BUILDING": "kind:fix",
        "FURNITURE": "kind:migration", "MACHINERY": "kind:integration",
    })
    owner = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "r_name"
    )
    people = customer.join(owner, customer.c_nationkey == owner.n_nationkey).select(
        "c_custkey", "c_name", "c_mktsegment", "n_name", "r_name"
    )
    status = (
        F.when(F.col("o_orderstatus") == "F", "Done")
        .when(F.col("o_orderstatus") == "P", "In Development")
        .when(F.col("o_orderpriority") == "5-LOW", "Canceled")
        .otherwise("To Do")
    )
    return orders.join(people, orders.o_custkey == people.c_custkey).select(
        key.alias("issue_key"), F.col("n_name").alias("project_key"),
        F.when(key % 2 == 0, F.col("r_name")).alias("epic_key"), F.col("r_name").alias("parent_key"),
        F.concat(F.lit("Order "), key.cast("string")).alias("summary"),
        status.alias("raw_status"),
        F.array_compact(F.array(kind, F.lit("team"), size)).alias("labels"),
        F.col("c_name").alias("assignee"),
        F.col("o_orderdate").alias("created"),
        (F.col("o_orderdate") + F.make_dt_interval(days=(key % 50).cast("int"))).alias("updated"),
        F.when(key % 5 == 0, F.floor(F.col("o_totalprice") / 10)).otherwise(0).alias("time_spent_s"),
        F.when(key % 11 == 0, (key % 24).cast("double")).alias("override_hours"),
        F.when(key % 3 == 0, (key % 8).cast("double")).alias("story_points"),
    )


def reference_projects(spark: SparkSession, d: str) -> DataFrame:
    supplier = table(spark, d, "supplier")
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    owner = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    return supplier.join(owner, supplier.s_nationkey == owner.n_nationkey).select(
        F.col("s_suppkey").alias("project_id"), F.col("s_name").alias("name"),
        F.col("r_name").alias("type"),
    )


def reference_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("project_id"), F.col("l_returnflag").alias("item_type"),
        F.col("l_linestatus").alias("size"), F.col("l_quantity").alias("cycle_hours"),
    )


def tasks(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    def day(offset: int, month: str) -> Column:
        first = F.lit(f"2001-{month}-01").cast("date")
        return F.date_add(first, ((key + offset) % 28).cast("int")).cast("string")
    spelling = F.element_at(
        F.array(*[F.lit(x) for x in (
            "todo", "To Do", " to_do ", "", "in_progress", "In Progress", "done", "completed", "blocked", "Custom",
        )]),
        (key % 10 + 1).cast("int"),
    )
    return table(spark, d, "part").select(
        key.alias("key"), F.when(key % 3 != 0, key * 9).alias("tracker_key"),
        F.col("p_name").alias("summary"),
        F.when(key % 7 == 0, "").otherwise(F.col("p_type")).alias("type"),
        F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, ("s", "m", "l", "xl"))), (key % 4 + 1).cast("int"))).alias("size"),
        spelling.alias("status"),
        F.array(F.col("p_brand"), F.concat(F.lit("size:"), F.col("p_size").cast("string")), F.lit("size:0")).alias("labels"),
        F.array(key - 1, key - 7).alias("blocked_by"),
        F.when(key % 97 == 0, "2001-13-45").otherwise(day(0, "01")).alias("created_at"),
        F.when(key % 4 == 0, "").otherwise(day(3, "02")).alias("started_at"),
        F.when(key % 5 == 0, F.lit(None).cast("string")).otherwise(day(11, "03")).alias("completed_at"),
        F.col("p_brand").alias("assignee"),
    )


def existing_links(spark: SparkSession, d: str) -> DataFrame:
    """Every even task is already blocked by its predecessor."""
    t = tasks(spark, d)
    return t.where(F.col("key") % 2 == 0).select(
        ((F.col("key") - 1) * 9).alias("blocker"), (F.col("key") * 9).alias("blocked")
    )


def history(spark: SparkSession, d: str) -> DataFrame:
    """One entry per nation and day, aggregated from its orders."""
    exact = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    days = F.col("_price") / F.lit(100_000.0)
    levels = [F.lit(70), days, F.lit(85), days * F.lit(1.25), F.lit(95), days * F.lit(1.5)]
    people = table(spark, d, "customer").join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", "n_name")
    return (
        table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("n_name").alias("project_key"), F.date_trunc("day", "o_orderdate").cast("timestamp").alias("ts"))
        .agg(
            F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"),
            exact.alias("_price"), F.max("o_totalprice").alias("_top"),
        )
        .select(
            "project_key", "ts", "total", "completed",
            (F.col("total") - F.col("completed")).alias("remaining"),
            (F.col("_top") / 10_000).alias("avg_cycle"),
            (F.col("completed") / F.lit(7.0)).alias("throughput"),
            F.create_map(*levels).alias("percentiles"),
        )
    )


def comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("issue_key"), F.col("turn").alias("seq"),
        F.col("role").alias("author"), F.col("text").alias("body"),
    )


def worklogs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("issue_key"), F.floor(F.col("value") * 60).alias("seconds")
    )


# Status an event moves an issue to.
EVENT_STATUS = {
    "signup": "To Do", "view": "In Progress", "click": "In Development",
    "purchase": "Done", "error": "Canceled",
}


def changes(events: DataFrame) -> DataFrame:
    """Change log from events, batch or streaming; 25 projects by user."""
    return events.select(
        F.col("user_id").alias("issue_key"),
        F.concat(F.lit("PROJECT_"), (F.col("user_id") % 25).cast("string")).alias("project_key"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.lit("status").alias("field"),
        _case("event_type", EVENT_STATUS).alias("to_status"),
    )


def raw_fields(spark: SparkSession, d: str) -> DataFrame:
    """Custom fields of varying type built around each event's own JSON."""
    key = F.col("event_id")
    varied = (
        F.when(key % 4 == 0, F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
        .when(key % 4 == 1, F.lit("null"))
        .when(key % 4 == 2, F.lit("[1,2]"))
        .otherwise((key % 13).cast("string"))
    )
    text = F.concat(
        F.lit('{"customfield_10001":'), F.col("props"), F.lit(',"customfield_10002":'), varied,
        F.lit(',"customfield_10004":'), (key % 9).cast("string"), F.lit(',"flag":true}'),
    )
    return table(spark, d, "events").select(key.alias("issue_key"), F.parse_json(text).alias("raw"))


def _histories(spark: SparkSession, d: str) -> DataFrame:
    """Changelog of every issue: a history per status change, with a second item for every third part.

    Every issue whose key 13 divides also has a change to Done at a time that nobody can read.
    """
    t = transitions(spark, d)
    change = F.struct(F.col("field"), F.col("from_status").alias("fromString"), F.col("to_status").alias("toString"))
    other = F.struct(F.lit("assignee").alias("field"), F.lit("").alias("fromString"), F.col("author").alias("toString"))
    history = F.struct(
        F.date_format("ts", STAMP).alias("created"), F.struct(F.col("author").alias("displayName")).alias("author"),
        F.when(F.col("seq.l_partkey") % 3 == 0, F.array(other, change)).otherwise(F.array(change)).alias("items"),
    )
    broken = F.struct(
        F.lit("yesterday").alias("created"), F.struct(F.lit("nobody").alias("displayName")).alias("author"),
        F.array(F.struct(F.lit("status").alias("field"), F.lit("To Do").alias("fromString"), F.lit("Done").alias("toString"))).alias("items"),
    )
    return t.groupBy("issue_key").agg(F.array_sort(F.collect_list(F.struct("seq", history.alias("h")))).alias("_h")).select(
        "issue_key",
        F.concat(F.when(F.col("issue_key") % 13 == 0, F.array(broken)).otherwise(F.slice(F.array(broken), 1, 0)), F.col("_h.h")).alias("histories"),
    )


STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'"


def issue_pages(spark: SparkSession, d: str) -> DataFrame:
    """Search pages of up to 100 issues as JSON text, one page per row, and some that are broken.

    Issue keys are numbers, so a page is a range of them and no group exceeds its
    page size. Every region adds a page that breaks off and one with an issue that has
    no key.
    """
    key = F.col("issue_key")

    def named(number: Column) -> Column:
        return F.concat("project_key", F.lit("-"), number.cast("string"))

    def linked(number: Column) -> Column:
        return F.struct(
            named(number).alias("key"),
            F.struct(F.concat(F.lit("Order "), number.cast("string")).alias("summary"), F.struct(F.concat(F.lit("Open "), (number % 4).cast("string")).alias("name")).alias("status")).alias("fields"))

    created, updated = F.date_format("created", STAMP), F.date_format("updated", STAMP)
    links = F.array(F.struct(
        F.concat(F.lit("L"), key.cast("string")).alias("id"),
        F.struct(F.lit("Blocks").alias("name"), F.lit("is blocked by").alias("inward"), F.lit("blocks").alias("outward")).alias("type"),
        F.when(key % 3 == 1, linked(key + 1)).alias("inwardIssue"),
        F.when(key % 3 == 2, linked(key + 2)).alias("outwardIssue"),
    ))
    files = F.array(F.struct(
        key.cast("string").alias("id"), F.lit("plan.pdf").alias("filename"),
        (key * 10).alias("size"), created.alias("created"),
        F.struct(F.col("assignee").alias("displayName")).alias("author"),
    ))
    fields = F.struct(
        "summary", F.struct(F.col("raw_status").alias("name")).alias("status"),
        F.struct(F.lit("Story").alias("name")).alias("issuetype"), "labels",
        F.struct(F.col("assignee").alias("displayName")).alias("assignee"),
        F.struct(F.col("parent_key").alias("key")).alias("parent"),
        created.alias("created"), updated.alias("updated"), F.col("time_spent_s").alias("timespent"),
        F.col("override_hours").alias("customfield_10001"),
        F.col("story_points").alias("customfield_10002"),
        F.col("epic_key").alias("customfield_10014"),
        links.alias("issuelinks"),
        F.when(key % 10 == 0, files).alias("attachment"),
    )
    issue = F.struct(
        named(key).alias("key"), fields.alias("fields"), F.struct(F.col("histories")).alias("changelog")
    )
    page = F.floor(key / 100)
    pages = (
        issues(spark, d).join(_histories(spark, d), "issue_key", "left")
        .groupBy(page.alias("page")).agg(F.collect_list(issue).alias("issues"))
        .select(F.to_json(F.struct("issues", F.size("issues").alias("total"), F.lit(True).alias("isLast"))).alias("value"))
    )
    number = F.col("r_regionkey").cast("string")
    broken = F.array(
        F.concat(F.lit('{"issues":[{"key":"BROKEN-'), number),
        F.concat(F.lit('{"issues":[{"fields":{"summary":"no key '), number, F.lit('"}}],"isLast":true}')),
    )
    return pages.union(table(spark, d, "region").select(F.explode(broken)))


def write_item_files(spark: SparkSession, d: str, items: DataFrame, folder: str) -> None:
    """``items`` as one indented JSON array a project, in files named after the projects."""
    def time(name: str, none: str | None = None) -> Column:
        return F.coalesce(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(none))

    record = F.struct(
        F.col("item_id").cast("string").alias("ID"), F.col("item_type").alias("Type"), F.col("description").alias("Description"), F.col("size").alias("Size"),
        F.col("status").alias("Status"), time("created", "0001-01-01T00:00:00Z").alias("Created"), time("in_progress_ts").alias("InProgress"),
        time("done_ts").alias("Done"), F.col("cycle_hours").alias("CycleTime"), F.col("assignee").alias("Assignee"), F.col("tracker_key").cast("string").alias("JiraKey"))
    order = W.partitionBy("project_key").orderBy("item_id")
    body = F.concat(F.lit("  "), F.replace(F.to_json(record, {"pretty": "true", "ignoreNullFields": "false"}), F.lit("\n"), F.lit("\n  ")))
    first, last = F.lag("item_id").over(order).isNull(), F.lead("item_id").over(order).isNull()
    lines = items.select("project_key", "item_id", F.concat(F.when(first, "[\n").otherwise(""), body, F.when(last, "\n]").otherwise(",")).alias("value"))
    lines.repartition("project_key").sortWithinPartitions("project_key", "item_id").drop("item_id").write.partitionBy("project_key").text(folder)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for project in fs.listStatus(root):
        if project.isDirectory():
            key = project.getPath().getName().removeprefix("project_key=")
            for part in fs.listStatus(project.getPath()):
                fs.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(f"{folder}/data-{key}.json"))


def workflow(spark: SparkSession, d: str) -> DataFrame:
    """Transitions open to each status that occurs among the orders."""
    statuses = issues(spark, d).select(F.col("raw_status").alias("status")).distinct()
    moves = F.array(*[
        F.struct(F.lit(p).alias("position"), F.lit(i).alias("transition_id"), F.lit(n).alias("name"), F.lit(t).alias("to_status"))
        for p, i, n, t in (
            (1, "11", "Start", "In Progress"), (2, "21", "Close", "Done"), (3, "31", "Done", "Closed"),
        )
    ])
    return (
        statuses.where(F.col("status") != "Canceled")
        .select("status", F.explode(moves).alias("m")).select("status", "m.*")
    )


def instances(spark: SparkSession, d: str) -> DataFrame:
    """Tracker instances: regions, each owning the prefixes R0X, R1X, ..."""
    key = F.col("r_regionkey")
    def prefix(tail: str) -> Column:
        return F.concat(F.lit("r"), key.cast("string"), F.lit(tail))
    return table(spark, d, "region").select(
        F.col("r_name").alias("instance"), F.array(prefix("x"), prefix("Y")).alias("prefixes"),
        (key == 0).alias("is_default"),
    )
