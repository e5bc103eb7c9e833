"""Ordered series: burndown, latest and most recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shipgauge.functions.status import is_done, is_live
from shipgauge.sources.scratch import materialize


def running_position(
    rows: DataFrame, group: str, order: list[str], name: str, group_facts: DataFrame
) -> DataFrame:
    """Adds ``name``, the 1-based position of a row within its group, and the
    columns of ``group_facts`` (one row per group).

    A ``row_number`` window would put a whole group into one task. Here the rows
    are range-partitioned by (group, order), so a large group spans many sorted
    partitions, and are written once so that both readings below see the same
    partitions. What precedes a partition is then known from one count per
    (group, partition): groups + partitions rows in all. Group columns ride on
    those counts, so the final join key splits a large group by partition too.
    """
    keys = [group, *order]
    placed = materialize(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}),
        "positions",
    )
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        placed.groupBy(group, "_part")
        .agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1)
        .drop("_first", "_n")
        .join(group_facts, group)
    )
    return (
        placed.join(runs, [group, "_part"])
        .withColumn(name, F.col("_seq") + F.col("_base"))
        .drop("_part", "_seq", "_base")
    )


def burndown(items: DataFrame, as_of: Column) -> DataFrame:
    """Start point and one point per completion with the running count.

    The start lies one day before the first completion; a project without
    completions has a single point at ``as_of``. Completions at the same time
    are ordered by item id.
    """
    live = items.groupBy("project_key").agg(
        F.count_if(is_live(F.col("status"))).alias("total"),
        F.min(F.when(is_done(F.col("status")), F.col("done_ts"))).alias("_first"),
    )
    starts = live.select(
        "project_key",
        F.coalesce(F.col("_first") - F.expr("INTERVAL '1' DAY"), as_of).alias("ts"),
        F.lit(0).cast("bigint").alias("completed"),
        F.col("total").alias("remaining"),
    )
    finished = items.where(is_done(F.col("status")) & F.col("done_ts").isNotNull()).select(
        "project_key", "done_ts", "item_id"
    )
    totals = live.select("project_key", "total")
    points = running_position(
        finished, "project_key", ["done_ts", "item_id"], "completed", totals
    ).select(
        "project_key", F.col("done_ts").alias("ts"), "completed",
        (F.col("total") - F.col("completed")).alias("remaining"),
    )
    return starts.unionByName(points)


def latest(rows: DataFrame, group: str, ts: str, ties: tuple[Column, ...] = ()) -> DataFrame:
    """Row with the greatest ``ts``, then ``ties``, per group, as one map-side combined maximum."""
    rest = [c for c in rows.columns if c not in (group, ts)]
    order = F.struct(F.col(ts), *ties) if ties else F.col(ts)
    return (
        rows.groupBy(group)
        .agg(F.max(ts).alias(ts), F.max_by(F.struct(*rest), order).alias("_row"))
        .select(group, ts, "_row.*")
    )


def top_rows(rows: DataFrame, group: str, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group.

    Filtering a rank keeps only n rows per group in every map task before the
    shuffle, so a group of any size sends at most n rows per task.
    """
    window = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def recent_items(issues: DataFrame, n: int = 5) -> DataFrame:
    order = [F.col("updated").desc(), F.col("issue_key")]
    return top_rows(
        issues.select("project_key", "issue_key", "raw_status", "summary", "updated"),
        "project_key", order, n,
    )


def recent_comments(comments: DataFrame, n: int = 0) -> DataFrame:
    """Latest ``n`` comments per issue (0: all) with the count of all of them.

    ``comments``: issue_key, seq, author, body. A missing author is Unknown.
    ``seq`` ascending is the order to show them in.
    """
    named = comments.withColumn(
        "author", F.coalesce(F.nullif(F.col("author"), F.lit("")), F.lit("Unknown"))
    )
    totals = comments.groupBy("issue_key").agg(F.count("*").alias("total_comments"))
    if n > 0:
        last = top_rows(named, "issue_key", [F.col("seq").desc()], n, "_rank").drop("_rank")
        return last.join(totals, "issue_key")
    return named.join(totals, "issue_key")
