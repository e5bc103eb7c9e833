"""Grouped item metrics on small hand-made inputs."""

import math

import pytest
from pyspark.sql import functions as F

from shipgauge.operators import refclass, rollup
from tests.util import ago, by, item, items, now, one


def facts(spark, *rows):
    return rollup.project_facts(items(spark, *rows), now())


def sizes(spark, *rows):
    return rollup.size_facts(items(spark, *rows), now())


def types(spark, *rows):
    return rollup.type_stats(rollup.group_facts(items(spark, *rows), now(), by=("item_type",)))


def test_status_counts(spark):
    got = one(rollup.status_counts(facts(
        spark, item("Done", cycle=4), item("Done", cycle=6), item("In Progress"), item("To Do"), item("To Do"),
    )))
    assert (got["total"], got["done"], got["in_progress"], got["to_do"]) == (5, 2, 1, 2)
    assert got["avg_cycle_hours"] == 5.0 and got["progress_pct"] == 40.0


def test_in_development_counts_as_in_progress(spark):
    got = one(rollup.flow_counts(facts(spark, item("In Development"), item("Canceled"), item("Blocked"))))
    assert (got["in_progress"], got["canceled"], got["to_do"], got["done"]) == (1, 1, 1, 0)


def test_only_canceled(spark):
    got = one(rollup.status_counts(facts(spark, item("Canceled"), item("Canceled"))))
    assert got["total"] == 0 and got["progress_pct"] == 0.0


def test_other_spelling_of_canceled_counts(spark):
    assert one(facts(spark, item("Cancelled")))["total"] == 1


def test_average_cycle(spark):
    assert one(facts(spark, item("Done", cycle=4), item("Done", cycle=6), item("Done", cycle=5), item("To Do")))["avg_cycle_hours"] == 5.0
    assert one(facts(spark, item("Done"), item("To Do")))["avg_cycle_hours"] == 0.0


def test_negative_cycle_is_no_sample(spark):
    got = one(facts(spark, item("Done", cycle=-3), item("Done", cycle=4)))
    assert got["cycle_n"] == 1 and got["avg_cycle_hours"] == 4.0


def test_throughput(spark):
    got = one(rollup.throughput(facts(spark, *[item("Done", done=ago(days=n)) for n in (1, 2, 7, 20)])))
    assert got["throughput_per_day"] == 3 / 14
    assert one(rollup.throughput(facts(spark, item("Done"))))["throughput_per_day"] == 0


def test_throughput_ignores_status_and_excludes_the_cutoff(spark):
    got = one(rollup.throughput(facts(
        spark, item("Canceled", done=ago(days=1)), item("To Do", done=ago(days=2)), item("Done", done=ago(days=14)),
    )))
    assert got["recent_done"] == 2


def test_size_stats(spark):
    got = by(rollup.size_stats(sizes(
        spark, item("Done", "S", 2), item("Done", "S", 3), item("Done", "M", 5), item("Done", "L", 10),
        item("To Do", "M"), item("Done", "", 4),
    )), "size")
    assert set(got) == {"S", "M", "L"}
    assert (got["S"]["n"], got["S"]["avg_hours"]) == (2, 2.5)
    assert got["M"]["n"] == 1 and got["L"]["n"] == 1


def test_size_distribution(spark):
    got = by(rollup.size_distribution(sizes(
        spark, item("Done", "M", 4), item("Done", "M", 6), item("Done", "M", 5), item("To Do", "M"), item("To Do", "L"),
    )), "size")
    assert (got["M"]["mean"], got["M"]["stddev"], got["M"]["remaining"]) == (5.0, 1.0, 1)
    assert (got["L"]["n"], got["L"]["mean"], got["L"]["stddev"], got["L"]["remaining"]) == (0, None, None, 1)


def test_one_sample_has_no_spread(spark):
    assert one(rollup.size_distribution(sizes(spark, item("Done", "M", 4))))["stddev"] == 0.0


def test_deviation_survives_sums_beyond_38_digits(spark):
    from shipgauge.functions import stats

    n, x = 10**12, 10**11
    row = spark.range(1).select(
        F.lit(n).alias("n"), F.lit(str(n * x)).cast("decimal(28,0)").alias("t"),
        F.lit(str(n * x * x)).cast("decimal(38,0)").alias("s"),
    )
    got = one(row.select(stats.sd_population_hours(F.col("t"), F.col("s"), F.col("n")).alias("sd")))
    assert got["sd"] is not None and got["sd"] >= 0


def test_type_stats(spark):
    got = by(types(
        spark, item("Done"), item("Done"), item("To Do"), item("Done", item_type="Fix"),
        item("In Progress", item_type="Fix"), item("To Do", item_type=""), item("Canceled", item_type="Fix"),
        item("Canceled", item_type="Gone"),
    ), "item_type")
    assert "Gone" not in got
    assert (got["Component"]["total"], got["Component"]["done"], got["Component"]["remaining"]) == (3, 2, 1)
    assert got["Fix"]["total"] == 2
    assert got["Untyped"]["total"] == 1


def test_status_breakdown(spark):
    got = one(rollup.status_breakdown(items(
        spark, item("Done"), item("Blocked"), item("To Do"), item("In Progress"), item("Review"), item("In Development"),
    )))
    assert (got["done"], got["blocked"], got["to_do"], got["in_progress"], got["other"]) == (1, 1, 1, 1, 2)


def test_size_facts_roll_up_to_project_facts(spark):
    data = items(spark, *[
        item(s, z, c, p, created=ago(days=c), done=ago(days=c))
        for p in "AB" for s in ("Done", "To Do", "Canceled", "In Progress") for z in "SML" for c in (1, 3, 8)
    ])
    direct = rollup.project_facts(data, now())
    rolled = rollup.project_facts(rollup.size_facts(data, now()), now()).select(direct.columns)
    assert sorted(map(str, direct.collect())) == sorted(map(str, rolled.collect()))


def test_sync_summary(spark):
    got = by(rollup.sync_summary(items(spark, item("Done"), item("Done", project="Q"), item("To Do"))), "project_key")
    assert {k: (v["level"], v["item_count"]) for k, v in got.items()} == {"P": ("project", 2), "Q": ("project", 1), None: ("all", 3)}


def test_empty_items(spark):
    none = items(spark)
    assert rollup.project_facts(none, now()).count() == 0
    assert rollup.size_distribution(rollup.size_facts(none, now())).count() == 0


# Reference classes

PROJECTS = "project_id BIGINT, name STRING, type STRING, completed_at DATE, team_size INT"
ITEMS = "project_id BIGINT, item_type STRING, size STRING, cycle_hours DOUBLE"


def classes(spark, projects, rows):
    return (
        spark.createDataFrame([(i, n, t, None, 5) for i, n, t in projects], PROJECTS),
        spark.createDataFrame(rows, ITEMS),
    )


def test_reference_summary(spark):
    got = one(refclass.refclass_summary(*classes(
        spark, [(1, "a", "API Migration"), (2, "b", "API Migration")],
        [(1, "Component", "M", 4.0), (2, "Component", "M", 6.0), (2, "Fix", "S", 2.0)],
    )))
    assert (got["type"], got["project_count"], got["item_count"], got["avg_hours"]) == ("API Migration", 2, 3, 4.0)


def test_reference_summary_without_items(spark):
    got = one(refclass.refclass_summary(*classes(spark, [(1, "a", "T")], [])))
    assert (got["project_count"], got["item_count"], got["avg_hours"], got["stddev"]) == (1, 0, 0.0, 0.0)


def test_reference_distribution_is_population(spark):
    rows = [(1, "Component", "M", h) for h in (4.0, 6.0, 5.0)]
    dist = refclass.refclass_distribution(*classes(spark, [(1, "a", "T")], rows))
    got = one(dist)
    assert got["mean"] == 5.0 and got["stddev"] == pytest.approx(math.sqrt(2 / 3), abs=1e-12)
    assert dist.where("type = 'Unknown'").count() == 0


def test_reference_items_from_items(spark):
    done = [item("Done", "M", c) for c in (4, 5, 6)]
    assert refclass.refclass_items(items(spark, *done, item("To Do", "M", 3), item("Done", "M", 0))).count() == 3


def test_exact_sums(spark):
    """Halves of large numbers add up to the true sums."""
    from shipgauge.functions import stats

    values = [0, 1, (1 << 20) - 1, 1 << 20, (1 << 42) + 12345, 6_000_000_000_000, 999_999_999_999]
    df = spark.createDataFrame([(v,) for v in values * 3] + [(None,)], "ms BIGINT")
    parts = df.agg(*stats.sum_parts(F.col("ms"), "t"), *stats.square_parts(F.col("ms"), "s"))
    got = one(stats.resolve(parts, ("t",), ("s",)))
    assert got == {"t": 3 * sum(values), "s": 3 * sum(v * v for v in values)}
    none = df.where("ms < 0").agg(*stats.sum_parts(F.col("ms"), "t"), *stats.square_parts(F.col("ms"), "s"))
    assert one(stats.resolve(none, ("t",), ("s",))) == {"t": 0, "s": 0}


def test_squares_of_long_durations_do_not_overflow(spark):
    """200 years a sample, more rows than a BIGINT sum of squared halves could hold."""
    from shipgauge.functions import stats

    ms, n = 200 * 365 * 24 * 3_600_000, 5_000_000
    parts = spark.range(n).select(F.lit(ms).alias("ms")).agg(
        F.count("*").alias("n"), *stats.sum_parts(F.col("ms"), "t"), *stats.square_parts(F.col("ms"), "s"))
    got = one(stats.resolve(parts, ("t",), ("s",)))
    assert (got["t"], got["s"]) == (n * ms, n * ms * ms)


def test_deviation_is_exact_for_any_group_size(spark):
    """Half the samples one millisecond above and half below the mean, from their sums."""
    from shipgauge.functions import stats

    x = 10**9
    rows = [(n, str(n * x), str(n * x * x + n)) for n in (2, 10**6, 2 * 10**11, 10**12)]
    df = spark.createDataFrame(rows, "n BIGINT, t STRING, s STRING").select(
        "n", F.col("t").cast("decimal(30,0)").alias("t"), F.col("s").cast("decimal(38,0)").alias("s"))
    for r in df.select("n", stats.sd_population_hours(F.col("t"), F.col("s"), F.col("n")).alias("sd")).collect():
        assert r["sd"] == pytest.approx(1 / stats.MS_PER_HOUR, rel=1e-12), r["n"]
