"""Days until the remaining work of a project is done, as quantiles.

For every project and iteration the hours of all remaining items are drawn by
size, summed and divided by the capacity; the quantiles are taken over the
iterations. Sums are first drawn as bounds, in 4-byte floats; those whose bounds
leave open whether they have an asked rank are drawn again, exactly. The result is
that of drawing every sum exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shipgauge.functions import draws, stats
from shipgauge.functions.times import target_date
from shipgauge.operators.selection import effective_capacity
from shipgauge.settings import (
    DEFAULT_SIZE_HOURS,
    OTHER_SIZE_HOURS,
    PERCENTILES,
    Settings,
)
from shipgauge.sources.scratch import materialize

# Item pairs times iterations in one unit of work, about 30 milliseconds.
PAIRS_PER_UNIT = 1 << 20
# From so many on, units share radii by ranges: each first word then serves once or more.
SHARED_PAIRS = 1 << 32


def _default(index: int) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for size, pair in DEFAULT_SIZE_HOURS.items():
        out = out.when(F.col("size") == size, F.lit(pair[index]))
    return out.otherwise(F.lit(OTHER_SIZE_HOURS[index]))


def effective_distribution(sizes: DataFrame) -> DataFrame:
    """Observed distribution of each size, or its default without samples.

    ``sizes`` is ``rollup.size_distribution``: the samples and the open items of
    a size sit on the same row and the defaults are four literals, so nothing
    is joined here.
    """
    observed = F.col("n") > 0
    return sizes.select(
        "project_key", "size", "remaining", observed.alias("is_observed"),
        F.when(observed, F.col("mean")).otherwise(_default(0)).alias("mean"),
        F.when(observed, F.col("stddev")).otherwise(_default(1)).alias("stddev"),
    )


def backed_distribution(sizes: DataFrame, projects: DataFrame, classes: DataFrame) -> DataFrame:
    """As ``effective_distribution``, with reference classes between observed and default.

    ``sizes``: ``rollup.size_distribution`` by size and item type. ``projects``:
    project_key, type. ``classes``: ``refclass.backoff_distribution``; the finest level
    that has items counts: (type, item type, size), then (type, size), then the type.
    ``source`` names what was taken: observed, class, class-size, class-type or default.
    Classes number a few rows a type, and so do rows of ``sizes`` a project; a project
    without a type goes by the default.
    """
    rows = sizes.join(projects.select("project_key", "type"), "project_key", "left")
    names = {3: ("class", ("type", "item_type", "size")), 2: ("class-size", ("type", "size")), 1: ("class-type", ("type",))}
    source = F.when(F.col("n") > 0, "observed")
    found = {c: F.when(F.col("n") > 0, F.col(c)) for c in ("mean", "stddev")}
    for level, (name, keys) in names.items():
        own = classes.where(F.col("level") == level).select(
            *keys, F.struct("mean", "stddev").alias(f"level_{level}"))
        rows = rows.join(own, list(keys), "left")
        hit = F.col(f"level_{level}")
        source = source.when(hit.isNotNull(), name)
        found = {c: F.coalesce(v, hit[c]) for c, v in found.items()}
    return rows.select(
        "project_key", "item_type", "size", "remaining", source.otherwise("default").alias("source"),
        *[F.coalesce(found[c], _default(i)).alias(c) for i, c in enumerate(("mean", "stddev"))],
    )


def _units(
    distribution: DataFrame, count: Column, listed: Column, seed: int, tasks: int | None, whole: bool = False
) -> DataFrame:
    """Units of at most PAIRS_PER_CHUNK item pairs times as many iterations as make PAIRS_PER_UNIT, or all with ``whole``.

    ``count`` is the number of a row's iterations, ``listed`` their numbers, or NULL for
    those from 0 on. Work is cut before anything is drawn, and the units are dealt over
    ``tasks`` partitions; one large project therefore occupies the whole cluster. The
    count is explicit because units are few and small and would be coalesced into one task.
    """
    spark = distribution.sparkSession
    if tasks is None:
        tasks = max(
            int(spark.conf.get("spark.sql.shuffle.partitions")),
            2 * spark.sparkContext.defaultParallelism,
        )
    c = F.col
    key_a, key_b = draws.keys(seed, c("project_key"), c("size"))
    per_chunk = 2 * draws.PAIRS_PER_CHUNK
    last_chunk = F.ceil(c("remaining") / F.lit(per_chunk)) - 1
    per_unit = c("_count") if whole else F.greatest(
        F.lit(1), F.least(c("_count"), F.floor(F.lit(2 * PAIRS_PER_UNIT) / c("items")))
    )
    return (
        distribution.withColumn("_count", count).where((c("remaining") > 0) & (c("_count") > 0))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk)))
        .withColumn("items", F.least(c("remaining") - c("chunk") * per_chunk, F.lit(per_chunk)))
        .withColumn("_per_unit", per_unit.cast("int"))
        .withColumn("first", F.explode(F.sequence(F.lit(0), c("_count") - 1, c("_per_unit"))))
        .select(
            "project_key", key_a.alias("key_a"), key_b.alias("key_b"), "chunk", "items", "mean", "stddev",
            "first", F.least(c("first") + c("_per_unit") - 1, c("_count") - 1).alias("last"),
            F.slice(listed, c("first") + 1, c("_per_unit")).alias("listed"),
        )
        .repartition(tasks, "project_key", "key_a", "chunk", "first")
    )


def iteration_totals(
    distribution: DataFrame, iterations: int, seed: int, tasks: int | None = None, wanted: DataFrame | None = None
) -> DataFrame:
    """(project_key, iteration, total_ms): drawn work of all remaining items.

    ``wanted`` (project_key, listed) names the iterations to draw of each project, all
    without it. Sums are combined on the map side: only (project, iteration) partial
    sums are shuffled.
    """
    if wanted is None:
        units = _units(distribution, F.lit(iterations), F.lit(None).cast("array<int>"), seed, tasks)
    else:
        units = _units(distribution.join(wanted, "project_key"), F.size("listed"), F.col("listed"), seed, tasks)
    return (
        units.mapInArrow(draws.unit_totals, draws.TOTALS)
        .groupBy("project_key", "iteration")
        .agg(F.sum("ms").alias("total_ms"))
    )


def open_iterations(
    distribution: DataFrame, iterations: int, seed: int, ranks: list[int], tasks: int | None = None
) -> DataFrame:
    """(project_key, listed, places): iterations whose sums have to be known for ``ranks``.

    ``places`` holds for each rank the rank that its sum has among those of ``listed``.
    The sum at a rank lies between the low and the high bound at this rank. An iteration
    whose bounds lie beyond both for every rank is left out, and counts for the ranks that
    it lies below. A project's rows are as many as ``iterations``, a number set by the
    caller, and its sorts spill. From SHARED_PAIRS drawn pairs on, units are dealt by ranges
    of first words, so that each radius is worked out once; how many there are is one number
    taken from ``distribution``, a few rows a project.
    """
    c = F.col
    pairs = distribution.where("stddev <> 0").agg(F.sum(F.ceil(c("remaining") / 2))).first()[0] or 0
    shared = pairs * iterations >= SHARED_PAIRS
    units = _units(distribution, F.lit(iterations), F.lit(None).cast("array<int>"), seed, tasks, whole=shared)
    if shared:
        units = units.mapInArrow(draws.by_range, draws.RANGED).repartitionById(1 << 32 - draws.RANGE_BITS, "range")
    bounds = (
        units.mapInArrow(draws.unit_bounds, draws.BOUNDS)
        .groupBy("project_key", "iteration")
        .agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    )
    project = Window.partitionBy("project_key")
    ranked = bounds.withColumns({f"_{b}": F.row_number().over(project.orderBy(b)) for b in ("low", "high")})
    ends = {f"{b}_{k}": F.max(F.when(c(f"_{b}") == k, c(b))).over(project) for b in ("low", "high") for k in ranks}
    below = {k: c("high") < c(f"low_{k}") for k in ranks}
    settled = F.lit(True)
    for k in ranks:
        settled = settled & (below[k] | (c("low") > c(f"high_{k}")))
    return (
        ranked.withColumns(ends).withColumn("_settled", settled)
        .groupBy("project_key")
        .agg(
            F.collect_list(F.when(~c("_settled"), c("iteration"))).alias("listed"),
            F.array(*[F.lit(k) - F.count_if(c("_settled") & below[k]) for k in ranks]).alias("places"),
        )
    )


def rank_of(pct: int, iterations: int, rank_mode: str) -> int:
    """1-based rank of a percentile among the sorted iterations."""
    nearest = max(1, -(-iterations * pct // 100))
    if rank_mode == "nearest":
        return nearest
    if rank_mode == "compat":
        return min(-(-iterations * pct // 100) + 1, iterations)
    raise ValueError("rank_mode must be 'nearest' or 'compat'")


def completion_quantiles(
    sizes: DataFrame,
    capacities: DataFrame,
    cfg: Settings = Settings(),
    percentiles: tuple[int, ...] = PERCENTILES,
    iterations: int = 10_000,
    seed: int = 42,
    rank_mode: str = "nearest",
) -> DataFrame:
    """(project_key, pct, days) for every project of ``capacities``.

    ``capacities``: project_key, capacity (NULL for the default). A project with
    nothing left needs 0 days. Milliseconds are ranked instead of days, which
    is the same order, and turned into days once at the end. Distributions and
    the iterations to draw exactly, a row a project, are stored once.
    """
    if iterations < 1 or not percentiles:
        raise ValueError("iterations and percentiles must not be empty")
    distribution = materialize(effective_distribution(sizes), "distribution")
    ranks = {p: rank_of(p, iterations, rank_mode) for p in percentiles}
    asked_ranks = sorted(set(ranks.values()))
    chosen = materialize(open_iterations(distribution, iterations, seed, asked_ranks), "iterations")
    totals = iteration_totals(distribution, iterations, seed, wanted=chosen.select("project_key", "listed"))
    order = Window.partitionBy("project_key").orderBy("total_ms", "iteration")
    wanted = F.array(*[
        F.struct(F.lit(p).alias("pct"), F.col("places")[asked_ranks.index(k)].alias("rank")) for p, k in ranks.items()
    ])
    places = chosen.select("project_key", F.explode(wanted).alias("w")).select("project_key", F.col("w.pct").alias("pct"), F.col("w.rank").alias("_rank"))
    ranked = (
        totals.withColumn("_rank", F.row_number().over(order).cast("bigint"))
        .join(places, ["project_key", "_rank"])
        .select("project_key", "pct", "total_ms")
    )
    asked = capacities.select(
        "project_key",
        effective_capacity(F.col("capacity"), cfg).alias("capacity"),
        F.explode(F.array(*[F.lit(p) for p in percentiles])).alias("pct"),
    )
    days = F.col("total_ms") / (F.lit(stats.MS_PER_HOUR) * F.col("capacity"))
    return asked.join(ranked, ["project_key", "pct"], "left").select(
        "project_key", "pct", F.coalesce(days, F.lit(0.0)).alias("days")
    )


def quantiles_wide(quantiles: DataFrame, percentiles: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """One row per project with columns p50, p70, ..."""
    return quantiles.groupBy("project_key").agg(*[
        F.max(F.when(F.col("pct") == p, F.col("days"))).alias(f"p{p}") for p in percentiles
    ])


def percentile_map(quantiles: DataFrame) -> DataFrame:
    """One MAP<INT, DOUBLE> per project; as many entries as levels were asked."""
    return quantiles.groupBy("project_key").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("pct", "days")))).alias("percentiles")
    )


def timeline(quantiles: DataFrame, as_of: Column) -> DataFrame:
    """The day of the report (pct 0) and the day each level is reached."""
    today = quantiles.select("project_key").distinct().select(
        "project_key", F.lit(0).alias("pct"), F.lit(0.0).alias("days"),
        F.to_date(as_of).alias("target_date"),
    )
    return quantiles.withColumn("target_date", target_date(as_of, F.col("days"))).unionByName(today)
