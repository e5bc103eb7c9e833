"""Continuous anchors and project status on Structured Streaming.

Anchors are minima and the latest status is a maximum over the change log, so late,
repeated and reordered events do not change the outcome, no watermark is needed, and
a micro-batch can be reduced on its own and folded into what is stored. Spark keeps
no state of its own: the stored tables are the state, they change by whole versions
that name their last batch, and a batch that runs again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shipgauge.functions.status import normalize_status
from shipgauge.functions.times import hours_between
from shipgauge.operators.ingest import first_transitions
from shipgauge.operators.rollup import group_facts, project_facts, status_counts
from shipgauge.settings import Settings
from shipgauge.sources.manifest import Manifest

# Versions after which files of past ones go.
SNAPSHOT_EVERY = 20
# Runs of one size that are merged into one of the next.
FAN_IN = 8
# Parts of the issue state (as many as keep one near 100 MB), and parts over which one project's issues are spread.
BUCKETS = 64
SPREAD = 16
ANCHORS = "issue_key STRING, in_progress_ts TIMESTAMP, done_ts TIMESTAMP"


def issue_states(changes: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Anchors and latest status per issue; ``changes`` may be a stream. ``last``: when the status came about.

    ``changes``: project_key, issue_key, ts, seq, field, to_status.
    """
    to = F.col("to_status")
    return (
        changes.where((F.col("field") == "status") & F.col("ts").isNotNull())
        .groupBy("project_key", "issue_key")
        .agg(
            F.min(F.when(to.isin(*cfg.wip_statuses), F.col("ts"))).alias("in_progress_ts"),
            F.min(F.when(to.isin(*cfg.done_statuses), F.col("ts"))).alias("done_ts"),
            F.max_by("to_status", F.struct("ts", "seq")).alias("raw_status"),
            F.min("ts").alias("created"),
            F.max(F.struct("ts", "seq")).alias("last"),
        )
    )


def _start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _never() -> Column:
    """Only throughput needs a time, and it is not kept."""
    return F.lit(None).cast("timestamp")


def _new(notes: dict, batch_id: int) -> bool:
    """Notes the batch; False if it has been folded in before."""
    if notes.get("batch", -1) >= batch_id:
        return False
    notes["batch"] = batch_id
    return True


class AnchorRuns:
    """First transitions as runs of batches: FAN_IN runs of one size are merged into one of the next.

    n batches leave at most FAN_IN - 1 runs of each of log n sizes, and every row is
    rewritten log n times.
    """

    def __init__(self, spark: SparkSession, root: str, fan_in: int = FAN_IN):
        self.table, self.fan_in = Manifest(spark, root), fan_in

    def fold(self, anchors: DataFrame, batch_id: int) -> None:
        if self.table.current()[1]["notes"].get("batch", -1) >= batch_id:
            return
        path = self.table.new_folder("run")
        anchors.write.parquet(self.table.absolute(path))

        def add(parts, notes):
            return _new(notes, batch_id) and parts.update({path: {"path": path, "level": 0, "schema": _ddl(anchors)}})

        if self.table.change(add):
            while self._merge():
                pass

    def _merge(self) -> bool:
        runs = self.table.parts()
        levels: dict[int, list[str]] = {}
        for name, p in runs.items():
            levels.setdefault(p["level"], []).append(name)
        full = [level for level, names in levels.items() if len(names) >= self.fan_in]
        if not full:
            return False
        level = min(full)
        names, path = levels[level], self.table.new_folder("run")
        _earliest(self._read(runs, names)).write.parquet(self.table.absolute(path))

        def swap(parts, notes):
            if not set(names) <= set(parts):  # someone else has merged them
                return False
            for name in names:
                del parts[name]
            parts[path] = {"path": path, "level": level + 1, "schema": runs[names[0]]["schema"]}

        done = self.table.change(swap)
        self.table.vacuum()
        return done

    def _read(self, runs: dict, names: list[str]) -> DataFrame:
        return self.table.read([runs[n]["path"] for n in names], runs[names[0]]["schema"] if names else ANCHORS)

    def read(self) -> DataFrame:
        runs = self.table.parts()
        return _earliest(self._read(runs, list(runs)))


def _earliest(runs: DataFrame) -> DataFrame:
    return runs.groupBy("issue_key").agg(F.min("in_progress_ts").alias("in_progress_ts"), F.min("done_ts").alias("done_ts"))


def stream_first_transitions(
    changes: DataFrame, out: str, checkpoint: str, cfg: Settings = Settings(), once: bool = False
) -> StreamingQuery:
    """Keeps the first in-progress and done time of every issue in ``out``."""
    runs = AnchorRuns(changes.sparkSession, out)
    return _start(changes, lambda df, n: runs.fold(first_transitions(df, cfg), n), checkpoint, once)


def read_first_transitions(spark: SparkSession, out: str) -> DataFrame:
    """Anchors only ever move back in time, so their minimum is the current one."""
    return AnchorRuns(spark, out).read()


def _as_items(states: DataFrame, cfg: Settings) -> DataFrame:
    return states.withColumns({
        "status": normalize_status(F.col("raw_status"), cfg.done_statuses, cfg.wip_statuses),
        "cycle_hours": F.coalesce(hours_between(F.col("in_progress_ts"), F.col("done_ts")), F.lit(0.0)),
    })


class StatusSink:
    """Folds batches of issue states into project status.

    Issues lie in BUCKETS parts by a hash of their project and of themselves, so that
    even one project's issues are in SPREAD of them. A batch reads and rewrites the
    parts that its issues are in, and no others. Each part also keeps its own facts by
    project, which add up to the project's. The figures kept do not depend on a time,
    so no clock is read. Files number two a part and version; those of past versions go
    after ``snapshot_every`` batches.
    """

    def __init__(self, root: str, cfg: Settings = Settings(), snapshot_every: int = SNAPSHOT_EVERY, buckets: int = BUCKETS):
        self.root, self.cfg, self.every, self.buckets = root, cfg, snapshot_every, buckets

    def table(self, spark: SparkSession) -> Manifest:
        return Manifest(spark, self.root)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("project_key", F.pmod(F.xxhash64("issue_key"), F.lit(SPREAD))), F.lit(self.buckets)).cast("int")

    def _stored(self, spark: SparkSession, kind: str, buckets: list[int] | None = None) -> DataFrame:
        table = self.table(spark)
        version = table.current()[1]
        paths = [p[kind] for b, p in version["parts"].items() if buckets is None or int(b) in buckets]
        return table.read(paths, version["notes"][kind] if paths else "project_key STRING")

    def state(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """Stored issues, all or those of some parts."""
        return self._stored(spark, "path", buckets)

    def facts(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark, "facts")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = self.table(spark)
        if table.current()[1]["notes"].get("batch", -1) >= batch_id:
            return
        staged, path = table.new_folder("batch"), table.new_folder("state")
        batch.withColumn("bucket", self.bucket()).write.parquet(table.absolute(staged))
        fresh = spark.read.parquet(table.absolute(staged))
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        before, both = self.state(spark, touched), fresh.drop("bucket")
        if len(before.columns) > 1:
            both = both.unionByName(before)
        merged = both.groupBy("project_key", "issue_key").agg(
            F.min("in_progress_ts").alias("in_progress_ts"), F.min("done_ts").alias("done_ts"),
            F.max_by("raw_status", "last").alias("raw_status"), F.min("created").alias("created"), F.max("last").alias("last"))
        states, facts = f"{path}/states", f"{path}/facts"
        self._write(merged.withColumn("bucket", self.bucket()), table.absolute(states))
        written = spark.read.schema(f"{_ddl(merged)}, bucket INT").parquet(table.absolute(states))
        figures = group_facts(_as_items(written, self.cfg), _never(), self.cfg, ("bucket",))
        self._write(figures, table.absolute(facts))

        def swap(parts, notes):
            notes.update(path=_ddl(merged), facts=_ddl(figures.drop("bucket")))
            return _new(notes, batch_id) and parts.update({
                str(b): {"path": f"{states}/bucket={b}", "facts": f"{facts}/bucket={b}"} for b in touched})

        table.change(swap)
        table.drop(staged)
        if (batch_id + 1) % self.every == 0:
            table.vacuum()

    @staticmethod
    def _write(df: DataFrame, path: str) -> None:
        df.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)


def stream_project_status(
    changes: DataFrame, sink: StatusSink, checkpoint: str, once: bool = False
) -> StreamingQuery:
    return _start(changes, lambda df, n: sink(issue_states(df, sink.cfg), n), checkpoint, once)


def read_project_status(spark: SparkSession, sink: StatusSink) -> DataFrame:
    """Latest figures per project: the facts of all parts added up."""
    return status_counts(project_facts(sink.facts(spark), _never()))
