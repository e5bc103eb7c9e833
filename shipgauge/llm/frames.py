"""Column picking and small helpers the operators share.

Inputs may carry any further columns, also ones whose names differ only in case
or equal an operator's own; ``pick`` takes what an operator needs by position,
so nothing can clash.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shipgauge.sources.scratch import materialize, new_path, shared_dir  # noqa: F401  (for the operators)


def position(df: DataFrame, name: str) -> int:
    """Exact name first, then the first that matches without regard to case."""
    names = df.columns
    if name in names:
        return names.index(name)
    found = [i for i, n in enumerate(names) if n.lower() == name.lower()]
    if not found:
        raise ValueError(f"column {name} is missing; there are {names}")
    return found[0]


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns alone, cast to the given types."""
    at = {name: position(df, name) for name in types}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").cast(types[n]).alias(n) for n, i in at.items()])


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text; a null text is the empty one."""
    return pick(df, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))


class Rows:
    """All columns of ``df`` under names that no operator uses, and the way back."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        tag = uuid.uuid4().hex[:8]
        self.inner = [f"r{i}_{tag}" for i in range(len(self.names))]
        self.df = df.toDF(*self.inner)
        self._source = df

    def col(self, name: str) -> Column:
        return F.col(self.inner[position(self._source, name)])

    def restore(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(i).alias(n) for i, n in zip(self.inner, self.names)])


class Stored:
    """A table written once to the shared folder, which can be taken away again when nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str, compression: str = "snappy"):
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, name)
        df.write.option("compression", compression).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(conf).delete(path, True)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, empty while nothing has been written to it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
