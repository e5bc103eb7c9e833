"""Session settings the operators rely on for skewed data."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution splits oversized join partitions. Forced, it also does so
# where the result has to be shuffled again, which costs less than one task
# working through a third of the rows.
# Rows go to Python in batches of bounded size, also where single rows are large.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark
