from datetime import datetime, timedelta

from pyspark.sql import functions as F

NOW = datetime(2026, 6, 1, 12)
ITEM = (
    "project_key STRING, item_id STRING, item_type STRING, description STRING, size STRING, status STRING, "
    "created TIMESTAMP, in_progress_ts TIMESTAMP, done_ts TIMESTAMP, cycle_hours DOUBLE, assignee STRING, "
    "tracker_key STRING"
)


def now():
    return F.lit(NOW).cast("timestamp")


def ago(**kw):
    return NOW - timedelta(**kw)


def item(status, size="M", cycle=0.0, project="P", item_type="Component", created=None, done=None, key=None):
    return (project, key or "K", item_type, "", size, status, created, None, done, float(cycle), "", "")


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEM)


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()


def by(df, *keys):
    out = {}
    for row in df.collect():
        d = row.asDict()
        k = tuple(d[x] for x in keys)
        out[k if len(k) > 1 else k[0]] = d
    return out
