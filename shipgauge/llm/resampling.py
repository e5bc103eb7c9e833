"""Importance resampling by hashed n-gram models.

Words and word pairs are hashed into BUCKETS; a target and a raw model are their
shares in documents labelled good and in all documents. A document's weight is the
log ratio of its probabilities under the two. Sampling without replacement in
proportion to the weights takes the largest sums of log weight and Gumbel noise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shipgauge.llm.encoding import slices
from shipgauge.llm.frames import documents, materialize, pick
from shipgauge.llm.words import mix64, word_hashes

BUCKETS = 1 << 17
# Labelled documents of the target model at most: those with the smallest hashes of their ids.
TARGET_ROWS = 20_000
# Tokens added to a bucket of the target model and to what the raw model expects there,
# so that a bucket too rare to tell has a ratio near 1.
SMOOTHING = 100.0
# What op2 smooths by: less lets words speak that only toxic documents hold.
LIGHT_SMOOTHING = 1.0
WEIGHTS = "doc_id long, log_weight double, sort_key double, place long"


def good_documents(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """At most ``rows`` ids whose labels all say quality 1 and toxic 0."""
    known = pick(labels, doc_id="long", quality="int", toxic="int").where(F.col("doc_id").isNotNull())
    agreed = known.groupBy("doc_id").agg(
        F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("good"))
    return agreed.where("good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id")


def good_share(labels: DataFrame) -> float:
    """The share of the labelled ids that ``good_documents`` would take without its limit; 1 without labels."""
    known = pick(labels, doc_id="long", quality="int", toxic="int").where(F.col("doc_id").isNotNull())
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    row = known.groupBy("doc_id").agg(F.min(good.cast("int")).alias("good")).agg(F.avg("good")).first()
    return 1.0 if row[0] is None else float(row[0])


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of neighbours, and the text of each, in the order of the texts."""
    h, bounds = word_hashes(texts, pieces=True)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    pairs = mix64(h[:-1] * np.uint64(3) + mix64(h[1:])) if len(h) else h
    same = row[1:] == row[:-1]
    of = np.concatenate([row, row[1:][same]])
    values = np.concatenate([h, pairs[same]]) % np.uint64(buckets)
    return values.astype(np.int64), of


def _count(buckets: int):
    def run(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                values, of = features(part.column("text"), buckets)
                raw += np.bincount(values, minlength=buckets)
                good = part.column("good").to_numpy(zero_copy_only=False)
                target += np.bincount(values[good[of]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    return run


def _weigh(ratio: np.ndarray):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                values, of = features(part.column("text"), len(ratio))
                weight = np.bincount(of, weights=ratio[values], minlength=len(part)).astype(np.float64)
                u = (part.column("noise").to_numpy() + 0.5) / float(1 << 52)
                key = weight - np.log(-np.log(u))
                bits = key.view(np.int64)
                place = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)  # ordered as the keys are
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(weight), pa.array(key), pa.array(place)], names=[c.split()[0] for c in WEIGHTS.split(", ")])

    return run


def importance_weights(docs: DataFrame, good: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """doc_id, log_weight, sort_key and place (an integer in the order of sort_key) of every row; ``good``: ids of a bounded number of target documents."""
    texts = documents(docs)
    flagged = texts.join(F.broadcast(good.select("doc_id", F.lit(True).alias("good"))), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    counts = (
        flagged.select("text", "good").mapInArrow(_count(buckets), "bucket long, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # a row per bucket
    )
    at = counts.column("bucket").to_numpy()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[at] = counts.column("raw").to_numpy()
    target[at] = counts.column("target").to_numpy()
    ratio = log_ratio(raw, target, smoothing)
    noise = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 52))
    return texts.withColumn("noise", noise).mapInArrow(_weigh(ratio), WEIGHTS)


def log_ratio(raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Per bucket the log of its probability in the target over that in the raw text."""
    expected = raw * (target.sum() / max(raw.sum(), 1.0))
    return np.log(target + smoothing) - np.log(expected + smoothing)


def kth_largest(rows: DataFrame, column: str, k: int) -> int:
    """The k-th largest of a BIGINT column, 16 bits at a time: each round counts at most 65,536 groups."""
    found, shift = None, 48
    while shift >= 0:
        inside = rows if found is None else rows.where(F.shiftright(column, shift + 16) == found)
        groups = sorted(inside.groupBy(F.shiftright(column, shift).alias("g")).count().collect(), key=lambda r: -r["g"])
        for r in groups:
            if k <= r["count"]:
                found = r["g"]
                break
            k -= r["count"]
        shift -= 16
    return found


def resample(docs: DataFrame, labels: DataFrame, fraction: float | None = None, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS, smoothing: float = SMOOTHING) -> DataFrame:
    """The sample: doc_id, log_weight, sort_key and kept (true) of round(fraction * rows) rows.

    ``fraction`` is by default the share of good ones among the labelled documents, so
    that the sample is as large as the good text is taken to be; without labels all
    rows stay, with none but bad ones no row does.
    The noise is a hash of doc_id and text, so partitions do not change the sample;
    repeated rows share it and rows equal at the cut all stay. A null or empty text
    has weight 0; a null doc_id stays null and is never in the target; labels with
    nulls or contradictions are not good ones; without good labels all weights are
    differences to an even spread; an empty table or a fraction of 0 gives an empty
    sample, one of 1 or more all rows. Other columns are not looked at.
    """
    weights = materialize(importance_weights(docs, good_documents(labels, target_rows), buckets, smoothing), "weights")
    fraction = good_share(labels) if fraction is None else fraction
    rows = weights.count()
    k = min(round(fraction * rows), rows)
    chosen = weights.limit(0) if k <= 0 else weights.where(F.col("place") >= F.lit(kth_largest(weights, "place", k)))
    return chosen.select("doc_id", "log_weight", "sort_key", F.lit(True).alias("kept"))
