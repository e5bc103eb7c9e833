"""Mixing to target weights with soft membership, in DataFrame functions only.

A classifier learned from a labelled table gives every document a posterior over
domains. Projected-gradient least squares then finds a rate per document, zero or
more, for which the expected tokens of the domains match their targets; every step
is one distributed sum of as many numbers as there are domains.
"""

from __future__ import annotations

import logging
import math
from json import loads

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from shipgauge.llm.frames import Rows, documents, materialize, pick

# Hashed words the classifier tells apart.
BUCKETS = 1 << 13
# Labelled documents it is fitted on at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
# A bucket counts for a domain if its count there is so many standard errors off.
SIGNIFICANT = 4.0
PASSES = 40
# The fit ends this near to its optimum, as a share of all tokens.
TOLERANCE = 1e-7
# How little leaving rates at 1 counts beside meeting the targets.
RIDGE = 1e-8
# Rates have no upper bound unless a caller asks for one.
MAX_RATE = math.inf
# Targets that are missed by more than this share of all tokens are warned of.
MISSED = 1e-3
_SCALE = 1 << 20
_LOG = logging.getLogger(__name__)


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id and domain, one of q0t0 .. q1t1, from quality and toxic; rows with a null or a contradiction are left out."""
    rows = pick(labels, doc_id="long", quality="int", toxic="int").dropna()
    return (
        rows.select("doc_id", F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("domain"))
        .groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("other"))
        .where("domain = other").drop("other")
    )


def word_buckets(text: Column, buckets: int) -> Column:
    """One number per word, and per run of punctuation, of the whole text, as an array."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z\\x{80}-\\x{10FFFF}]+|[!-/:-@\\[-`{-~]+"), F.lit(0))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def n_words(text: Column) -> Column:
    """White-space separated words, the unit of the targets."""
    plain = F.trim(F.regexp_replace(text, "[\\t-\\r]", " "))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, " +"))).cast("long")


class Classifier:
    """Naive Bayes over hashed words: weights per domain against the first one."""

    def __init__(self, docs: DataFrame, labels: DataFrame, domains: list[str], buckets: int = BUCKETS, train_rows: int = TRAIN_ROWS):
        self.domains, self.buckets = domains, buckets
        labels = labels.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull())
        if other := [r["domain"] for r in labels.where(~F.col("domain").isin(domains)).select("domain").distinct().limit(20).collect()]:
            raise ValueError(f"labels hold domains without a target: {sorted(other)}; give each one, 0 to leave it out of the mixture")
        sample = (
            labels
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
        )
        seen = (
            documents(docs).join(F.broadcast(sample), "doc_id")  # at most train_rows rows of two short values
            .select("domain", F.explode(word_buckets(F.col("text"), buckets)).alias("bucket"))
            .groupBy("domain", "bucket").count()
        )
        counts = materialize(seen, "word-counts")
        n = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}  # one row per domain
        # A domain that no label names, while others are named, has no documents.
        self.priors = [(n.get(d, 0) + 1) / (sum(n.values()) + len(domains)) if d in n or not n else 0.0 for d in domains]
        total = counts.groupBy("domain").agg(F.sum("count").alias("all")).collect()
        self._all = {r["domain"]: r["all"] for r in total}
        self._weights = [self._table(r) for r in self._fit(counts)]

    def _fit(self, counts: DataFrame) -> list[str]:
        """Per domain, for all buckets, the log of a word's share there over its share everywhere; 0 unless significant."""
        everywhere = max(1, sum(self._all.values()))
        by_bucket = counts.groupBy("bucket").agg(
            F.sum("count").alias("all"),
            *[F.sum(F.when(F.col("domain") == d, F.col("count")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(self.domains)],
        )
        weights = []
        for i, d in enumerate(self.domains):
            expected = F.col("all") * F.lit(self._all.get(d, 0) / everywhere)
            far = F.abs(F.col(f"n{i}") - expected) > F.lit(SIGNIFICANT) * F.sqrt(expected + 1)
            weight = F.when(far, F.log((F.col(f"n{i}") + 0.5) / (expected + 0.5))).otherwise(F.lit(0.0))
            weights.append(F.round(F.coalesce(weight, F.lit(0.0)), 4))
        rows = counts.sparkSession.range(self.buckets).select(F.col("id").cast("int").alias("bucket")).join(by_bucket, "bucket", "left")
        table = rows.agg(F.array_sort(F.collect_list(F.struct("bucket", F.array(*weights).alias("w")))).alias("t"))  # buckets entries
        return list(table.select(*[F.to_json(F.expr(f"transform(t, x -> x.w[{i}])")) for i in range(len(self.domains))]).first())

    @staticmethod
    def _table(json: str) -> Column:
        return F.expr("array(" + ",".join(f"{v!r}D" for v in loads(json)) + ")")  # folded into one constant

    def scores(self, buckets: Column) -> list[Column]:
        """Per domain the log of its prior and likelihood, computed within the row."""
        return [self._score(buckets, i) for i in range(len(self.domains))]

    def _score(self, buckets: Column, i: int) -> Column:
        if not self.priors[i]:
            return F.lit(-math.inf)
        return F.aggregate(buckets, F.lit(math.log(self.priors[i])), lambda total, b: total + F.get(self._weights[i], b))


def _softmax(df: DataFrame, scores: list[str], names: list[str]) -> DataFrame:
    top = F.greatest(*scores) if len(scores) > 1 else F.col(scores[0])
    df = df.withColumns({s: F.exp(F.col(s) - top) for s in scores})
    total = sum((F.col(s) for s in scores[1:]), F.col(scores[0]))
    return df.withColumns({n: F.col(s) / total for n, s in zip(names, scores)}).drop(*scores)


def _members(df: DataFrame, text: Column, model: Classifier, tag: str) -> DataFrame:
    """``df`` with its tokens and posteriors in columns that begin with ``tag``."""
    scores = [f"{tag}s{i}" for i in range(len(model.domains))]
    df = df.withColumns({f"{tag}tokens": n_words(text), f"{tag}words": word_buckets(text, model.buckets)})
    df = df.withColumns(dict(zip(scores, model.scores(F.col(f"{tag}words"))))).drop(f"{tag}words")
    return _softmax(df, scores, [f"{tag}p{i}" for i in range(len(scores))])


def fit_rates(members: DataFrame, tag: str, weights: list[float], total: float | None, passes: int = PASSES, top: float = MAX_RATE) -> tuple[Column, list[float]]:
    """The rate of each row as an expression, and the expected tokens it gives per domain.

    Minimises |expected - target|^2 + RIDGE * H0 * (sum of tokens * (rate - 1)^2) over
    rates from zero to ``top`` by projected gradients: a document's gradient is p * off, off
    being one number per domain, so the gradients of all steps add up to p * y and the
    rate is the projection of 1 - p * y, whatever the number of steps. Steps are scaled
    by the inverse of H, the sum of tokens * p * p' over rates between the bounds, and
    shortened until the objective falls. A trial is one pass over the members; sums are
    exact decimals, the same in any order. Targets that no rates reach are met as
    nearly as they can be.
    """
    k = len(weights)
    tokens, p = F.col(f"{tag}tokens"), [F.col(f"{tag}p{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def free_at(y: np.ndarray) -> Column:
        return F.lit(1.0) - sum((c * F.lit(float(v)) for c, v in zip(p[1:], y[1:])), p[0] * F.lit(float(y[0])))

    def rate_at(y: np.ndarray) -> Column:
        rate = F.greatest(F.lit(0.0), free_at(y))
        return rate if math.isinf(top) else F.least(F.lit(top), rate)

    def sums(y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The sum of what has the rates as its slopes, expected tokens per domain, and H."""
        weight = F.col("rate") * tokens
        between = F.when((F.col("rate") > 0) & (F.col("rate") < F.lit(top)), tokens)
        of = [weight * (free_at(y) - F.col("rate") / 2), *[weight * c for c in p], *[between * p[i] * p[j] for i, j in pairs]]
        row = members.withColumn("rate", rate_at(y)).agg(*[F.sum(c.cast("decimal(38,6)")).alias(f"x{n}") for n, c in enumerate(of)]).first()
        got, h = [float(v or 0) for v in row], np.zeros((k, k))
        for (i, j), v in zip(pairs, got[1 + k:]):
            h[i, j] = h[j, i] = v
        return got[0], np.array(got[1:1 + k]), h

    y = np.zeros(k)
    square, now, h = sums(y)
    wanted = now.sum() if total is None else total
    target = np.array(weights) / max(sum(weights), 1e-300) * wanted
    ridge = RIDGE * max(float(np.trace(h)) / k, 1e-300)
    objective = lambda square, y: square + target @ y + ridge / 2 * y @ y
    for _ in range(passes):
        slope = target - now + ridge * y
        if float(np.abs(slope).sum()) <= TOLERANCE * max(1.0, wanted):
            break
        step = np.linalg.solve(h + ridge * np.eye(k), slope)
        size = 1.0
        while size > 1e-4:
            tried = y - size * step
            got = sums(tried)
            if objective(got[0], tried) <= objective(square, y) - 1e-4 * size * slope @ step:
                break
            size /= 4
        else:
            break
        y, (square, now, h) = tried, got
    return rate_at(y), now.tolist()


def _rates(members: DataFrame, targets: dict[str, float], total: float | None, top: float) -> Column:
    """The rates of ``members``; target and reached tokens of every domain go to the log, as a warning where they differ."""
    domains = sorted(targets)
    rate, reached = fit_rates(members, "m_", [targets[d] for d in domains], total, top=top)
    if total is None:
        total = float(members.agg(F.sum("m_tokens")).first()[0] or 0)
    for d, got in zip(domains, reached):
        wanted = targets[d] / max(sum(targets.values()), 1e-300) * total
        missed = abs(got - wanted) > MISSED * max(total, 1.0)
        _LOG.log(logging.WARNING if missed else logging.INFO, "mixing: %s reaches %.0f expected tokens, target %.0f%s", d, got, wanted, ", MISSED" if missed else "")
    return rate


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], total: float | None = None, train_rows: int = TRAIN_ROWS, top: float = MAX_RATE) -> DataFrame:
    """doc_id, tokens, p_<domain> for every domain of ``targets``, and rate, one row per row of ``docs``.

    ``labels``: doc_id and domain; null ones are left out, and a domain that has no
    target is an error. A target of 0 is one: its documents leave the mixture as far as
    the classifier tells them apart. A domain without labels, while others have some,
    has a posterior of 0. ``total``: tokens the mixture should have, by default as many as
    there are. ``top``: rates end there, if given; targets may then be missed. Target
    and reached tokens of each domain are logged. A null or empty text has no tokens, the priors as posterior and a
    rate like any other. A null doc_id stays null and is never trained on; repeated
    rows are documents of their own with equal rates; an empty table gives an empty
    result; without labels all domains are equally likely and the targets are met
    as nearly as that allows. Other columns are not looked at.
    """
    domains = sorted(targets)
    model = Classifier(docs, labels, domains, train_rows=train_rows)
    texts = documents(docs)
    members = materialize(_members(texts, F.col("text"), model, "m_").drop("text"), "members")
    rate = _rates(members, targets, total, top)
    return members.select(
        "doc_id", F.col("m_tokens").alias("tokens"), *[F.col(f"m_p{i}").alias(f"p_{d}") for i, d in enumerate(domains)], rate.alias("rate"),
    )


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], total: float | None = None, train_rows: int = TRAIN_ROWS, top: float = MAX_RATE) -> DataFrame:
    """``docs`` with every row as often as its rate says: the whole part, and once more with the rest as probability.

    Domains, rates and what is logged are those of ``mixing_rates``. The draw is a hash of doc_id and text, so that it does not depend on partitions.
    """
    domains = sorted(targets)
    model = Classifier(docs, labels, domains, train_rows=train_rows)
    rows = Rows(docs)
    text = F.coalesce(rows.col("text").cast("string"), F.lit(""))
    members = materialize(_members(rows.df, text, model, "m_"), "members")
    rate = _rates(members.select("m_tokens", *[f"m_p{i}" for i in range(len(domains))]), targets, total, top)
    draw = F.pmod(F.xxhash64(rows.col("doc_id"), text), F.lit(_SCALE)) / F.lit(float(_SCALE))
    rated = members.withColumn("m_rate", rate)
    copies = F.floor("m_rate") + (draw < F.col("m_rate") - F.floor("m_rate")).cast("long")
    repeated = rated.withColumn("m_copies", copies).where("m_copies > 0").withColumn("m_copy", F.explode(F.sequence(F.lit(1), "m_copies")))
    return rows.restore(repeated)
