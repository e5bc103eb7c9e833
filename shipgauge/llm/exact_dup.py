"""Exact copies by a tree merge of sorted digest runs, in DataFrame functions only.

Every input partition turns its rows into a run: one entry per digest, sorted,
with the entry's count and the row that would stay. In each round the runs of
``FAN_IN`` partitions meet: partition p keeps the share of the digest space that
the next digit of its own number names and receives that share of its partners'
runs, which are merged entry by entry. After the last round a digest's top digits
name its partition, so every digest has been merged, no task has held more than
its share, and a digest that a third of all rows carry was one entry per run from
the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shipgauge.llm.frames import Rows, documents, materialize

# Runs that meet in one round, and rounds: FAN_IN ** ROUNDS parts of the digest space.
FAN_IN = 16
ROUNDS = 2
WHITE_SPACE = "[\\x20\\x09-\\x0D]"
_NO_ID = (1 << 63) - 1


def normalised(text: Column) -> Column:
    """The text without white space; one byte-wise replacement per character is faster than a pattern."""
    for c in " \n\t\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def entry_columns(doc_id: Column, text: Column) -> dict[str, Column]:
    """What a run holds of a row: digest, a second check of equality, and its rank."""
    plain = normalised(text)
    return {
        "digest": F.unhex(F.sha2(plain, 256)),
        "proof": F.struct(F.octet_length(plain).alias("bytes"), F.xxhash64(plain).alias("hash")),
        # The smallest rank stays: most code points, then doc_id (null last), then the row's own number.
        "rank": F.struct((-F.char_length(text)).alias("points"), F.coalesce(doc_id, F.lit(_NO_ID)).alias("id"), F.monotonically_increasing_id().alias("row")),
    }


def tree_merge(rows: DataFrame, fan_in: int = FAN_IN, rounds: int = ROUNDS) -> DataFrame:
    """digest, proof, best (the smallest rank) and size, from rows with digest, proof and rank."""
    share = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    digits = [(F.floor(share / F.lit(float(1 << 32)) * F.lit(float(fan_in ** (r + 1)))).cast("long") % fan_in).cast("int") for r in range(rounds)]
    own = F.pmod(F.spark_partition_id(), F.lit(fan_in ** rounds))
    runs = (
        rows.groupBy(own.alias("part"), "digest", "proof").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("size"))
        if rounds else rows.select(F.lit(0).alias("part"), "digest", "proof", F.col("rank").alias("best"), F.lit(1).alias("size"))
    )
    for r in range(rounds):
        place = fan_in ** r
        kept = F.col("part") - (F.floor(F.col("part") / place).cast("int") % fan_in) * place
        runs = (
            runs.withColumn("part", (kept + digits[r] * place).cast("int"))
            .groupBy("part", "digest", "proof").agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        )
    return runs.drop("part")


def exact_duplicates(docs: DataFrame, fan_in: int = FAN_IN, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    Texts are equal when identical without the characters of WHITE_SPACE; a null
    text counts as empty. Of equal texts the one with the most code points stays,
    then the smallest doc_id; a null doc_id comes last. keep_id is the doc_id of
    the row that stays. Of repeated rows, which share text and doc_id, exactly one
    is kept. An empty table gives an empty result. Other columns are not looked at.
    """
    texts = documents(docs)
    rows = materialize(texts.select("doc_id", *_named(entry_columns(F.col("doc_id"), F.col("text")))), "digests")
    merged = tree_merge(rows, fan_in, rounds)
    return rows.join(merged, ["digest", "proof"]).select(
        "doc_id",
        F.nullif(F.col("best.id"), F.lit(_NO_ID)).alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("rank") == F.col("best")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, fan_in: int = FAN_IN, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = Rows(docs)
    text = F.coalesce(rows.col("text").cast("string"), F.lit(""))
    marked = materialize(rows.df.select("*", *_named(entry_columns(rows.col("doc_id").cast("long"), text))), "texts")
    best = tree_merge(marked.select("digest", "proof", "rank"), fan_in, rounds).select(F.col("best.row").alias("row"))
    return rows.restore(marked.join(best.hint("shuffle_hash"), marked["rank.row"] == best["row"], "left_semi"))


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]
