"""Token counts behind a digest cache.

A text's normalised content and the tokenizer's version have digests; counts are
stored under both. Only distinct contents without a stored count are encoded, and
their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shipgauge.llm.encoding import WORDS_ONLY, Encoder, encoder, slices
from shipgauge.llm.frames import documents, materialize, read_or_empty

SCHEMA = "content binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the file, the library that reads it and its version."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"\0{library} {version(library)}".encode()).hexdigest()


def content_digest(text: Column, collapse: bool) -> Column:
    """SHA-256 of the text; runs of white space count as one space where the tokenizer drops them."""
    if collapse:
        text = F.regexp_replace(text, "[\\t-\\r ]{2,}|[\\t-\\r]", " ")
    return F.unhex(F.sha2(text, 256))


class TokenCache:
    """Counts in a Parquet folder, one subfolder per tokenizer version.

    Rows are only ever added. Two jobs that add the same content at once leave
    two equal rows, which reading unites.
    """

    def __init__(self, spark: SparkSession, path: str, tokenizer: str):
        self.spark, self.folder = spark, f"{path}/tokenizer={tokenizer_version(tokenizer)}"

    def counts(self) -> DataFrame:
        """content, n_tokens: one row per content."""
        return read_or_empty(self.spark, self.folder, SCHEMA).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, rows: DataFrame) -> None:
        rows.select("content", "n_tokens").write.mode("append").parquet(self.folder)


def token_counts(docs: DataFrame, tokenizer: str, cache: TokenCache, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row of ``docs``.

    Nothing is added at the ends, special strings inside a text are read as the
    library does by default, and the whole text counts. A null or empty text has
    0 bytes and 0 tokens; a null doc_id stays null; repeated rows come out as
    often as they came in and are encoded once; an empty table gives an empty
    result and adds nothing. Other columns are not looked at.

    The texts that miss are moved once, by doc_id and digest, to meet the list of
    distinct misses; nothing else moves but digests. Rows that share both meet in one
    task, which encodes the first of them; where adaptive execution splits so hot a
    task, each of its parts encodes one, and reading the cache unites them.
    """
    collapse = _collapses(tokenizer)
    texts = documents(docs).withColumn("content", content_digest(F.col("text"), collapse))
    texts = texts.withColumn("owner", F.coalesce("doc_id", F.lit(-(1 << 63))))
    keys = materialize(texts.select("doc_id", "owner", F.octet_length("text").cast("long").alias("n_bytes"), "content"), "contents")
    misses = (
        keys.groupBy("content").agg(F.min("owner").alias("owner"))
        .join(cache.counts(), "content", "left_anti")
    )
    to_encode = texts.select("owner", "content", "text").join(misses.hint("shuffle_hash"), ["owner", "content"], "left_semi")
    cache.append(to_encode.select("content", "text").mapInArrow(_count(tokenizer), SCHEMA))
    return (
        keys.join(cache.counts(), "content", "left")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def _collapses(tokenizer: str) -> bool:
    return not tokenizer.endswith(".model") and Encoder(tokenizer).rule == WORDS_ONLY


def _count(tokenizer: str):
    """Counts of the texts of a task, those of a repeated content once."""
    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                fresh = []
                for content in part.column("content").to_pylist():
                    fresh.append(content not in seen)
                    seen.add(content)
                if not any(fresh):
                    continue
                if not all(fresh):
                    part = part.filter(pa.array(fresh))
                n = encoder(tokenizer).count(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(n, pa.int64())], names=["content", "n_tokens"])

    return run
