"""Token counts by a digest cache.

The normalised content of a document (null counts as the empty text; the tokenizers here normalise inside, so no other
form is certain to keep the count) and the tokenizer's version (library, its version and the vocabulary file) name an entry
of the cache. Stored counts are joined by digest, only distinct misses are encoded, and those are appended to the cache.

The cache is a Parquet table partitioned by tokenizer version in a shared folder. Runs may append at the same time: an entry
that two runs wrote has the same count in both and is read once. A run that loses an executor repeats tasks; the
writer commits a task's rows once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.encoding import ChunkEncoder, TokenizerFile
from tallyforge.llm.shared import exists, stored

CACHE_SCHEMA = "digest binary, n_tokens long"


def content_digest(text):
    """SHA-256 of the normalised content's UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def count_misses(misses: DataFrame, file: TokenizerFile) -> DataFrame:
    """``digest, text`` to ``digest, n_tokens``."""
    shared = misses.sparkSession.sparkContext.broadcast(file)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(shared.value)
        for batch in batches:
            for first, _, edge in encoder.lists(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("digest").slice(first, len(edge) - 1), pa.array(np.diff(edge))], ["digest", "n_tokens"])

    return misses.mapInArrow(count, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per row of ``docs``: ``id_col, n_bytes, n_tokens, over_limit``.

    Null text counts as empty and has no tokens. Rows with equal texts, in any number, are encoded once and each
    keep their row; null ids stay null; other columns are ignored. An empty table gives an empty result. Texts of any length are
    encoded whole. ``cache`` is a path in a shared folder; it is made where missing.
    """
    spark = docs.sparkSession
    file = TokenizerFile.read(tokenizer)
    at = f"{cache}/version={file.version}"
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.withColumn("digest", content_digest(F.col("text")))
    # One row per digest leaves each task, so a text that a third of the rows share costs no more than another.
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    if not exists(spark, at):
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(at)
    known = spark.read.schema(CACHE_SCHEMA).parquet(at).select("digest")
    # A cache of any size joins by shuffle or, below the checked size, by broadcast, as its files tell Catalyst; an empty one too.
    misses = distinct.join(known, "digest", "left_anti")
    count_misses(misses, file).write.mode("append").parquet(at)
    # Written first, so that both sides of the join are plain and the rows of a hot digest can be split.
    counts = stored(spark.read.schema(CACHE_SCHEMA).parquet(at).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    found = keyed.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")).join(counts, "digest")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
