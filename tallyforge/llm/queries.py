"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.decontamination import find_overlaps
from tallyforge.llm.jaccard_join import near_components
from tallyforge.llm.licenses import scan_licenses
from tallyforge.llm.nearest import search
from tallyforge.llm.packing import pack
from tallyforge.llm.quality import select_quality
from tallyforge.llm.secret_scan import secret_digest
from tallyforge.llm.shared import fresh_folder
from tallyforge.llm.suffix_dedup import digest, remove_repeats
from tallyforge.llm.token_counts import count_tokens
from tallyforge.llm.warc import round_trip

SEQUENCE = (4096, 2048, 1024, 512)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected documents: their expected grade (0 toxic to 2 good), and how likely each grade is reached."""
    kept = select_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "expected_grade", F.col("tails")[0].alias("p_not_toxic"), F.col("tails")[1].alias("p_good"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(_table(spark, sf_dir, "documents"), least=200))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that a result never depends on what ran before."""
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh_folder(spark, "token-cache"), limit=512)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), tiers=SEQUENCE)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages"), fresh_folder(spark, "warc"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(_table(spark, sf_dir, "documents"))


OP9_SQL = """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM (SELECT page_id, html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
"""

QUERIES = {"op1_nearest_neighbours": op1_nearest_neighbours, "op2_quality_classifier": op2_quality_classifier, "op3_suffix_dedup": op3_suffix_dedup, "op4_jaccard_join": op4_jaccard_join, "op5_token_counts": op5_token_counts, "op6_decontamination": op6_decontamination, "op7_license_scan": op7_license_scan, "op8_packing": op8_packing, "op9_warc": op9_warc, "op10_secret_scan": op10_secret_scan}
ORACLES: dict[str, str] = {"op9_warc": OP9_SQL}
