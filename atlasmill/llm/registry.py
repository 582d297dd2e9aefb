"""Queries of the corpus operators, one per operator, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .html_text import main_text
from .language_id import fold, identify
from .line_dedup import dedup_lines
from .mixing import mix
from .ogg import media_columns
from .quality import classify
from .secret_scan import scan_secrets
from .sentencepiece_bpe import encode_decode
from .sharding import ring_shards
from .shared import read
from .simhash import near_groups
from .token_alignment import align_tokenizers
from .whitening import whiten


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files lie; only the driver reads them."""
    import public_tokenizers

    return public_tokenizers.path(name)


ORACLES: dict[str, str] = {}


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLES["op9_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AND row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read(spark, sf_dir, "documents"), least=1)
    return found.withColumn("text_sha256", F.sha2("text", 256)).drop("text")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = ring_shards(read(spark, sf_dir, "documents"))
    return shards.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op10_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id")) == 0
    found = identify(docs, learn=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_spans")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
