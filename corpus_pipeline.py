"""The corpus pipeline: raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet
and read again as the next one's docs. All but the last keep the columns of documents. Null texts
count as empty in every stage; documents without words end at the mix; repeated rows go at exact dedup,
which keeps one; columns beyond those of documents pass through all stages but the last; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atlasmill.llm.exact_dedup import drop_copies
from atlasmill.llm.mixing import mixed
from atlasmill.llm.near_texts import drop_near_texts
from atlasmill.llm.quality import keep_good
from atlasmill.llm.registry import tokenizer_path
from atlasmill.llm.sentencepiece_bpe import encode_decode
from atlasmill.llm.shared import read, staged

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the row with the largest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest doc_id stays."""
    return drop_near_texts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents occur as often as the mix takes them."""
    return mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as text, and the check of their decoding."""
    return encode_decode(docs, tokenizer_path("piece_bpe_32k.model"), keep=["lang", "source"])


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("source mixing", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: The classifier, the components and the token ids have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
