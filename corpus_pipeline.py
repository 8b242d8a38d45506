"""From documents to token counts: quality rules, language ID, near-duplicates, mixing and byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstmill.llm import byte_bpe, language_id, mixing, near_copies, quality_rules
from burstmill.shared import materialize

#: Language scores (0 to 1) below which a document is rejected, besides those without a letter.
MIN_LANGUAGE_SCORE = 0.4
RANKS = "byte_bpe_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    found = quality_rules.quality(docs)
    return found.filter(F.col(found.columns[-1])["kept"]).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    model = language_id.fit(docs, usable=~language_id.held_out())
    found = language_id.predict(docs, model)
    verdict = F.col(found.columns[-1])
    return found.filter((verdict["lang_pred"] != language_id.UNDETERMINED) & (verdict["score"] >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8 or more), the one with the smallest doc_id."""
    return near_copies.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded bytes, for each row of the mix."""
    found = byte_bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], digests=True)
    return found.select("doc_id", "lang", "source", f"{found.columns[-1]}.*")


STAGES = [("quality rules", quality), ("language ID", language), ("SimHash near-dedup", near_duplicates), ("mixing sources", mix), ("byte-level BPE", tokens)]
#: SQL expresses neither the regression nor the merges; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
