"""From raw documents to token ids: the stages of a training corpus, each written as Parquet and read again by the next.

1. language: documents whose language cannot be told (no letters, or a score below 0.5) go.
2. near duplicates: of each group of near copies the document with the least id stays.
3. secrets: every secret, under encodings too, becomes a mark; all documents stay.
4. mix: sources are mixed to their target weights; a document appears once for each turn in which words of it are taken.
5. tokens: every text is encoded by byte-level BPE, and the ids are decoded again; all columns but the text go on beside them.

Rows with null texts have no language and end at stage 1. Columns beyond those of documents are carried through all stages;
one that has the name of a result of stage 5 gets a mark before it there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from latticework.llm import bpe, langid, mixing, neardup, secrets, shared


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified(spark, docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(spark, docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return bpe.digest_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True, keep=rest)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mix", mix), ("tokens", tokens)]
#: No stage is expressible in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = shared.new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
