"""The corpus pipeline: five stages, each on all that the one before it kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as
Parquet in the shared folder and reads it again as the next one's docs.

All stages take null texts (as empty ones), null and repeated doc_ids, repeated rows, texts of any length, and further columns of any names, and an
empty table gives an empty one. The first four return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cairnlake.llm.common import Workspace, table
from cairnlake.llm.exactdedup import exact_dedup
from cairnlake.llm.mix import mixed_documents
from cairnlake.llm.ngramjoin import one_of_each
from cairnlake.llm.packing import pack_documents
from cairnlake.llm.quality import keep_good

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Every row is judged by its own text; without labels of both kinds all stay."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the largest doc_id; of rows that share it one. Null and empty texts are one group."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that of the smallest doc_id. Rows without doc_id or without words all stay."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each epoch of a document; its source's last one is cut at the budget. Rows without words stay once; null is a source of its own."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix packed into sequences: a row for each piece. A document's epochs, and rows that repeat a doc_id, are pieces each; an empty text is one piece of its end token."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]
#: The trained scores, the Jaccard components and the tokens can't be had in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.write(docs, name)
            if i:
                work.drop(STAGES[i - 1][0])
    return docs
