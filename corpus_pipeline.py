"""The corpus pipeline: from documents to token files, each stage on what the one before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.llm.common import scratch
from stratagrid.llm.decontam import drop_contaminated
from stratagrid.llm.mixing import in_mixed_order
from stratagrid.llm.nearcopies import drop_near_copies
from stratagrid.llm.quality import keep_quality
from stratagrid.llm.queries import SHARES
from stratagrid.llm.tokens import token_table
from stratagrid.session import table

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality posterior, by host (source) and section (language), is at least one half."""
    return keep_quality(docs, table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked at five-word shingle similarity of 0.8 or more."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item at word edit similarity of 0.8 or more."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the Pfair schedule of their sources."""
    return in_mixed_order(docs, SHARES)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of docs' files; doc_id, start, n_tokens, ids_crc32 read back from them.

    Rows that come from no file are taken in ascending doc_id order.
    """
    order = None
    try:
        docs = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        order = ["_file", "_row"]
    except AnalysisException:
        pass
    return token_table(spark, docs, public_tokenizers.path(TOKENIZER), order_by=order)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID output", token_output),
]

#: Stages fit a classifier, link fingerprints and run a tokenizer: SQL has no equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; what the last one returns."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch(spark, f"stage-{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
