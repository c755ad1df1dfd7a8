"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.session import table


def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stratagrid.llm.tokens import token_table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_table(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagrid.llm.licences import licence_report

    return licence_report(table(spark, sf_dir, "documents"))


def op3_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagrid.llm.linededup import page_report

    return page_report(table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagrid.llm.langid import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagrid.llm.decontam import benchmark_matches

    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagrid.llm.sketch import fingerprint_report

    return fingerprint_report(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagrid.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


#: Target shares of the mix; sources that are not named have one share.
SHARES = {"src0": 6, "src1": 3, "src2": 3, "src3": 2}


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagrid.llm.mixing import mix_sources

    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs, SHARES)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagrid.llm.quality import score_quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_quality(docs, labels, host=F.col("source"), path=F.col("lang"))
    return scored.select("doc_id", "source", "lang", "quality_evidence", "host_posterior", "path_posterior", "quality_posterior", "quality_keep")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagrid.llm.pii import personal_data_report

    return personal_data_report(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagrid.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagrid.llm.sortmeans import sort_means

    return sort_means(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stratagrid.llm.tokencount import with_token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from stratagrid.llm import collocations, linededup

    return {"op3_site_lines": linededup.report_sql(), "op11_collocations": collocations.report_sql()}
