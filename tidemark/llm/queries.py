"""Queries of this package over the whole test tables, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, neighbours, packing, sourcecheck, toxicity
from tidemark.sources import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "vectors"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    files = sourcecheck.file_nodes(table(spark, d, "nodes"), table(spark, d, "source_files"))
    return sourcecheck.unparsable(files).select(F.col("id").alias("node_id"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return sourcecheck.rates(sourcecheck.file_nodes(table(spark, d, "nodes"), table(spark, d, "source_files")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p9_bins(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(bpe.count_tokens(table(spark, d, "documents")))


def _model(spark: SparkSession, d: str) -> dict:
    return toxicity.fit(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).filter("flagged").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.scores(table(spark, d, "documents"), _model(spark, d))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.source_rates(table(spark, d, "documents"), _model(spark, d))


QUERIES = {
    "p3_found": p3_found, "p4_found": p4_found, "p4_rates": p4_rates, "p8_ids": p8_ids, "p9_bins": p9_bins,
    "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates,
}

#: None of these can be said in SQL; they are tested against brute force, other encoders, round trips and held-out marks.
SQL: dict[str, str] = {}
