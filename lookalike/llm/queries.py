"""The pN_ queries: (spark, folder of tables) -> DataFrame, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lookalike.llm import communities, edits, groups, leaks, neighbours, residue, survivors, tokens
from lookalike.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Texts are worked on in Python, so a small file is dealt out to all cores."""
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.found(table(spark, folder, "metadata"))


def p1_recall(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.recall(table(spark, folder, "metadata"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return communities.found(table(spark, folder, "metadata"))


def p2_described(spark: SparkSession, folder: str) -> DataFrame:
    return communities.described(table(spark, folder, "metadata"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return groups.grouped(table(spark, folder, "edges"), table(spark, folder, "metadata"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return edits.found(table(spark, folder, "metadata"))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    return edits.classes(table(spark, folder, "metadata"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.survivors(table(spark, folder, "clusters"), table(spark, folder, "metadata"))


def p5_merged(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.merged(table(spark, folder, "clusters"), table(spark, folder, "metadata"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(documents(spark, folder))


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.round_trip(documents(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.found(documents(spark, folder), table(spark, folder, "eval_items"))


def p7_tolerant(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps with at most one substituted word in any 13."""
    return leaks.overlaps(documents(spark, folder), table(spark, folder, "eval_items"), wrong=1)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.found(documents(spark, folder))


def p8_residue(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_pieces(documents(spark, folder))


QUERIES = {f.__name__: f for f in (p1_found, p1_recall, p2_found, p2_described, p3_found, p4_found, p4_classes, p5_found, p5_merged, p6_ids, p6_round_trip, p7_found, p7_tolerant, p8_found, p8_residue)}
SQL: dict[str, str] = survivors.SQL | groups.SQL | edits.SQL
