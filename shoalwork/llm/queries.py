"""Queries of the problems that work on text, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwork.llm.containers import fill_containers
from shoalwork.llm.inherited import inherited_lines
from shoalwork.llm.lookalikes import lookalike_pairs, visible_forms
from shoalwork.llm.mailings import cluster_mails, described, neighbours
from shoalwork.llm.mojibake import garbled_fields
from shoalwork.llm.nearsets import all_pairs, groups, similar_pairs
from shoalwork.llm.tokens import encode_corpus
from shoalwork.plans.cut import cut
from shoalwork.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return inherited_lines(table(spark, folder, "trec07_misp"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled_fields(table(spark, folder, "trec07_misp"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours(cluster_mails(table(spark, folder, "trec07_misp")))


def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return described(cut(cluster_mails(table(spark, folder, "trec07_misp"))))


def _similar_mails(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    mails = table(spark, folder, "trec07_misp").where("body is not null").select("email_index", F.concat(F.coalesce("subject", F.lit("")), F.lit("\n"), "body").alias("text"))
    return similar_pairs(mails, "email_index", "text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return all_pairs(*_similar_mails(spark, folder), "email_index")


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """email_index, representative, group_id, links: one row for each mail of 20 and more triples."""
    return groups(*_similar_mails(spark, folder), "email_index")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """container_kind, doc_id, piece, first_token, n_tokens, container_no, offset: all documents for each kind of container."""
    sized = cut(encode_corpus(table(spark, folder, "documents"), counts=True))
    kinds = table(spark, folder, "token_containers").where("capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").alias("capacity")).collect()  # a fixed table
    return reduce(DataFrame.unionByName, [fill_containers(sized, k["capacity"]).withColumn("container_kind", F.lit(k["container_kind"])) for k in kinds])


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike_pairs(table(spark, folder, "documents"))


def p9_forms(spark: SparkSession, folder: str) -> DataFrame:
    return visible_forms(table(spark, folder, "documents")).select("doc_id", F.md5("form").alias("form_md5"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_clusters, p6_found, p6_groups, p7_ids, p8_containers, p9_found, p9_forms)}


def oracle_sql() -> dict[str, str]:
    return {}
