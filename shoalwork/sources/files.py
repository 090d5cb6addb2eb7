"""Readers and writers of the file forms around the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIL_CSV = "sender string, receiver string, subject string, date string, body string, url string, label int"


def read_mail_csv(spark: SparkSession, path: str) -> DataFrame:
    """A mail CSV with header, quoted line breaks and doubled quotes."""
    return spark.read.csv(path, schema=MAIL_CSV, header=True, multiLine=True, escape='"')


def read_idf_csv(spark: SparkSession, path: str) -> DataFrame:
    """(term, idf): idf to three places, 0 where it is no number."""
    return spark.read.csv(path, schema="term string, idf string", header=True, escape='"').select("term", F.coalesce(F.round(F.col("idf").try_cast("double"), 3), F.lit(0.0)).alias("idf"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(payload): each JSON file as one text, to be parsed by operators.graph.parse_events."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"))


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of JSON arrays or lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def to_events(raw: DataFrame) -> DataFrame:
    """(email_index, payload): each mail as an event document with its attributes; the last attributes are the links."""
    item = lambda kind, c, group: F.struct(F.lit(kind).alias("type"), c.alias("value"), F.lit(group).alias("category"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    fixed = [item(k, text(c), "Payload delivery") for k, c in (("email-src", "sender"), ("email-dst", "receiver"), ("email-subject", "subject"), ("email-date", "date"), ("email-body", "body"))]
    sites = F.transform(F.filter(F.coalesce("urls", F.array().cast("array<string>")), lambda u: F.length(F.trim(u)) > 0), lambda u: item("url", u, "Network activity"))
    event = F.struct(F.concat(F.lit("TREC-07 Email "), F.col("email_index")).alias("info"), "email_index", "orig_csv_index", F.concat(F.array(*fixed), sites).alias("Attribute"))
    return raw.select("email_index", F.to_json(F.struct(event.alias("Event"))).alias("payload"))


def cluster_document(assigned: DataFrame, records: DataFrame, key: str, algorithm: str) -> DataFrame:
    """(cluster, size, document): one JSON document per cluster with its members' records; noise (-1) keeps ids only."""
    joined = assigned.join(records, key)
    others = [c for c in records.columns]
    body = F.sort_array(F.collect_list(F.struct(*others)))
    return joined.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list(key)).alias("ids"), F.when(F.col("cluster") != -1, body).alias("emails")).select(
        "cluster", "size", F.to_json(F.struct(F.lit(algorithm).alias("algorithm"), F.when(F.col("cluster") == -1, "noise").otherwise(F.concat(F.lit("cluster_"), "cluster")).alias("name"), "size", F.col("ids").alias("email_indices"), "emails")).alias("document"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables, one folder for each type."""
    nodes.write.mode("overwrite").partitionBy("ntype").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("etype").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)
