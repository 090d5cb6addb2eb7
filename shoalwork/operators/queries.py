"""Queries of the general problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoalwork.operators.instants import instants
from shoalwork.operators.packed import split_packed
from shoalwork.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_packed(table(spark, folder, "campaigns"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return instants(table(spark, folder, "trec07_misp"), table(spark, folder, "relays"), table(spark, folder, "tz_abbrevs"))


P4_SQL = r"""
WITH p AS (
  SELECT campaign_label, unnest(regexp_extract_all(email_ids, '"[^"]*"|''[^'']*''|\d+(\.0+)?')) AS x,
         generate_subscripts(regexp_extract_all(email_ids, '"[^"]*"|''[^'']*''|\d+(\.0+)?'), 1) AS i
  FROM campaigns)
SELECT campaign_label, row_number() OVER (PARTITION BY campaign_label ORDER BY i) AS pos,
       CAST(regexp_extract(replace(x, ',', ''), '\d+') AS BIGINT) AS email_id
FROM p WHERE regexp_matches(x, '\d')
"""


def queries() -> dict:
    return {"p4_found": p4_found, "p5_found": p5_found}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL}
