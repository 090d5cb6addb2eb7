"""A readable report of a graph, from small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalwork.operators import graph as G


def markdown(edge: DataFrame, top: int = 10) -> str:
    """Sections: totals, edge types, most linked entities of each kind, degrees, components. Only rows shown are collected."""
    def rows(title: str, df: DataFrame) -> list[str]:
        return [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(str, r)) + " |" for r in df.collect()), ""]

    nodes = G.endpoints(edge).select("ntype", "key").distinct()
    out = ["# Graph report", ""]
    out += rows("Nodes", nodes.groupBy("ntype").agg(F.count(F.lit(1)).alias("n")).orderBy("ntype"))
    out += rows("Edges", edge.groupBy("etype").agg(F.count(F.lit(1)).alias("n")).orderBy("etype"))
    for kind in ("has_url", "has_receiver", "has_stem", "has_domain", "has_sender"):
        out += rows(f"Most frequent: {kind}", edge.where(F.col("etype") == kind).groupBy(F.col("dst").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(top))
    out += rows("Degrees", G.connectivity(edge, nodes).orderBy("etype", "side"))
    tag = lambda side, c: F.concat(F.element_at(F.create_map(*[x for k, v in G.SCHEMA.items() for x in (F.lit(k), F.lit(v[side]))]), F.col("etype")), F.lit(":"), F.col(c))
    found = G.components(edge.select(tag(0, "src").alias("a"), tag(1, "dst").alias("b")))
    out += rows("Components", found.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component").limit(5))
    return "\n".join(out)
