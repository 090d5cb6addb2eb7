"""Link prediction over embeddings: splits, negatives, scores, rankings and a graph convolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalwork.functions import columns as C


def supervised_types(schema: dict[str, tuple[str, str]], primary: str, direction: str = "out") -> list[str]:
    """Edge types from (out), to (in) or either way at the primary node type; an error if there are none."""
    out = [k for k, (a, b) in schema.items() if a == primary and b != primary]
    into = [k for k, (a, b) in schema.items() if b == primary and a != primary]
    found = {"out": out, "in": into, "both": list(dict.fromkeys(out + into))}[direction]
    if not found:
        raise ValueError("no edge type touches the primary node type")
    return found


def spread(*cols: Column, seed: int = 42) -> Column:
    """A number below 2^31 - 1 from integer columns by plain arithmetic, the same in any engine."""
    x = F.lit(seed).cast("bigint")
    for c in cols:
        x = F.pmod((x * 48271 + F.pmod(c.cast("bigint"), F.lit(2147483647))) * 16807, F.lit(2147483647))
    return x


def split_edges(edge: DataFrame, etype: str, src: str, dst: str, val: float = 0.1, test: float = 0.1, seed: int = 42, slices: int = 1024) -> DataFrame:
    """The edges with split = val, test or train: of E edges of a type exactly floor(E * share) each, in the order of a hash.

    The place in that order is the count of the slices of the hash before an edge's, plus its rank within its slice.
    """
    hashed = edge.withColumn("_h", spread(F.col(src), F.col(dst), seed=seed)).withColumn("_s", F.floor(F.col("_h") / (2147483647 // slices + 1)))
    counts = hashed.groupBy(etype, "_s").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(etype).orderBy("_s")
    before = counts.select(etype, "_s", (F.sum("_c").over(w) - F.col("_c")).alias("_b"), F.sum("_c").over(Window.partitionBy(etype)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(etype, "_s").orderBy("_h", src, dst)) - 1
    placed = hashed.withColumn("_r", rank).join(F.broadcast(before), [etype, "_s"]).withColumn("_p", F.col("_r") + F.col("_b"))  # at most `slices` rows a type
    n_val, n_test = F.floor(F.col("_n") * val), F.floor(F.col("_n") * test)
    return placed.withColumn("split", F.when(F.col("_p") < n_val, "val").when(F.col("_p") < n_val + n_test, "test").otherwise("train")).drop("_h", "_s", "_r", "_b", "_n", "_p")


def negatives(edge: DataFrame, src: str, dst: str, n_dst: int, seed: int = 7) -> DataFrame:
    """For each edge one with a hashed destination in [0, n_dst)."""
    return edge.withColumn(dst, F.pmod(spread(F.col(src), F.col(dst), seed=seed), F.lit(n_dst)))


def sample_neighbours(edge: DataFrame, src: str, dst: str, fanout: int, seed: int = 11) -> DataFrame:
    """At most `fanout` in-neighbours of each destination, in the order of a hash (neighbour sampling of the training loop)."""
    w = Window.partitionBy(dst).orderBy(spread(F.col(src), F.col(dst), seed=seed), src)
    return edge.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= fanout).drop("_r")


def edge_scores(edge: DataFrame, left: DataFrame, right: DataFrame, src: str, dst: str, key: str, vector: str, relation: list[float] | None = None) -> DataFrame:
    """The edges with score: dot product of the ends, weighted by a relation vector if one is given (DistMult)."""
    a = left.select(F.col(key).alias(src), F.col(vector).alias("_a"))
    b = right.select(F.col(key).alias(dst), F.col(vector).alias("_b"))
    weighed = F.zip_with("_a", F.array(*map(F.lit, relation)), lambda x, r: x.cast("double") * r) if relation else F.col("_a")
    return edge.join(a, src).join(b, dst).withColumn("score", C.dot(weighed, F.col("_b"))).drop("_a", "_b")


def mlp_scores(pairs: DataFrame, a: str, b: str, hidden: list[list[float]], bias: list[float], out: list[float], last: float) -> DataFrame:
    """The pairs with score: a two-layer perceptron over both vectors one after the other."""
    x = F.concat(F.col(a), F.col(b))
    layer = F.array(*(F.greatest(C.dot(x, F.array(*map(F.lit, w))) + c, F.lit(0.0)) for w, c in zip(hidden, bias)))
    return pairs.withColumn("score", C.dot(layer, F.array(*map(F.lit, out))) + last)


def log_loss(score: Column, label: Column, positive_weight: float = 1.0) -> Column:
    """Stable binary cross entropy with logits."""
    soft = F.greatest(-score, F.lit(0.0)) + F.log1p(F.exp(-F.abs(score)))
    return (1 - label) * score + (1 + (positive_weight - 1) * label) * soft


def auroc_ap(scored: DataFrame, group: str, score: str = "score", label: str = "label") -> DataFrame:
    """(group, auroc, ap): area under the ROC curve by rank sums and average precision, ties as one step.

    Rows are first counted by score, so that windows see distinct scores only.
    """
    by = scored.groupBy(group, score).agg(F.sum(F.col(label)).alias("p"), F.count(F.lit(1)).alias("n"))
    up, down = Window.partitionBy(group).orderBy(score), Window.partitionBy(group).orderBy(F.desc(score))
    every = Window.partitionBy(group)
    ranked = by.select(group, "p", "n", (F.sum("n").over(up) - (F.col("n") - 1) / 2).alias("rank"), F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("seen"), F.sum("p").over(every).alias("pos"), F.sum("n").over(every).alias("all"))
    sums = ranked.groupBy(group).agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.max("pos").alias("pos"), F.max("all").alias("all"), F.sum(F.col("p") / F.col("pos") * F.col("tp") / F.col("seen")).alias("ap"))
    area = (F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * (F.col("all") - F.col("pos")))
    return sums.where("pos > 0 and pos < all").select(group, F.round(area, 6).alias("auroc"), F.round("ap", 6).alias("ap"))


def top_k(queries: DataFrame, items: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, item, score, rank): the k items of largest cosine for each query, itself excepted; ties by item.

    The queries are the stated set; the items meet them in blocks, each block keeps its own k and only those are ranked.
    """
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    from shoalwork.operators.clustering import blocks
    from shoalwork.plans.cut import cut

    q = cut(blocks(queries, key, vector))
    d = cut(blocks(items, key, vector)).select(F.col("ids").alias("item_ids"), F.col("data").alias("item_data"), F.col("block").alias("o"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        norm = lambda raw, n: (x := np.frombuffer(raw).reshape(n, -1)) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        for batch in batches:
            for qi, qd, ii, idata in zip(batch["ids"], batch["data"], batch["item_ids"], batch["item_data"]):
                qi, ii = np.asarray(qi), np.asarray(ii)
                s = norm(qd, len(qi)) @ norm(idata, len(ii)).T
                s[qi[:, None] == ii[None]] = -np.inf
                order = np.lexsort((np.broadcast_to(ii, s.shape), -np.round(s, 9)), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(qi)), order.shape[1])
                flat = order.ravel()
                out = pd.DataFrame({"query": qi[rows], "item": ii[flat], "score": s[rows, flat]})
                yield out[np.isfinite(out["score"])]

    met = q.join(d, F.lit(True)).repartition("block", "o").mapInPandas(meet, "query bigint, item bigint, score double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "item")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hit_rate_mrr(ranked: DataFrame, truth: DataFrame, cutoffs: list[int]) -> DataFrame:
    """(k, hit_rate, mrr) from (query, item, rank) and the true (query, item): share of queries with truth that have a hit
    within k, and the mean reciprocal first rank over those that do."""
    sources = truth.select("query").distinct()
    first = ranked.join(truth.distinct(), ["query", "item"]).groupBy("query").agg(F.min("rank").alias("first"))
    per = sources.join(first, "query", "left")
    each = per.select("first", F.explode(F.array(*map(F.lit, cutoffs))).alias("k"))
    hit = F.col("first") <= F.col("k")
    return each.groupBy("k").agg(F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("hit_rate"), F.round(F.coalesce(F.avg(F.when(hit, 1.0 / F.col("first"))), F.lit(0.0)), 6).alias("mrr"))


def sage_layer(edge: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame, key: str, vector: str, own: list[list[float]], other: list[list[float]], relu: bool = True) -> DataFrame:
    """(key, vector): own weights times each destination's vector plus other weights times the mean of its in-neighbours'.

    edge: src, dst. Destinations without neighbours get their own part only. The mean is taken for each dimension before
    any vector is gathered, so a hub's neighbours are combined on the map side.
    """
    width = len(other[0])
    message = edge.join(src_nodes.select(F.col(key).alias("src"), F.col(vector).alias("_x")), "src")
    mean = message.groupBy("dst").agg(F.array(*(F.avg(F.col("_x")[i].cast("double")) for i in range(width))).alias("_m"))
    row = lambda c, w: C.dot(c, F.array(*map(F.lit, w)))
    act = lambda c: F.greatest(c, F.lit(0.0)) if relu else c
    joined = dst_nodes.select(F.col(key).alias("dst"), F.col(vector).alias("_y")).join(mean, "dst", "left")
    new = F.array(*(act(row(F.col("_y"), a) + F.coalesce(row(F.col("_m"), b), F.lit(0.0))) for a, b in zip(own, other)))
    return joined.select(F.col("dst").alias(key), new.alias(vector))
