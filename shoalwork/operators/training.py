"""Training of link scores on embeddings, and what is read from its log."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalwork.functions import columns as C


def train_relation(labelled: DataFrame, nodes: DataFrame, src: str, dst: str, label: str, key: str, vector: str, decay: float = 5e-4, rounds: int = 30) -> list[float]:
    """The relation vector of a DistMult head on fixed embeddings: logistic regression without intercept on the products of the ends."""
    a, b = (nodes.select(F.col(key).alias(c), F.transform(vector, lambda x: x.cast("double")).alias(f"_{c}")) for c in (src, dst))
    rows = labelled.join(a, src).join(b, dst).select(F.col(label).cast("double").alias("label"), array_to_vector(F.zip_with(f"_{src}", f"_{dst}", lambda x, y: x * y)).alias("features"))
    model = LogisticRegression(fitIntercept=False, standardization=False, regParam=decay, maxIter=rounds).fit(rows)
    return [float(x) for x in model.coefficients]


def accuracy(scored: DataFrame, score: str, label: str) -> DataFrame:
    """(n, loss, accuracy) of logits: mean stable cross entropy, and the share on the right side of 0."""
    from shoalwork.operators.links import log_loss

    y = F.col(label).cast("double")
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(log_loss(F.col(score), y)), 6).alias("loss"), F.round(F.avg(((F.col(score) >= 0).cast("double") == y).cast("double")), 6).alias("accuracy"))


def contrast(scored: DataFrame, group: str, score: str, label: str, temperature: float = 0.1) -> DataFrame:
    """(group, loss): mean over positives of the log-sum-exp over the group's scores minus the positive's, with the largest taken out."""
    s = F.col(score) / temperature
    most = F.max(s).over(Window.partitionBy(group))
    logs = scored.withColumn("_m", most).withColumn("_l", F.log(F.sum(F.exp(s - F.col("_m"))).over(Window.partitionBy(group))) + F.col("_m"))
    return logs.where(F.col(label) == 1).groupBy(group).agg(F.round(F.avg(F.col("_l") - s), 6).alias("loss"))


def patience(log: DataFrame, step: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """The log with the steps since the best loss so far (early stopping reads it). One row a step."""
    w = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    seen = log.withColumn("_best", F.min(F.struct(F.col(loss), F.col(step))).over(w))
    return seen.withColumn("since_best", F.col(step) - F.col(f"_best.{step}")).drop("_best")


def grid(points: DataFrame, key: str, vector: str, label: str, radii: list[float], min_samples: int = 5) -> DataFrame:
    """One row per radius with size, noise, clusters and agreement with the labels of a density clustering."""
    from functools import reduce

    from shoalwork.operators.clustering import agreement, dbscan
    from shoalwork.plans.cut import cut

    out = []
    for radius in radii:
        found = cut(dbscan(points, key, vector, radius, min_samples).join(points.select(key, label), key))
        counts = found.agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("cluster") == -1).alias("n_noise"), F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"))
        out.append(counts.crossJoin(agreement(found, label, "cluster").drop("n")).withColumn("epsilon", F.lit(radius)))  # one row each
    return reduce(DataFrame.unionByName, out)


def sample_rows(df: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for the same seed and keys (a sampling operator)."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def norms(points: DataFrame, vector: str) -> DataFrame:
    """(mean, most) of the Euclidean norms."""
    n: Column = F.sqrt(C.dot(F.col(vector), F.col(vector)))
    return points.agg(F.round(F.avg(n), 6).alias("mean"), F.round(F.max(n), 6).alias("most"))
