"""Clusters of vectors: centroids, coherence, silhouette, k-means and the choice of k."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def centroids(vectors: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, n, centroid): the mean vector of each cluster, combined by dimension before the shuffle."""
    parts = vectors.select(F.col(cluster).alias("cluster"), F.posexplode(vector).alias("i", "x")).groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return parts.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def silhouette(vectors: DataFrame, key: str, cluster: str, vector: str) -> DataFrame:
    """(key, cluster, silhouette) by distances to the centroids (simplified silhouette).

    a is the distance to the own centroid, b that to the nearest other one; the
    value is (b - a) / max(a, b), 1 for a cluster of one, 0 where both are 0 or
    there is no other cluster. Linear in the vectors: all pairs of vectors, as
    the plain silhouette needs them, can't be looked at in a large collection.
    Centroids are few (one a cluster) and are broadcast.
    """
    c = centroids(vectors, cluster, vector)
    cs = c.agg(F.collect_list(F.struct("cluster", "n", "centroid")).alias("cs"))
    v = vectors.select(F.col(key).alias("key"), F.col(cluster).alias("cluster"), F.col(vector).alias("v")).crossJoin(F.broadcast(cs))  # one row of centroids
    own = F.filter("cs", lambda s: s["cluster"] == F.col("cluster"))[0]
    a = euclidean(F.col("v"), own["centroid"])
    b = F.array_min(F.transform(F.filter("cs", lambda s: s["cluster"] != F.col("cluster")), lambda s: euclidean(F.col("v"), s["centroid"])))
    got = v.select("key", "cluster", own["n"].alias("n"), a.alias("a"), b.alias("b"))
    s = F.when(F.col("n") == 1, 1.0).when(F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return got.select(F.col("key").alias(key), F.col("cluster").alias(cluster), s.alias("silhouette"))


def kmeans(vectors: DataFrame, vector: str, k: int, seed: int = 42, iterations: int = 100, tol: float = 1e-3) -> KMeansModel:
    data = vectors.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=iterations, tol=tol).fit(data)


def elbow(vectors: DataFrame, vector: str, most: int, seed: int = 42, compatible: bool = False) -> int:
    """The k from 2 to ``most`` where the summed squared distance bends most (2 in compatible mode, 0 if most < 2)."""
    if most < 2:
        return 0
    if compatible:
        return 2
    dims = vectors.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg((F.var_pop(F.col("x").cast("double")) * F.count("*")).alias("s"))
    cost = [dims.agg(F.sum("s")).first()[0] or 0.0] + [kmeans(vectors, vector, k, seed).summary.trainingCost for k in range(2, most + 1)]
    bends = {k: cost[k - 2] - 2 * cost[k - 1] + cost[k] for k in range(2, most)}
    return max(bends, key=bends.get) if bends else 2


def assigned(vectors: DataFrame, vector: str, model: KMeansModel, name: str = "cluster") -> DataFrame:
    df = vectors.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    return model.transform(df).withColumnRenamed("prediction", name).drop("features")
