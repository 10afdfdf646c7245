"""Feature vectors: scaling, projection, k-means, centroid distances."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F


def centroids(rows: DataFrame, label: str, vector: str, size: int) -> DataFrame:
    """(label, centroid): mean vector per label, by position."""
    flat = rows.select(label, F.posexplode(vector).alias("i", "x"))
    mean = flat.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # one row per label and position: bounded by labels x size
    return mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("centroid"))


def distances(rows: DataFrame, key: str, vector: str, centres: DataFrame, label: str, centre: str = "centroid") -> DataFrame:
    """(key, label, distance) to every centre; the centres are few and are sent to every task."""
    sq = F.aggregate(F.zip_with(F.col(vector), F.col(centre), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)
    return rows.crossJoin(F.broadcast(centres.select(F.col(label).alias("_label"), F.col(centre).alias(centre)))).select(key, F.col("_label").alias(label), F.sqrt(sq).alias("distance"))


def margin(sorted_distances: Column) -> Column:
    """(second - first) / second of sorted distances, within [0, 1]."""
    a, b = sorted_distances[0], sorted_distances[1]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (b - a) / F.greatest(b, F.lit(1e-12))))


def nearest(dist: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, distance, confidence): the nearest centre and its lead over the second."""
    g = dist.groupBy(key).agg(F.min_by(F.struct(label, "distance"), F.struct("distance", label)).alias("b"), F.sort_array(F.collect_list("distance")).alias("d"))
    return g.select(key, F.col(f"b.{label}").alias(label), F.col("b.distance").alias("distance"), margin(F.col("d")).alias("confidence"))


def project(rows: DataFrame, vector: str, components: int) -> DataFrame:
    """Adds ``projected``: standardised and projected on the first components (signs are arbitrary)."""
    v = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_s").fit(v)
    s = scaler.transform(v)
    pca = PCA(k=components, inputCol="_s", outputCol="_p").fit(s)
    return pca.transform(s).withColumn("projected", vector_to_array("_p")).drop("_v", "_s", "_p")


def kmeans(rows: DataFrame, vector: str, k: int, seed: int = 42, steps: int = 30) -> DataFrame:
    """Adds ``cluster`` (0..k-1) by seeded parallel k-means."""
    v = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=steps, featuresCol="_v", predictionCol="cluster").fit(v)
    return model.transform(v).drop("_v")


def window_average(pieces: DataFrame, by: list[str], word: str, vector: str) -> DataFrame:
    """Mean vector per word over windows."""
    flat = pieces.select(*by, word, F.posexplode(vector).alias("i", "x"))
    mean = flat.groupBy(*by, word, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy(*by, word).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("mean_vector"))
