"""Clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekmill.functions import text as T, urls


def assign(vectors: DataFrame, centroids: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """H2: (id, centroid_id, distance): the nearest of centroids(centroid_id, centroid) by cosine distance, the lowest id on ties.
    All centroids (k times dims numbers, k is a parameter) travel as one array row."""
    packed = centroids.agg(F.array_sort(F.collect_list(F.struct("centroid_id", "centroid"))).alias("cs"))
    own = vectors.crossJoin(F.broadcast(packed))
    each = F.transform("cs", lambda c: F.struct(F.round(1 - T.cosine(F.col(vec_col), c["centroid"]), 9).alias("distance"), c["centroid_id"].alias("centroid_id")))
    return own.withColumn("_b", F.array_min(each)).select(F.col(id_col), F.col("_b.centroid_id").alias("centroid_id"), F.round("_b.distance", 6).alias("distance"))


def mean_vectors(vectors: DataFrame, by: str, vec_col: str = "embedding", out: str = "centroid") -> DataFrame:
    """H3, H4: (by, normalised mean): partial sums by position on the map side, a row for each group and position in the shuffle."""
    sums = vectors.select(by, F.posexplode(vec_col).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return sums.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p")).select(by, T.unit(F.transform("p", lambda x: x["m"])).alias(out))


def inertia(assigned: DataFrame) -> DataFrame:
    """H3: the sum of squared distances."""
    return assigned.agg(F.round(F.sum(F.pow("distance", F.lit(2.0))), 6).alias("inertia"))


def kmeans(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", max_iter: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """H1: (assignment, centroids) by MLlib's parallel k-means++ and Lloyd steps under cosine distance. k is at most the number of
    vectors; empty clusters aren't among the centroids."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    n = vectors.limit(k).count()
    if n == 0:
        return spark.createDataFrame([], "vec_id bigint, cluster int"), spark.createDataFrame([], "cluster int, centroid array<double>")
    points = vectors.select(F.col(id_col), array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    if n == 1:
        return points.select(id_col, F.lit(0).alias("cluster")), vectors.select(F.lit(0).alias("cluster"), T.unit(F.col(vec_col)).alias("centroid"))
    model = KMeans(k=min(k, n), maxIter=max_iter, seed=seed, tol=1e-6, distanceMeasure="cosine").fit(points)
    assigned = model.transform(points).select(id_col, F.col("prediction").alias("cluster"))
    centers = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centroid array<double>")
    return assigned, centers.join(assigned.select("cluster").distinct(), "cluster", "left_semi").withColumn("centroid", T.unit(F.col("centroid")))


def labels(clusters: DataFrame, by: str = "cluster", title_col: str = "title", url_col: str = "url") -> DataFrame:
    """(by, label): the two commonest title words, else the commonest host, else 'Uncategorized'."""
    words = clusters.select(by, F.explode(T.label_words(F.col(title_col))).alias("w")).groupBy(by, "w").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), "w")
    top = words.withColumn("r", F.row_number().over(w)).filter("r <= 2").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("r", T.title_case(F.col("w")).alias("w")))).alias("ws"))
    hosts = clusters.select(by, urls.host(F.col(url_col)).alias("h")).filter("h <> ''").groupBy(by, "h").agg(F.count(F.lit(1)).alias("n"))
    host = hosts.groupBy(by).agg(F.min_by("h", F.struct((-F.col("n")).alias("n"), "h")).alias("h"))
    out = clusters.select(by).distinct().join(top, by, "left").join(host, by, "left")
    return out.select(by, F.coalesce(F.array_join(F.transform("ws", lambda x: x["w"]), " "), "h", F.lit("Uncategorized")).alias("label"))


def cluster_documents(wanted: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """H5: (documents with cluster and label, unmatched URLs): wanted(url) are looked up, documents are the means of their chunks' vectors;
    at most one document makes a single cluster."""
    docs = chunks.filter("url IS NOT NULL").select("url", "document_id", "title", "chunk_id").join(wanted.select("url").distinct(), "url", "left_semi")
    vecs = docs.join(vectors, "chunk_id")
    unmatched = wanted.select("url").distinct().join(vecs.select("url").distinct(), "url", "left_anti")
    per_doc = mean_vectors(vecs, "document_id", out="embedding")
    assigned, _ = kmeans(per_doc, k, "document_id")
    info = vecs.groupBy("document_id").agg(F.min("url").alias("url"), F.min("title").alias("title"))
    out = info.join(assigned, "document_id").withColumn("cluster", F.concat(F.lit("cluster_"), F.col("cluster").cast("string")))
    return out.join(labels(out), "cluster"), unmatched
