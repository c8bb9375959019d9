"""Hierarchical digests: reduce, cluster by a mixture model chosen by BIC, digest, embed again, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.chunking import node_id
from ..storage import stored
from .hooks import hooked
from .mixture import assign, fit_mixtures
from .retrieval import cosine, embed, unit

DIMENSIONS, MAX_LEVELS, MIN_MEMBERS = 10, 3, 2
JOINER, MAX_DIGEST, MAX_SOURCES = "\n\n---\n\n", 30_000, 50
NODE_FEATURES = 128  # of digest vectors: principal components are taken of them again


def reduced(vectors: DataFrame, k: int = DIMENSIONS) -> DataFrame:
    """Adds reduced: principal components of the unit vectors."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    held = vectors.withColumn("unit_vector", array_to_vector(unit(F.col("embedding"))))
    made = PCA(k=k, inputCol="unit_vector", outputCol="components").fit(held).transform(held)
    return made.withColumn("reduced", vector_to_array("components")).drop("unit_vector", "components")


def clusters(vectors: DataFrame) -> DataFrame:
    """vectors (namespace, chunk_id, reduced) -> (namespace, chunk_id, cluster), by a mixture of each namespace over all its rows."""
    models = stored(fit_mixtures(vectors, "namespace", "chunk_id", "reduced"), "mixtures")
    return assign(vectors, models, "namespace", "chunk_id", "reduced")


def digests(members: DataFrame, summarise=None, hook=None) -> DataFrame:
    """members (namespace, cluster, chunk_id, text, embedding) -> one digest per cluster of two or more.

    Extractive: members nearest the centroid first, joined up to the cap; only those that fit are gathered.
    summarise: optional pandas UDF from the joined text to a digest. hook: a function of a Series of joined texts; where
    it fails the extract stands, and text_by says which it is (see hooks.hooked).
    """
    terms = members.select("namespace", "cluster", F.posexplode("embedding").alias("i", "x")).groupBy("namespace", "cluster", "i").agg(F.avg("x").alias("x"))
    centroid = terms.groupBy("namespace", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("centre"))
    sizes = members.groupBy("namespace", "cluster").agg(F.count("*").alias("cluster_size")).where(F.col("cluster_size") >= MIN_MEMBERS)
    near = members.join(centroid, ["namespace", "cluster"]).join(sizes, ["namespace", "cluster"]).withColumn("near", F.coalesce(F.round(cosine(F.col("embedding"), F.col("centre")), 9), F.lit(0.0)))
    order = Window.partitionBy("namespace", "cluster").orderBy(F.desc("near"), "chunk_id")
    # Each member adds a joiner at least, so no more than these fit: the rank limit holds before the shuffle, and running lengths are over few rows.
    nearest = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(MAX_SOURCES, MAX_DIGEST // len(JOINER) + 1))
    so_far = F.sum(F.length("text") + len(JOINER)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("text") - len(JOINER)
    placed = nearest.withColumn("before", so_far).where((F.col("before") < MAX_DIGEST) | (F.col("place") <= MAX_SOURCES))
    packed = placed.groupBy("namespace", "cluster").agg(F.first("cluster_size").alias("cluster_size"), F.array_sort(F.collect_list(F.struct("place", F.when(F.col("before") < MAX_DIGEST, F.col("text")).alias("text"), "chunk_id"))).alias("m"))
    text = F.substring(F.array_join(F.transform("m", lambda z: z["text"]), JOINER), 1, MAX_DIGEST)
    made = packed.select("namespace", "cluster", "cluster_size", (summarise(text) if summarise else text).alias("text"), F.slice(F.transform("m", lambda z: z["chunk_id"]), 1, MAX_SOURCES).alias("source_chunk_ids"))
    if hook is None:
        return made
    return hooked(made, "digest", "string", F.col("text"), hook, ["text"]).drop("text").withColumnsRenamed({"digest": "text", "digest_by": "text_by"})


def level_stats(assigned: DataFrame) -> DataFrame:
    """Per namespace: vectors, clusters, clusters of two or more."""
    per = assigned.groupBy("namespace", "cluster").agg(F.count("*").alias("n"))
    return per.groupBy("namespace").agg(F.sum("n").alias("vectors"), F.count("*").alias("clusters"), F.count_if(F.col("n") >= MIN_MEMBERS).alias("summaries"))


def build_tree(leaves: DataFrame, levels: int = MAX_LEVELS, summarise=None, reduce=reduced, hook=None) -> DataFrame:
    """leaves (namespace, chunk_id, text, embedding) -> all digest nodes, level by level over all namespaces at once.

    Stops when fewer than two digests come out of a level. reduce: principal components, or manifold.manifold.
    """
    current, nodes = leaves, None
    for level in range(1, levels + 1):
        groups = clusters(reduce(current, min(DIMENSIONS, len(current.select("embedding").first()[0]))))
        made = digests(current.join(groups, ["namespace", "chunk_id"]), summarise, hook)
        made = made.withColumn("chunk_id", node_id(F.lit(level), F.col("cluster"), F.col("namespace"))).withColumn("raptor_level", F.lit(level))
        made = stored(made, f"digests-{level}")
        n = made.limit(2).count()
        if n:
            made = stored(embed(made, features=NODE_FEATURES), f"tree-{level}")
        elif nodes is None:
            return made.withColumn("embedding", F.array().cast("array<float>"))
        else:
            break
        nodes = made if nodes is None else nodes.unionByName(made)
        if n < 2:
            break
        current = made.select("namespace", "chunk_id", "text", "embedding")
    return nodes
