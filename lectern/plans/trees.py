"""Digest trees over the vector stand-in and the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Views
from ..operators import tree as T
from ..operators.manifold import manifold
from ..registry import query


def texts(v: Views) -> DataFrame:
    """Vectors with a text each: that of the document with the same number, else a placeholder."""
    pages = v.documents.select(F.col("doc_id").alias("vec_id"), "text").dropDuplicates(["vec_id"])
    return v.vectors.join(pages, "vec_id", "left").withColumn("text", F.coalesce("text", F.lit("no text")))


@query("v6_reduced")
def v6(v: Views) -> DataFrame:
    return T.reduced(v.vectors).select("chunk_id", F.size("reduced").alias("n"), F.round(F.aggregate("reduced", F.lit(0.0), lambda s, x: s + x * x), 4).alias("energy"))


@query("v6_manifold")
def v6_manifold(v: Views) -> DataFrame:
    """Coordinates along the neighbour graph: how many there are, and how far from the middle."""
    made = manifold(v.vectors.select("namespace", "chunk_id", "embedding"), T.DIMENSIONS)
    return made.select("chunk_id", F.size("reduced").alias("n"), F.round(F.sqrt(F.aggregate("reduced", F.lit(0.0), lambda s, x: s + x * x)), 3).alias("far"))


@query("v7_clusters")
def v7(v: Views) -> DataFrame:
    return T.clusters(T.reduced(v.vectors))


@query("a10_level_stats")
def a10(v: Views) -> DataFrame:
    return T.level_stats(T.clusters(T.reduced(v.vectors)))


def _digests(v: Views) -> DataFrame:
    held = texts(v)
    return T.digests(held.join(T.clusters(T.reduced(held)), ["namespace", "chunk_id"]))


@query("v8_digests")
def v8(v: Views) -> DataFrame:
    return _digests(v).select("namespace", "cluster", "cluster_size", F.length("text").alias("n_chars"))


@query("v9_nodes")
def v9(v: Views) -> DataFrame:
    from ..functions.chunking import excerpt, node_id
    from ..operators.retrieval import embed

    nodes = embed(_digests(v).withColumn("chunk_id", node_id(F.lit(1), F.col("cluster"), F.col("namespace"))))
    return nodes.select("chunk_id", F.lit(1).alias("raptor_level"), "cluster_size", F.size("source_chunk_ids").alias("n_sources"), F.length(excerpt(F.col("text"))).alias("n_excerpt"))


@query("v10_tree")
def v10(v: Views) -> DataFrame:
    return T.build_tree(texts(v).select("namespace", "chunk_id", "text", "embedding")).groupBy("namespace", "raptor_level").agg(F.count("*").alias("nodes"), F.sum("cluster_size").alias("members"))
