"""Dimension reduction along a neighbour graph: spectral coordinates by power iteration, in one task or over the cluster."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Files, shared_folder, stored
from .retrieval import approximate_top_k, build_index
from .shards import dealt, give_back

NEIGHBOURS = 15
#: Vectors carried besides the wanted ones, times the graph is applied between two orthogonalisations, and how many of these there are.
SPARE, STEPS, TURNS = 3, 6, 10
#: Namespaces up to this size are iterated in one task (about 25 edges a row: a few hundred MB); larger ones in blocks of about
#: as many rows, which send each other their rows' numbers in each of TURNS * STEPS steps. Both do the same.
TASK_ROWS = 50_000
SEPARATOR = "\u0001"


def neighbour_graph(vectors: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(namespace, src, dst, weight), both ways: each vector with the nearest of its namespace.

    Neighbours come from the vector index. A weight falls with the squared distance, in units of how far the farthest
    neighbour of either end is, so that sparse and dense regions weigh alike; of two weights of a pair the larger stays.
    """
    named = vectors.where("embedding is not null").withColumn("chunk_id", F.concat_ws(SEPARATOR, "namespace", "chunk_id"))
    found = approximate_top_k(named.select("namespace", F.col("chunk_id").alias("query_id"), "embedding"), build_index(named), neighbours + 1)
    far = F.greatest(2 - 2 * F.col("score"), F.lit(0.0))
    pairs = stored(found.where("query_id <> chunk_id").select(F.col("query_id").alias("src"), F.col("chunk_id").alias("dst"), far.alias("far")), "neighbours")
    reach = pairs.groupBy("src").agg(F.greatest(F.max("far"), F.lit(1e-9)).alias("reach"))
    both = pairs.join(reach, "src").join(reach.withColumnsRenamed({"src": "dst", "reach": "other"}), "dst")
    weighed = both.withColumn("weight", F.exp(-F.col("far") / F.sqrt(F.col("reach") * F.col("other"))))
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    edges = weighed.select("weight", ends).groupBy("e.src", "e.dst").agg(F.max("weight").alias("weight"))
    degree = edges.groupBy("src").agg(F.sum("weight").alias("degree"))
    scaled = edges.join(degree, "src").join(degree.withColumnsRenamed({"src": "dst", "degree": "dst_degree"}), "dst")
    part = lambda c, i: F.split_part(c, F.lit(SEPARATOR), F.lit(i))
    return scaled.select(part(F.col("src"), 1).alias("namespace"), part(F.col("src"), 2).alias("src"), part(F.col("dst"), 2).alias("dst"), "degree", (F.col("weight") / F.sqrt(F.col("degree") * F.col("dst_degree"))).alias("weight"))


def orthogonal(gram: np.ndarray) -> np.ndarray:
    """T with X T orthonormal, where gram = X' X; directions that X has lost come out as zero."""
    values, axes = np.linalg.eigh(gram)
    return axes * np.where(values > 1e-12 * max(values[-1], 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0)


def ordered(product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, T) of the Rayleigh quotients X' B X."""
    values, axes = np.linalg.eigh((product + product.T) / 2)
    return values[::-1], axes[:, ::-1]


def _start(key: Column, m: int) -> list[Column]:
    """m numbers of a row by hash, the same however rows are dealt."""
    return [((F.pmod(F.xxhash64(key, F.lit(j)), F.lit(1 << 30)) / (1 << 29)) - 1).alias(f"x{j}") for j in range(m)]


def spectral_task(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the leading part of (A + I) / 2 for the edges of a graph, from the start x."""
    apply = lambda y: 0.5 * (y + np.stack([np.bincount(src, weight * c[dst], len(y)) for c in y.T], 1))
    for _ in range(TURNS):
        for _ in range(STEPS):
            x = apply(x)
        x = x @ orthogonal(x.T @ x)
    values, turn = ordered(x.T @ apply(x))
    return values, x @ turn


def coordinates(vectors: np.ndarray, values: np.ndarray, degree: np.ndarray, volume: float | np.ndarray, k: int) -> np.ndarray:
    """Diffusion coordinates without the constant one: eigenvectors of the random walk, each times its eigenvalue. volume: all degrees of the graph."""
    walk = vectors[:, 1 : k + 1] / np.sqrt(degree)[:, None] * np.sqrt(np.reshape(volume, (-1, 1)))
    return walk * np.maximum(2 * values[1 : k + 1] - 1, 0)


def manifold(vectors: DataFrame, k: int, neighbours: int = NEIGHBOURS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Adds reduced: k coordinates along the neighbour graph of the namespace, in which near vectors stay near.

    vectors: (namespace, chunk_id, embedding, ...), chunk_id unique in a namespace. The coordinates are the
    leading eigenvectors of the graph's random walk, by power iteration with orthogonalisation. A vector without
    neighbours (alone in its namespace, or null) is at zero.
    """
    edges = stored(neighbour_graph(vectors, neighbours), "graph")
    nodes = stored(edges.groupBy("namespace", F.col("src").alias("chunk_id")).agg(F.first("degree").alias("degree")), "graph-nodes")
    m = k + 1 + SPARE
    sizes = stored(nodes.groupBy("namespace").agg(F.count("*").alias("n")), "graph-sizes")
    small = sizes.where(F.col("n") <= task_rows).select("namespace")
    large = sizes.where(F.col("n") > task_rows).select("namespace", F.ceil(F.col("n") / task_rows).cast("int").alias("blocks"))
    schema = "namespace string, chunk_id string, reduced array<double>"

    def one(mine: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("chunk_id")
        place = pd.Series(np.arange(len(mine)), mine["chunk_id"])
        x = mine[[f"x{j}" for j in range(m)]].to_numpy(float)
        values, found = spectral_task(place[graph["src"]].to_numpy(), place[graph["dst"]].to_numpy(), graph["weight"].to_numpy(), x)
        reduced = coordinates(found, values, mine["degree"].to_numpy(), mine["degree"].sum(), k)
        give_back()
        return mine[["namespace", "chunk_id"]].assign(reduced=list(np.pad(reduced, ((0, 0), (0, k - reduced.shape[1])))))

    started = nodes.select("namespace", "chunk_id", "degree", *_start(F.col("chunk_id"), m))
    done = started.join(small, "namespace").groupBy("namespace").cogroup(edges.join(small, "namespace").groupBy("namespace")).applyInPandas(one, schema)
    if large.limit(1).count():
        done = done.unionByName(_spectral_jobs(started.join(large, "namespace"), edges.join(large.select("namespace"), "namespace"), large, k, m))
    out = vectors.join(done.withColumnsRenamed({"namespace": "of", "chunk_id": "reduced_id"}), (F.col("namespace") == F.col("of")) & (F.col("chunk_id") == F.col("reduced_id")), "left").drop("of", "reduced_id")
    return out.withColumn("reduced", F.coalesce("reduced", F.array_repeat(F.lit(0.0), k)))


#: Place of a block in the number of a row (block, place in it), and the number of what is no row: sums of a block, or how all rows are turned.
BLOCK_BITS, NO_ROW = 32, -1
MESSAGE = "namespace string, to int, row long, x array<double>"


def _numbers(column: pa.ChunkedArray, wide: int) -> np.ndarray:
    """Arrays of one length as rows of numbers."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)


def _messages(namespace: str, to: np.ndarray, row: np.ndarray, x: np.ndarray) -> pa.Table:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x, float).ravel()))
    return pa.table({"namespace": pa.array([namespace] * len(x), pa.string()), "to": pa.array(to, pa.int32()), "row": pa.array(row, pa.int64()), "x": lists})


def _received(sent: pa.Table, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(row numbers rising, their x, what came as no row) of the messages to a block."""
    row = sent["row"].to_numpy()
    is_row = row != NO_ROW
    x, rest = _numbers(sent.filter(pa.array(is_row))["x"], m), sent.filter(pa.array(~is_row))["x"]
    order = np.argsort(row[is_row])
    return row[is_row][order], x[order], np.asarray(rest[0].as_py()) if len(rest) else None


def _block_step(m: int, sums: bool, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(graph of a block's rows, messages to it) -> messages: (A + I) / 2 applied to what came, to each block with a neighbour of a row.

    With sums, X' X besides, to no block. In the last step the rows stay as they were turned, for their own block alone, and the sums are X' B X.
    """
    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _messages("", np.zeros(0, int), np.zeros(0, int), np.zeros((0, m)))
        namespace, own = rows["namespace"][0].as_py(), rows["row"].to_numpy()
        row, x, turn = _received(sent, m)
        if turn is not None:
            x = x @ turn.reshape(m, m)
        ends, weight = rows["ends"].combine_chunks(), rows["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        src = np.repeat(np.arange(len(own), dtype=np.int32), ends.value_lengths().to_numpy(zero_copy_only=False))
        ends = ends.flatten().to_numpy(zero_copy_only=False)
        at = np.searchsorted(row, ends).astype(np.int32)
        mine = x[np.searchsorted(row, own)]
        y = 0.5 * (mine + np.stack([np.bincount(src, weight * c[at], len(own)) for c in np.ascontiguousarray(x.T)], 1))
        block = int(own[0] >> BLOCK_BITS)
        if last:
            out = [_messages(namespace, np.full(len(own), block), own, mine)]
        else:
            to = np.unique(np.concatenate([src.astype(np.int64) << BLOCK_BITS | ends >> BLOCK_BITS, np.arange(len(own)) << BLOCK_BITS | block]))
            of = to >> BLOCK_BITS
            out = [_messages(namespace, to & ((1 << BLOCK_BITS) - 1), own[of], y[of])]
        if sums or last:
            out.append(_messages(namespace, np.array([NO_ROW]), np.array([NO_ROW]), ((mine if last else y).T @ y).reshape(1, -1)))
            give_back()
        return pa.concat_tables(out)

    return run


def _spectral_jobs(started: DataFrame, edges: DataFrame, large: DataFrame, k: int, m: int) -> DataFrame:
    """The same iteration by blocks of a namespace's rows, dealt by hash.

    A block has the edges of its rows as arrays. In a step it gets the numbers of its rows' neighbours, once each, and sends those of
    its own rows to the blocks that hold a neighbour: a task has about 25 edges and at most as many messages a row of its block, however
    many rows the namespace has. Sums a namespace are m x m numbers. large: (namespace, blocks).
    """
    spark = started.sparkSession
    folder, files = shared_folder(spark, "spectral"), Files(spark, shared_folder(spark, "x"))
    block = F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int")
    place = F.row_number().over(Window.partitionBy("namespace", "block").orderBy("chunk_id")) - 1
    number = F.shiftleft(F.col("block").cast("long"), BLOCK_BITS) + place
    named = stored(started.withColumn("block", block).withColumn("row", number), "graph-rows")
    ends = named.select("namespace", F.col("chunk_id").alias("dst"), F.col("row").alias("end"))
    lists = edges.join(ends, ["namespace", "dst"]).groupBy("namespace", F.col("src").alias("chunk_id")).agg(F.collect_list(F.struct("end", "weight")).alias("e"))
    graph = stored(named.select("namespace", "chunk_id", "block", "row").join(lists, ["namespace", "chunk_id"]).select("namespace", "block", "row", F.col("e.end").alias("ends"), F.col("e.weight").alias("weights")), "graph-blocks")

    def met(rows: DataFrame, sent: DataFrame, run, schema: str) -> DataFrame:
        rows, sent = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (rows, sent))  # own names: both sides may come of one table
        return dealt(rows, "namespace", "block").groupBy("namespace", "block").cogroup(dealt(sent, "namespace", "to").groupBy("namespace", "to")).applyInArrow(run, schema)

    def turned(sent: DataFrame, turn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """The rows' messages, and to each block of a namespace what comes of its sums."""
        def make(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"namespace": [rows["namespace"].iloc[0]], "x": [turn(np.sum(np.stack(rows["x"].to_numpy()), 0).reshape(m, m)).ravel().tolist()]})

        turns = sent.where(F.col("to") == NO_ROW).groupBy("namespace").applyInPandas(make, "namespace string, x array<double>")
        told = turns.join(large, "namespace").select("namespace", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"), F.lit(NO_ROW).cast("long").alias("row"), "x")
        return sent.where(F.col("to") != NO_ROW).unionByName(told)

    def written(sent: DataFrame, what: str) -> DataFrame:
        sent.write.parquet(f"{folder}/{what}")
        return spark.read.schema(MESSAGE).parquet(f"{folder}/{what}")

    near = F.array_distinct(F.transform("ends", lambda e: F.shiftright(e, BLOCK_BITS).cast("int")))
    first = graph.select("namespace", "row", F.explode(F.array_union(near, F.array("block"))).alias("to"))
    x = first.join(named.select("namespace", "row", F.array(*[F.col(f"x{j}") for j in range(m)]).alias("x")), ["namespace", "row"]).select("namespace", "to", "row", "x")
    for turn in range(TURNS):
        for step in range(STEPS):
            x = met(graph, x, _block_step(m, step == STEPS - 1, False), MESSAGE)
        x = turned(written(x, f"{turn}"), orthogonal)
        if turn:
            files.delete(f"{folder}/{turn - 1}")
    ritz = turned(written(met(graph, x, _block_step(m, False, True), MESSAGE), "ritz"), lambda g: np.vstack(ordered(g)))
    files.delete(f"{folder}/{TURNS - 1}")

    def finish(mine: pa.Table, sent: pa.Table) -> pa.Table:
        row, x, told = _received(sent, m)
        values, turn = told[:m], told[m:].reshape(m, m)
        at = np.searchsorted(row, mine["row"].to_numpy())
        reduced = coordinates(x[at] @ turn, values, mine["degree"].to_numpy(), mine["volume"].to_numpy(), k)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * k), pa.array(reduced.ravel()))
        return pa.table({"namespace": mine["namespace"], "chunk_id": mine["chunk_id"], "reduced": lists})

    whole = started.groupBy("namespace").agg(F.sum("degree").alias("volume"))
    mine = named.select("namespace", "chunk_id", "block", "row", "degree").join(whole, "namespace")
    return met(mine, ritz, finish, "namespace string, chunk_id string, reduced array<double>")
