"""Exact top-k inner products by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import mapped
from .vectors import array_of, best_rows, common_size, exact_type, floored, matrix, met, packs, seeds, slots_for

SCALE, TOP = 256, 5
#: Rows of the bounded sample that pivots are chosen from and that first limits are taken from; results never depend on it.
SAMPLE, PIVOTS = 4096, 32
#: Rows in a pack of candidates and of queries, and how many candidates of the best bounds a query looks at first.
CANDIDATE_PACK, QUERY_PACK, FIRST = 4096, 512, 64
#: Bounds are widened by this share of the squared lengths, more than single-precision distances can be off.
SLACK = 1e-5


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each next pivot is the row whose nearest pivot is farthest."""
    if not len(sample):
        return sample
    rows = sample.astype(float)
    chosen, nearest = [0], ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(rows)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    a, b = rows.astype(float), pivots.astype(float)
    squared = (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0)).astype(np.float32)


def search_pack(query: np.ndarray, query_far: np.ndarray, limit: float, own: np.ndarray, rows: np.ndarray, norms: np.ndarray, far: np.ndarray, ids: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """The k best (scores, ids) of a query after a pack, and how many rows were evaluated.

    Of all pivots p the largest |d(query, p) - d(row, p)| is a lower bound of the distance of query and row, so
    (|query|^2 + |row|^2 - bound^2) / 2 is an upper bound of their inner product. Rows are evaluated in falling order of
    it until the next one is under the k-th score, or under limit, which k rows are known to reach.
    """
    gap = np.abs(far - query_far[:, None]).max(0) if len(far) else np.zeros(len(ids), np.float32)
    squared = float(query.astype(float) @ query.astype(float)) + norms
    bound = (squared - gap.astype(float) ** 2) / 2 + SLACK * squared + 1e-3
    scores, found = best
    least = max(limit, scores[-1]) if len(scores) == k else limit
    able = np.flatnonzero((bound >= least) & ~own)
    order, at, step = able[np.argsort(-bound[able], kind="stable")], 0, FIRST
    while at < len(order) and bound[order[at]] >= least:
        look = order[at : at + step]
        s = (rows[look] @ query).astype(np.int64)
        high = s >= least
        scores, found = np.concatenate([scores, s[high]]), np.concatenate([found, ids[look[high]]])
        keep = best_rows(scores, found, k)
        scores, found = scores[keep], found[keep]
        if len(scores) == k:
            least = max(least, scores[-1])
        at, step = at + step, 2 * step
    return (scores, found), min(at, len(order))


def top_k(vectors: DataFrame, is_query, k: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the highest inner product with each query, ties to the smaller id.

    is_query: a condition on the columns of vectors that chooses the stated query set. Entries count as floor(256 x), and
    scores are exact whole numbers. A pivot table holds the distance of every row to 32 pivots; packs of rows meet packs
    of queries in their slot, where each query keeps its k best so far, and only those of a slot are compared at the end.

    A query's own rows are those with its id; fewer candidates than k give fewer rows. Vectors that are null, hold null
    or non-finite entries or have another length than the commonest take no part, nor do rows without id. Repeated rows
    are candidates one by one; equal query rows (id and vector) are one query. Other columns are read by is_query only.
    An empty table gives no rows; an entry of 2**23 and more is an error.
    """
    return _searched(vectors, is_query, k, id_col, vec_col)[0]


def evaluated_share(vectors: DataFrame, is_query, k: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """The share of pairs of query and row whose inner product the search computes."""
    _, work = _searched(vectors, is_query, k, id_col, vec_col)
    done, pairs = work.agg(F.sum("evaluated"), F.sum("pairs")).first()
    return done / pairs


def _searched(vectors: DataFrame, is_query, k: int, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame | None]:
    spark = vectors.sparkSession
    n, size = common_size(vectors, vec_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked")).where("id is not null")
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"), None
    sample = seeds(rows, ["id", "vector"], "id", "vector", size, SAMPLE).combine_chunks()
    sample_ids, sample_rows = _read_table(sample, size)
    pivots = choose_pivots(sample_rows, PIVOTS)
    held = spark.sparkContext.broadcast((sample_ids, sample_rows, pivots))  # at most SAMPLE + PIVOTS vectors
    slots = slots_for(rows, n, CANDIDATE_PACK)

    def read(batch: pa.RecordBatch) -> list[np.ndarray]:
        at, found = matrix(batch.column(1), size)
        return [batch.column(0).to_numpy()[at], floored(found, SCALE, 2**31)]

    def read_query(batch: pa.RecordBatch) -> list[np.ndarray]:
        at, found = matrix(batch.column(1), size)
        return [batch.column(0).to_numpy()[at], floored(found, SCALE, 2**31), batch.column(2).to_numpy()[at]]

    def with_distances(ids: np.ndarray, whole: np.ndarray) -> list[np.ndarray]:
        return [ids, whole.astype(np.int32), distances(whole, held.value[2]).T]

    def with_limits(ids: np.ndarray, whole: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
        known, known_rows, points = held.value
        kind = exact_type(whole, known_rows)
        scores = (whole.astype(kind) @ known_rows.astype(kind).T).astype(float)
        scores[ids[:, None] == known] = -np.inf
        limits = np.sort(scores, 1)[:, -k] if len(known) >= k else np.full(len(ids), -np.inf)
        return [ids, whole.astype(np.int32), hashes, limits, distances(whole, points)]

    queries = rows.where("asked").select("id", "vector", F.xxhash64("vector").alias("hash")).dropDuplicates().sortWithinPartitions("id", "hash")
    q = packs(queries, read_query, with_limits, QUERY_PACK, slots, ["ids", "whole", "hashes", "limits", "far"])
    c = packs(rows.select("id", "vector"), read, with_distances, CANDIDATE_PACK, slots, ["ids", "whole", "far"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_pack, best, work, state = None, [], np.zeros(0), None
        for batch in batches:
            for row in range(batch.num_rows):
                number = batch.column("q_pack")[row].as_py()
                if number != held_pack:
                    if held_pack is not None:
                        yield _best(state, best, work)
                    m = batch.column("q_n")[row].as_py()
                    state = [array_of(batch, f"q_{x}", row, kind, *shape).copy() for x, kind, shape in (("ids", np.int64, (m,)), ("whole", np.int32, (m, size)), ("hashes", np.int64, (m,)), ("limits", np.float64, (m,)), ("far", np.float32, (m, -1)))]
                    held_pack, best, work = number, [(np.zeros(0, np.int64),) * 2] * m, np.zeros((m, 2), np.int64)
                ids, whole, _, limits, far = state
                count = batch.column("n")[row].as_py()
                row_ids, packed = array_of(batch, "ids", row, np.int64, count), array_of(batch, "whole", row, np.int32, count, size)
                row_far = array_of(batch, "far", row, np.float32, far.shape[1], count)
                norms, kind = (packed.astype(float) ** 2).sum(1), exact_type(whole, packed)
                a, b = whole.astype(kind), packed.astype(kind)
                for i in range(len(ids)):
                    best[i], looked = search_pack(a[i], far[i], limits[i], row_ids == ids[i], b, norms, row_far, row_ids, k, best[i])
                    work[i] += looked, count
        if held_pack is not None:
            yield _best(state, best, work)

    near = mapped(met(q, c, slots), search, "query_id long, hash long, ids array<long>, scores array<long>, evaluated long, pairs long")
    each = near.select("query_id", "hash", F.explode(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))).alias("x")).select("query_id", "hash", "x.*")
    rank = F.row_number().over(Window.partitionBy("query_id", "hash").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), near


def _read_table(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, size), np.int64)
    at, found = matrix(table.column(1).combine_chunks(), size)
    return table.column(0).to_numpy()[at], floored(found, SCALE, 2**31)


def _best(state: list[np.ndarray], best: list[tuple[np.ndarray, np.ndarray]], work: np.ndarray) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(state[0]), pa.array(state[2]), pa.array([f for _, f in best], longs), pa.array([s for s, _ in best], longs), pa.array(work[:, 0]), pa.array(work[:, 1])], names=["query_id", "hash", "ids", "scores", "evaluated", "pairs"])
