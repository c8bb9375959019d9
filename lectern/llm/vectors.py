"""Tables of vectors as matrices: which rows take part, whole-number scores, and packs of rows that meet pack by pack."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped


def common_size(df: DataFrame, column: str) -> tuple[int, int]:
    """(rows, length) of the commonest length, ties to the longer, among vectors without null and non-finite entries; (0, 0) if none."""
    whole = F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    best = df.where(whole).groupBy(F.size(column).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return (best["n"], best["size"]) if best and best["size"] else (0, 0)


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, rows x size doubles) of the vectors of this length without null and non-finite entries."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == size)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    values = flat.reshape(len(at), size)
    whole = np.isfinite(values).all(1)
    return at[whole], values[whole]


def floored(values: np.ndarray, scale: int, most: float) -> np.ndarray:
    """floor(scale * value) as whole numbers; an entry whose number reaches most has no exact score and is an error."""
    scaled = np.floor(values * scale)
    if scaled.size and np.abs(scaled).max() >= most:
        raise OverflowError(f"a vector entry times {scale} reaches {most}")
    return scaled.astype(np.int64)


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """The cheapest type in which inner products of the rows of a and b, and their parts, are exact."""
    bound = a.shape[-1] * (int(np.abs(a).max()) if a.size else 0) * (int(np.abs(b).max()) if b.size else 0)
    if bound >= 2**56:
        raise OverflowError("inner products over 2**56")
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def regrouped(batches: Iterator[pa.RecordBatch], read: Callable, rows: int) -> Iterator[list[np.ndarray]]:
    """Arrays of so many rows (fewer at the end) from Arrow batches of any size; read gives arrays of one length for a batch."""
    held, n = [], 0
    for batch in batches:
        part = read(batch)
        held.append(part)
        n += len(part[0])
        while n >= rows:
            joined = [np.concatenate(c) for c in zip(*held)]
            yield [c[:rows] for c in joined]
            held, n = [[c[rows:] for c in joined]], n - rows
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def packs(df: DataFrame, read: Callable, encode: Callable, rows: int, slots: int, names: list[str]) -> DataFrame:
    """One record for so many rows of a partition: (pack, slot, n, names ...), the named columns as bytes from encode.

    pack and slot follow from the place in the input: df has to have one order in its partitions (as read or sorted), so
    that a task that runs again gives the same packs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, arrays in enumerate(regrouped(batches, read, rows)):
            held = {"pack": [task << 32 | number], "slot": pa.array([(1009 * task + number) % slots], pa.int32()), "n": pa.array([len(arrays[0])], pa.int32())}
            yield pa.RecordBatch.from_pydict(held | {k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in zip(names, encode(*arrays))})

    return mapped(df, run, "pack long, slot int, n int, " + ", ".join(f"{x} binary" for x in names))


def met(queries: DataFrame, candidates: DataFrame, slots: int) -> DataFrame:
    """Each pack of the stated query set beside each pack of all rows: rows stay in their slot, query packs go to every slot.

    The join is by slot; what moves is the table once and the query set once a slot. All packs of a query pack follow each
    other. The number of partitions is stated, so that small tables are not put into one task.
    """
    q = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns if c != "slot"], F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    return q.repartition(slots, "slot").hint("merge").join(candidates.repartition(slots, "slot"), "slot").drop("slot")


def slots_for(df: DataFrame, n: int, rows: int) -> int:
    """Tasks that n rows in packs of so many are dealt to: two a core or as many as Spark shuffles to, no more than packs."""
    spark = df.sparkSession
    return max(1, min(-(-n // rows), max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def array_of(batch: pa.RecordBatch, name: str, row: int, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(batch.column(name)[row].as_buffer(), kind).reshape(*shape)


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def seeds(df: DataFrame, columns: list[str], id_col: str, vec_col: str, size: int, rows: int) -> pa.Table:
    """A bounded sample, the rows of least hash, for pivots and first limits. It decides what is looked at first, never a result."""
    chosen = df.where(F.size(vec_col) == size).orderBy(F.xxhash64(id_col, vec_col), id_col).select(*columns).limit(rows)
    return chosen.toArrow()
