"""Hard negatives in score windows by a vertical scan of the dimensions (BOND)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import mapped, stored
from .vectors import array_of, best_rows, common_size, exact_type, floored, matrix, met, packs, seeds, slots_for

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative scores between these hundredths of the positive's score.
LOW, HIGH = 50, 95
#: Rows of the bounded sample that first limits are taken from; results never depend on it.
SAMPLE = 4096
#: Rows in a pack of columns and of anchors, and dimensions that are read between two cuts of the bitmap.
COLUMN_PACK, ANCHOR_PACK, STEP = 4096, 256, 8


def vertical_scan(columns: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, alive: np.ndarray, least: float, most: float, k: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of the bitmap alive whose inner product with the anchor lies in least .. most, their products, and numbers read.

    columns: one row a dimension, low and high its least and greatest entry. Dimensions are read in falling magnitude of
    the anchor. What the rest can still add, at least and at most, follows from low and high; rows that cannot reach the
    window leave the bitmap. With k, the k-th best of the sums that are certain raises least.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    weights = anchor[order]
    ends = np.stack([weights * low[order], weights * high[order]])
    rest_low, rest_high = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (ends.min(0), ends.max(0)))
    rows = np.flatnonzero(alive)
    sums, read = np.zeros(len(rows), columns.dtype), 0
    for at in range(0, len(order), STEP):
        dims, end = order[at : at + STEP], min(at + STEP, len(order))
        block = columns[dims] if len(rows) == columns.shape[1] else columns[dims[:, None], rows]
        sums, read = sums + weights[at:end] @ block, read + block.size
        if k and len(rows) > k:
            least = max(least, np.partition(sums, -k)[-k] + rest_low[end])
        keep = (sums + rest_high[end] >= least) & (sums + rest_low[end] <= most)
        if not keep.all():
            rows, sums = rows[keep], sums[keep]
        if not len(rows):
            break
    return rows, sums.astype(np.int64), read


def hard_negatives(vectors: DataFrame, is_anchor, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors that is_anchor chooses.

    An anchor's positives are the rows of its label with the highest inner products; for each, the best rows of other
    labels that score 50 to 95 hundredths of it. Entries count as floor(256 x); ties go to the smaller id.

    Two scans over packs of columns: the first for positives, whose scores set the windows of the second. In a slot an
    anchor keeps the best rows of each window so far, which close the window from below; slots are compared at the end.

    Rows without id, label or vector, with null or non-finite entries or of another length than the commonest take no
    part. An anchor's own rows are those with its id. Repeated rows count one by one; anchors equal in id, label and
    vector are one. Other columns are read by is_anchor only. An empty table gives no rows; an entry of 2**23 and more
    is an error. A label that most rows have only makes the first scan longer: packs are dealt without regard to labels.
    """
    spark = vectors.sparkSession
    taken = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    n, size = common_size(taken, vec_col)
    rows = taken.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asked"))
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sample = seeds(rows, ["id", "label", "vector"], "id", "vector", size, SAMPLE)
    held = spark.sparkContext.broadcast(_sample(sample, size))  # at most SAMPLE vectors
    slots = slots_for(rows, n, COLUMN_PACK)

    def read(batch: pa.RecordBatch) -> list[np.ndarray]:
        at, found = matrix(batch.column("vector"), size)
        return [batch.column("id").to_numpy()[at], batch.column("label").to_numpy()[at], floored(found, SCALE, 2**31)]

    def as_columns(ids: np.ndarray, labels: np.ndarray, whole: np.ndarray) -> list[np.ndarray]:
        return [ids, labels, whole.astype(np.int32).T]

    columns = packs(rows.select("id", "label", "vector"), read, as_columns, COLUMN_PACK, slots, ["ids", "labels", "columns"])
    one = F.row_number().over(Window.partitionBy("id", "label", "hash").orderBy("vector"))
    anchors = rows.where("asked").withColumn("hash", F.xxhash64("vector")).dropDuplicates(["id", "label", "hash", "vector"])
    anchors = stored(anchors.select("id", "label", "vector", "hash", one.alias("twin")), "anchors")

    first = anchors.withColumn("windows", F.array(F.struct(F.lit(0).alias("place"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))))
    found = _scan(first, columns, held, size, slots, positives, True).withColumnsRenamed({"row_id": "positive_id", "score": "positive_score"})
    key = ["id", "label", "hash", "twin"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("positive_score"), "positive_id"))
    best = stored(found.withColumn("place", place).where(F.col("place") <= positives).select(*key, "place", "positive_id", "positive_score"), "positives")

    window = F.struct("place", F.expr(f"(positive_score * {LOW} + 99) div 100").alias("low"), F.expr(f"positive_score * {HIGH} div 100").alias("high"))
    windows = best.where("positive_score >= 0").groupBy(*key).agg(F.collect_list(window).alias("windows"))  # as many as positives
    second = _scan(anchors.join(windows, key), columns, held, size, slots, negatives, False).withColumnsRenamed({"row_id": "negative_id", "score": "negative_score"})
    rank = F.row_number().over(Window.partitionBy(*key, "place").orderBy(F.desc("negative_score"), "negative_id"))
    kept = second.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return kept.join(best, [*key, "place"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _sample(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, size), np.int64)
    at, found = matrix(table.column(2).combine_chunks(), size)
    return table.column(0).to_numpy()[at], table.column(1).to_numpy()[at], floored(found, SCALE, 2**31)


def _scan(anchors: DataFrame, columns: DataFrame, sample, size: int, slots: int, k: int, same_label: bool) -> DataFrame:
    """(id, label, hash, twin, place, row_id, score): at least the k best rows of each window of each anchor, k a slot at most."""
    edge = float("inf")

    def read(batch: pa.RecordBatch) -> list[np.ndarray]:
        at, found = matrix(batch.column("vector"), size)
        windows = np.empty(len(at), object)
        for i, w in enumerate(batch.column("windows").take(pa.array(at)).to_pylist()):
            windows[i] = [(x["place"], -edge if x["low"] is None else x["low"], edge if x["high"] is None else x["high"]) for x in w]
        return [batch.column("id").to_numpy()[at], floored(found, SCALE, 2**31), *(batch.column(c).to_numpy()[at] for c in ("label", "hash", "twin")), windows]

    def with_limits(ids, whole, labels, hashes, twins, windows) -> list[np.ndarray]:
        known, known_labels, known_rows = sample.value
        kind = exact_type(whole, known_rows)
        scores = (whole.astype(kind) @ known_rows.astype(kind).T).astype(float)
        scores[(ids[:, None] == known) | ((labels[:, None] == known_labels) != same_label)] = -edge
        flat = []
        for i, mine in enumerate(windows):
            for place, low, high in mine:  # k sampled rows reach the limit, so no row under it is wanted
                inside = np.sort(scores[i][(scores[i] >= low) & (scores[i] <= high) & (scores[i] > -edge)])
                flat.append((i, place, max(low, inside[-k]) if len(inside) >= k else low, high))
        return [ids, whole.astype(np.int32), labels, hashes, twins.astype(np.int64), np.array(flat, np.float64)]

    names = ["ids", "whole", "labels", "hashes", "twins", "windows"]
    q = packs(anchors.select("id", "vector", "label", "hash", "twin", "windows").sortWithinPartitions("id", "label", "hash", "twin"), read, with_limits, ANCHOR_PACK, slots, names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_pack, state, best = None, None, []
        for batch in batches:
            for row in range(batch.num_rows):
                number = batch.column("q_pack")[row].as_py()
                if number != held_pack:
                    if held_pack is not None:
                        yield _rows(state, best)
                    m = batch.column("q_n")[row].as_py()
                    shapes = ((np.int64, (m,)), (np.int32, (m, size)), (np.int64, (m,)), (np.int64, (m,)), (np.int64, (m,)), (np.float64, (-1, 4)))
                    state = [array_of(batch, f"q_{x}", row, kind, *shape).copy() for x, (kind, shape) in zip(names, shapes)]
                    held_pack, best = number, [(np.zeros(0, np.int64),) * 2] * len(state[5])
                    spans = np.searchsorted(state[5][:, 0], np.arange(m + 1))
                ids, whole, labels, _, _, windows = state
                count = batch.column("n")[row].as_py()
                row_ids, row_labels = (array_of(batch, x, row, np.int64, count) for x in ("ids", "labels"))
                packed = array_of(batch, "columns", row, np.int32, size, count)
                kind = exact_type(whole, packed.T)
                cols, a = packed.astype(kind), whole.astype(kind)
                low, high = cols.min(1), cols.max(1)
                for i in range(len(ids)):
                    mine = range(spans[i], spans[i + 1])
                    least = [max(windows[w, 2], best[w][0][-1]) if len(best[w][0]) == k else windows[w, 2] for w in mine]
                    alive = ((row_labels == labels[i]) == same_label) & (row_ids != ids[i])
                    rows, sums, _ = vertical_scan(cols, low, high, a[i], alive, min(least), windows[spans[i] : spans[i + 1], 3].max(), k * same_label)
                    for w, bottom in zip(mine, least):
                        good = (sums >= bottom) & (sums <= windows[w, 3])
                        if good.any():
                            s, f = np.concatenate([best[w][0], sums[good]]), np.concatenate([best[w][1], row_ids[rows[good]]])
                            keep = best_rows(s, f, k)
                            best[w] = s[keep], f[keep]
        if held_pack is not None:
            yield _rows(state, best)

    found = mapped(met(q, columns, slots), scan, "id long, label long, hash long, twin int, place int, scores array<long>, rows array<long>")
    pairs = F.explode(F.arrays_zip(F.col("rows").alias("row_id"), F.col("scores").alias("score")))
    return found.select("id", "label", "hash", "twin", "place", pairs.alias("x")).select("id", "label", "hash", "twin", "place", "x.*")


def _rows(state: list[np.ndarray], best: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ids, _, labels, hashes, twins, windows = state
    at, longs = windows[:, 0].astype(int), pa.list_(pa.int64())
    arrays = [pa.array(ids[at]), pa.array(labels[at]), pa.array(hashes[at]), pa.array(twins[at].astype(np.int32)), pa.array(windows[:, 1].astype(np.int32)), pa.array([s for s, _ in best], longs), pa.array([f for _, f in best], longs)]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "label", "hash", "twin", "place", "scores", "rows"])
