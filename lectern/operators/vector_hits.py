"""The best vectors of a shard for all queries of a block at once: pairs are scored in memory and never become rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs whose scores are in memory at once.
PAIRS = 2_000_000


def by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (row numbers, rows x length doubles) of the vectors that are not null; a null entry is NaN."""
    column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == size)
        out[int(size)] = at, column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), size)
    return out


def lowest(keys: np.ndarray, k: int, tie: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least keys of each row, in order; ties by tie of the column, or by the column."""
    if keys.shape[1] > k:
        some = keys[:, ::8] if keys.shape[1] > 64 * k else keys  # the k-th of some keys is no less than that of all
        cut = np.partition(some, k - 1, axis=1)[:, k - 1]
        row, column = np.divmod(np.flatnonzero(keys <= cut[:, None]), keys.shape[1])
    else:
        row, column = (x.ravel() for x in np.indices(keys.shape))
    order = np.lexsort((column if tie is None else tie[column], keys[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, np.arange(len(keys)))
    few = np.arange(len(row)) - first[row] < k
    return row[few], column[few]


def best_products(queries: pa.ChunkedArray, vectors: pa.ChunkedArray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(query, vector, product) of the k largest rounded inner products of each query, ties by place of the vector.

    As in Spark, NaN comes before all numbers; a pair of null or of different lengths has no product and comes last.
    """
    asked, held, n = by_length(queries), by_length(vectors), len(vectors)
    of, at, keys = [], [], []
    step = max(1, PAIRS // max(1, n))
    for i in range(0, len(queries), step):
        key = np.full((min(step, len(queries) - i), n), np.inf)
        for size in asked.keys() & held.keys():
            rows, q = asked[size]
            some = slice(*np.searchsorted(rows, (i, i + len(key))))
            product = np.round(q[some] @ held[size][1].T, digits)
            key[np.ix_(rows[some] - i, held[size][0])] = np.where(np.isnan(product), -np.inf, -product)
        row, column = lowest(key, k)
        of.append(row + i), at.append(column), keys.append(key[row, column])
    if not of:
        return np.zeros(0, int), np.zeros(0, int), pa.array([], pa.float64())
    score = -np.concatenate(keys)
    return np.concatenate(of), np.concatenate(at), pa.array(np.where(score == np.inf, np.nan, score), mask=score == -np.inf)


def entries(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of one length as they are, the length of each in double, 1 where there is none); those with a null entry are zero."""
    column = column.combine_chunks()
    flat = column.flatten()
    x = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(column), -1)
    if flat.null_count:
        x = np.where(flat.is_null().to_numpy(zero_copy_only=False).reshape(x.shape).any(1)[:, None], 0, x)
    length = np.ones(len(x))
    for i in range(0, len(x), UNIT_ROWS):
        length[i : i + UNIT_ROWS] = np.sqrt(np.cumsum(np.square(x[i : i + UNIT_ROWS], dtype=float), axis=1)[:, -1])
    return x, np.where(length == 0, 1.0, length)


def _words(column: pa.ChunkedArray) -> np.ndarray:
    """Sketches: one row of numbers for each place in them."""
    column = column.combine_chunks()
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(column), -1).T)


#: Pairs whose sketches are in memory at once, pairs that are compared at a time, more than any two differ by, and vectors measured at a time.
SKETCH_PAIRS, TILE_PAIRS, FAR, UNIT_ROWS = 2_000_000, 200_000, 1 << 14, 10_000


def differing(asked: np.ndarray, held: np.ndarray, differ: np.ndarray) -> None:
    """Adds to differ how many bits of each two sketches differ, a tile of pairs at a time."""
    wide = max(1, TILE_PAIRS // max(1, asked.shape[1]))
    for i in range(0, held.shape[1], wide):
        tile = differ[:, i : i + wide]
        for j in range(0, len(asked), 3):  # three numbers have under 256 bits
            bits = np.bitwise_count(asked[j][:, None] ^ held[j][None, i : i + wide])
            for a, b in zip(asked[j + 1 : j + 3], held[j + 1 : j + 3]):
                bits += np.bitwise_count(a[:, None] ^ b[None, i : i + wide])
            tile += bits


def nearest_sketches(queries: pa.Table, rows: pa.Table, n: int, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, bits that differ, cosine) of the n rows with the nearest sketches in the cells that each query reads; with k, the k best of these.

    queries: (query_id, embedding, sketch, cells), rows: (cell, chunk_id, embedding, sketch). Queries that read like
    cells are taken together, and only the cells that one of them reads are looked at. Of a row, the sketch stays in memory
    and its vector as it came; only the vectors of candidates are made doubles.
    """
    none = np.zeros(0, int)
    if not queries.num_rows or not rows.num_rows:
        return none, none, none, none.astype(float)
    (q, long), (v, wide) = entries(queries["embedding"]), entries(rows["embedding"])
    cell = rows["cell"].to_numpy()
    bits = np.frombuffer(b"".join(queries["cells"].to_pylist()), np.uint8).reshape(len(q), -1)
    by_cell = np.argsort(cell, kind="stable").astype(np.int32)
    members = np.bincount(cell, minlength=bits.shape[1] * 8)
    asked, held = _words(queries["sketch"]), _words(rows["sketch"])[:, by_cell]
    rank = np.empty(len(v), np.int32)
    rank[pc.sort_indices(rows["chunk_id"]).to_numpy()] = np.arange(len(v), dtype=np.int32)
    order = np.lexsort(bits.T[::-1])
    step = max(1, SKETCH_PAIRS // len(v))
    out = []
    for i in range(0, len(order), step):
        some = order[i : i + step]
        reads = np.unpackbits(bits[some], axis=1).astype(bool)
        read = reads.any(0)
        there = np.repeat(read, members)
        at, words = (by_cell, held) if there.all() else (by_cell[there], held[:, there])
        if not len(at):
            continue
        differ = np.repeat(np.where(reads[:, read], 0, FAR).astype(np.int16), members[read], axis=1)
        differing(asked[:, some], words, differ)
        row, column = lowest(differ, n, rank[at])
        far = differ[row, column]
        near = far < FAR
        row, column, far = row[near], at[column[near]], far[near]
        x, y = q[some[row]] / long[some[row], None], v[column] / wide[column, None]
        score = np.cumsum(x * y, axis=1)[:, -1].copy()  # in order of the entries, so that equal vectors have equal scores; a view would keep all the sums
        if k is not None:
            best = np.lexsort((rank[column], -score, row))
            row, column, far, score = row[best], column[best], far[best], score[best]
            few = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, column, far, score = row[few], column[few], far[few], score[few]
        out.append((some[row].astype(np.int32), column, far, score))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none, none.astype(float))
