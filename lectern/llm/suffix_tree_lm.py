"""Language-model scoring with a probabilistic suffix tree over words, and one over bytes for the spelling of rare words.

A text is a sequence of words and one end. Symbols of the word tree are the words of at least FREQUENT of the
training tokens (so at most 1 / FREQUENT of them, whatever the corpus), one symbol for all other words, the end,
and a start that only contexts hold. Contexts are the last one or two symbols, over word breaks. A next symbol is
kept in a context if it was seen there MIN_COUNT times and diverges from what the context's suffix predicts
(G statistic >= WORD_G); contexts with a kept symbol are states, and those of two words grow out of kept pairs.
In a state, kept symbols have their counts; what was seen of all others, with SMOOTH, is spread as the suffix does:
p(w | s) = (n(s, w) + b(s) p(w | suffix)) / (n(s) + SMOOTH), b(s) = n(s) - kept counts + SMOOTH.
A rare word then costs its share among rare words, (c + V p) / (N + V) with N tokens and V kinds of them in
training and p the byte tree's probability of its spelling.

The logarithm of a text's probability is a sum over its n-grams in which only kept ones add to what single symbols
give; so kept n-grams are a table of values. The BROADCAST_GRAMS most frequent ones are broadcast, the rest is joined.

The byte tree reads a word after a break and closes it with one. Contexts are up to DEPTH bytes back to that break,
kept by share (MIN_SHARE of all symbols bounds the states by DEPTH / MIN_SHARE) and G statistic.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold, give_back, mapped, stored
from .textarrays import LOWER, SPACED, chunks, find_sorted, gather_bytes, mix, span_hashes, string_buffers, word_spans

DEPTH = 5
MIN_SHARE = 2e-5
MIN_G = 20.0
SMOOTH = 4.0
#: Words of at least this share of the training tokens are symbols of the word tree and are broadcast: at most 1 / FREQUENT of them.
FREQUENT = 1e-6
#: And seen so often: words seen once stand for those that were not seen, and give the rare symbol their share.
SYMBOL_COUNT = 2
#: So many kept n-grams, the most frequent ones, are broadcast (16 bytes each): these are most of those that texts hold.
BROADCAST_GRAMS = 2_000_000
#: A symbol is kept in a context that it follows so often and with this G statistic.
MIN_COUNT, WORD_G = 2, 20.0
#: Symbols of the word tree take BITS bits of an n-gram's key; trigrams are told apart by TRIGRAM.
BITS, TRIGRAM = 20, 1 << 62
RARE, LAST, START, FIRST_WORD = 0, 1, 2, 3
#: N-grams that one task of the counting gathers, on average, and parts that each task's n-grams are dealt in for each of these.
GRAMS_A_TASK, PARTS = 3_000_000, 4
#: Hashes that a task gathers before it sends their sums, and bytes that it works on at once: these bound its memory.
FLUSH, WORK_BYTES = 500_000, 1 << 20
GRAM_FLUSH = 2_000_000
BREAK = 32  # never occurs inside a word


def _unique_sum(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each word (its bytes, then BREAK): (context of up to DEPTH bytes with the symbol, packed; word index).

    The context goes back to the break before the word; a packed value has its own length in the top byte.
    """
    size = np.diff(off)
    soff = np.concatenate([[0], np.cumsum(size + 2)])
    sym = np.full(soff[-1], BREAK, np.uint64)
    sym[np.arange(off[-1]) + np.repeat(2 * np.arange(len(size)) + 1, size)] = buf
    place = np.arange(soff[-1]) - np.repeat(soff[:-1], size + 2)
    packed = sym.copy()
    for d in range(1, DEPTH + 1):
        back = np.zeros_like(sym)
        back[d:] = sym[:-d]
        packed |= np.where(place >= d, back << np.uint64(8 * d), np.uint64(0))
    packed |= np.minimum(place, DEPTH).astype(np.uint64) << np.uint64(56)
    real = place > 0
    return packed[real], np.repeat(np.arange(len(size)), size + 1)


def _count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, n): kind 0 words by hash, 1 packed symbols in context, 2 number of texts."""
    hashes, counts, body, sizes, texts = [], [], [], [], 0
    for batch in batches:
        buf, off = string_buffers(batch.column(0))
        texts += batch.num_rows
        for _, _, b, o in chunks(buf, off, WORK_BYTES):
            b = LOWER[b]
            starts, ends, _ = word_spans(b, o, SPACED)
            h, first, n = np.unique(span_hashes(b, starts, ends), return_index=True, return_counts=True)
            data, woff = gather_bytes(b, starts[first], ends[first])
            hashes.append(h), counts.append(n), body.append(data), sizes.append(np.diff(woff))
        if sum(map(len, hashes)) > FLUSH:
            yield from _flush(hashes, counts, body, sizes)
            hashes, counts, body, sizes = [], [], [], []
    yield from _flush(hashes, counts, body, sizes)
    yield _rows(2, np.zeros(1, np.uint64), np.array([texts]))


def _rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])


def _flush(hashes: list, counts: list, body: list, sizes: list) -> Iterator[pa.RecordBatch]:
    if not hashes:
        return
    h, n, size = np.concatenate(hashes), np.concatenate(counts), np.concatenate(sizes)
    data, off = np.concatenate(body), np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)
    first = order[new]
    total = np.add.reduceat(n[order], np.flatnonzero(new)) if len(first) else n
    yield _rows(0, h[first], total)
    keys, sums = [], []
    for i in range(0, len(first), 50_000):
        some = first[i : i + 50_000]
        packed, word = _grams(*gather_bytes(data, off[some], off[some] + size[some]))
        k, s = _unique_sum(packed, total[i : i + 50_000][word])
        keys.append(k), sums.append(s)
    if keys:
        yield _rows(1, *_unique_sum(np.concatenate(keys), np.concatenate(sums)))


@dataclass
class Model:
    """Automaton of the kept contexts of bytes; symbol classes are the bytes seen in training, class 0 all others."""

    classes: np.ndarray  # byte -> class
    goto: np.ndarray  # states x classes -> state
    logp: np.ndarray  # states x classes -> log10 probability
    start: int  # state after a break
    states: int


def symbol_counts(counts: DataFrame) -> DataFrame:
    """(ctx, len, sym, n) for every context length 0..DEPTH, from the packed symbols in their longest contexts."""
    packed = counts.where("kind = 1").select(F.col("key"), F.shiftrightunsigned("key", 56).cast("int").alias("len"), "n")
    d = F.explode_outer(F.sequence(F.lit(0), F.col("len"))).alias("d")
    cut = packed.select("key", "n", d)
    masks = F.array(*[F.lit((1 << (8 * (i + 1))) - 1) for i in range(DEPTH + 1)])
    kept = cut.select(F.col("d").alias("len"), F.col("key").bitwiseAND(F.element_at(masks, F.col("d") + 1)).alias("code"), "n")
    summed = kept.groupBy("len", "code").agg(F.sum("n").alias("n"))
    return summed.select("len", F.shiftright("code", 8).alias("ctx"), F.col("code").bitwiseAND(F.lit(255)).cast("int").alias("sym"), "n")


def fit(counts: DataFrame) -> Model:
    """Contexts of enough share come to the driver (at most DEPTH / MIN_SHARE of them, with their next symbols)."""
    grams = symbol_counts(counts)
    symbols = grams.where("len = 0").agg(F.sum("n")).first()[0] or 0
    sizes = grams.groupBy("len", "ctx").agg(F.sum("n").alias("total")).where(F.col("total") >= max(1, MIN_SHARE * symbols))
    rows = grams.join(sizes.select("len", "ctx"), ["len", "ctx"], "left_semi").select("len", "ctx", "sym", "n").toArrow()
    tree: dict[bytes, dict[int, int]] = {}
    for length, ctx, sym, n in zip(*(c.to_pylist() for c in rows.columns)):
        tree.setdefault(ctx.to_bytes(length, "big"), {})[sym] = n
    del rows
    root = tree.setdefault(b"", {})
    root.setdefault(BREAK, 0)
    used = sorted(root)
    classes = np.zeros(256, np.int64)
    classes[used] = np.arange(1, len(used) + 1)
    others = 256 - len(used)
    width = len(used) + 1
    kept = {b"", bytes([BREAK])} | {bytes([b]) for b in used}
    base = (np.concatenate([[0], [root[b] for b in used]]) + 1.0) / (sum(root.values()) + width)
    dist = {b"": base}

    def smoothed(ctx: bytes) -> np.ndarray:
        if ctx not in dist:
            parent = smoothed(ctx[1:])
            own = tree.get(ctx)
            if own is None:
                dist[ctx] = parent
            else:
                row = SMOOTH * parent
                row[classes[list(own)]] += list(own.values())
                dist[ctx] = row / (SMOOTH + sum(own.values()))
        return dist[ctx]

    for ctx in sorted(tree, key=lambda c: (len(c), c)):
        if len(ctx) < 2:
            continue
        own = tree[ctx]
        n = np.array(list(own.values()), float)
        if 2 * float((n * np.log(n / n.sum() / smoothed(ctx[1:])[classes[list(own)]])).sum()) >= MIN_G:
            kept.update(ctx[:i] for i in range(1, len(ctx) + 1))
    states = sorted(kept, key=lambda c: (len(c), c))
    index = {c: i for i, c in enumerate(states)}
    logp = np.log10(np.stack([smoothed(c) for c in states])).astype(np.float32)
    logp[:, 0] -= np.log10(max(1, others))  # an unseen byte is one of these
    goto = np.zeros((len(states), width), np.int32)
    for i, c in enumerate(states):  # by length: the suffix's row is ready
        if c:
            goto[i] = goto[index.get(c[1:], 0)] if c[1:] in index else goto[_longest(index, c[1:])]
        for b in used:
            j = index.get(c + bytes([b]))
            if j is not None:
                goto[i, classes[b]] = j
    goto[:, classes[BREAK]] = index[bytes([BREAK])]
    start = index[bytes([BREAK])]
    return Model(classes, goto, logp, start, len(states))


def _longest(index: dict[bytes, int], ctx: bytes) -> int:
    while ctx not in index:
        ctx = ctx[1:]
    return index[ctx]


def word_logp(model: Model, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """log10 probability of each word with the break that closes it, after a break."""
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    at, size = off[:-1][order], size[order]
    state = np.full(len(size), model.start, np.int32)
    total = np.zeros(len(size))
    cls = model.classes[buf]
    close = model.classes[BREAK]
    width = model.goto.shape[1]
    goto, logp = model.goto.ravel(), model.logp.ravel()
    longest = int(size[0]) if len(size) else 0
    live = len(size)
    for j in range(longest):
        live = int(np.searchsorted(-size, -j, "left"))  # sizes over j
        cell = state[:live].astype(np.int64) * width + cls[at[:live] + j]
        total[:live] += logp[cell]
        state[:live] = goto[cell]
    total += model.logp[state, close]
    out = np.empty(len(size))
    out[order] = total
    return out


@contextmanager
def lent(context: SparkContext, value) -> Iterator[Broadcast]:
    """A broadcast for what runs inside: then the driver and the executors drop it."""
    shared = context.broadcast(value)
    try:
        yield shared
    finally:
        shared.destroy()
        give_back()


@dataclass
class Words:
    """The word tree's symbols: hashes in order, the symbol of each, and by symbol its count and its probability without context."""

    hashes: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray
    p: np.ndarray
    tokens: int
    rare_tokens: int
    rare_types: int

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return find_sorted(self.hashes, hashes)

    def of(self, places: np.ndarray) -> np.ndarray:
        return np.where(places >= 0, self.symbols[places] if len(self.symbols) else 0, RARE)


def alphabet(counts: DataFrame, texts: int, word_tokens: int, word_types: int) -> Words:
    """Symbols in order of frequency."""
    often = counts.where((F.col("kind") == 0) & (F.col("n") >= max(SYMBOL_COUNT, FREQUENT * word_tokens))).select("key", "n").toArrow()
    keys, n = often["key"].to_numpy().view(np.uint64), often["n"].to_numpy()
    ranked = np.lexsort((keys, -n))
    by_symbol = np.concatenate([[word_tokens - n.sum(), texts, texts], n[ranked]])
    p = by_symbol.astype(float)
    p[[RARE, LAST]] += 1
    p /= word_tokens + texts + 2
    symbol = np.empty(len(n), np.int64)
    symbol[ranked] = np.arange(len(n)) + FIRST_WORD
    order = np.argsort(keys)
    return Words(keys[order], symbol[order], by_symbol, p, word_tokens + texts, int(by_symbol[RARE]), word_types - len(n))


def sequences(symbols: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with a start and an end for each row, row of each)."""
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n + 2) - n - 2
    out = np.full(len(symbols) + 2 * rows, START, np.uint64)
    out[first + n + 1] = LAST
    out[np.arange(len(symbols)) + 2 * row + 1] = symbols
    return out, np.repeat(np.arange(rows), n + 2)


def gram_keys(seq: np.ndarray, row: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the n-grams of two or three symbols."""
    n = max(0, len(seq) - order + 1)
    key = np.zeros(n, np.uint64)
    for j in range(order):
        key = key << np.uint64(BITS) | seq[j : j + n]
    inside = row[:n] == row[order - 1 : order - 1 + n]
    return key[inside], row[:n][inside]


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second bytes and so on: high ones are all zero and are compressed away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _gram_partition(words: Words, order: int, parts: int, prefixes: np.ndarray | None, some: KeptMap | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, keys, counts): differences of sorted n-gram keys and their counts, dealt by a hash of the key."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        keys, n = _unique_sum(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        part = ((mix(keys) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        keys, n = keys[by_part], n[by_part]
        cut = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
        full = np.flatnonzero(np.diff(cut))
        dealt = [(keys[cut[p] : cut[p + 1]], n[cut[p] : cut[p + 1]]) for p in full]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([_planes(np.diff(k, prepend=np.uint64(0))) for k, _ in dealt], pa.binary()), pa.array([_planes(c.astype(np.uint32)) for _, c in dealt], pa.binary())], ["part", "keys", "counts"])

    for batch in batches:
        buf, off = string_buffers(batch.column(0))
        for i, j, b, o in chunks(buf, off, WORK_BYTES):
            b = LOWER[b]
            starts, ends, row = word_spans(b, o, SPACED)
            seq, srow = sequences(words.of(words.places(span_hashes(b, starts, ends))), row, j - i)
            keys, _ = gram_keys(seq, srow, order)
            if prefixes is not None:
                keys = keys[find_sorted(prefixes, keys >> np.uint64(BITS)) >= 0]
            if some is not None:
                keys = keys[some.likely(keys >> np.uint64(BITS))]
            if len(keys):
                held.append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in held) > GRAM_FLUSH:
                yield flush()
    if held:
        yield flush()


def count_grams(texts: DataFrame, words: Broadcast, tokens: int, order: int, only: Broadcast | None = None) -> DataFrame:
    """(key, n) of the n-grams that occur MIN_COUNT times; only: prefixes, the only ones that count, and a map (kept_map) that turns most others down, or None for either."""
    tasks = max(1, -(-tokens // GRAMS_A_TASK))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gram_partition(words.value, order, PARTS * tasks, *(only.value if only else (None, None)), batches)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            for k, n in zip(batch.column(1), batch.column(2)):
                keys.append(np.cumsum(_from_planes(k.as_py(), np.uint64), dtype=np.uint64)), counts.append(_from_planes(n.as_py(), np.uint32))
        if keys:
            k, n = _unique_sum(np.concatenate(keys), np.concatenate(counts).astype(np.int64))
            k, n = k[n >= MIN_COUNT], n[n >= MIN_COUNT]
            for at in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000])], ["key", "n"])

    return mapped(mapped(texts, gather, "part int, keys binary, counts binary").repartition(tasks, "part"), total, "key long, n long")


def _g(n: np.ndarray, context: np.ndarray, p: np.ndarray) -> np.ndarray:
    return 2 * n * np.log(n / (context * p))


def _over(df: DataFrame, shared: list[Broadcast], work, schema: str) -> DataFrame:
    """work(*what is shared, *columns) -> columns, of whole batches of numbers (null: 0)."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in work(*(x.value for x in shared), *columns)], names)

    return mapped(df, run, schema)


def _kept_pairs(words: Words, key: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Pairs that diverge from their second symbol's probability."""
    kept = _g(n, words.counts[key >> BITS], words.p[key & _MASK]) >= WORD_G
    return [key[kept], n[kept]]


def _p_after_one(words: Words, mass: np.ndarray, u: np.ndarray, w: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """p(w | u) from the count that the pair is kept with (0: it isn't)."""
    n = words.counts[u]
    return (kept + (n - mass[u] + SMOOTH) * words.p[w]) / (n + SMOOTH)


def _kept_triples(words: Words, mass: np.ndarray, key: np.ndarray, n: np.ndarray, context: np.ndarray, pair: np.ndarray) -> list[np.ndarray]:
    """Triples that diverge from their suffix, with their context's count and the suffix's probability."""
    p = _p_after_one(words, mass, key >> BITS & _MASK, key & _MASK, pair)
    kept = _g(n, context, p) >= WORD_G
    return [key[kept], n[kept], context[kept], p[kept]]


def _pair_values(words: Words, mass: np.ndarray, key: np.ndarray, n: np.ndarray, triples: np.ndarray) -> list[np.ndarray]:
    """What a pair adds: as a kept symbol in its context, and as the context of what follows."""
    u, w = key >> BITS, key & _MASK
    own = np.log10(1 + n / ((words.counts[u] - mass[u] + SMOOTH) * words.p[w]))
    return [key, own + np.log10((n - triples + SMOOTH) / (n + SMOOTH)), n]


_MASK = (1 << BITS) - 1


def gram_values(train: DataFrame, words: Words, shared: Broadcast) -> tuple[DataFrame, np.ndarray]:
    """((key, value, n) of the kept n-grams, counts kept in each context of one symbol); shared: the words."""
    context = train.sparkSession.sparkContext
    pairs = stored(_over(count_grams(train, shared, words.tokens, 2), [shared], _kept_pairs, "key long, n long"), "lm-pairs")
    mass = np.zeros(len(words.counts), np.int64)
    sums = pairs.groupBy(F.shiftright("key", BITS).alias("u")).agg(F.sum("n").alias("n")).toArrow()  # a row a symbol at most
    mass[sums["u"].to_numpy()] = sums["n"].to_numpy()
    few = pairs.count() <= BROADCAST_GRAMS
    only = (np.sort(pairs.select("key").toArrow()["key"].to_numpy()).view(np.uint64), None) if few else (None, kept_map(pairs))
    first, second = pairs.select(F.col("key").alias("prefix"), F.col("n").alias("context")), pairs.select(F.col("key").alias("suffix"), F.col("n").alias("pair"))
    with lent(context, mass) as kept:
        with lent(context, only) as counted:
            del only
            seen = count_grams(train, shared, words.tokens, 3, counted).withColumn("prefix", F.shiftright("key", BITS)).withColumn("suffix", F.col("key").bitwiseAND((1 << 2 * BITS) - 1))
            seen = seen.join(first, "prefix").join(second, "suffix", "left").select("key", "n", "context", "pair")
            triples = stored(_over(seen, [shared, kept], _kept_triples, "key long, n long, context long, p double"), "lm-triples")
        held = triples.groupBy(F.shiftright("key", BITS).alias("prefix")).agg(F.sum("n").alias("triples"))
        of_pairs = _over(pairs.join(held, F.col("key") == F.col("prefix"), "left").select("key", "n", "triples"), [shared, kept], _pair_values, "key long, value double, n long")
        spare = F.col("context") - F.col("triples") + SMOOTH
        of_triples = triples.join(held, F.shiftright("key", BITS) == F.col("prefix")).select(F.col("key").bitwiseOR(F.lit(TRIGRAM)).alias("key"), F.log10(1 + F.col("n") / (spare * F.col("p"))).alias("value"), "n")
        return stored(of_pairs.unionByName(of_triples), "lm-values"), mass


def least_count(values: DataFrame) -> int:
    """The least count with which no more than BROADCAST_GRAMS n-grams are at least so frequent."""
    sizes = values.groupBy("n").agg(F.count("*").alias("grams")).orderBy(F.desc("n")).toArrow()  # different counts: at most some sqrt(4 * tokens)
    fits = int((np.cumsum(sizes["grams"].to_numpy()) <= BROADCAST_GRAMS).sum())
    return int(sizes["n"][fits - 1].as_py()) if fits else 1 << 62


class Values:
    """A broadcast table of n-gram values, with a bitmap that turns most other keys down, made where it is used."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.value = value[np.argsort(key)]
        self.key, self.some = np.sort(key), None

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (mix(key) >> np.uint64(41)).astype(np.intp)

    def sums(self, key: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        if self.some is None:
            self.some = np.zeros(1 << 23, bool)
            self.some[self._slot(self.key)] = True
        likely = np.flatnonzero(self.some[self._slot(key)])
        at = find_sorted(self.key, key[likely])
        hit = at >= 0
        return np.bincount(row[likely[hit]], self.value[at[hit]], rows) if hit.any() else np.zeros(rows)


def _row_grams(seq: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    yield gram_keys(seq, row, 2)
    keys, rows = gram_keys(seq, row, 3)
    yield keys | np.uint64(TRIGRAM), rows


#: Bits of the map of kept n-grams (32 MB whatever their number) and parts that it is made in.
MAP_BITS, MAP_PARTS = 28, 64


def _bits(key: np.ndarray) -> np.ndarray:
    return (mix(key) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


class KeptMap:
    """A bit for each hash of a kept n-gram, eight to a byte; its parts stay compressed until it is used."""

    def __init__(self, parts: dict[int, bytes]):
        self.parts, self.bits = parts, None

    def likely(self, key: np.ndarray) -> np.ndarray:
        """Whether each key may be kept: true for all that are."""
        if self.bits is None:
            width = (1 << MAP_BITS) // MAP_PARTS // 8
            self.bits = np.zeros((MAP_PARTS, width), np.uint8)
            for part in list(self.parts):
                self.bits[part] = np.frombuffer(zlib.decompress(self.parts.pop(part)), np.uint8)
            self.bits = self.bits.ravel()
        at = _bits(key)
        return (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def kept_map(values: DataFrame) -> KeptMap:
    """Tasks send the places of their n-grams' bits in order, as differences; the driver gets compressed parts."""
    width = (1 << MAP_BITS) // MAP_PARTS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            at = np.unique(np.concatenate(held))
            held.clear()
            cut = np.searchsorted(at, width * np.arange(MAP_PARTS + 1))
            full = np.flatnonzero(np.diff(cut))
            steps = [_planes(np.diff(at[cut[p] : cut[p + 1]] - p * width, prepend=0).astype(np.uint32)) for p in full]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(steps, pa.binary())], ["part", "steps"])

        for batch in batches:
            held.append(_bits(batch.column(0).to_numpy().view(np.uint64)))
            if sum(map(len, held)) > GRAM_FLUSH:
                yield flush()
        if held:
            yield flush()

    def fill(table: pa.Table) -> pa.Table:
        bits = np.zeros(width, np.uint8)
        for steps in table["steps"]:
            bits[np.cumsum(_from_planes(steps.as_py(), np.uint32))] = 1
        return pa.table({"part": table["part"][:1], "bits": pa.array([zlib.compress(np.packbits(bits), 1)], pa.binary())})

    made = mapped(values.select("key"), place, "part int, steps binary").groupBy("part").applyInArrow(fill, "part int, bits binary").toArrow()  # MAP_PARTS rows
    return KeptMap(dict(zip(made["part"].to_pylist(), made["bits"].to_pylist())))


def joined_values(documents: DataFrame, words: Broadcast, values: DataFrame) -> DataFrame:
    """(gram_row, grams): the sum of values of a text's n-grams, for those that are not broadcast.

    A map of hashes keeps n-grams that are not in the table from the shuffle; what it lets through besides joins nothing.
    """
    shared = documents.sparkSession.sparkContext.broadcast(kept_map(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, kept = words.value, shared.value
        for batch in batches:
            rid = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            buf, off = string_buffers(batch.column(1))
            for i, j, b, o in chunks(buf, off, WORK_BYTES):
                b = LOWER[b]
                starts, ends, row = word_spans(b, o, SPACED)
                for keys, rows in _row_grams(*sequences(symbols.of(symbols.places(span_hashes(b, starts, ends))), row, j - i)):
                    some = kept.likely(keys)
                    keys, rows = keys[some], rows[some]
                    order = np.lexsort((keys, rows))
                    keys, rows = keys[order], rows[order]
                    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])) if len(keys) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(rid[i:j][rows[first]]), pa.array(keys[first].view(np.int64)), pa.array(np.diff(np.append(first, len(keys))))], ["gram_row", "key", "times"])

    flat = mapped(documents, run, "gram_row long, key long, times long")
    return flat.join(values, "key").groupBy("gram_row").agg(F.sum(F.col("times") * F.col("value")).alias("grams"))


FIELDS = ["row", "key", "n", "n_tokens", "n_known", "base", "score"]


def _score_partition(model: Model, words: Words, back: np.ndarray, values: Values | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, key, n, n_tokens, n_known, base, score): one of each text with what is known here, n null and the row for a key, so that the join deals it out; one of each rare word, its spelling's log probability for a score."""
    log_p, log_back = np.log10(words.p), np.log10(back)
    for batch in batches:
        rid = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        buf, off = string_buffers(batch.column(1))
        for i, j, b, o in chunks(buf, off, WORK_BYTES):
            b = LOWER[b]
            rows = j - i
            starts, ends, row = word_spans(b, o, SPACED)
            h, first, which = np.unique(span_hashes(b, starts, ends), return_index=True, return_inverse=True)
            at = words.places(h)
            symbol = words.of(at)[which]
            rare = symbol == RARE
            seq, srow = sequences(symbol, row, rows)
            next_one = seq != START
            score = np.bincount(srow[next_one], log_p[seq[next_one]], rows) + np.bincount(srow[:-1][next_one[1:]], log_back[seq[:-1][next_one[1:]]], rows)
            if values is not None:
                for keys, of in _row_grams(seq, srow):
                    score += values.sums(keys, of, rows)
            yield pa.RecordBatch.from_arrays([
                pa.array(rid[i:j]), pa.array(rid[i:j]), pa.nulls(rows, pa.int64()), pa.array(np.bincount(row, minlength=rows)), pa.array(np.bincount(row, ~rare, rows).astype(np.int64)),
                pa.array(np.bincount(row[~rare], np.log10(words.counts[symbol[~rare]] + 1.0), rows)), pa.array(score)], FIELDS)
            if rare.any():
                kinds = np.flatnonzero(at < 0)
                place = np.zeros(len(h), np.int64)
                place[kinds] = np.arange(len(kinds))
                spelled = word_logp(model, *gather_bytes(b, starts[first[kinds]], ends[first[kinds]]))
                pair, n = _unique_sum(row[rare] * len(kinds) + place[which[rare]], np.ones(int(rare.sum()), np.int64))
                r, w = np.divmod(pair, len(kinds))
                none = lambda t, k=len(pair): pa.nulls(k, t)
                yield pa.RecordBatch.from_arrays([pa.array(rid[i:j][r]), pa.array(h[kinds[w]].view(np.int64)), pa.array(n), none(pa.int64()), none(pa.int64()), none(pa.float64()), pa.array(spelled.astype(np.float32).astype(float)[w])], FIELDS)


def score(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out_fold: int = 2) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts hold the end alone; texts of any length are read whole. Repeated ids are kept apart by their
    text; rows that repeat both are answered one by one. An empty table gives an empty result.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    held_out = fold(F.col(id_col), folds) == held_out_fold
    train = documents.where(~held_out).select(F.col(text_col).alias("text"))
    partial = mapped(train, _count_partition, "kind int, key long, n long")
    counts = stored(partial.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    by_kind = {r["kind"]: r for r in counts.where("kind <> 1").groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    texts = by_kind[2]["n"] if 2 in by_kind else 0
    word_tokens, word_types = (by_kind[0]["n"], by_kind[0]["v"]) if 0 in by_kind else (0, 0)
    tokens, types = word_tokens + texts, word_types + (texts > 0)
    model = fit(counts)
    words = alphabet(counts, texts, word_tokens, word_types)
    shared = documents.sparkSession.sparkContext.broadcast(words)
    give_back()
    values, mass = gram_values(train, words, shared)
    back = (words.counts - mass + SMOOTH) / (words.counts + SMOOTH)
    least = least_count(values)
    top, rest = values.where(F.col("n") >= least), values.where(F.col("n") < least)
    few = not rest.count()
    found = top.select("key", "value").toArrow()
    key_value = [found[k].to_numpy() for k in ("key", "value")]
    del found
    table = Values(key_value[0].view(np.uint64), key_value[1]) if len(key_value[0]) else None
    del key_value
    rest_of = documents.sparkSession.sparkContext.broadcast((model, back, table))
    del table
    give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, back, table = rest_of.value
        return _score_partition(model, shared.value, back, table, batches)

    rows = documents.select(key.alias("row"), F.col(text_col).alias("text"))
    flat = mapped(rows, run, "row long, key long, n long, n_tokens long, n_known long, base double, score double")
    # Repeats of a row send the same parts again; the number of texts with the row divides them out.
    rare = counts.where((F.col("kind") == 0) & (F.col("n") < max(SYMBOL_COUNT, FREQUENT * word_tokens))).select(F.col("key").alias("word"), F.col("n").alias("c"))
    joined = flat.join(rare, F.col("key") == F.col("word"), "left")
    spelled = F.log10((F.coalesce("c", F.lit(0)) + words.rare_types * F.pow(F.lit(10.0), F.col("score"))) / (words.rare_tokens + words.rare_types))
    own = F.col("n") * (spelled if words.rare_types else F.col("score"))
    sums = joined.groupBy("row").agg(
        F.count_if(F.col("n").isNull()).alias("copies"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum(F.when(F.col("n").isNull(), F.col("score")).otherwise(own)).alias("score"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_base"))
    if few:
        sums = sums.withColumn("grams", F.lit(0.0))
    else:
        sums = sums.join(joined_values(rows, shared, rest.select("key", "value")), F.col("row") == F.col("gram_row"), "left")
    end = float(np.log10(texts + 1))
    norm = float(np.log10(tokens + types + 1))
    n = F.col("n_tokens") / F.col("copies") + 1
    done = sums.select(
        F.col("row").alias("key_row"), n.cast("long").alias("n_tokens"),
        ((F.col("n_known") + F.coalesce("rare_known", F.lit(0))) / F.col("copies") + (1 if texts else 0)).cast("long").alias("n_known"),
        ((F.col("base") + F.coalesce("rare_base", F.lit(0.0))) / F.col("copies") + end - n * norm).alias("base_score"),
        ((F.col("score") + F.coalesce("grams", F.lit(0.0))) / F.col("copies")).alias("score"))
    base = documents.select(F.col(id_col), held_out.alias("held_out"), key.alias("base_row"))
    return base.join(done, F.col("base_row") == F.col("key_row")).select(id_col, "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
