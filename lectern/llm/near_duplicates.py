"""Near-duplicates by improved consistent weighted sampling over TF-IDF word shingles.

A shingle is five words; its weight is its count times 1 + the mean idf of its words on a scale of 0 to 1 (idf of
words in under RARE of all documents is clipped to 1). Each text is sampled SAMPLES times, consistently for its
weights; samples are banded. Texts with equal shingles form one node first. In every bucket the node that shares
most buckets with others is the anchor, and all members are verified against it by exact weighted Jaccard
similarity. In buckets whose members are then still in different groups, every two of different groups are compared, in
memory: by longer samples first, then by their shingles; pairs never become rows. Classes are the connected components of verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import mapped, stored, without
from .textarrays import ALNUM, chunks, find_sorted, lower_latin, mix, span_hashes, string_buffers, word_spans

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
#: Longer samples, drawn only for the texts of buckets that stars left split; how many must agree before their shingles are
#: compared: six standard deviations under what similarity 0.8 gives, which turns down about one of 10**8 such pairs.
LONG, LONG_AGREE = 256, 166
#: Members of a bucket, and bytes of their shingles, that a task compares with as many others at once; larger buckets are dealt in blocks that meet each other.
BLOCK_ROWS, BLOCK_BYTES = 4000, 100_000_000
#: Words in at least this share of documents have their own idf; there are at most (mean distinct words) / RARE.
RARE = 1e-3
#: Node lists up to this many rows (16 bytes each) are broadcast to fetch their texts.
BROADCAST_NODES = 1_000_000
_SEEDS = mix(np.arange(1, LONG + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MINUS_LOG = -np.log((np.arange(65536) + 0.5) / 65536).astype(np.float32)
_UNIT = ((np.arange(65536) + 0.5) / 65536).astype(np.float32)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        h, n = (np.concatenate(x) for x in zip(*held))
        keys, which = np.unique(h, return_inverse=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(which, n, len(keys)).astype(np.int64))], ["word", "df"])

    for batch in batches:
        buf, off = string_buffers(batch.column(0))
        for _, _, b, o in chunks(buf, off, 1 << 20):
            b = lower_latin(b)
            starts, ends, row = word_spans(b, o, ALNUM)
            h = span_hashes(b, starts, ends)
            order = np.argsort(h + row.astype(np.uint64) * _STEP[0], kind="stable")
            both = np.stack([h[order], row[order].astype(np.uint64)])
            new = np.concatenate([[True], (both[:, 1:] != both[:, :-1]).any(0)]) if len(h) else np.zeros(0, bool)
            keys, n = np.unique(both[0][new], return_counts=True)
            held.append((keys, n))
            if sum(len(k) for k, _ in held) > 500_000:
                yield flush()
    if held:
        yield flush()


def word_idf(documents: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of frequent words, their idf on a scale of 0 to 1); all other words have 1."""
    n = documents.count()
    df = mapped(documents.select(text_col), _document_frequency, "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
    often = df.where(F.col("df") >= max(2.0, RARE * n)).toArrow()
    keys = often["word"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    idf = np.log(max(n, 1) / often["df"].to_numpy().astype(float)) / np.log(1 / RARE)
    return keys[order], np.clip(idf[order], 0, 1)


def shingles(b: np.ndarray, o: np.ndarray, idf: tuple[np.ndarray, np.ndarray], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, weight) of each distinct shingle, by row and hash; texts of fewer than k words have one shingle of all."""
    rows = len(o) - 1
    starts, ends, row = word_spans(b, o, ALNUM)
    h = span_hashes(b, starts, ends)
    at = find_sorted(idf[0], h)
    value = np.where(at >= 0, idf[1][at] if len(idf[1]) else 1.0, 1.0)
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    short = (count > 0) & (count < k)
    size = np.where(short, count, k)
    n_shingles = np.where(count >= k, count - k + 1, (count > 0).astype(int))
    srow = np.repeat(np.arange(rows), n_shingles)
    begin = first[srow] + np.arange(len(srow)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    key, total = np.zeros(len(srow), np.uint64), np.zeros(len(srow))
    hp, vp = np.concatenate([h, np.zeros(k, np.uint64)]), np.concatenate([value, np.zeros(k)])
    for j in range(k):
        inside = j < size[srow]
        key += np.where(inside, hp[begin + j] * _STEP[j % 5] * np.uint64(2 * (j // 5) + 1) + np.uint64(j + 1), np.uint64(0))
        total += np.where(inside, vp[begin + j], 0.0)
    key = mix(key)
    order = np.lexsort((key, srow))
    srow, key, total = srow[order], key[order], (total / np.maximum(size[srow], 1))[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (srow[1:] != srow[:-1])])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(new, len(key)))
    return srow[new], key[new], tf * (1 + total[new])


def sample(row_starts: np.ndarray, key: np.ndarray, weight: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """rows x samples: improved consistent weighted sampling; equal entries mean that the same (shingle, level) was drawn.

    r, c ~ Gamma(2, 1) and beta ~ U(0, 1) come from the hash of shingle and sample; the shingle with the least
    c / (y e^r), y = exp(r (floor(ln w / r + beta) - beta)), is drawn.
    """
    log_w = np.log(weight).astype(np.float32)
    out = np.empty((len(row_starts), samples), np.uint64)
    sizes = np.diff(np.append(row_starts, len(key)))
    mask = np.uint64(0xFFFF)
    for k in range(samples):
        h = mix(key ^ _SEEDS[k])
        r = _MINUS_LOG[(h & mask).astype(np.intp)] + _MINUS_LOG[((h >> np.uint64(16)) & mask).astype(np.intp)]
        c = _MINUS_LOG[((h >> np.uint64(32)) & mask).astype(np.intp)] + _MINUS_LOG[(h >> np.uint64(48)).astype(np.intp)]
        beta = _UNIT[((h * _STEP[1]) >> np.uint64(48)).astype(np.intp)]
        t = np.floor(log_w / r + beta)
        a = np.log(c) - r * (t - beta) - r
        least = np.minimum.reduceat(a, row_starts)
        hit = np.flatnonzero(a == np.repeat(least, sizes))
        group = np.searchsorted(row_starts, hit, "right") - 1
        one = hit[np.concatenate([[True], group[1:] != group[:-1]])]
        out[:, k] = mix(key[one] + t[one].astype(np.int64).view(np.uint64) * _STEP[0])
    return out


def sketch(documents: DataFrame, idf: tuple[np.ndarray, np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """(doc, src, node, weight, bands) per document; node is null for a text without words.

    node hashes the weighted shingle set; src hashes id and text and finds the text again.
    """
    shared = documents.sparkSession.sparkContext.broadcast(idf)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            buf, off = string_buffers(batch.column(2))
            for i, j, b, o in chunks(buf, off, 1 << 20):
                row, key, weight = shingles(lower_latin(b), o, idf)
                starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
                full = row[starts]
                node, total = [None] * (j - i), [None] * (j - i)
                bands = [None] * (j - i)
                if len(starts):
                    drawn = sample(starts, key, weight)
                    sums = np.add.reduceat(mix(key + (weight * 4096).astype(np.uint64) * _STEP[2]), starts)
                    totals = np.add.reduceat(weight, starts)
                    grouped = drawn.reshape(len(full), BANDS, ROWS)
                    joined = mix(sum(grouped[:, :, q] * _STEP[q] for q in range(ROWS)) + np.arange(BANDS, dtype=np.uint64) * _STEP[3])
                    for at, r in enumerate(full):
                        node[r], total[r] = int(sums[at].view(np.int64)), float(totals[at])
                        bands[r] = joined[at].view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(node, pa.int64()), pa.array(total, pa.float64()),
                    pa.array(bands, pa.list_(pa.int64()))], ["doc", "src", "node", "weight", "bands"])

    rows = documents.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("src"), F.col(text_col).alias("text"))
    return mapped(rows, run, f"doc {kind}, src long, node long, weight double, bands array<long>")


def similarity(a: tuple, b: tuple, idf: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarity of each row of two string columns, given as (bytes, offsets)."""
    n = len(a[1]) - 1
    parts = [shingles(lower_latin(x), o, idf) for x, o in (a, b)]
    row = np.concatenate([parts[0][0], parts[1][0]])
    key = np.concatenate([parts[0][1], parts[1][1]])
    weight = np.concatenate([parts[0][2], parts[1][2]])
    order = np.lexsort((key, row))
    row, key, weight = row[order], key[order], weight[order]
    same = np.flatnonzero((row[1:] == row[:-1]) & (key[1:] == key[:-1]))
    shared = np.bincount(row[same], np.minimum(weight[same], weight[same + 1]), n)
    total = np.bincount(row, weight, n)
    return shared / np.maximum(total - shared, 1e-12)


def verify(pairs: DataFrame, texts: DataFrame, idf: tuple[np.ndarray, np.ndarray], threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the threshold; texts: (node, text), one row a node."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                value = similarity(string_buffers(part.column(2)), string_buffers(part.column(3)), idf)
                keep = pa.array(np.flatnonzero(value >= threshold))
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), pa.array(value).take(keep)], ["a", "b", "similarity"])

    joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    joined = joined.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return mapped(joined.select("a", "b", "text_a", "text_b"), run, "a long, b long, similarity double")


def profiles(texts: DataFrame, idf: tuple[np.ndarray, np.ndarray], samples: bool) -> DataFrame:
    """(node, keys, weights, long) of each text: its shingles, and a byte of each of LONG samples (none: no bytes)."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = string_buffers(batch.column(1))
            for i, j, b, o in chunks(buf, off, 1 << 18):
                row, key, weight = shingles(lower_latin(b), o, shared.value)
                starts = np.searchsorted(row, np.arange(j - i + 1))
                drawn = sample(starts[:-1], key, weight, LONG).astype(np.uint8) if samples else np.zeros((j - i, 0), np.uint8)
                parts = [[x[p:q].tobytes() for p, q in zip(starts, starts[1:])] for x in (key, weight)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(x, pa.binary()) for x in (*parts, [d.tobytes() for d in drawn])]], ["node", "keys", "weights", "long"])

    return mapped(texts.select("node", "text"), run, "node long, keys binary, weights binary, long binary")


def _texts(documents: DataFrame, nodes: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the wanted nodes, one row each."""
    wanted = stored(nodes.join(wanted.select("node").distinct(), "node", "left_semi").select("node", "src"), "wanted")
    n = wanted.count()
    rows = documents.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("src"), F.col(text_col).alias("text"))
    found = stored(rows.join(F.broadcast(wanted) if n <= BROADCAST_NODES else wanted, "src").select("node", "text"), "texts")
    return found if found.count() == n else stored(found.groupBy("node").agg(F.first("text").alias("text")), "texts-once")  # rows that repeat id and text


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def _fits(threshold: float, a: str, b: str) -> Column:
    """Whether the total weights allow the threshold."""
    return F.least(a, b) / F.greatest(a, b) >= threshold - 1e-9


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _joined_groups(links: DataFrame, labelled: DataFrame) -> DataFrame:
    """(old_label, new_label) of the groups that links between members (node, label) of them join."""
    labelled = labelled.select("node", "label").distinct()
    ends = links.join(labelled.select(F.col("node").alias("a"), F.col("label").alias("label_a")), "a").join(labelled.select(F.col("node").alias("b"), F.col("label").alias("label_b")), "b")
    return components(ends.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).where("a <> b")).select(F.col("node").alias("old_label"), F.col("label").alias("new_label"))


def _relabelled(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups, F.col("label") == F.col("old_label"), "left").withColumn("label", F.coalesce("new_label", "label")).drop("old_label", "new_label")


def _split(rows: DataFrame) -> DataFrame:
    """The rows (bucket, node, weight, label) of buckets whose members are in different groups."""
    ends = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return rows.join(ends.select("bucket"), "bucket")


def block_links(table: pa.Table, threshold: float) -> list[tuple[int, int, float]]:
    """Links (a, b, similarity) between members (slot, node, weight, label, buckets, keys, weights, long) of different groups of one bucket.

    Members of one slot meet each other, those of two slots those of the other. A pair is compared in the first bucket
    that holds both, unless links found here have joined its groups already.
    """
    table = table.sort_by([("slot", "ascending"), ("label", "ascending"), ("node", "ascending")])
    bucket = table["bucket"][0].as_py() if table.num_rows else 0
    slot, node, weight = (table[c].to_numpy() for c in ("slot", "node", "weight"))
    group = np.unique(table["label"].to_numpy(), return_inverse=True)[1]
    raw = [table[c].to_pylist() for c in ("keys", "weights", "long")]
    where = [set(x) for x in table["buckets"].to_pylist()]
    long = np.frombuffer(b"".join(raw[2]), np.uint8).reshape(len(node), -1)
    cut = int(np.searchsorted(slot, slot[-1])) if len(slot) else 0  # where the second slot starts; 0 with one slot
    out = []
    for i in range(cut or len(node)):
        others = np.arange(max(cut, i + 1), len(node))
        least, most = np.minimum(weight[others], weight[i]), np.maximum(weight[others], weight[i])
        others = others[(group[others] != group[i]) & (least / most >= threshold - 1e-9)]
        if long.shape[1] and len(others):
            agree = np.bitwise_count((long[others] == long[i]).view(np.uint64)).sum(1)
            some = agree >= LONG_AGREE
            others = others[some][np.argsort(-agree[some].astype(np.int64), kind="stable")]
        for j in others.tolist():
            if group[i] == group[j] or min(where[i] & where[j]) != bucket:
                continue
            x, y = (np.frombuffer(raw[0][n], np.uint64) for n in (i, j))
            p, q = (np.frombuffer(raw[1][n]) for n in (i, j))
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            same = y[at] == x
            shared = np.minimum(p[same], q[at[same]]).sum()
            value = shared / max(p.sum() + q.sum() - shared, 1e-12)
            if value >= threshold:
                out.append((int(node[i]), int(node[j]), float(value)))
                group[group == group[j]] = group[i]
    return out


def _bucket_links(left: DataFrame, texts: DataFrame, idf: tuple[np.ndarray, np.ndarray], threshold: float, samples: bool = False) -> DataFrame:
    """Links (a, b, similarity) that join the groups in each bucket of left (bucket, node, weight, label).

    Every two members of a bucket that stay in different groups are compared, with samples by their longer samples first.
    A bucket over BLOCK_ROWS or BLOCK_BYTES is dealt in blocks by hash, and any two blocks meet in a task.
    """
    left = stored(_split(left), "split-rows")
    known = stored(profiles(texts, idf, samples), "profiles")
    sizes = left.join(known.select("node", F.octet_length("keys").alias("bytes")), "node").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    slots = sizes.select("bucket", F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("bytes") / BLOCK_BYTES, F.lit(1))).cast("int").alias("slots"))
    all_of = left.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))  # BANDS at most
    rows = left.join(slots, "bucket").withColumn("slot", F.pmod(F.xxhash64("node", "bucket"), "slots").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    rows = rows.select("bucket", F.least("slot", "other").alias("one"), F.greatest("slot", "other").alias("two"), "slot", "node", "weight", "label").join(all_of, "node").join(known, "node")
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "one", "two")

    def compare(table: pa.Table) -> pa.Table:
        found = block_links(table, threshold)
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("a", "b", "similarity"), zip(*found) if found else ([], [], []), (pa.int64(), pa.int64(), pa.float64()))})

    return stored(dealt.groupBy("bucket", "one", "two").applyInArrow(compare, "a long, b long, similarity double").distinct(), "split-links")


def _finer_links(split: DataFrame, texts: DataFrame, idf: tuple[np.ndarray, np.ndarray], threshold: float) -> DataFrame:
    """Links (a, b, similarity) found among the nodes (bucket, node, weight, label) of split buckets, by longer samples and then by shingles."""
    return _bucket_links(split, texts, idf, threshold, True)


def duplicate_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, src (hash of id and text), class_id (least id of its class), n_links, first (src that stays).

    n_links: other documents with the same shingles, and different texts that a verified link leads to. Null and empty
    texts and texts without words link with nothing; texts of fewer than five words link with texts of the same
    words; very long texts are compared whole; ties and repeated rows fall in one class; a null id loses to any other
    as class_id; other columns are ignored.
    """
    idf = word_idf(documents, text_col)
    sketches = stored(sketch(documents, idf, id_col, text_col), "sketches")
    worded = sketches.where(F.col("node").isNotNull())
    nodes = stored(worded.groupBy("node").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "src")).alias("least"), F.count("*").alias("copies"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
                   .select("node", F.col("least.none").alias("none"), F.col("least.doc").alias("doc"), F.col("least.src").alias("src"), "copies", "weight", "bands"), "nodes")
    rows = nodes.select("node", "weight", F.explode("bands").alias("bucket"))
    sizes = stored(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    shared = stored(rows.join(sizes, "bucket"), "bucket-rows")
    degree = stored(shared.groupBy("node").agg(F.sum("size").alias("degree")), "degrees")
    placed = stored(shared.select("bucket", "node", "weight").join(degree, "node"), "placed")
    anchors = stored(placed.groupBy("bucket").agg(F.max(F.struct("degree", "node", "weight")).alias("anchor")), "anchors")
    star = placed.join(anchors, "bucket").where((F.col("node") != F.col("anchor.node")) & _fits(threshold, "weight", "anchor.weight"))
    star = stored(star.select(F.col("anchor.node").alias("a"), F.col("node").alias("b")).distinct(), "star-pairs")
    links = stored(verify(star, _texts(documents, nodes, _ends(star), id_col, text_col), idf, threshold), "star-links")
    member = _labelled(nodes.select("node", "none", "doc", "src", "copies"), components(links))
    # Members of a bucket that the stars left in different groups; two of them were compared, as one is the anchor.
    several = sizes.where("size > 2").select("bucket")
    split = stored(_split(placed.select("bucket", "node", "weight").join(several, "bucket").join(member.select("node", "label"), "node")), "split-members")
    if split.limit(1).count():
        more = _finer_links(split, _texts(documents, nodes, split, id_col, text_col), idf, threshold)
        links, member = links.unionByName(more), _relabelled(member, _joined_groups(more, split))
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    linked = _ends(links).groupBy("node").agg(F.count("*").alias("linked"))
    member = stored(member, "members")
    heads = member.groupBy("label").agg(F.min(F.struct("none", "doc", "src")).alias("head"))
    classes = member.select("node", "label", "copies").join(heads, "label").join(linked, "node", "left")
    n_links = F.coalesce("linked", F.lit(0)) + F.col("copies") - 1
    classes = stored(classes.select("node", F.col("head.doc").alias("class_id"), F.col("head.src").alias("first"), n_links.alias("n_links")), "classes")
    both = sketches.select("doc", "src", "node").join(classes, "node", "left")
    own = F.col("node").isNull()
    return both.select(F.col("doc").alias(id_col), "src", F.when(own, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(own, F.col("src")).otherwise(F.col("first")).alias("first"))


def keep_first(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each class: the one with the least id; of rows that repeat it, one."""
    classes = stored(duplicate_classes(documents, id_col, text_col).select("src", "first"), "keep")
    copies = classes.where(F.col("src") == F.col("first")).groupBy("src").agg(F.count("*").alias("copies")).where("copies > 1")
    repeated = stored(copies.select(F.col("src").alias("gone_src")), "repeated")
    later = classes.where(F.col("src") != F.col("first")).select(F.col("src").alias("gone_src")).distinct()
    kept = without(documents, stored(later.unionByName(repeated), "later-copies"), id_col, text_col)
    if repeated.limit(1).count():
        src = F.xxhash64(F.col(f"kept_row.{id_col}"), F.col(f"kept_row.{text_col}")).alias("row_src")
        rows = documents.select(F.struct(*documents.columns).alias("kept_row")).select("kept_row", src)
        one = rows.join(repeated, F.col("row_src") == F.col("gone_src"), "left_semi").dropDuplicates(["row_src"])
        kept = kept.unionByName(one.select("kept_row.*"))
    return kept
