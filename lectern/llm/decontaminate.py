"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window of L words (10, or all words of a shorter item) holds w = L - k + 1 k-grams with k = ceil(L / 2).
Its fingerprint is the least k-gram hash in it, so a document and an item that share a whole window always
share a fingerprint. Fingerprints are joined first; the windows at joined places are then compared word by
word, which extends every hit to its exact extent and removes hash collisions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_KEYS, held, stored

WINDOW = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Benchmarks up to this many words are broadcast (at most about 100 MB of fingerprints and windows).
BROADCAST_WORDS = 200_000


def words(text: Column) -> Column:
    """ASCII letters and digits and everything beyond ASCII are word characters; null has no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: w != "")


def _lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _fingerprints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Exploded to len, fp, pos, seg: for each length one fingerprint for each change of the least hash, and at least each
    w words, with the words that windows starting there can hold. df has ws, words; they are hashed once for all lengths."""
    df = held(df, "hs", F.transform("ws", lambda x: F.xxhash64(F.lower(x))))
    grams, least, prints = [], [], []
    for length in lengths:
        k = (length + 1) // 2
        w = length - k + 1
        gram = f"xxhash64(x, {', '.join(f'get(hs, i + {j})' for j in range(1, k))})" if k > 1 else "x"
        grams.append(F.expr(f"transform(hs, (x, i) -> {gram})").alias(f"gs{length}"))
        first = f"least(x, {', '.join(f'get(gs{length}, i + {j})' for j in range(1, w))})" if w > 1 else "x"
        least.append(F.expr(f"transform(slice(gs{length}, 1, greatest(size(hs) - {length - 1}, 0)), (x, i) -> {first})").alias(f"fs{length}"))
        one = f"named_struct('len', {length}, 'fp', x, 'pos', i, 'seg', slice(ws, i + 1, {length + w - 1}))"
        prints.append(F.expr(f"filter(transform(fs{length}, (x, i) -> if(i % {w} = 0 or x <> get(fs{length}, i - 1), {one}, null)), p -> p is not null)"))
    own = [c for c in df.columns if c not in ("ws", "hs")]
    df = df.select(*own, "ws", "hs", *grams).select(*own, "ws", *least).select(*own, F.explode_outer(F.concat(*prints)).alias("p"))
    return df.select(*own, "p.len", "p.fp", "p.pos", "p.seg").where("fp is not null")


def _windows(n: str, length: str, first: str, last: str) -> Column:
    """array<struct<at, win>> of the exact windows that start at first..last."""
    one = f"named_struct('at', j, 'win', array_join(slice(ws, j + 1, {length}), ' '))"
    return F.expr(f"if({n} < {length}, array(), transform(sequence({first}, least({last}, {n} - {length})), j -> {one}))")


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Every distinct (window length, window text, item) of the benchmark; items without words have none."""
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("body"))
    items = held(items, "ws", F.transform(words(F.col("body")), _lower_ascii)).withColumn("n", F.size("ws")).where("n > 0")
    long_ones = items.where(F.col("n") >= WINDOW).select("item", F.lit(WINDOW).alias("len"), F.explode_outer(_windows("n", str(WINDOW), "0", "n")).alias("x"))
    short = items.where(F.col("n") < WINDOW).select("item", F.col("n").alias("len"), F.struct(F.lit(0).alias("at"), F.array_join("ws", " ").alias("win")).alias("x"))
    return long_ones.unionByName(short).select("item", "len", F.col("x.win").alias("win")).where("win is not null").distinct()


def hits(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_key struct, at, len, item): each place of a document where a window of an item occurs.

    doc_key is the id with a hash of the text, so that rows which share an id but not a text stay apart.
    """
    known = benchmark_windows(benchmark, item_col, item_text_col)
    size = benchmark.agg(F.sum(F.size(words(F.col(item_text_col)))).alias("n")).first()["n"] or 0
    hint = F.broadcast if size <= BROADCAST_WORDS else (lambda df: df)
    lengths = [r["len"] for r in known.select("len").distinct().orderBy("len").collect()]
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")).alias("doc_key")
    if not lengths:
        item = F.lit(None).cast(dict(benchmark.dtypes)[item_col]).alias("item")
        return documents.select(key, F.lit(0).alias("at"), F.lit(0).alias("len"), item).where("false")
    texts = known.select("len", "win").distinct()
    prints = _fingerprints(texts.select(F.col("len").alias("own_len"), F.split("win", " ").alias("ws")), lengths).where("len = own_len").select("len", "fp").distinct()
    docs = held(documents.select(key, F.col(text_col).alias("body")), "ws", words(F.col("body"))).drop("body")
    spots = _fingerprints(docs, lengths).join(hint(prints), ["len", "fp"], "left_semi")
    spots = spots.select("doc_key", "len", F.col("pos").alias("base"), F.col("seg").alias("ws")).withColumn("n", F.size("ws"))
    spots = spots.select("doc_key", "len", "base", F.explode_outer(_windows("n", "len", "0", "n")).alias("x"))
    spots = spots.select("doc_key", "len", (F.col("base") + F.col("x.at")).alias("at"), _lower_ascii(F.col("x.win")).alias("win")).where("win is not null")
    spots = spots.join(hint(texts.select("win")), "win", "left_semi").distinct()
    return spots.join(hint(known.select("win", "item")), "win").select("doc_key", "at", "len", "item")


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, items (array), contaminated.

    Null and empty texts have no words and no hits; texts of any length are searched whole; repeated rows are answered
    one by one; a null item id marks words but names no item; an empty table gives an empty result; other columns are
    ignored.
    """
    found = hits(documents, benchmark, id_col, text_col, item_col, item_text_col)
    at = F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.at, s.at + s.len - 1)))))").cast("long")
    per_doc = found.groupBy("doc_key").agg(F.collect_set(F.struct("at", "len")).alias("spans"), F.collect_set("item").alias("found_items"))
    per_doc = per_doc.select("doc_key", at.alias("hit"), "found_items")
    base = documents.select(F.col(id_col), F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")).alias("key"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    both = base.join(per_doc, F.col("key").eqNullSafe(F.col("doc_key")), "left")
    return both.select(
        id_col, "n_words", F.coalesce("hit", F.lit(0)).alias("n_hit"),
        F.coalesce("found_items", F.array().cast(f"array<{dict(benchmark.dtypes)[item_col]}>")).alias("items"),
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns."""
    marked = stored(hits(documents, benchmark, id_col, text_col).select("doc_key").distinct(), "leaks")
    marked = F.broadcast(marked) if marked.count() <= BROADCAST_KEYS else marked
    rows = documents.select(F.struct(*documents.columns).alias("kept_row"))
    key = F.struct(F.col(f"kept_row.{id_col}").alias("id"), F.xxhash64(f"kept_row.{text_col}").alias("hash"))
    return rows.join(marked, key.eqNullSafe(F.col("doc_key")), "left_anti").select("kept_row.*")
