"""Chunking pages, chunk identity, near-duplicate captions, layout context."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored
from .overlap import drop_overlapping_large

SIZE, OVERLAP = 800, 150
# Separators in the order in which they are tried.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", "")
REACH_PT, CONTEXT_CHARS, MIN_REST = 72.0, 400, 20
OVERLAP_RATIO = 0.8


def sliding_chunks(pages: DataFrame, text_col: str = "text", size: int = 800, step: int = 700) -> DataFrame:
    """Windows of size characters every step characters: chunk_index and content; empty text has none."""
    n = F.length(text_col)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step)))
    cut = F.posexplode(F.transform(starts, lambda i: F.substr(F.col(text_col), (i + 1).cast("int"), F.lit(size)))).alias("chunk_index", "content")
    return pages.select("*", cut)


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most size characters: cut at the first separator that occurs, merge neighbours, carry an overlap.

    Separators are dropped at cuts and put back where neighbours are merged; blank pieces are skipped.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    parts = [p for p in (text.split(mark) if mark else list(text)) if p]
    done: list[str] = []
    run: list[str] = []

    def merge() -> None:
        """Greedy runs of pieces; the tail of a run, up to the overlap, opens the next."""
        held: list[str] = []
        length = 0
        for p in run:
            grown = length + len(p) + (len(mark) if held else 0)
            if grown > size and held:
                done.append(mark.join(held))
                while held and (length > overlap or length + len(p) + len(mark) > size):
                    length -= len(held.pop(0)) + (len(mark) if held else 0)
            held.append(p)
            length += len(p) + (len(mark) if len(held) > 1 else 0)
        if held:
            done.append(mark.join(held))
        run.clear()

    for p in parts:
        if len(p) <= size:
            run.append(p)
        else:
            merge()
            done.extend(split_text(p, size, overlap, finer) if finer else [p[i : i + size] for i in range(0, len(p), size)])
    merge()
    return done


def recursive_chunks(pages: DataFrame, keys: list[str], text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row per non-blank piece: the keys, chunk_index (gaps where blank pieces were) and content."""
    kept = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pieces = [[(i, p.strip()) for i, p in enumerate(split_text(t, size, overlap)) if p.strip()] if isinstance(t, str) else [] for t in frame[text_col]]
            out = frame[keys].loc[frame.index.repeat([len(p) for p in pieces])].reset_index(drop=True)
            flat = [x for p in pieces for x in p]
            yield out.assign(chunk_index=pd.Series([i for i, _ in flat], dtype="int32"), content=pd.Series([c for _, c in flat], dtype="object"))

    return pages.select(*keys, text_col).mapInPandas(run, f"{kept}, chunk_index int, content string")


def chunk_id(filename: Column, page: Column, index: Column) -> Column:
    return F.concat_ws("::", filename, page.cast("string"), index.cast("string"))


def node_id(level: Column, cluster: Column, namespace: Column) -> Column:
    return F.concat_ws("::", F.lit("raptor"), F.concat(F.lit("L"), level.cast("string")), F.concat(F.lit("C"), cluster.cast("string")), namespace)


def excerpt(text: Column, n: int = 500) -> Column:
    return F.substring(text, 1, n)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


#: Groups up to this size are folded in one row; larger ones are joined.
FOLD_ROWS = 500


def drop_overlapping(rows: DataFrame, group: str, order: str, text_col: str, ratio: float = OVERLAP_RATIO, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Greedy per group, in order: a row goes if its tokens overlap those of a kept row by the ratio of the smaller set.

    Rows without tokens never match. A page's captions are a small group, which is folded; a group of over fold_rows
    rows is settled by joins (overlap.drop_overlapping_large), with the same result.
    """
    held = rows.select(group, order, F.col(text_col).alias("text"), tokens(F.col(text_col)).alias("toks"))
    sizes = held.groupBy(group).agg(F.count("*").alias("n"))
    large = sizes.where((F.col("n") > fold_rows) & F.col(group).isNotNull()).select(F.col(group).alias("large_group"))
    if not large.limit(1).count():
        return _folded(held, group, order, ratio).withColumnRenamed("text", text_col)
    large = stored(large, "overlap-groups")
    is_large = F.col(group) == F.col("large_group")
    joined = drop_overlapping_large(held.join(large, is_large, "left_semi"), group, order, ratio)
    return _folded(held.join(large, is_large, "left_anti"), group, order, ratio).unionByName(joined).withColumnRenamed("text", text_col)


def _folded(held: DataFrame, group: str, order: str, ratio: float) -> DataFrame:
    packed = held.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, "text", "toks"))).alias("rows"))
    dup = f"exists(acc, k -> size(k.toks) > 0 and size(x.toks) > 0 and size(array_intersect(k.toks, x.toks)) / least(size(k.toks), size(x.toks)) >= {ratio})"
    kept = F.expr(f"aggregate(rows, slice(rows, 1, 0), (acc, x) -> if({dup}, acc, concat(acc, array(x))))")
    return packed.select(group, F.explode(kept).alias("r")).select(group, F.col(f"r.{order}").alias(order), F.col("r.text").alias("text"))


def _fill(blocks: str, above: bool) -> str:
    """Fold of the texts, nearest first, into half of the budget; the last one is cut if enough room is left.

    The result reads from the top down, so what is above comes out with the nearest text last.
    """
    half = CONTEXT_CHARS // 2
    joined = (lambda x: f"concat({x}, ' ', acc.t)") if above else (lambda x: f"concat(acc.t, ' ', {x})")
    one = f"if(length(acc.t) = 0, x.text, {joined('x.text')})"
    part = joined(f"substring(x.text, 1, {half} - length(acc.t))")
    cut = f"if({half} - length(acc.t) > {MIN_REST}, trim({part}), acc.t)"
    step = f"if(acc.full, acc, if(length({one}) <= {half}, named_struct('t', {one}, 'full', false), named_struct('t', {cut}, 'full', true)))"
    return f"aggregate({blocks}, named_struct('t', '', 'full', false), (acc, x) -> {step}, acc -> acc.t)"


def image_context(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """Images with the text within 72 pt above and below on the same page: 'above [IMAGE] below', empty without any.

    Blocks fill each side nearest first and are given from the top down. Images and blocks meet in strips of a page that
    are as high as the reach, so a block meets only images near it; of each side no more blocks are gathered than could fit.
    """
    strip = lambda y: F.floor(y / REACH_PT)
    edges = F.explode(F.array(F.struct(F.lit("up").alias("side"), F.col("y1").alias("edge")), F.struct(F.lit("down").alias("side"), F.col("y0").alias("edge"))))
    b = blocks.select("file", "page", "text", edges.alias("e")).select("file", "page", "text", "e.side", "e.edge", strip(F.col("e.edge")).alias("strip"))
    lines = F.explode(F.array(F.struct(F.lit("up").alias("side"), F.col("y0").alias("line"), (F.col("y0") - REACH_PT).alias("end")), F.struct(F.lit("down").alias("side"), F.col("y1").alias("line"), (F.col("y1") + REACH_PT).alias("end"))))
    wanted = images.select("file", "page", "xref", lines.alias("l")).select("file", "page", "xref", "l.side", "l.line", F.explode(F.array_distinct(F.array(strip(F.col("l.line")), strip(F.col("l.end"))))).alias("strip"))
    far = F.when(F.col("side") == "up", F.col("line") - F.col("edge")).otherwise(F.col("edge") - F.col("line"))
    near = wanted.join(b, ["file", "page", "side", "strip"]).withColumn("d", far).where((F.col("d") >= 0) & (F.col("d") <= REACH_PT))
    place = F.row_number().over(Window.partitionBy("file", "page", "xref", "side").orderBy("d", "text"))
    fitting = near.withColumn("place", place).where(F.col("place") <= CONTEXT_CHARS)  # each takes a blank at least
    side = lambda name: F.array_sort(F.array_compact(F.collect_list(F.when(F.col("side") == name, F.struct("d", "text")))))
    packed = fitting.groupBy("file", "page", "xref").agg(side("up").alias("up"), side("down").alias("down"))
    joined = F.expr(f"concat_ws(' ', nullif({_fill('up', True)}, ''), '[IMAGE]', nullif({_fill('down', False)}, ''))")
    found = packed.select("file", "page", "xref", F.substring(joined, 1, CONTEXT_CHARS).alias("context"))
    return images.select("file", "page", "xref").distinct().join(found, ["file", "page", "xref"], "left").withColumn("context", F.coalesce("context", F.lit("")))


def multimodal_chunks(images: DataFrame) -> DataFrame:
    """One chunk row per kept image: its context or a placeholder, dimensions, format and a running id per file and page."""
    place = F.row_number().over(Window.partitionBy("file", "page").orderBy("xref")) - 1
    text = F.coalesce(F.nullif(F.col("context"), F.lit("")), F.format_string("[Image on page %d]", F.col("page")))
    return images.select(F.concat_ws("::", F.lit("mm"), "file", F.col("page").cast("string"), place.cast("string")).alias("chunk_id"), text.alias("text"), "width_px", "height_px", "format")
