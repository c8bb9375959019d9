"""Course wikis: statements of core documents in order, repeats consolidated, extractive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 150_000
BLOCK = 100  # documents


def course_wiki(pages: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """pages (course_id, doc_id, page_number, text) -> (course_id, wiki, n_lines): first occurrence of each line, in page order.

    Repeats are dropped by an aggregate per (course, line) before lines are gathered. Lengths are first summed by
    blocks of documents, so that the running length by line, and the gathering, see only the blocks within the cap.
    """
    from pyspark.sql.window import Window

    lines = pages.select("course_id", "doc_id", "page_number", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    lines = lines.select("course_id", F.struct("doc_id", "page_number", "line_no").alias("at"), F.trim("raw").alias("line")).where("line <> ''")
    once = lines.groupBy("course_id", F.lower("line").alias("norm")).agg(F.min(F.struct("at", "line")).alias("first"))
    once = once.withColumn("block", F.floor(F.col("first.at.doc_id") / BLOCK))
    blocks = once.groupBy("course_id", "block").agg(F.sum(F.length("first.line") + 1).alias("block_length"))
    ahead = F.sum("block_length").over(Window.partitionBy("course_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_length")
    near = blocks.withColumn("ahead", ahead).where(F.col("ahead") < max_chars).select("course_id", "block")
    once = once.join(near, ["course_id", "block"], "left_semi")
    run = F.sum(F.length("first.line") + 1).over(Window.partitionBy("course_id").orderBy("first.at").rowsBetween(Window.unboundedPreceding, 0))
    kept = once.withColumn("before", run - F.length("first.line") - 1).where(F.col("before") < max_chars)
    packed = kept.groupBy("course_id").agg(F.array_sort(F.collect_list("first")).alias("rows"))
    return packed.select("course_id", F.substring(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), 1, max_chars).alias("wiki"), F.size("rows").cast("long").alias("n_lines"))
