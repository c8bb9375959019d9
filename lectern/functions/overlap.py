"""Greedy drop of rows whose tokens overlap those of a kept row, for groups of any size, as a set-similarity join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored

#: Ranges that rows are dealt in to be numbered, and rounds in which first rows of tokens are settled before pairs are made.
PARTS, ROUNDS = 64, 3


def _numbered(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Adds place: numbers that rise with order and text inside a group; no task sees all rows of a large one."""
    dealt = stored(rows.repartitionByRange(PARTS, group, order, "text").withColumn("part", F.spark_partition_id()), "overlap-dealt")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(group, order, "text"))
    return dealt.withColumn("place", F.col("part").cast("long") * (1 << 40) + inside).drop("part")


def _able(a: str, b: str) -> Column:
    """Whether two rows that share a token may overlap enough: the smaller one has it in its prefix."""
    one = lambda x, y: F.col(f"{x}prefix") & (F.col(f"{x}size") <= F.col(f"{y}size"))
    return one(a, b) | one(b, a)


def _pairs(first: DataFrame, second: DataFrame, bags: DataFrame, ratio: float) -> DataFrame:
    """(earlier, later) of rows that overlap by the ratio, of those with a token in common that may."""
    a = first.select("bucket", F.col("token").alias("a_token"), F.col("place").alias("earlier"), F.col("size").alias("a_size"), F.col("prefix").alias("a_prefix"))
    b = second.select(F.col("bucket").alias("b_bucket"), F.col("token").alias("b_token"), F.col("place").alias("later"), F.col("size").alias("b_size"), F.col("prefix").alias("b_prefix"))
    met = a.join(b, (F.col("bucket") == F.col("b_bucket")) & (F.col("a_token") == F.col("b_token"))).where((F.col("earlier") < F.col("later")) & _able("a_", "b_")).select("earlier", "later").distinct()
    both = met.join(bags.select(F.col("place").alias("earlier"), F.col("bag").alias("a_bag")), "earlier").join(bags.select(F.col("place").alias("later"), F.col("bag").alias("b_bag")), "later")
    share = F.size(F.array_intersect("a_bag", "b_bag")) / F.least(F.size("a_bag"), F.size("b_bag"))
    return both.where(share >= ratio).select("earlier", "later")


def drop_overlapping_large(rows: DataFrame, group: str, order: str, ratio: float) -> DataFrame:
    """rows (group, order, text, toks) -> (group, order, text) of those that stay; groups are not null.

    A row goes if its tokens overlap those of a kept earlier row by the ratio of the smaller set. Equal sets are one
    row, the first. If the smaller of two sets of s tokens is to lack fewer than s - ceil(ratio s) + 1 of the other's, it
    shares one of that many of its rarest: rows meet only on these. First, for a few rounds, rows that come before all
    others they may overlap with are kept, and what overlaps them goes, so a cluster of near copies is compared with
    its first row only. Then the pairs that are left are made, and settled in order: what no undecided earlier row
    overlaps stays, what a kept one overlaps goes.
    """
    held = rows.where("size(toks) > 0").withColumn("bag", F.array_sort("toks"))
    firsts = held.groupBy(group, "bag").agg(F.min(F.struct(order, "text")).alias("first")).select(group, "bag", F.col(f"first.{order}").alias(order), "first.text")
    bags = stored(_numbered(firsts, group, order).withColumn("bucket", F.xxhash64(group)), "overlap-bags")
    each = bags.select("bucket", "place", F.size("bag").alias("size"), F.explode("bag").alias("token"))
    often = each.groupBy("bucket", "token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("place").orderBy("n", "token"))
    prefix = rank <= F.col("size") - F.ceil(ratio * F.col("size") - 1e-9) + 1
    entries = stored(each.join(often.where("n > 1"), ["bucket", "token"], "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("prefix", prefix).where("n > 1").drop("n"), "overlap-entries")
    undecided, kept = bags.select("place"), None
    for _ in range(ROUNDS):
        live = stored(entries.join(undecided, "place", "left_semi"), "overlap-live")
        heads = live.groupBy("bucket", "token").agg(F.min("place").alias("first"), F.min(F.when(F.col("prefix"), F.col("place"))).alias("first_prefix"))
        barred = live.join(heads, ["bucket", "token"]).where((F.col("prefix") & (F.col("first") < F.col("place"))) | (F.col("first_prefix") < F.col("place"))).select("place").distinct()
        stay = stored(undecided.join(barred, "place", "left_anti"), "overlap-stay")
        gone = _pairs(live.join(stay, "place", "left_semi"), live, bags, ratio).select(F.col("later").alias("place")).distinct()
        kept = stay if kept is None else kept.unionByName(stay)
        undecided = stored(undecided.join(stay, "place", "left_anti").join(gone, "place", "left_anti"), "overlap-undecided")
        if not undecided.limit(1).count():
            break
    if undecided.limit(1).count():
        live = entries.join(undecided, "place", "left_semi")
        pairs = stored(_pairs(live, live, bags, ratio), "overlap-pairs")
        while undecided.limit(1).count():
            waiting = pairs.join(undecided.select(F.col("place").alias("earlier")), "earlier", "left_semi").select(F.col("later").alias("place")).distinct()
            stay = stored(undecided.join(waiting, "place", "left_anti"), "overlap-stay")
            gone = pairs.join(stay.select(F.col("place").alias("earlier")), "earlier", "left_semi").select(F.col("later").alias("place")).distinct()
            kept = kept.unionByName(stay)
            undecided = stored(undecided.join(stay, "place", "left_anti").join(gone, "place", "left_anti"), "overlap-undecided")
    empty = rows.where("size(toks) = 0").select(group, order, "text")
    return bags.join(kept, "place", "left_semi").select(group, order, "text").unionByName(empty)
