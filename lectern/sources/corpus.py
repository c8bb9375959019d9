"""Page, file and image sources; keyed, idempotent sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from ..storage import KeyedStore, stored

MIN_NATIVE, MIN_PAGE = 50, 10
BATCH = 100
MAX_FILE, MAX_IMAGE, MIN_SIDE = 100 * 1024 * 1024, 10 * 1024 * 1024, 50


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def page_counts(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds char_count and word_count."""
    return pages.withColumns({"char_count": F.length(text_col), "word_count": word_count(F.col(text_col))})


def select_page_text(pages: DataFrame) -> DataFrame:
    """(native_text, ocr_text) -> text, is_ocr: short native text gives way to longer OCR text; tiny pages go."""
    native, ocr = F.coalesce("native_text", F.lit("")), F.coalesce("ocr_text", F.lit(""))
    use = (F.length(native) < MIN_NATIVE) & (F.length(ocr) > F.length(native))
    picked = pages.withColumn("is_ocr", use).withColumn("text", F.when(use, ocr).otherwise(native))
    return picked.where(F.length("text") >= MIN_PAGE)


def namespace(code: Column) -> Column:
    return F.regexp_replace(F.lower(code), " ", "-")


def files_in(files: DataFrame, allowed: tuple[str, ...] = ("pdf", "docx", "pptx")) -> DataFrame:
    """(path, length) of a binaryFile listing -> accepted files with their type; pdf where there is no extension."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext == "", "pdf").otherwise(ext)
    return files.withColumn("file_type", kind).where(F.col("file_type").isin(*allowed) & (F.col("length") <= MAX_FILE))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Old and new rows with one row a key, that of the latest version; of equal versions the new row stays, and of equal new ones the greatest."""
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("is_new"), *[F.desc(c) for c in new.columns if c not in (*keys, version)]))
    return both.withColumn("version_rank", rank).where("version_rank = 1").drop("version_rank", "is_new")


def upsert_store(spark: SparkSession, folder: str, keys: list[str], fields: str, new: DataFrame, version: int) -> KeyedStore:
    """Puts rows into a keyed table of buckets and returns it. Only the new rows are written; rows of an earlier version
    with the same keys give way when the table is read. The same version again changes nothing. One row a key."""
    store = KeyedStore(spark, folder, keys, fields)
    store.write(new, version)
    return store


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str], scopes: DataFrame | None = None) -> DataFrame:
    """Rows of the given scopes (by default those that new holds) are deleted, then new is added."""
    return old.join((new if scopes is None else scopes).select(*scope).distinct(), scope, "left_anti").unionByName(new, allowMissingColumns=True)


def write_scopes(df: DataFrame, path: str, partition: str) -> None:
    """Overwrites exactly the partitions that df holds; running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def interaction_rows(df: DataFrame, scores: list[str]) -> DataFrame:
    """Interaction rows with their scores as ragas_json, null when there is none."""
    some = F.coalesce(*[F.col(s).cast("string") for s in scores]).isNotNull()
    return df.withColumn("ragas_json", F.when(some, F.to_json(F.struct(*scores), {"ignoreNullFields": "false"}))).drop(*scores)


def append_interactions(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("course_id").parquet(path)


def latest_document(df: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(version, *rest)).alias("newest")).select(key, "newest.*")


#: Ranges that the rows of a group are dealt in to be numbered.
NUMBER_PARTS = 64


def batches(rows: DataFrame, group: str, order: str, size: int = BATCH) -> DataFrame:
    """Adds batch: consecutive runs of size rows of a group in order; ties by all other columns.

    Rows are dealt in ranges of the order and numbered inside a range of a group; the rows of a group in the ranges
    before it are added from counts, so that a large group is numbered by many tasks. Ranges of whole numbers follow from
    the least and greatest one; for orders of any other type Spark's range partitioner samples them, and the dealt rows
    are stored, so that a task that runs again finds the same ranges.
    """
    rest = [c for c in rows.columns if c not in (group, order)]
    if isinstance(rows.schema[order].dataType, IntegralType):
        bounds = rows.where(F.col(order).isNotNull()).agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
        width = max(1, -(-((bounds["high"] or 0) - (bounds["low"] or 0) + 1) // NUMBER_PARTS))
        dealt = rows.withColumn("part", F.coalesce(F.floor((F.col(order) - (bounds["low"] or 0)) / width), F.lit(-1)).cast("long"))
    else:
        dealt = stored(rows.repartitionByRange(NUMBER_PARTS, group, order, *rest).withColumn("part", F.spark_partition_id().cast("long")), "dealt")
    counts = dealt.groupBy(F.col(group).alias("held_group"), F.col("part").alias("held_part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("held_group").orderBy("held_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("held_group", "held_part", before.alias("before"))
    place = F.row_number().over(Window.partitionBy(group, "part").orderBy(order, *rest))
    numbered = dealt.withColumn("place", place).join(starts, F.col(group).eqNullSafe(F.col("held_group")) & (F.col("part") == F.col("held_part")))
    return numbered.select(*rows.columns, F.floor((F.col("before") + F.col("place") - 1) / size).alias("batch"))


def batch_outcomes(rows: DataFrame, group: str, ok: str) -> DataFrame:
    """Per group: total, upserted and failed_batches; a batch fails whole when one of its rows does."""
    per_batch = rows.groupBy(group, "batch").agg(F.count("*").alias("n"), F.min(F.col(ok).cast("int")).alias("good"))
    return per_batch.groupBy(group).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("upserted"), F.count_if(F.col("good") == 0).alias("failed_batches"))


def ingest_status(total: Column, upserted: Column, failed: Column) -> Column:
    return F.when((total > 0) & (failed == 0), "completed").when(upserted > 0, "partial").otherwise("failed")


def mark_read(rows: DataFrame, user: object) -> tuple[DataFrame, DataFrame]:
    """(rows with the user's unread ones read, how many changed)."""
    hit = (F.col("user_id") == F.lit(user)) & ~F.col("is_read")
    return rows.withColumn("is_read", F.when(hit, True).otherwise(F.col("is_read"))), rows.agg(F.count_if(hit).alias("changed"))


def cascade(children: DataFrame, key: str, removed: DataFrame) -> DataFrame:
    """Children of removed parents go."""
    return children.join(removed.select(key).distinct(), key, "left_anti")


def set_null(children: DataFrame, key: str, removed: DataFrame) -> DataFrame:
    """References to removed parents become null."""
    gone = removed.select(F.col(key).alias("gone_key")).distinct()
    joined = children.join(gone, F.col(key) == F.col("gone_key"), "left")
    return joined.withColumn(key, F.when(F.col("gone_key").isNull(), F.col(key))).drop("gone_key")


PNG, JPEG = bytes([0x89, 0x50, 0x4E, 0x47]), bytes([0xFF, 0xD8, 0xFF])


def screen_images(images: DataFrame) -> DataFrame:
    """Images of at least 50 px each way, with oversized flag and format by extension, else by magic bytes."""
    ext = F.lower(F.coalesce("ext", F.lit("")))
    head = F.substring("content", 1, 4)
    kind = F.when(ext == "png", "png").when(ext.isin("jpg", "jpeg"), "jpeg").when(head == F.lit(PNG), "png").when(F.substring("content", 1, 3) == F.lit(JPEG), "jpeg")
    kept = images.where((F.col("width_px") >= MIN_SIDE) & (F.col("height_px") >= MIN_SIDE))
    return kept.withColumn("format", kind).withColumn("oversized", F.col("length") > MAX_IMAGE)


def images_of_pages(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Images on pages that survived parsing."""
    return images.join(pages.select("file", "page").distinct(), ["file", "page"], "left_semi")
