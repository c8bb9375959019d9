"""Materials from a stream - files or rows - to pages and chunks, with a status for each and retries of those that fail."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import sliding_chunks
from ..sources.corpus import files_in
from ..storage import Files, KeyedStore, shared_folder, stored
from .streams import run_available

#: How often a material that failed is tried again.
RETRIES = 3


def pages_of_text(content: bytes | str, attempt: int) -> list[str]:
    """The default parser: UTF-8 text whose pages end with a form feed. A material without any text fails."""
    text = content.decode("utf-8") if isinstance(content, bytes | bytearray) else content or ""
    pages = text.split("\f")
    if not any(p.strip() for p in pages):
        raise ValueError("no text")
    return pages


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """(material_id, length, content) of the files that appear in a folder, whatever the store Spark reads it from; the path is the id."""
    reader = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length long, content binary")
    return reader.load(folder).select(F.col("path").alias("material_id"), "length", "content")


class Ingested:
    """Where an ingest keeps what it made: statuses by material, and chunks by batch."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str):
        self.spark, self.folder, self.id_type = spark, folder.rstrip("/"), id_type
        self.statuses = KeyedStore(spark, f"{self.folder}/statuses", ["material_id"], f"material_id {id_type}, status string, attempts int, page_count int, error string")

    def materials(self) -> DataFrame:
        """(material_id, status, attempts, page_count, error): ready, failed or rejected, the newest word on each."""
        return self.statuses.read()

    def chunks(self) -> DataFrame:
        """(material_id, page_number, chunk_index, content) of the materials that are ready, as their last ingest left them."""
        schema = f"material_id {self.id_type}, page_number int, chunk_index int, content string, ingest_batch long"
        if not Files(self.spark, self.folder).names(f"{self.folder}/chunks"):
            return self.spark.createDataFrame([], schema).drop("ingest_batch")
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/chunks")
        last = rows.groupBy(F.col("material_id").alias("of")).agg(F.max("ingest_batch").alias("last"))
        ready = self.statuses.read().where("status = 'ready'").select(F.col("material_id").alias("ready_id"))
        return rows.join(last, (F.col("material_id") == F.col("of")) & (F.col("ingest_batch") == F.col("last")), "left_semi").join(ready, F.col("material_id") == F.col("ready_id"), "left_semi").drop("ingest_batch")


def parsed(materials: DataFrame, parse: Callable, attempt: int) -> DataFrame:
    """(material_id, page_number, text, n_pages, error): a row a page, or one row with the error of a material that fails."""
    key = materials.schema["material_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for material, content in zip(frame["material_id"], frame["content"]):
                try:
                    pages = list(parse(content, attempt))
                    rows += [(material, i + 1, p, len(pages), None) for i, p in enumerate(pages)] or [(material, None, None, 0, "no pages")]
                except Exception as error:  # one material's failure is its own
                    rows.append((material, None, None, 0, f"{type(error).__name__}: {error}"))
            out = pd.DataFrame(rows, columns=["material_id", "page_number", "text", "n_pages", "error"])
            yield out.astype({"page_number": "Int32", "n_pages": "int32"})

    return materials.select("material_id", "content").mapInPandas(run, f"material_id {key}, page_number int, text string, n_pages int, error string")


def ingest(materials: DataFrame, parse: Callable = pages_of_text, folder: str | None = None, retries: int = RETRIES) -> Ingested:
    """Runs a stream of materials (material_id, content, for files also length) to the end of what is there.

    parse(content, attempt) gives the pages of a material. Where it raises, the material is tried again, up to retries
    times, alone: others go on. Then its status is failed, with the last error; else it is ready, and its pages are
    cut into sliding chunks. Files of other kinds or over the size limit are rejected. A material that comes again takes
    the place of its earlier ingest; a batch that is replayed overwrites what it wrote. The first of equal ids in a
    batch counts; rows without id are no materials.
    """
    spark = materials.sparkSession
    made = Ingested(spark, folder or shared_folder(spark, "ingest"), materials.schema["material_id"].dataType.simpleString())

    def each(batch: DataFrame, number: int) -> None:
        queue = batch.where("material_id is not null").dropDuplicates(["material_id"])
        found = []
        if "length" in batch.columns:
            accepted = files_in(queue.select(F.col("material_id").alias("path"), "length")).select(F.col("path").alias("accepted"))
            refused = queue.join(accepted, F.col("material_id") == F.col("accepted"), "left_anti")
            found.append(refused.select("material_id", F.lit("rejected").alias("status"), F.lit(0).alias("attempts"), F.lit(0).alias("page_count"), F.lit("kind or size").alias("error")))
            queue = queue.join(accepted, F.col("material_id") == F.col("accepted"), "left_semi")
        for attempt in range(1, retries + 2):
            pages = stored(parsed(queue, parse, attempt), "pages")
            good = pages.where("error is null")
            chunks = sliding_chunks(good.select("material_id", "page_number", "text")).select("material_id", "page_number", F.col("chunk_index").cast("int").alias("chunk_index"), "content", F.lit(number).cast("long").alias("ingest_batch"))
            chunks.write.mode("overwrite").parquet(f"{made.folder}/chunks/{number}-{attempt}")
            found.append(good.groupBy("material_id").agg(F.lit("ready").alias("status"), F.lit(attempt).alias("attempts"), F.max("n_pages").alias("page_count"), F.lit(None).cast("string").alias("error")))
            bad = pages.where("error is not null")
            if not bad.limit(1).count():
                break
            if attempt > retries:
                found.append(bad.select("material_id", F.lit("failed").alias("status"), F.lit(attempt).alias("attempts"), F.lit(0).alias("page_count"), "error"))
            queue = queue.join(bad.select(F.col("material_id").alias("bad_id")), F.col("material_id") == F.col("bad_id"), "left_semi")
        statuses = found[0]
        for more in found[1:]:
            statuses = statuses.unionByName(more)
        made.statuses.write(statuses, number)

    run_available(materials, each, made.folder)
    return made
