"""Table reading, shared storage and seeds common to the operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The folder that scratch() has opened, for the thread that opened it.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def stored(df: DataFrame, what: str, top: str | None = None) -> DataFrame:
    """Write a frame to the shared folder (or to top) and read it back: cuts lineage, survives lost executors."""
    path = f"{top or _scratch.get() or shared_dir(df.sparkSession)}/lectern-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored inside goes at the end, so whatever is kept of it has to be written before, elsewhere."""
    folder = f"{shared_dir(spark)}/lectern-scratch-{uuid.uuid4().hex}"
    opened = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(opened)
        delete(spark, folder)


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % n, F.lit(0))


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: filters and lambdas above cannot pull its expression into themselves."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


#: Rows in an Arrow batch where the session has Spark's default: texts are long, and a batch stands in memory several times.
BATCH_ROWS = "500"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once, for sessions that were not started with it on their path."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    if getattr(context, "_lectern_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    bundle = Path(tempfile.mkdtemp(prefix="spark-lectern-")) / "lectern.zip"
    with zipfile.ZipFile(bundle, "w") as out:
        for path in top.rglob("*.py"):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(str(bundle))
    context._lectern_shipped = True


#: Called when a task ends: workers are used again, and what one stage keeps would stand beside what the next one needs.
AT_END: list[Callable[[], None]] = []


def give_back() -> None:
    """Frees what caches keep and returns freed memory to the system."""
    for clear in AT_END:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same function of Arrow batches, whose worker gives memory back to the system at the end of the task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def mapped(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """mapInArrow with the package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)


def with_fields(df: DataFrame, columns: list[str], more: str) -> T.StructType:
    """The schema of the named columns followed by those of a DDL string."""
    return T.StructType([df.schema[c] for c in columns] + T.StructType.fromDDL(more).fields)


#: Groups that a sample is taken of, at most: the largest ones. Labels are few; a dirty column may hold anything.
MAX_GROUPS = 1000


def hash_sample(df: DataFrame, group: Column, key: Column, per_group: int) -> DataFrame:
    """About per_group rows of each group (all of a smaller one), those with the least hashes of the key.

    Sizes are one row a group, of MAX_GROUPS groups; rows are then filtered in place, so no group is ranked or gathered in a task.
    """
    found = df.groupBy(group.alias("g")).agg(F.count("*").alias("n")).where("g is not null").orderBy(F.desc("n"), "g").limit(MAX_GROUPS)
    sizes = {r["g"]: r["n"] for r in found.collect()}
    if not sizes:
        return df.where("false")
    cuts = F.create_map(*[F.lit(x) for g, n in sorted(sizes.items()) for x in (g, int(min(1.0, per_group / n) * (1 << 20)))])
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < F.coalesce(F.try_element_at(cuts, group), F.lit(0)))


#: Row keys up to this many are broadcast (8 bytes each); above, both sides are shuffled.
BROADCAST_KEYS = 1_000_000


def without(documents: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents, with all their columns, whose hash of id and text is not in gone (one stored column, gone_src)."""
    rows = documents.select(F.struct(*documents.columns).alias("kept_row"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_src"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    return rows.join(gone, F.col("row_src") == F.col("gone_src"), "left_anti").select("kept_row.*")
