"""The shared folder: stored frames, and keyed tables as logs of changes that are merged when read."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_top(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one in local runs without it, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_top(spark)}/lectern-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The frame written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """The few calls on folders that Spark's readers and writers do not offer."""

    def __init__(self, spark: SparkSession, top: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.files = self.hadoop.Path(top).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        place = self.hadoop.Path(path)
        return sorted(f.getPath().getName() for f in self.files.listStatus(place)) if self.files.exists(place) else []

    def delete(self, path: str) -> None:
        self.files.delete(self.hadoop.Path(path), True)

    def write(self, path: str, text: str) -> None:
        """Appears whole or not at all; a file that is there already stays."""
        place, draft = self.hadoop.Path(path), self.hadoop.Path(f"{path}.{uuid.uuid4().hex}.draft")
        out = self.files.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.files.rename(draft, place):
            self.files.delete(draft, False)


def latest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """One row a key, that of the latest change; of one change the greatest."""
    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "change_version")]
        return rows.groupBy(*keys).agg(F.max(F.struct("change_version", *rest)).alias("newest")).select(*keys, "newest.*")

    return merge


def summed(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """One row a key, the sums of its changes."""
    def merge(rows: DataFrame) -> DataFrame:
        rest = [f for f in rows.schema.fields if f.name not in (*keys, "change_version")]
        return rows.groupBy(*keys).agg(*[F.sum(f.name).cast(f.dataType).alias(f.name) for f in rest], F.max("change_version").alias("change_version"))

    return merge


class KeyedStore:
    """A keyed table as a log of changes in hash buckets, with a manifest of what counts.

    A change writes only its own rows, into their buckets, and then a manifest that names them; a version that is there
    already changes nothing, so batches can be replayed. Reading merges the parts of a bucket by merge, which has to be
    associative (latest row, sums). When a bucket has fan parts of a level they become one of the next level: a row is
    written again once a level, so what a change writes follows its size and not that of the table. The two newest
    manifests and their parts are kept, so that a reader of the one before is not cut off.

    fields: DDL of the columns, keys first. Parts carry the column change_version besides.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], fields: str, merge: Callable | None = None, buckets: int = 16, fan: int = 4):
        self.spark, self.top, self.keys, self.fields = spark, folder.rstrip("/"), keys, fields
        self.merge, self.buckets, self.fan = merge or latest(keys), buckets, fan
        self.files = Files(spark, self.top)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.top}/manifests") if n.endswith(".json"))

    def _manifest(self, version: int) -> dict[str, list[list]]:
        return json.loads(self.spark.read.text(f"{self.top}/manifests/{version}.json", wholetext=True).first()[0])

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _parts(self, parts: list[tuple[str, str]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], f"{self.fields}, change_version long")
        return self.spark.read.schema(f"{self.fields}, change_version long").parquet(*[f"{self.top}/data/{name}/bucket={b}" for b, name in parts])

    def read(self, keys: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """The table as of the newest version (or the newest before one); with keys, only the buckets that hold them are read."""
        there = [v for v in self.versions() if before is None or v < before]
        manifest = self._manifest(there[-1]) if there else {}
        if keys is not None:
            wanted = {str(r[0]) for r in keys.select(self._bucket()).distinct().collect()}  # at most as many as buckets
            manifest = {b: parts for b, parts in manifest.items() if b in wanted}
        rows = self.merge(self._parts([(b, name) for b, parts in manifest.items() for name, _ in parts])).drop("change_version")
        return rows if keys is None else rows.join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def _put(self, rows: DataFrame, name: str) -> list[str]:
        """Writes a part by buckets and says which there are."""
        rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.top}/data/{name}")
        return [n.split("=")[1] for n in self.files.names(f"{self.top}/data/{name}") if n.startswith("bucket=")]

    def write(self, changes: DataFrame, version: int) -> None:
        """Adds a change; versions rise."""
        there = self.versions()
        if there and version <= there[-1]:
            return
        columns = [f.strip().split(" ")[0] for f in self.fields.split(",") if " " in f.strip()]
        manifest = self._manifest(there[-1]) if there else {}
        for b in self._put(changes.select(*columns, F.lit(version).cast("long").alias("change_version")), str(version)):
            manifest[b] = [*manifest.get(b, []), [str(version), 0]]
        level = 0
        while due := {b: [n for n, at in parts if at == level] for b, parts in manifest.items() if sum(at == level for _, at in parts) >= self.fan}:
            name = f"{version}-{level + 1}"
            self._put(self.merge(self._parts([(b, n) for b, names in due.items() for n in names])), name)
            for b in due:
                manifest[b] = [[name, level + 1], *[p for p in manifest[b] if p[1] != level]]
            level += 1
        self.files.write(f"{self.top}/manifests/{version}.json", json.dumps(manifest))
        self._forget(there[:-1], [manifest] + [self._manifest(v) for v in there[-1:]])

    def _forget(self, versions: list[int], kept: list[dict]) -> None:
        live = {(b, name) for m in kept for b, parts in m.items() for name, _ in parts}
        for v in versions:
            for b, parts in self._manifest(v).items():
                for name, _ in parts:
                    if (b, name) not in live:
                        self.files.delete(f"{self.top}/data/{name}/bucket={b}")
            self.files.delete(f"{self.top}/manifests/{v}.json")
