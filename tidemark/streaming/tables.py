"""A table of latest rows by key that rewrites only the buckets a batch touches.

Rows live in buckets by a hash of their key. A version is a manifest, a small file that
names the folder of each bucket; writing version n copies on write: buckets with keys of
the batch are read, merged and written to new folders, all others are taken over by name.
The manifest appears by one rename, so that a version is there as a whole or not at all,
and a batch that runs again finds its version and does nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """The latest row of each key under ``path``, which all executors share.

    ``order`` names the columns that say which of two rows with one key is later; rows
    that come late but are older change nothing. ``buckets`` counts when the table is
    begun; afterwards the table's own number holds.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order
        found = self._manifest(self.version())
        self.buckets = found["buckets"] if found else buckets

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        fs, where = self._fs(f"{self.path}/manifests")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int | None:
        return max(self.versions(), default=None)

    def _manifest(self, version: int | None) -> dict | None:
        if version is None:
            return None
        fs, where = self._fs(f"{self.path}/manifests/v{version}.json")
        stream = fs.open(where)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, version: int, manifest: dict) -> None:
        fs, temporary = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(temporary)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, final = self._fs(f"{self.path}/manifests/v{version}.json")
        if not fs.rename(temporary, final):
            fs.delete(temporary, False)
            if version not in self.versions():
                raise RuntimeError(f"version {version} of {self.path} can't be published")

    def _rows(self, folders: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def upsert(self, batch: DataFrame, version: int) -> bool:
        """Version ``version``: the one before with the batch's rows; False if it is there already."""
        versions = self.versions()
        if version in versions:
            return False
        before = self._manifest(max((v for v in versions if v < version), default=None)) or {"buckets": self.buckets, "folders": {}, "schema": None}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rest = [c for c in batch.columns if c not in self.keys]
        latest = lambda df: df.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("_r")).select(*self.keys, *[F.col("_r")[c].alias(c) for c in rest])
        new = latest(batch).select(*batch.columns)
        touched = [r["b"] for r in new.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets``
        old = self._rows([f"{self.path}/{before['folders'][str(b)]}" for b in touched if str(b) in before["folders"]], batch.schema)
        place = f"data/v{version}-{uuid.uuid4().hex}"
        merged = latest(old.unionByName(new)).select(*batch.columns, bucket.alias("_bucket"))
        merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{place}")
        folders = before["folders"] | {str(b): f"{place}/_bucket={b}" for b in touched}
        self._publish(version, {"buckets": self.buckets, "folders": folders, "schema": batch.schema.jsonValue()})
        return True

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: batch n is version n."""

        def write(batch: DataFrame, number: int) -> None:
            self.upsert(batch, number)

        return write

    def read(self, version: int | None = None) -> DataFrame:
        """A version's rows, the last one's by default."""
        from pyspark.sql.types import StructType

        found = self._manifest(self.version() if version is None else version)
        if not found:
            raise ValueError(f"{self.path} has no version yet")
        return self._rows([f"{self.path}/{f}" for f in found["folders"].values()], StructType.fromJson(found["schema"]))

    def vacuum(self, keep: int = 2) -> int:
        """Drop all but the last ``keep`` versions and the folders that only they name; how many folders went."""
        versions = self.versions()
        kept = versions[-keep:]
        live = {f for v in kept for f in self._manifest(v)["folders"].values()}
        gone = {f for v in versions for f in self._manifest(v)["folders"].values()} - live
        for v in versions[:-keep]:
            fs, where = self._fs(f"{self.path}/manifests/v{v}.json")
            fs.delete(where, False)
        for f in gone:
            fs, where = self._fs(f"{self.path}/{f}")
            fs.delete(where, True)
        return len(gone)
