"""Stored tables with versions: a manifest names what belongs to a version, so that readers of an older one go on seeing it.

A version exists once its manifest is written, which is one file. Data of a version are never changed afterwards; a job that fails before leaves files that no
manifest names, and can be run again. There is one writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Manifest:
    """Rows of a schema for each version, below a folder."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root, schema
        self._read: dict[int, list] = {}

    def _path(self, version: int) -> str:
        return f"{self.root}/manifest/version={version}"

    def _files(self, path: str) -> list[str]:
        """Names in a folder, none where it doesn't exist."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []

    def versions(self) -> list[int]:
        """Committed versions in order."""
        named = sorted(int(x.removeprefix("version=")) for x in self._files(f"{self.root}/manifest") if x.startswith("version="))
        return [v for v in named if "_SUCCESS" in self._files(self._path(v))]

    def latest(self) -> int:
        """The greatest version, 0 before the first."""
        return max(self.versions(), default=0)

    def read(self, version: int) -> list:
        """The rows of a version."""
        if version == 0:
            return []
        if version not in self._read:
            if "_SUCCESS" not in self._files(self._path(version)):
                raise ValueError(f"there is no version {version}")
            self._read[version] = self.spark.read.schema(self.schema).parquet(self._path(version)).collect()
        return self._read[version]

    def commit(self, version: int, rows: Sequence[tuple]) -> None:
        """Writes a version; one that is committed already is an error."""
        if "_SUCCESS" in self._files(self._path(version)):
            raise ValueError(f"version {version} exists")
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("overwrite").parquet(self._path(version))


class KeyedTable:
    """Rows with unique keys, in buckets by the hash of the key. A change rewrites the buckets of its keys alone.

    buckets: how many; a bucket should stay below some hundred MB, as it is what a small change rewrites. The manifest has a row for each bucket that isn't empty, with the
    version whose folder holds it; so its size is bounded by the number of buckets. Null keys are keys like others.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.root, self.keys, self.buckets = spark, root, [*keys], buckets
        self.schema = T._parse_datatype_string(schema)
        self.manifest = Manifest(spark, root, "bucket int, held int")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _held(self, version: int | None) -> dict[int, int]:
        return {r.bucket: r.held for r in self.manifest.read(self.manifest.latest() if version is None else version)}

    def _rows(self, held: dict[int, int]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/data/version={v}/bucket={b}" for b, v in sorted(held.items())))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest unless one is named."""
        return self._rows(self._held(version))

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of these keys, from their buckets alone."""
        wanted = {r.bucket for r in keys.select(self.bucket().alias("bucket")).distinct().collect()}
        rows = self._rows({b: v for b, v in self._held(version).items() if b in wanted})
        return self._matched(rows, keys, "left_semi")

    def _matched(self, rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        named = keys.select(*(F.col(k).alias(f"_{k}") for k in self.keys)).distinct()
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return rows.join(named, same, how)

    def change(self, rows: DataFrame | None = None, gone: DataFrame | None = None, order: Column | None = None) -> dict[int, int]:
        """Upserts rows, then deletes the keys in gone; returns the new version's buckets and versions.

        Of rows with one key the one of greatest `order` stays, of all columns where none is named.
        """
        names = self.schema.names
        version, held = self.manifest.latest() + 1, self._held(None)
        parts = []
        if rows is not None:
            last = F.max_by(F.struct(*names), F.struct(order, F.struct(*names)) if order is not None else F.struct(*names))
            parts.append(rows.groupBy(*self.keys).agg(last.alias("_row")).select("_row.*").select(*names))
        touched = None
        for df in [*parts, *([gone] if gone is not None else [])]:
            one = df.select(self.bucket().alias("bucket"))
            touched = one if touched is None else touched.unionAll(one)
        if touched is None:
            return held
        touched = {r.bucket for r in touched.distinct().collect()}
        out = self._rows({b: v for b, v in held.items() if b in touched})
        if parts:
            out = self._matched(out, parts[0], "left_anti").unionByName(parts[0])
        if gone is not None:
            out = self._matched(out, gone, "left_anti")
        path = f"{self.root}/data/version={version}"
        out.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        full = {r.bucket for r in self.spark.read.schema(T._parse_datatype_string("bucket int")).parquet(path).distinct().collect()} if touched else set()
        held = {b: v for b, v in held.items() if b not in touched} | {b: version for b in full}
        self.manifest.commit(version, sorted(held.items()))
        return held
