"""Deep scans in order that can stop and go on: rows are range-partitioned and sorted once, and a table of bounds tells which parts a scan still has to read.

A step reads the parts behind its key alone, as many as hold the rows it asks for, and sorts nothing but these. Keys are unique and not null; rows with a null in the key come first, in an order of
their own, as Spark sorts them. The table of bounds has a row a part, so its size is the table's size over `rows`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a part, about.
ROWS = 1_000_000


class OrderedScan:
    def __init__(self, spark: SparkSession, root: str, schema, keys: Sequence[str]):
        self.spark, self.root, self.schema, self.keys = spark, root, schema, [*keys]

    @classmethod
    def written(cls, df: DataFrame, keys: Sequence[str], root: str, rows: int = ROWS) -> OrderedScan:
        """Writes df in order of the keys, and its bounds."""
        parts = max(1, -(-df.count() // rows))
        placed = df.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id())
        placed.sortWithinPartitions(*keys).write.partitionBy("part").parquet(f"{root}/rows")
        out = cls(df.sparkSession, root, df.schema, keys)
        stored = df.sparkSession.read.schema(out._with_part()).parquet(f"{root}/rows")
        key = F.struct(*keys)
        stored.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{root}/bounds")
        return out

    def _with_part(self):
        from pyspark.sql import types as T

        return T.StructType([*self.schema.fields, T.StructField("part", T.IntegerType())])

    def _behind(self, names: Sequence[str], key: Sequence) -> Column:
        """Whether the columns come after a key, field by field."""
        out = F.lit(False)
        for name, value in reversed(list(zip(names, key, strict=True))):
            out = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & out)
        return out

    def bounds(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/bounds")

    def rows(self) -> int:
        return self.bounds().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def parts_after(self, key: Sequence | None, limit: int) -> list[int]:
        """The parts that hold the next rows: the one that the key lies in, and those behind it until their rows suffice without the first."""
        bounds = self.bounds()
        if key is not None:
            bounds = bounds.filter(self._behind([f"last.{k}" for k in self.keys], key))
        out, held = [], 0
        for r in bounds.orderBy("first").select("part", "n").toLocalIterator():
            out.append(r.part)
            held += r.n if len(out) > 1 or key is None else 0
            if held >= limit:
                break
        return out

    def after(self, key: Sequence | None, limit: int) -> DataFrame:
        """The next rows behind a key in order, from the beginning without one."""
        stored = self.spark.read.schema(self._with_part()).parquet(f"{self.root}/rows").filter(F.col("part").isin(self.parts_after(key, limit)))
        if key is not None:
            stored = stored.filter(self._behind(self.keys, key))
        return stored.drop("part").orderBy(*self.keys).limit(limit)

    def last_key(self, rows: DataFrame) -> tuple | None:
        """The key behind which a scan goes on after these rows; None of no rows."""
        last = rows.agg(F.max(F.struct(*self.keys)).alias("k")).first().k
        return None if last is None else tuple(last)
