"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is set, a local master gets a temporary one, and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to reliable storage and continue from there, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again; column pruning and filters reach the files."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text as an array; null gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with value computed once even where body names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names derived from names that df doesn't have."""
    out = []
    for name in names:
        while name in df.columns or name in out:
            name = f"_{name}"
        out.append(name)
    return out


def prefix_sum(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds name: the sum of value over all earlier rows of the group, ordered by bucket and then by order.

    No task holds a whole group: rows are summed within a bucket, and only one row per bucket is summed over the
    group. The caller picks enough buckets for its largest group. Nulls in group compare equal.
    """
    keys = [*group, bucket]
    per = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    per = per.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)))
    right = per.select(*(F.col(k).alias(f"_r_{k}") for k in keys), F.coalesce("_before", F.lit(0)).alias("_before"))
    within = F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    out = df.withColumn("_within", F.coalesce(within, F.lit(0))).join(right, same)
    return out.withColumn(name, F.col("_before") + F.col("_within")).drop("_before", "_within", *(f"_r_{k}" for k in keys))


def field(schema: str) -> T.StructType:
    return T._parse_datatype_string(schema)
