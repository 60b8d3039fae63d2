"""Sources and sinks on files that Spark reads: JSON lines, repositories of Markdown, issues, pages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.ledger import latest


def page_scan(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Pages in order of title and id, `limit` of them."""
    out = pages.orderBy("title", "page_id")
    return out if limit is None else out.limit(limit)


def chunk_scan(chunks: DataFrame) -> DataFrame:
    """The chunks that have an id and a content."""
    return chunks.filter((F.coalesce(F.col("chunk_id").cast("string"), F.lit("")) != "") & (F.coalesce("content", F.lit("")) != ""))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file of the given schema; a line that isn't an object fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def replace_jsonl(rows: DataFrame, path: str) -> str:
    """rows in a new folder below path, complete before the name of the current one, a table of one row, points to it."""
    spark = rows.sparkSession
    out = f"{path}/{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").json(out)
    spark.range(1).select(F.lit(out).alias("current")).write.mode("overwrite").parquet(f"{path}/current")
    return out


def read_current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that replace_jsonl wrote last."""
    return read_jsonl(spark, spark.read.parquet(f"{path}/current").first().current, schema)


def last_writer_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return latest(rows, [key], F.desc(order))


def recent_pages(pages: DataFrame, as_of: Column, hours: int, limit: int) -> DataFrame:
    """The pages changed in the last hours, newest first."""
    if hours <= 0 or limit <= 0:
        raise ValueError("hours and limit must be positive")
    since = as_of - F.make_dt_interval(hours=F.lit(hours))
    return pages.filter(F.col("last_modified") >= since).orderBy(F.desc("last_modified"), "page_id").limit(limit)


def distinct_pages(pages: DataFrame, order: str) -> DataFrame:
    """The first row of each page that a paged listing gave."""
    return latest(pages, ["page_id"], F.asc(order))


def repository_docs(files: DataFrame, repo: str, folder: str = "docs") -> DataFrame:
    """(page_id, text) of a repository's README and the Markdown files in folder, of files (path, text)."""
    lower = F.lower("path")
    wanted = (lower == "readme.md") | (lower.endswith(".md") & F.startswith(F.col("path"), F.lit(f"{folder}/")))
    return files.filter(wanted).select(F.concat(F.lit(f"gh:{repo}:"), "path").alias("page_id"), "text")


def issues(rows: DataFrame, repo: str, state: str = "all", pulls: bool = False) -> DataFrame:
    """(page_id, title, text) of issues (number, title, state, is_pull, body, comments array): body and comments that aren't empty."""
    out = rows if state == "all" else rows.filter(F.col("state") == state)
    out = out if pulls else out.filter(~F.coalesce("is_pull", F.lit(False)))
    parts = F.filter(F.concat(F.array(F.coalesce("body", F.lit(""))), F.coalesce("comments", F.array().cast("array<string>"))), lambda x: F.trim(x) != "")
    return out.select(F.concat(F.lit(f"gh:{repo}#"), F.col("number").cast("string")).alias("page_id"), "title", F.array_join(parts, "\n\n").alias("text"))


def previews(chunks: DataFrame, length: int = 160) -> DataFrame:
    """(page_id, chunks: array of chunk_id, preview) in order of chunk."""
    told = F.struct("chunk_id", F.substring("content", 1, length).alias("preview"))
    return chunks.groupBy("page_id").agg(F.sort_array(F.collect_list(told)).alias("chunks"))


def index_records(chunks: DataFrame) -> DataFrame:
    """Chunks in the nested form of the index."""
    top = ["chunk_id", "parent_id", "page_id", "title", "content", "embedding_text", "hash"]
    return chunks.select(*top, F.struct(*(c for c in chunks.columns if c not in top and c != "error")).alias("metadata"))


def numbered(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
