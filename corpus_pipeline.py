"""The corpus pipeline: quality rules, near-duplicates, repeated passages, source mix, tokens.

STAGES are (name, function); a function takes (spark, docs, sf_dir), where docs has the columns of documents, and returns a
DataFrame. Its rows are written as Parquet and read again for the next stage. All stages but the last return the columns of
documents.

1. quality: documents that the base rules or the learned decision list reject go.
2. near_duplicates: of each group of texts of five-word Jaccard similarity 0.8 or more one row of the least doc_id stays.
3. repeated_passages: words covered by a 13-word window that a document of smaller doc_id has too are cut out of the text.
4. source_mix: every document is repeated, kept or left out as the target weights of the sources say.
5. tokens: token ids, their number, and whether they decode to the text.

Each stage reads the five columns of documents alone, so extra columns are left out, whatever their names. An empty table gives no rows at any stage, and texts of any
length are worked on whole. Rows with a null id or text:

1. a null text has no words, so the base rules reject it; rows without an id are judged by their texts; repeated rows are judged one by one; ties of labels count as the worst.
2. null and empty texts are one group, of which one row stays; a null id stays only where no other id is in its group; of rows alike in all columns one stays.
3. a null text stays null; a row without an id keeps all its words, and rows of one id take none from each other; a text without words left is empty.
4. rows without words are left out; a null source is a source of its own; rows of one id are separate documents, and shares are rounded by a hash, the same in every run.
5. a null text has no ids; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import bpe, mixing, quality, simhash, substring_dedup
from lodestone.llm.common import shared_table, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "byte_bpe_50k.json"
#: DuckDB SQL can express neither the learned rules nor connected components at this size; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality.learn(quality.training_sample(docs, table(spark, sf_dir, "labels")))
    rest = [c for c in COLUMNS if c != "doc_id"]
    return quality.judged(docs, rules, keep=rest).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_key"))
    first = simhash.similar_firsts(docs, "_key").select(F.col("doc_id").alias("_id"), F.col("_key").alias("_kept"))
    kept = docs.join(first, (F.col("_key") == F.col("_kept")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    once = Window.partitionBy("_key", "doc_id").orderBy("text")  # of rows alike in all columns one stays
    return kept.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.whole_documents(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.bpe_round_trip(docs.select(*COLUMNS), public_tokenizers.path(TOKENIZER))
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", by_quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
