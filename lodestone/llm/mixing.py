"""Mixing sources to target weights with a low-discrepancy schedule.

1. Targets: sources share the total by weight; none gets more than `most` times its size, and what it leaves is shared
   again by weight. That level is found from prefix sums over the sources sorted by size and weight.
2. Schedule: the slots 0, 1, ... of the mix, `block` words each, map to golden-ratio points, and these through the
   cumulative targets to sources. Every stretch of the mix has nearly the target shares.
3. Blocks: a source's documents, shuffled by hash, are laid end to end and cut into blocks of equal words; a document may
   lie in several. A source's slots are ranked, and slot r takes block r modulo the number of blocks.
4. A document's words are taken as often as slots took its blocks, `most` times at the most.

Only DataFrame functions are used. Documents and slots are numbered by prefix sums over buckets, so a source of a third of
all rows is spread over many tasks; sources themselves must fit a window (millions do).

A null text has no words; a null source is a source of its own, after all others. Documents without words are
returned with taken = 0. Rows of one id are separate documents. Empty input gives no rows. Extra columns aren't read, whatever
their names. A very long document lies in many blocks. Equal hashes are ordered by id, then by
where a row stands among those of its id by source and text. The length of a block
follows from the total: it only makes the schedule of small mixes finer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, prefix_sum, word_count

WEIGHTS, MOST, SEED = (1, 2, 3), 3, 17
#: Words in a block, fewer where the mix would have under SLOTS slots; documents in a bucket of the shuffled order, slots in one.
BLOCK, SLOTS, DOCUMENTS, RANKED = 1024, 1 << 17, 1024, 4096
#: Golden-ratio points are multiples of STEP / PERIOD, kept in whole numbers; PERIOD is prime.
PERIOD = 2_147_483_647
STEP = round(PERIOD * (5**0.5 - 1) / 2)
CELLS = 4096


def source_sizes(docs: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """(source, source_size, documents, weight) of docs (source, size); weights repeat over the sources by code point, null last."""
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sums.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int")))


def targets(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """sizes with target: shares of the total by weight, most times the size at the most."""
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    fuller = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = F.lit(float(most)) * F.col("source_size")
    out = sizes.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
    out = out.withColumn("_capped", F.coalesce(F.sum(cap).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = out.withColumn("_weights", F.sum("weight").over(fuller))
    # the water level if this source and all fuller ones stay below their caps
    out = out.withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_weights"))
    level = F.max(F.when(F.col("_level") * F.col("weight") <= cap, F.col("_level"))).over(everything)
    return out.withColumn("target", F.least(cap, F.coalesce(level * F.col("weight"), cap))).drop("_total", "_capped", "_weights", "_level")


def schedule(shares: DataFrame, slots: int) -> DataFrame:
    """(slot, source): golden-ratio points mapped through the cumulative targets of shares (source, target)."""
    spark = shares.sparkSession
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    ends = shares.filter("target > 0").withColumn("hi", F.sum("target").over(ordered) / F.sum("target").over(Window.partitionBy()))
    ends = ends.withColumn("lo", F.coalesce(F.lag("hi").over(ordered), F.lit(0.0)))
    last = F.row_number().over(Window.orderBy(F.col("source").desc_nulls_first())) == 1
    ends = ends.withColumn("hi", F.when(last, F.lit(2.0)).otherwise(F.col("hi")))  # sums of doubles may end below 1
    # a range join as an equi-join: a source is listed in every cell of [0, 1) that it touches
    cells = F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int"))
    listed = ends.select("source", "lo", "hi", F.explode(F.when(F.col("lo") < 1, cells)).alias("cell"))
    point = ((F.col("slot") % PERIOD) * STEP % PERIOD) / F.lit(float(PERIOD))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
    met = points.join(listed, "cell").filter((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")))
    return met.select("slot", "source")


def ranked(slots: DataFrame) -> DataFrame:
    """slots with rank: how many earlier slots their source has."""
    dealt = slots.select("slot", "source", F.floor(F.col("slot") / RANKED).alias("stretch"), F.lit(1).cast("long").alias("one"))
    return prefix_sum(dealt, ["source"], "stretch", ["slot"], "one", "rank").select("slot", "source", "rank")


def _hash(*columns: Column) -> Column:
    return F.xxhash64(F.lit(SEED), *columns)


def laid_out(docs: DataFrame, documents: int) -> DataFrame:
    """docs (key, source, size) with start: words of its source before a document, in shuffled order."""
    buckets = max(16, min(1 << 16, -(-documents // DOCUMENTS)))
    shuffled = docs.withColumn("_order", _hash("key"))
    shuffled = shuffled.withColumn("_bucket", F.pmod(F.shiftright("_order", 16), F.lit(buckets)))
    return prefix_sum(shuffled, ["source"], "_bucket", ["_order", "key"], "size", "start").drop("_order", "_bucket")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """docs (key, source, size) with source_size, target and taken; key must differ between rows."""
    docs = cut(docs)
    shares = cut(targets(source_sizes(docs, weights), most))
    total, documents = shares.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("documents"), F.lit(0))).first()
    block = max(1, min(block, total // SLOTS))
    numbered = ranked(schedule(shares, -(-total // block)))
    plain = shares.select(F.col("source").alias("_s"), "source_size", "target")
    blocks = F.ceil(F.col("source_size") / block)
    taken = numbered.join(plain, F.col("source").eqNullSafe(F.col("_s"))).filter(F.col("rank") < most * blocks)
    taken = taken.groupBy(F.col("source").alias("_s"), (F.col("rank") % blocks).alias("_block")).agg(F.count("*").alias("times"))
    placed = laid_out(docs.filter("size > 0"), documents)
    piece = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    pieces = placed.select("key", "source", "start", "size", piece.alias("block"))
    inside = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    met = pieces.withColumn("words", inside).join(taken, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_block")))
    sums = met.groupBy("key").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = docs.join(plain, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return out.join(sums, "key", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def keyed(docs: DataFrame, name: str, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with a key in the column name, different in every row: the id (for null ids the text's hash) and a number among rows of that id."""
    hashed = F.xxhash64(F.col(text))
    within = F.when(F.col(id).isNull(), hashed)  # rows without id are no hot group
    order = Window.partitionBy(F.col(id), within).orderBy(F.col(source), hashed)
    return docs.withColumn(name, F.struct(F.col(id).cast("long").alias("doc_id"), within.alias("hash"), F.row_number().over(order).alias("n")))


def sized(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, doc_id, source, size) of docs."""
    hashed = F.xxhash64(F.col(text))  # texts themselves aren't shuffled
    slim = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), hashed.alias("hash"))
    within = F.when(F.col("doc_id").isNull(), F.col("hash"))
    n = F.row_number().over(Window.partitionBy("doc_id", within).orderBy("source", "hash"))
    return slim.select(F.struct("doc_id", within.alias("hash"), n.alias("n")).alias("key"), "doc_id", "source", "size")


def whole_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs, each row as often as the mix takes it: taken / size, rounded up or down by the row's hash, so that sums stay near."""
    shares = mix(sized(docs, id, text, source), weights, most)
    part = F.pmod(_hash(F.lit("round"), "key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(F.coalesce(F.try_divide(F.col("taken").cast("double"), F.col("size")), F.lit(0.0)) + part).cast("int")
    key, deal, taken, n, copy = fresh(docs, "_key", "_deal", "_taken", "_times", "_copy")
    told = shares.filter("taken > 0").select(F.xxhash64("key").alias(deal), F.col("key").alias(taken), times.alias(n)).filter(F.col(n) > 0)
    rows = keyed(docs, key, id, text, source)
    same = (F.xxhash64(key) == F.col(deal)) & F.col(key).eqNullSafe(F.col(taken))
    return rows.join(told, same).withColumn(copy, F.explode(F.sequence(F.lit(1), n))).select(*docs.columns)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(sized(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")))
    return out.select("doc_id", "size", "source_size", "target", "taken")
