"""What retrieved documents prove: collapse of versions, coverage, duplication, gates and the next step of a search.

Rows are retrieved documents: qid, chunk_id, page_id, doc_key, site, version, is_eol, lineage (array), targets (array),
raw (reranker score), score (search score), recency, hash, snippet. A group is the versions of one document: doc_key, or the page
of a document without one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import scoring, version
from lodestone.functions.text import mask_count


def group_key() -> Column:
    key = F.coalesce(F.col("doc_key"), F.lit(""))
    return F.when(key != "", key).otherwise(F.concat(F.lit("page:"), F.col("page_id").cast("string")))


def lineages(docs: DataFrame) -> DataFrame:
    """(doc_key, lineage, lineage_keys): the known versions of each document in order of version, and their canonical texts.

    Sorted here once a document; a lineage is the versions of one document, not a group that grows with the corpus.
    """
    known = docs.filter((F.coalesce("doc_key", F.lit("")) != "") & (F.coalesce("version", F.lit("")) != "")).select("doc_key", "version").distinct()
    sorted_ = known.select("doc_key", F.struct(version.version_key(F.col("version")).alias("order"), "version", version.canonical(F.col("version")).alias("key")).alias("v"))
    sorted_ = sorted_.groupBy("doc_key").agg(F.sort_array(F.collect_list("v")).alias("v"))
    return sorted_.select("doc_key", F.col("v.version").alias("lineage"), F.col("v.key").alias("lineage_keys"))


def with_lineage(docs: DataFrame, known: DataFrame) -> DataFrame:
    out = docs.join(known.withColumnRenamed("doc_key", "_key"), F.col("doc_key") == F.col("_key"), "left").drop("_key")
    none = F.array().cast("array<string>")
    return out.withColumn("lineage", F.coalesce("lineage", none)).withColumn("lineage_keys", F.coalesce("lineage_keys", none))


def annotated(docs: DataFrame, many: Sequence[str] = (), tiers: Mapping[str, float] | None = None) -> DataFrame:
    """docs (with_lineage) with group_key, version_key, target_keys, raw_currency, fit, authority and evidence.

    Versions are compared by their canonical texts, made once a row; lineages come sorted.
    """
    v, site, eol = (F.col(c) for c in ("version", "site", "is_eol"))
    out = docs.withColumn("group_key", group_key()).withColumn("version_key", version.canonical(v))
    out = out.withColumn("target_keys", F.transform("targets", version.canonical)).withColumn("_place", F.array_position("lineage", v))
    place, known = F.col("_place"), F.size("lineage")
    out = out.withColumn("raw_currency", version.currency_at(place, known, v, site, eol, many))
    match = version.match_at(place, known, F.col("version_key"), F.col("lineage_keys"), F.col("target_keys"))
    out = out.withColumn("fit", F.when(F.size("targets") > 0, match).otherwise(F.col("raw_currency"))).drop("_place")
    out = out.withColumn("authority", scoring.tier_of(site, tiers or {}))
    return out.withColumn("evidence", scoring.evidence(F.col("fit"), F.col("authority")))


def collapsed(docs: DataFrame) -> DataFrame:
    """docs (annotated) with survives: one document a group stays; where versions are compared, one a requested version."""
    tie = (F.desc("fit"), F.desc(F.when(F.size("targets") > 0, F.col("raw_currency")).otherwise(0.0)), F.desc("recency"), F.asc("chunk_id"), F.desc("raw"))
    group = Window.partitionBy("qid", "group_key")
    wanted = F.when(F.size("targets") >= 2, F.size(F.filter("target_keys", lambda t: t == F.col("version_key")))).otherwise(0)
    out = docs.withColumn("_wanted", wanted)
    # one shuffle: rows of a version lie within their group
    out = out.withColumn("_best", F.row_number().over(group.orderBy(*tie))).withColumn("_of_version", F.row_number().over(Window.partitionBy("qid", "group_key", "version_key").orderBy(*tie)))
    out = out.withColumn("_any", F.max("_wanted").over(group))
    survives = F.when(F.col("_any") > 0, F.col("_of_version") <= F.col("_wanted")).otherwise(F.col("_best") == 1)
    return out.withColumn("survives", survives).drop("_wanted", "_best", "_of_version", "_any")


def removed_versions(docs: DataFrame) -> DataFrame:
    """(qid, group_key, versions): the versions of each group that only removed documents have listed, in order of text."""
    gone = docs.filter(~F.col("survives") & (F.coalesce("version", F.lit("")) != ""))
    return gone.groupBy("qid", "group_key").agg(F.sort_array(F.collect_set("version")).alias("versions"))


def scored(queries: DataFrame, survivors: DataFrame, fallback: bool = False, fallback_ratio: float = 0.0) -> DataFrame:
    """One row a query (qid, targets): documents, good_topics, coverage, waiver, missing, duplication, means, overall, sensitivity.

    fallback: without a reranker, documents count as good by their share of the best search score.
    """
    compare = F.size("targets") >= 2
    s = survivors.withColumn("_wanted", F.coalesce(F.array_contains("target_keys", F.col("version_key")), F.lit(False)))
    if fallback:
        s = s.withColumn("_good", F.col("score") >= fallback_ratio * F.max("score").over(Window.partitionBy("qid")))
    else:
        s = s.withColumn("_good", F.col("raw") >= scoring.FLOOR)
    counted = ~(compare & F.col("_wanted"))
    hashed = F.when(F.coalesce("hash", F.lit("")) != "", F.col("hash"))
    per = s.groupBy("qid").agg(
        F.count("*").alias("documents"),
        F.count_distinct(F.when(F.col("_good"), F.col("group_key"))).alias("good_topics"),
        F.collect_set("version_key").alias("_versions"),
        F.slice(F.sort_array(F.collect_list("raw"), asc=False), 1, 2).alias("_tops"),
        scoring.ratio(F.count_distinct(hashed), F.count(hashed), None).alias("_hashes"),
        scoring.ratio(F.count_distinct(F.when(counted, F.col("group_key"))), F.count_distinct(F.when(counted, F.struct("group_key", "version"))), None).alias("_topics"),
        F.avg("evidence").alias("evidence_mean"),
        F.avg("fit").alias("fit_mean"),
        F.avg("authority").alias("authority_mean"),
        F.max("recency").alias("recency"),
        F.least(F.lit(1.0), F.sum(mask_count(F.col("snippet"))) / scoring.MASK_CAP).alias("sensitivity"),
        F.bool_and("is_eol").alias("deprecated"),
    )
    out = queries.select("qid", "targets").join(per, "qid", "left")
    found = F.filter("targets", lambda t: F.array_contains(F.coalesce("_versions", F.array().cast("array<string>")), version.canonical(t)))
    top, second = F.get("_tops", F.lit(0)), F.get("_tops", F.lit(1))
    waiver = F.lit(False) if fallback else F.coalesce(~compare & (top >= scoring.STRONG) & (second.isNull() | (F.round(top - second, 9) >= scoring.GAP)), F.lit(False))
    topics = F.least(F.lit(1.0), F.coalesce("good_topics", F.lit(0)) / scoring.TOPICS)
    out = out.withColumn("waiver", waiver)
    out = out.withColumn("coverage", F.when(F.col("documents").isNull(), 0.0).when(compare, F.size(found) / F.size("targets")).when(F.col("waiver"), 1.0).otherwise(topics))
    out = out.withColumn("missing", F.when(compare, F.array_except("targets", found)).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("duplication", F.greatest(1 - F.coalesce("_hashes", F.lit(1.0)), 1 - F.coalesce("_topics", F.lit(1.0))))
    zero = {"documents": 0, "good_topics": 0, "evidence_mean": 0.0, "fit_mean": 0.0, "authority_mean": 0.0, "recency": 0.0, "sensitivity": 0.0, "deprecated": False}
    out = out.fillna(zero).drop("_versions", "_tops", "_hashes", "_topics")
    total = scoring.overall(F.col("evidence_mean"), F.col("coverage"), F.col("duplication"))
    return out.withColumn("overall", F.when(F.col("documents") == 0, 0.0).otherwise(total))


def conflicts(survivors: DataFrame) -> DataFrame:
    """(qid, conflicting): two topics of one site and version stand at nearly the same high score."""
    topics = survivors.filter(F.coalesce("site", F.lit("")) != "").groupBy("qid", "site", "version", "group_key").agg(F.max("raw").alias("top"))
    tiers = topics.groupBy("qid", "site", "version").agg(F.slice(F.sort_array(F.collect_list("top"), asc=False), 1, 2).alias("tops"))
    one, two = F.get("tops", F.lit(0)), F.get("tops", F.lit(1))
    near = F.coalesce((two >= scoring.FLOOR) & (F.round(one - two, 9) < scoring.CONFLICT_GAP), F.lit(False))
    return tiers.groupBy("qid").agg(F.max(near).alias("conflicting"))


def next_step(states: DataFrame, survivors: DataFrame) -> DataFrame:
    """(qid, action, version_filter) of the retry ladder, the first that applies.

    rewrite_query: no good topic. retry_version: a missing requested version is in a lineage, or all documents are of ended
    versions and newer ones are known (the version that helps most documents, then the greatest by text). expand_topics: too few
    topics. proceed otherwise.
    """
    indexed = survivors.select("qid", F.explode(F.arrays_zip("lineage", "lineage_keys")).alias("x"), F.col("chunk_id").alias("c")).select("qid", F.col("x.lineage").alias("v"), F.col("x.lineage_keys").alias("k"), "c")
    indexed = indexed.groupBy("qid", "k").agg(F.min(F.struct("c", "v")).alias("first"))
    wanted = states.select("qid", F.posexplode("missing").alias("place", "m")).withColumn("k", version.canonical(F.col("m")))
    hit = wanted.join(indexed, ["qid", "k"]).groupBy("qid").agg(F.min_by("first.v", F.struct("place", "first.c", "first.v")).alias("indexed"))
    last = F.coalesce(F.try_element_at("lineage", F.lit(-1)), F.lit(""))
    newer = survivors.filter(F.coalesce("doc_key", F.lit("")) != "").withColumn("latest", last)
    newer = newer.filter((F.col("latest") != "") & ~F.coalesce(F.try_element_at("lineage_keys", F.lit(-1)) == F.col("version_key"), F.lit(False)))
    newer = newer.groupBy("qid", "latest").agg(F.count_distinct("doc_key").alias("n")).groupBy("qid").agg(F.max_by("latest", F.struct("n", "latest")).alias("newer"))
    out = states.join(hit, "qid", "left").join(newer, "qid", "left")
    ended = (F.size("targets") == 0) & F.col("deprecated") & (F.col("documents") > 0)
    few = ~F.col("waiver") & (F.size("targets") < 2) & (F.col("good_topics") < scoring.TOPICS)
    action = (
        F.when(F.col("good_topics") == 0, "rewrite_query")
        .when(F.col("indexed").isNotNull(), "retry_version")
        .when(ended & F.col("newer").isNotNull(), "retry_version")
        .when(ended, "proceed")
        .when(few, "expand_topics")
        .otherwise("proceed")
    )
    out = out.withColumn("action", action)
    return out.select("qid", "action", F.when(F.col("action") == "retry_version", F.coalesce("indexed", "newer")).alias("version_filter"))


def merge_passes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Documents of both passes, those of the first where both have one: by chunk_id, or by page and hash without one."""
    both = first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2)))
    chunk = F.coalesce("chunk_id", F.lit(""))
    key = F.when(chunk != "", F.struct(chunk.alias("a"), F.lit("").alias("b"))).otherwise(F.struct(F.col("page_id").cast("string").alias("a"), F.concat(F.lit("#"), F.coalesce("hash", F.lit(""))).alias("b")))
    order = Window.partitionBy("qid", "_key").orderBy("pass", F.desc("score"), "chunk_id")
    return both.withColumn("_key", key).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_key", "_n")
