"""A graph of documents, their sources, domains, concepts and versions, as tables of nodes and edges.

Documents: page_id, title, source, domain, version, doc_key, keywords (array). The first document of a page_id counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed value: the name of an unknown source or domain.
OTHER = "기타"


def _plain(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def documents(rows: DataFrame, order: str) -> DataFrame:
    """One row a page, normed: blanks trimmed, unknown sources and domains named, keywords once each."""
    known = lambda c: F.when(_plain(c) == "", OTHER).otherwise(_plain(c))
    words = F.array_distinct(F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.trim(k)), lambda k: k != ""))
    out = rows.select(_plain("page_id").alias("page_id"), _plain("title").alias("title"), known("source").alias("source"), known("domain").alias("domain"), _plain("version").alias("version"), _plain("doc_key").alias("doc_key"), words.alias("keywords"), F.col(order).alias("place"))
    first = Window.partitionBy("page_id").orderBy("place")
    return out.filter("page_id <> ''").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def concepts(docs: DataFrame, least: int) -> DataFrame:
    """(concept, n): keywords of at least `least` documents."""
    return docs.select(F.explode("keywords").alias("concept")).groupBy("concept").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def nodes(docs: DataFrame, least: int = 2) -> DataFrame:
    """(id, label, type, count)."""
    group = lambda c, prefix, kind: docs.groupBy(F.col(c).alias("label")).agg(F.count("*").alias("count")).select(F.concat(F.lit(prefix), "label").alias("id"), "label", F.lit(kind).alias("type"), "count")
    own = docs.select(F.concat(F.lit("doc::"), "page_id").alias("id"), F.when(F.col("title") == "", F.col("page_id")).otherwise(F.col("title")).alias("label"), F.lit("document").alias("type"), F.lit(1).cast("long").alias("count"))
    named = concepts(docs, least).select(F.concat(F.lit("concept::"), "concept").alias("id"), F.col("concept").alias("label"), F.lit("concept").alias("type"), F.col("n").alias("count"))
    return group("source", "src::", "source").unionByName(group("domain", "dom::", "domain")).unionByName(named).unionByName(own)


def version_pairs(docs: DataFrame) -> DataFrame:
    """(source, target) of documents of one doc_key, the earlier one first.

    All pairs of a lineage are asked for; a lineage is the versions of one document, not a group that grows with the corpus.
    """
    own = docs.filter("doc_key <> ''").select("doc_key", "page_id", "place")
    other = own.select("doc_key", F.col("page_id").alias("_page"), F.col("place").alias("_place"))
    return own.join(other, "doc_key").filter(F.col("place") < F.col("_place")).select(F.concat(F.lit("doc::"), "page_id").alias("source"), F.concat(F.lit("doc::"), "_page").alias("target"))


def edges(docs: DataFrame, least: int = 2) -> DataFrame:
    """(source, target, rel): FROM_SOURCE, BELONGS_TO, MENTIONS, VERSION_OF."""
    doc = F.concat(F.lit("doc::"), "page_id").alias("source")
    fixed = docs.select(doc, F.inline(F.array(F.struct(F.concat(F.lit("src::"), "source").alias("target"), F.lit("FROM_SOURCE").alias("rel")), F.struct(F.concat(F.lit("dom::"), "domain").alias("target"), F.lit("BELONGS_TO").alias("rel")))))
    words = docs.select(doc, F.explode("keywords").alias("concept")).join(concepts(docs, least).select("concept"), "concept", "left_semi")
    words = words.select("source", F.concat(F.lit("concept::"), "concept").alias("target"), F.lit("MENTIONS").alias("rel"))
    return fixed.unionByName(words).unionByName(version_pairs(docs).withColumn("rel", F.lit("VERSION_OF")))


def hierarchy(docs: DataFrame) -> DataFrame:
    """(source, target, rel) of the tree root, source, domain folder, page."""
    folder = F.concat(F.lit("folder::"), "source", F.lit("/"), "domain")
    top = docs.select(F.lit("root").alias("source"), F.concat(F.lit("src::"), "source").alias("target")).distinct()
    middle = docs.select(F.concat(F.lit("src::"), F.col("source")).alias("source"), folder.alias("target")).distinct()
    pages = docs.select(folder.alias("source"), F.concat(F.lit("doc::"), "page_id").alias("target"))
    return top.unionByName(middle).unionByName(pages).withColumn("rel", F.lit("CONTAINS"))


def cross_domain_links(docs: DataFrame, least: int = 2) -> DataFrame:
    """(concept, source, target): for each concept the first page of each of its domains, chained in order of domain."""
    rows = docs.select("page_id", "domain", "place", F.explode("keywords").alias("concept")).join(concepts(docs, least).select("concept"), "concept", "left_semi")
    first = rows.groupBy("concept", "domain").agg(F.min(F.struct("place", "page_id")).alias("page"))
    out = first.select("concept", F.col("page.page_id").alias("source"), F.lead("page.page_id").over(Window.partitionBy("concept").orderBy("domain")).alias("target"))
    return out.filter(F.col("target").isNotNull())


def report(docs: DataFrame, least: int = 2) -> DataFrame:
    """One row: documents, isolated ones, mean concepts a document; concepts, share over several domains, mean and greatest degree, the latter in per cent of documents."""
    rows = docs.select("page_id", "domain", F.explode("keywords").alias("concept"))
    per = rows.groupBy("concept").agg(F.count("*").alias("n"), F.count_distinct("domain").alias("domains")).filter(F.col("n") >= least)
    known = rows.join(per.select("concept"), "concept", "left_semi").groupBy("page_id").agg(F.count("*").alias("links"))
    by_doc = docs.select("page_id").join(known, "page_id", "left").agg(F.count("*").alias("documents"), F.count_if(F.col("links").isNull()).alias("isolated"), F.round(F.avg(F.coalesce("links", F.lit(0))), 6).alias("mean_links"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    by_concept = per.agg(F.count("*").alias("concepts"), zero(F.avg((F.col("domains") > 1).cast("double"))).alias("cross_domain"), zero(F.avg("n")).alias("mean_degree"), F.coalesce(F.max("n"), F.lit(0)).alias("top_degree"))
    out = by_doc.join(F.broadcast(by_concept), F.lit(True))  # one row each
    return out.withColumn("hairball", zero(F.try_divide(F.col("top_degree") * 100.0, F.col("documents"))))


# Keywords that name nothing.
NOISE_PARTS = ("masked_", "coderabbit", "checklist", "failed checks", "passed checks", "warning)", "bugfix")
NOISE = (
    "영향 범위", "확인 방법", "개요", "요약", "목차", "비고", "기타", "참고", "주의", "배경", "목적", "결론", "제목",
    "변경 사항", "변경사항", "온램프 정제 테스트", "onramp 정제 테스트",
    "on", "off", "summary", "please note", "note", "see", "see also", "example", "overview",
    "yes", "no", "true", "false", "todo", "done", "wip", "n/a", "tbd", "changes", "none",
)


def is_noise(keyword: Column) -> Column:
    """Whether a keyword names no concept: one letter or none, a sentence, a sign at its begin, a word of the lists."""
    plain = F.btrim(F.regexp_replace(F.coalesce(keyword, F.lit("")), r"(?U)\s+", " "), F.lit(" .,;:()[]"))
    lower, n = F.lower(plain), F.length(plain)
    out = (n <= 1) | (n > 40) | ~F.rlike(plain, F.lit(r"^[\p{L}\p{N}]")) | lower.isin(*NOISE)
    for part in NOISE_PARTS:
        out = out | F.contains(lower, F.lit(part))
    return out


def cleaned(docs: DataFrame) -> DataFrame:
    return docs.withColumn("keywords", F.filter("keywords", lambda k: ~is_noise(k)))


def keyword_diagnosis(docs: DataFrame, top: int = 25) -> DataFrame:
    """(noise, place, keyword, n): the most frequent keywords that are noise, and those that aren't."""
    counts = docs.select(F.explode("keywords").alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))
    counts = counts.withColumn("noise", is_noise(F.col("keyword")))
    order = Window.partitionBy("noise").orderBy(F.desc("n"), F.desc("keyword"))
    return counts.select("noise", F.row_number().over(order).alias("place"), "keyword", "n").filter(F.col("place") <= top)


def from_chunks(chunks: DataFrame) -> DataFrame:
    """Documents of chunks (page_id, place, title, domain, source, site, version, doc_key, keywords): the first chunk's attributes, all keywords.

    Pages of repositories are known by their id.
    """
    known = lambda *names: F.coalesce(*(F.when(_plain(n) != "", _plain(n)) for n in names))
    first = lambda c, name: F.min_by(c, F.col("place")).alias(name)
    source = F.when(F.startswith(_plain("page_id"), F.lit("gh:")), "github").otherwise(F.coalesce(known("source", "site"), F.lit("confluence")))
    rows = chunks.filter(_plain("page_id") != "").groupBy(_plain("page_id").alias("page_id")).agg(
        first(F.coalesce(known("title"), _plain("page_id")), "title"), first(_plain("domain"), "domain"), first(source, "source"), first(_plain("version"), "version"), first(_plain("doc_key"), "doc_key"), F.min("place").alias("place"), F.collect_list("keywords").alias("_words")
    )
    words = F.array_sort(F.array_distinct(F.filter(F.transform(F.flatten("_words"), lambda k: F.trim(k)), lambda k: k != "")))
    return rows.withColumn("keywords", words).drop("_words")


def snapshot(docs: DataFrame, least: int = 2) -> DataFrame:
    """Nodes and edges of the graph as JSON, a line each, for a reader outside of Spark."""
    told = nodes(docs, least).select(F.to_json(F.struct(F.lit("node").alias("is"), "id", "label", "type", "count")).alias("line"))
    return told.unionByName(edges(docs, least).select(F.to_json(F.struct(F.lit("edge").alias("is"), "source", "target", "rel")).alias("line")))
