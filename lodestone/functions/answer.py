"""The answer stage and the router as column expressions: contexts, validation of model output, statuses and guards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import text_of

PROBE = 80
# Domains, uses of the router, statuses that a model may claim, statuses without an answer.
DOMAINS = ("incident", "manual", "api_reference", "meeting_note", "planning")
SEARCH, UNANSWERABLE = "검색", "답변불가"
CLAIMED = ("answerable", "partially_answerable", "not_enough_evidence")
HELD = ("not_enough_evidence", "conflicting_evidence", "outdated_evidence")
# Fixed texts: labels of an answer's elements, and what is said of a status.
ELEMENTS = {"situation": "상황", "cause": "원인", "evidence": "근거", "solution": "해결", "infra_context": "인프라 맥락"}
NO_SOURCE = "답변을 뒷받침할 인용 출처를 찾지 못했습니다."
REASONS = {
    "partially_answerable": "관련 문서가 있으나 근거가 일부 부족합니다.",
    "not_enough_evidence": "관련 근거를 찾지 못해 답변을 보류합니다.",
    "conflicting_evidence": "문서 간 내용이 충돌해 확인이 필요합니다.",
    "outdated_evidence": "최신 문서를 찾지 못해 제한적으로만 답변합니다.",
}
MISSING = " 버전 문서를 찾지 못해 검색된 버전 기준으로만 답변합니다."
ROUTED = "use_case string, domains array<string>, refined_query string, confidence double, target_versions array<string>"
TARGET = r"^v?\d+(\.\d+)*$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def window_around(whole: Column, part: Column, length: int) -> Column:
    """At most length characters of whole: all of it if short enough, else around the beginning of part, else its beginning."""
    probe = F.substring(strip(text_of(part)), 1, min(PROBE, length))
    at = F.when(probe == "", -1).otherwise(F.position(probe, whole) - 1)
    begin = F.greatest(F.lit(0), at - F.greatest(F.lit(0), F.floor((F.lit(length) - F.length(probe)) / 2)))
    around = strip(F.substr(whole, (begin + 1).cast("int"), F.lit(length)))
    head = F.regexp_replace(F.substring(whole, 1, length), r"(?U)\s+\z", "")
    return whole if length <= 0 else F.when(F.length(whole) <= length, whole).when(at < 0, head).otherwise(around)


def contexts(docs: DataFrame, parents: DataFrame, length: int = 0) -> DataFrame:
    """(qid, place, title, content): what a model reads of docs (qid, place, title, snippet, parent_id).

    A known parent (parent_id, content) stands for its children, once a query, at the place of the first; other documents keep their snippet.
    """
    known = parents.select(F.col("parent_id").alias("_parent"), F.col("content").alias("_content"))
    out = docs.join(known, F.col("parent_id") == F.col("_parent"), "left")
    first = F.row_number().over(Window.partitionBy("qid", "_parent").orderBy("place"))
    out = out.withColumn("_n", F.when(F.col("_parent").isNull(), 1).otherwise(first)).filter("_n = 1")
    content = F.when(F.col("_parent").isNull(), text_of(F.col("snippet"))).otherwise(window_around(text_of(F.col("_content")), F.col("snippet"), length))
    return out.select("qid", "place", "title", content.alias("content"))


def context_text(blocks: DataFrame) -> DataFrame:
    """(qid, context): the blocks of each query in order, each under its own number, which citations name."""
    told = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] title: "), text_of(F.col("title")), F.lit("\ncontent: "), F.col("content"))
    listed = blocks.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", told.alias("text")))).alias("t"))
    return listed.select("qid", F.array_join(F.col("t.text"), "\n\n").alias("context"))


def flatten_elements(labels: Mapping[str, str] = ELEMENTS) -> Column:
    """A line for each of an answer's elements that isn't empty."""
    parts = [F.when(strip(text_of(F.col(n))) != "", F.concat(F.lit(f"{label}: "), strip(text_of(F.col(n))))) for n, label in labels.items()]
    return F.concat_ws("\n", *parts)


def evaluable(answer: Column, found: Column) -> Column:
    """Whether a judge can look at an answer: it has a text and contexts."""
    return (strip(text_of(answer)) != "") & (F.size(F.coalesce(found, F.array().cast("array<string>"))) > 0)


def answer_format(domains: Column, structured: Sequence[str]) -> Column:
    wanted = F.array(*map(F.lit, structured)) if structured else F.array().cast("array<string>")
    return F.when(F.coalesce(F.arrays_overlap(domains, wanted), F.lit(False)), "structured").otherwise("freeform")


def routed(output: Column, least: float = 0.5) -> Column:
    """struct(ok, use_case, domains, confidence, target_versions) of a router's JSON.

    A search needs one or two different known domains, and keeps them from `least` confidence on; an unanswerable question has none.
    """
    told = F.from_json(output, ROUTED)
    none = F.array().cast("array<string>")
    domains, sure = F.coalesce(told["domains"], none), F.coalesce(told["confidence"], F.lit(0.0))
    off = told["use_case"] == UNANSWERABLE
    known = F.forall(domains, lambda d: d.isin(*DOMAINS)) & F.size(domains).between(1, 2) & (F.size(F.array_distinct(domains)) == F.size(domains))
    valid = told["refined_query"].isNotNull() & sure.between(0, 1) & (off | ((told["use_case"] == SEARCH) & known))
    ok = F.coalesce(valid, F.lit(False))
    versions = F.filter(F.transform(F.coalesce(told["target_versions"], none), lambda v: F.trim(v)), lambda v: F.rlike(v, F.lit(TARGET)))
    return F.struct(
        ok.alias("ok"),
        F.when(ok & off, UNANSWERABLE).otherwise(SEARCH).alias("use_case"),
        F.when(ok & ~off & (sure >= least), domains).otherwise(none).alias("domains"),
        F.when(ok, sure).otherwise(0.0).alias("confidence"),
        F.when(ok, versions).otherwise(none).alias("target_versions"),
    )


def claimed_status(value: Column) -> Column:
    """A model's own judgement; anything but its three statuses says not enough."""
    plain = F.lower(F.trim(value))
    return F.when(plain.isin(*CLAIMED), plain).otherwise("not_enough_evidence")


def as_text(value: Column) -> Column:
    """A JSON value as text: the items of a list as lines, null as nothing."""
    listed = F.from_json(value, "array<string>")
    plain = F.when(F.startswith(F.trim(value), F.lit("[")) & listed.isNotNull(), F.array_join(listed, "\n", ""))
    bare = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    return F.coalesce(plain, bare, F.lit(""))


def cited(indices: Column, documents: Column) -> Column:
    """The numbers of documents that exist."""
    return F.filter(F.coalesce(indices, F.array().cast("array<int>")), lambda i: (i >= 0) & (i < documents))


def guarded(status: Column, sources: Column, missing: Column, reason: Column | None = None) -> Column:
    """struct(status, reason, shows_answer, sources): the final status and what goes with it.

    An answer without a source is only partial; missing requested versions are named; held statuses show no answer, and
    the one without evidence no sources.
    """
    bare = (status == "answerable") & (F.size(sources) == 0)
    final = F.when(bare, "partially_answerable").otherwise(status)
    usual = F.lit("")
    for name, text in REASONS.items():
        usual = F.when(final == name, text).otherwise(usual)
    told = F.when(bare, NO_SOURCE).otherwise(usual)
    told = F.when((F.size(missing) > 0) & (final == "partially_answerable"), F.concat(F.array_join(missing, ", "), F.lit(MISSING))).otherwise(told)
    kept = F.when(final == "not_enough_evidence", F.slice(sources, 1, 0)).otherwise(sources)
    return F.struct(final.alias("status"), told.alias("reason"), (~final.isin(*HELD)).alias("shows_answer"), kept.alias("sources"))


def final_answerability(conflicting: Column, outdated: Column, documents: Column, score: Column, claimed: Column) -> Column:
    """Gates, then no documents, then the score, and without a score the model's own judgement."""
    from .scoring import ANSWERABLE, PARTIAL

    by_score = F.when(score >= ANSWERABLE, "answerable").when(score >= PARTIAL, "partially_answerable").otherwise("not_enough_evidence")
    return (
        F.when(F.coalesce(conflicting, F.lit(False)), "conflicting_evidence")
        .when(F.coalesce(outdated, F.lit(False)), "outdated_evidence")
        .when(documents == 0, "not_enough_evidence")
        .when(score.isNotNull(), by_score)
        .otherwise(F.coalesce(claimed, F.lit("not_enough_evidence")))
    )
