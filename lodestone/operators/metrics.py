"""Quality of retrieval and of classifiers, calibration, comparisons and gates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scoring import ratio

TOLERANCE = 0.02
#: Parts of a group over which running sums go.
PARTS = 256
#: Edges of confidence bins; the last one includes its end.
EDGES = (0.0, 0.5, 0.7, 0.9, 1.0)


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query with relevant ids (qid, id): hit, reciprocal rank, recall and nDCG of ranked (qid, id, rank) at k."""
    need = relevant.select("qid", "id").distinct()
    sizes = need.groupBy("qid").agg(F.count("*").alias("n"))
    top = ranked.filter(F.col("rank") <= k).groupBy("qid", "id").agg(F.min("rank").alias("rank"))
    found = top.join(need, ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("first"), F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    out = sizes.join(found, "qid", "left")
    return out.select(
        "qid",
        F.col("first").isNotNull().cast("double").alias("hit"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.col("gain") / ideal, F.lit(0.0)).alias("ndcg"),
    )


def macro(per_query: DataFrame, names: Sequence[str] = ("hit", "rr", "recall", "ndcg")) -> DataFrame:
    return per_query.agg(F.count("*").alias("n"), *(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in names))


def distinct_pages(ranked: DataFrame) -> DataFrame:
    """ranked chunks (qid, page, rank) as pages in order of their first chunk."""
    first = ranked.groupBy("qid", "page").agg(F.min("rank").alias("first"))
    return first.select("qid", "page", F.row_number().over(Window.partitionBy("qid").orderBy("first", "page")).alias("rank"))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1")]


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    g, p = F.col(gold).cast("boolean"), F.col(predicted).cast("boolean")
    counts = rows.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    right, n = F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return counts.select("*", F.round(ratio(right, n), 6).alias("accuracy"), *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def multi_label(rows: DataFrame) -> DataFrame:
    """Micro precision, recall, F1 over (row, label) pairs, and shares of right first labels, orders and sets."""
    sets = F.sort_array(F.array_distinct("gold")) == F.sort_array(F.array_distinct("pred"))
    out = rows.agg(
        F.count("*").alias("n"),
        F.sum(F.size(F.array_intersect("gold", "pred"))).alias("tp"),
        F.sum(F.size(F.array_except("pred", "gold"))).alias("fp"),
        F.sum(F.size(F.array_except("gold", "pred"))).alias("fn"),
        F.count_if(F.get("gold", F.lit(0)) == F.get("pred", F.lit(0))).alias("_first"),
        F.count_if(F.col("gold") == F.col("pred")).alias("_order"),
        F.count_if(sets).alias("_set"),
    )
    shares = [F.round(ratio(F.col(a), F.col("n")), 6).alias(b) for a, b in (("_first", "primary_accuracy"), ("_order", "exact_ordered"), ("_set", "exact_set"))]
    return out.select("n", *prf(F.col("tp"), F.col("fp"), F.col("fn")), *shares)


def per_label(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support of each label of the fixed list, in one pass over rows."""
    told = rows.select(F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.array_contains("gold", x).alias("g"), F.array_contains("pred", x).alias("p")) for x in labels))).alias("x")).select("x.*")
    counts = told.groupBy("label").agg(F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(~F.col("g") & F.col("p")).alias("fp"), F.count_if(F.col("g") & ~F.col("p")).alias("fn"))
    return counts.select("label", *prf(F.col("tp"), F.col("fp"), F.col("fn")), (F.col("tp") + F.col("fn")).alias("support"))


def label_macro(by_label: DataFrame) -> DataFrame:
    return by_label.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")))


def secondary_rates(rows: DataFrame) -> DataFrame:
    """Of labels after the first: how many given ones are right; how many rows with a second one have it wrong; how many
    rows whose second one is wanted lack it. Null of none."""
    extra = F.slice("pred", F.lit(2), F.greatest(F.size("pred") - 1, F.lit(0)))
    two, need = F.size("pred") >= 2, F.size("gold") >= 2
    out = rows.agg(
        ratio(F.sum(F.size(F.filter(extra, lambda d: F.array_contains("gold", d)))), F.sum(F.size(extra)), None).alias("secondary_precision"),
        ratio(F.count_if(two & ~F.array_contains("gold", F.get("pred", F.lit(1)))), F.count_if(two), None).alias("over_rate"),
        ratio(F.count_if(need & ~F.array_contains("pred", F.get("gold", F.lit(1)))), F.count_if(need), None).alias("under_rate"),
    )
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


def _usable(rows: DataFrame) -> Column:
    parsed = F.coalesce(F.col("parse_ok"), F.lit(False)) if "parse_ok" in rows.columns else F.lit(True)
    return parsed & F.col("confidence").isNotNull()


def _binned(rows: DataFrame, edges: Sequence[float]) -> DataFrame:
    c, last = F.col("confidence"), len(edges) - 2
    number = sum((F.when(c >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    told = rows.filter(_usable(rows)).groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("confidence").alias("mean_confidence"))
    spine = rows.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bin"))
    return spine.join(told, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def confidence_bins(rows: DataFrame, edges: Sequence[float] = EDGES) -> DataFrame:
    """(bin, n, accuracy, confidence) of rows (confidence, correct, and parse_ok if known); rows without confidence or not parsed are left out."""
    return _binned(rows, edges).select("bin", "n", *(F.round(F.coalesce(x, F.lit(0.0)), 6).alias(x) for x in ("accuracy", "mean_confidence")))


def calibration_error(rows: DataFrame, edges: Sequence[float] = EDGES) -> DataFrame:
    """(used, excluded, ece): the mean gap of accuracy and confidence over bins, of unrounded means."""
    gap = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence")))
    told = _binned(rows, edges).agg(F.sum("n").alias("used"), F.round(F.coalesce(F.try_divide(gap, F.sum("n")), F.lit(0.0)), 6).alias("ece"))
    out = rows.agg(F.count_if(~_usable(rows)).alias("excluded"))
    return told.join(F.broadcast(out), F.lit(True)).select("used", "excluded", "ece")  # one row each


def ab_means(pairs: DataFrame, group: str | None, names: Sequence[str]) -> DataFrame:
    """(group, metric, a, b, delta, n) of pairs with columns {metric}_a and {metric}_b; group is an array, a row counts in each."""
    rows = pairs.select(F.explode(group).alias("group"), *(f"{m}_{s}" for m in names for s in "ab")) if group else pairs.select(F.lit("all").alias("group"), *(f"{m}_{s}" for m in names for s in "ab"))
    told = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_a").alias("a"), F.col(f"{m}_b").alias("b")) for m in names))
    means = rows.select("group", F.inline(told)).groupBy("group", "metric").agg(F.count("*").alias("n"), F.avg("a").alias("a"), F.avg("b").alias("b"))
    return means.select("group", "metric", "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round(F.col("b") - F.col("a"), 6).alias("delta"))


def moved(pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    """(metric, improved, worsened): how many queries moved."""
    told = F.array(*(F.struct(F.lit(m).alias("metric"), (F.col(f"{m}_b") - F.col(f"{m}_a")).alias("d")) for m in names))
    return pairs.select(F.inline(told)).groupBy("metric").agg(F.count_if(F.col("d") > 0).alias("improved"), F.count_if(F.col("d") < 0).alias("worsened"))


def movers(pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    """(metric, kind, place, qid, delta): the queries that each metric improved or worsened, those that moved most first."""
    told = F.array(*(F.struct(F.lit(m).alias("metric"), F.round(F.col(f"{m}_b") - F.col(f"{m}_a"), 4).alias("delta")) for m in names))
    rows = pairs.select("qid", F.inline(told)).filter("delta <> 0").withColumn("kind", F.when(F.col("delta") > 0, "improved").otherwise("worsened"))
    order = Window.partitionBy("metric", "kind").orderBy(F.desc(F.abs("delta")), "qid")
    return rows.select("metric", "kind", F.row_number().over(order).alias("place"), "qid", "delta")


#: Criteria of a comparison: name, group, metric, least difference, whether more than it is needed, and what an empty group says.
CRITERIA = (
    ("overall_recall_no_drop", "all", "recall", 0.0, False, "fails"),
    ("overall_ndcg_drop_within_2pp", "all", "ndcg", -0.02, False, "fails"),
    ("multi_recall_improved", "router_multi", "recall", 0.0, True, "fails"),
    ("single_recall_no_worsen", "router_single", "recall", 0.0, False, "passes"),
    ("noise_recall_no_drop", "noise", "recall", 0.0, False, "N/A"),
    ("noise_ndcg_within_2pp", "noise", "ndcg", -0.02, False, "N/A"),
)


def success_criteria(pairs: DataFrame, groups: str = "groups", criteria: Sequence[tuple] = CRITERIA) -> DataFrame:
    """(criterion, verdict, delta) of pairs with columns {metric}_a, {metric}_b and an array of groups; judged on unrounded means."""
    names = sorted({c[2] for c in criteria})
    every = pairs.select(F.explode(F.concat(F.array(F.lit("all")), F.col(groups))).alias("group"), *(f"{m}_{s}" for m in names for s in "ab"))
    told = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_a").alias("a"), F.col(f"{m}_b").alias("b")) for m in names))
    means = every.select("group", F.inline(told)).groupBy("group", "metric").agg((F.avg("b") - F.avg("a")).alias("delta"))
    wanted = rows_of(pairs, criteria)
    out = wanted.join(means, ["group", "metric"], "left")
    d, least = F.col("delta"), F.col("least")
    passes = F.when(F.col("more"), d > least).otherwise(d >= least)
    return out.select("criterion", F.when(d.isNull(), F.col("empty")).when(passes, "passes").otherwise("fails").alias("verdict"), F.round("delta", 4).alias("delta"))


def rows_of(df: DataFrame, criteria: Sequence[tuple]) -> DataFrame:
    listed = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("criterion", "group", "metric", "least", "more", "empty"), c, strict=True))) for c in criteria))
    return df.sparkSession.range(1).select(F.inline(listed))


def block_rates(rows: DataFrame) -> DataFrame:
    """(cohort, blocked, n, rate) of rows (qid, answerable, blocked, null without a prediction): near misses (ids with n), out of scope, answerable. Null of none."""
    cohort = F.when(F.col("answerable"), "answerable_false_block").when(F.startswith("qid", F.lit("n")), "near_miss").otherwise("out_of_scope")
    seen = rows.filter(F.col("blocked").isNotNull()).select(cohort.alias("cohort"), "blocked")
    both = seen.unionByName(seen.filter("cohort <> 'answerable_false_block'").withColumn("cohort", F.lit("total")))
    spine = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ("total", "near_miss", "out_of_scope", "answerable_false_block")))).alias("cohort"))
    told = spine.join(both.groupBy("cohort").agg(F.count_if("blocked").alias("blocked"), F.count("*").alias("n")), "cohort", "left").fillna(0)
    return told.select("cohort", "blocked", "n", F.round(F.try_divide(F.col("blocked"), F.col("n")), 4).alias("rate"))


def generation_summary(rows: DataFrame) -> DataFrame:
    """One row of rows (prompt_tokens, completion_tokens, llm_calls, latency_s, status, fallback): means, latencies, shares."""
    mean = lambda c, places: F.round(F.avg(c), places)
    out = rows.agg(
        F.count("*").alias("n"),
        mean("prompt_tokens", 1).alias("avg_prompt_tokens"),
        mean("completion_tokens", 1).alias("avg_completion_tokens"),
        mean("llm_calls", 2).alias("avg_llm_calls"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        F.round(ratio(F.count_if(F.col("status") == "answerable"), F.count("*")), 4).alias("answerable_rate"),
        F.round(ratio(F.count_if(F.col("status") == "not_enough_evidence"), F.count("*")), 4).alias("not_enough_rate"),
        F.count_if("fallback").alias("n_fallback"),
        F.round(ratio(F.count_if(~F.col("fallback")), F.count("*")), 4).alias("rerank_fired"),
    )
    places = {f"latency_p{int(100 * s)}": (lambda n, s=s: F.greatest(F.lit(1), F.least(n, F.bround(s * n + 0.5, 0)))) for s in (0.5, 0.95)}
    latency = values_at(rows.withColumn("_all", F.lit(1)), "_all", "latency_s", places)
    return out.join(F.broadcast(latency.select(*(F.round(c, 3).alias(c) for c in places))), F.lit(True))  # one row each


def excluded_domains(rows: DataFrame) -> DataFrame:
    """rows (gold array, domain) with excluded_ratio: the share of gold domains that a filter on domain can't reach."""
    lost = F.size(F.filter("gold", lambda d: d != F.col("domain")))
    return rows.withColumn("excluded_ratio", F.when(F.col("domain").isNull() | (F.size("gold") <= 0), 0.0).otherwise(lost / F.size("gold")))


def survival_rate(rows: DataFrame) -> DataFrame:
    """One row of rows (n wanted, alive): how many wanted chunks are still there."""
    return rows.agg(F.sum("n").alias("wanted"), F.sum("alive").alias("alive"), F.round(ratio(F.sum("alive"), F.sum("n")), 4).alias("rate"))


def predicted_answerable(hits: DataFrame, floor: float = 0.5229, least: int = 1) -> DataFrame:
    """(qid, predicted): whether a query has enough hits and one of at least the floor."""
    return hits.groupBy("qid").agg(((F.count("*") >= least) & (F.max("score") >= floor)).alias("predicted"))


def fresh(cached: DataFrame, wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    """wanted (qid, key) with fresh: a cached record of the query agrees in all parts of the key; a missing part is stale."""
    old = cached.select(F.col("qid").alias("_qid"), *(F.col(k).alias(f"_{k}") for k in key))
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"_{k}"))
    out = wanted.join(old, F.col("qid") == F.col("_qid"), "left")
    return out.select(*wanted.columns, F.coalesce(same & F.col("_qid").isNotNull(), F.lit(False)).alias("fresh"))


def threshold_sweep(rows: DataFrame) -> DataFrame:
    """(threshold, precision, recall, youden) of the best threshold of rows (score, positive).

    Candidates lie midway between neighbouring scores and below all. Counts at or above each come from one running sum over
    distinct scores, dealt by ranges of score, so candidates and rows are never crossed.
    """
    per = rows.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    per = per.withColumn("bucket", F.floor(F.col("score") * 1024))
    sums = per.groupBy("bucket").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"), F.max("score").alias("top"))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    known = sums.select("bucket", *(F.coalesce(F.sum(x).over(above), F.lit(0)).alias(f"o{x}") for x in ("bp", "bn")), F.lag("top").over(Window.orderBy("bucket")).alias("below"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("score"))
    joined = per.join(known, "bucket")
    joined = joined.select(
        "score",
        (F.sum("p").over(inside) + F.col("obp")).alias("tp"),
        (F.sum("n").over(inside) + F.col("obn")).alias("fp"),
        F.coalesce(F.lead("score").over(inside), "below").alias("lower"),
    )
    totals = rows.agg(F.count_if("positive").alias("all_p"), F.count_if(~F.col("positive")).alias("all_n")).withColumn("one", F.lit(1))
    out = joined.withColumn("one", F.lit(1)).join(F.broadcast(totals), "one")  # one row of totals
    threshold = F.when(F.col("lower").isNull(), F.col("score") - 1e-6).otherwise((F.col("score") + F.col("lower")) / 2)
    recall, precision = ratio(F.col("tp"), F.col("all_p")), ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    out = out.select(F.round(threshold, 6).alias("threshold"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(recall - ratio(F.col("fp"), F.col("all_n")), 6).alias("youden"))
    return out.orderBy(F.desc("youden"), F.desc("precision"), "threshold").limit(1)


def regressions(values: DataFrame, baseline: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(metric, value, base, fails) of values (metric, value, n) against baseline (metric, base, n).

    A missing value fails, and so does any where the numbers of queries differ: those are other queries.
    """
    base = baseline.withColumnRenamed("n", "_n") if "n" in baseline.columns else baseline.withColumn("_n", F.lit(None).cast("long"))
    out = base.join(values, "metric", "left")
    other = F.coalesce(F.col("n") != F.col("_n"), F.lit(False)) if "n" in values.columns else F.lit(False)
    return out.select("metric", "value", "base", (other | F.coalesce(F.col("value") < F.col("base") - tolerance, F.lit(True))).alias("fails"))


def values_at(rows: DataFrame, group: str, value: str, places: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(group, n, one column a place): the values at these places of each group's sorted known values, 1 for the least.

    places are functions of the number n of known values. Equal values are counted first; running sums go over parts of a group
    that hold about as many different values each, so no task holds a group.
    """
    per = rows.groupBy(group, value).agg(F.count(value).alias("count"))
    edges = [i / PARTS for i in range(1, PARTS)]
    groups = per.groupBy(F.col(group).alias("_group")).agg(F.sum("count").alias("n"), F.percentile_approx(value, edges).alias("edges"))
    same = F.col(group).eqNullSafe(F.col("_group"))
    per = per.filter(F.col(value).isNotNull()).join(groups, same).select("_group", "n", F.col(value).alias("value"), "count", F.size(F.filter("edges", lambda e: e < F.col(value))).alias("part"))
    sums = per.groupBy("_group", "part").agg(F.sum("count").alias("sum"))
    before = Window.partitionBy("_group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_group").alias(group), F.col("part").alias("_part"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    within = F.sum("count").over(Window.partitionBy("_group", "part").orderBy("value"))
    upto = per.withColumn("upto", within).join(sums, same & (F.col("part") == F.col("_part"))).withColumn("upto", F.col("upto") + F.col("before"))
    found = upto.groupBy("_group").agg(*(F.min(F.when(F.col("upto") >= place(F.col("n")), F.col("value"))).alias(name) for name, place in places.items()))
    return groups.select(F.col("_group").alias(group), "n").join(found, same, "left").select(group, "n", *places)


def percentiles(rows: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """(group, linear, nearest, upper) of each group: the three definitions of a percentile, of known values; null without any."""
    at = lambda n: share * (n - 1)
    places = {
        "low": lambda n: F.floor(at(n)) + 1,
        "high": lambda n: F.ceil(at(n)) + 1,
        "nearest": lambda n: F.bround(at(n), 0) + 1,
        "upper": lambda n: F.greatest(F.lit(1), F.least(n, F.bround(share * n + 0.5, 0))),
    }
    part = at(F.col("n")) - F.floor(at(F.col("n")))
    linear = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") * (1 - part) + F.col("high") * part)
    return values_at(rows, group, value, places).select(group, F.round(linear, 6).alias("linear"), "nearest", "upper")


def mean_of_known(value: Column) -> Column:
    """The mean without nulls and NaN."""
    return F.avg(F.when(~F.isnan(value), value))
