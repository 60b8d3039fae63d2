"""Quality rules: learned decision lists over text statistics.

Statistics of a text are built-in expressions. Sequential covering learns from labelled statistics: a rule is a
conjunction of thresholds, grown literal by literal for FOIL's gain on two thirds of the rows and pruned from its end on the rest;
the rows it covers are taken away and the next rule is grown, until none is precise enough. Candidate literals
are counted in Spark, one histogram over quantile bins a step; only these counts (features x bins x 2) reach the driver.
The list becomes one ordered conditional expression, so judging a document needs neither join nor shuffle.

Training takes TRAIN labelled documents at most, those of least hash; statistics, base rules and the verdict cover all rows.

A null text counts as empty: its statistics are zero and the base rule on words rejects it. Repeated ids are judged row
by row. Of contradicting labels of one document the worst counts, null labels don't. Without labels there are no learned
rules. Only the named columns are read, so others can't clash. An empty table gives no rows. A very long text is measured
as a whole, in its row. Of literals of equal gain the last by text is taken.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table, words

BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Labelled documents at most, quantile bins; least share of rejected documents among those covered, least number covered.
TRAIN, BINS = 20_000, 16
PRECISION, COVERED = 0.95, 5
GROW = 2 / 3


def _repeated(found: Column) -> Column:
    """Words covered by windows whose hash is in found (the windows of a text, in order) twice or more."""
    placed = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(
        s, lambda x, k: (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    )
    # lambdas over one-element arrays: each inner array is made once
    starts = F.element_at(F.transform(F.array(placed), lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"]))), 1)
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b
    )
    return F.element_at(F.transform(F.array(starts), covered), 1)


def statistics(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (long) and the columns keep of each row."""
    rows = docs.select(F.col(id).alias("doc_id"), *keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    blank = F.translate("_text", BLANKS, "")
    lines = F.filter(F.split("_text", "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    rows = rows.select(
        "doc_id",
        *keep,
        words(F.col("_text")).alias("_words"),
        lines.alias("_lines"),
        F.length(blank).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("_words")
    # element by element: slice() copies the whole array every time
    hashed = lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(WINDOW)))
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), hashed))
    rows = rows.select("*", windows.alias("_windows"))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    return rows.select(
        "doc_id",
        *keep,
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, _repeated(F.col("_windows"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))


#: What literals compare: names and their values over statistics().
FEATURES = {
    "word_length": lambda: _ratio("word_chars", "n_words"),
    "symbols_per_word": lambda: _ratio("n_symbols", "n_words"),
    "dup_line_share": lambda: _ratio("n_dup_lines", "n_lines"),
    "repeat_share": lambda: _ratio("n_repeat_words", "n_words"),
    "words_per_line": lambda: _ratio("n_words", "n_lines"),
    "n_words": lambda: F.col("n_words").cast("double"),
}


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self, value: Column) -> Column:
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    literals: tuple[Literal, ...]
    covered: int
    precision: float

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for x in self.literals:
            out = out & x.column(values[x.feature])
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.literals))


def thresholds(sample: DataFrame, bins: int = BINS) -> dict[str, list[float]]:
    """The quantile cuts of each feature, each once."""
    shares = [i / bins for i in range(1, bins)]
    row = sample.agg(*(F.percentile_approx(f, F.array(*map(F.lit, shares)), 10_000).alias(f) for f in FEATURES)).first()
    return {f: sorted(set(row[f] or [])) for f in FEATURES}


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[bool, bool], dict[str, list[int]]]:
    """(grow, bad) -> feature -> rows in each bin."""
    bins = [F.struct(F.lit(f).alias("f"), sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias("b")) for f in FEATURES]
    told = rows.select("grow", "bad", F.explode(F.array(*bins)).alias("x")).groupBy("grow", "bad", "x.f", "x.b").count().collect()
    out = {(g, b): {f: [0] * (len(cuts[f]) + 1) for f in FEATURES} for g in (True, False) for b in (True, False)}
    for r in told:
        out[r.grow, r.bad][r.f][r.b] += r["count"]
    return out


def _candidates(counts: dict, cuts: dict, grow: bool) -> dict[Literal, tuple[int, int]]:
    """literal -> (rejected, other) rows that it covers."""
    out = {}
    for f, values in cuts.items():
        bad, good = counts[grow, True][f], counts[grow, False][f]
        for i, cut in enumerate(values):
            out[Literal(f, False, cut)] = (sum(bad[: i + 1]), sum(good[: i + 1]))
            out[Literal(f, True, cut)] = (sum(bad[i + 1 :]), sum(good[i + 1 :]))
    return out


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    """FOIL's gain: rejected rows covered times the rise of their information."""
    share = lambda x: log2(x[0] / sum(x)) if x[0] else -1e9
    return after[0] * (share(after) - share(before)) if after[0] else -1.0


def _worth(c: tuple[int, int]) -> float:
    """Pruning measure: (rejected - other) / covered."""
    return (c[0] - c[1]) / sum(c) if sum(c) else -1.0


def learn(sample: DataFrame, precision: float = PRECISION) -> list[Rule]:
    """The decision list for sample (the FEATURES and bad, boolean): its rules reject, what none covers is kept.

    Precision and coverage end the list, and gain a rule; neither has a length set.
    """
    slim = sample.select(*FEATURES, F.col("bad").cast("boolean").alias("bad")).filter(F.col("bad").isNotNull())
    split = F.pmod(F.xxhash64(*FEATURES, "bad"), F.lit(1000)) < int(1000 * GROW)
    rows = shared_table(slim.withColumn("grow", split), "quality")
    cuts = thresholds(rows)
    values = {f: F.col(f) for f in FEATURES}
    rules: list[Rule] = []
    while True:
        literals: list[Literal] = []
        kept: list[tuple[int, int]] = []  # on the pruning rows, after each literal
        whole: list[tuple[int, int]] = []  # on all rows
        covered = rows
        at: tuple[int, int] | None = None
        while True:
            counts = _counts(covered, cuts)
            first = next(iter(FEATURES))
            at = at or (sum(counts[True, True][first]), sum(counts[True, False][first]))
            if not at[0] or not at[1] and literals:
                break
            grown, pruned = _candidates(counts, cuts, True), _candidates(counts, cuts, False)
            best = max(grown, key=lambda x: (_gain(at, grown[x]), str(x)), default=None)
            if best is None or _gain(at, grown[best]) <= 0:
                break
            # the threshold goes midway to the next value seen, so that near misses count as the side they resemble
            above = covered.agg(F.min(F.when(F.col(best.feature) > best.threshold, F.col(best.feature)))).first()[0]
            literal = best if above is None else Literal(best.feature, best.above, (best.threshold + above) / 2)
            literals.append(literal)
            kept.append(pruned[best])
            at = grown[best]
            whole.append((at[0] + kept[-1][0], at[1] + kept[-1][1]))
            covered = covered.filter(literal.column(F.col(literal.feature)))
        if not literals:
            break
        end = 1 + max(range(len(kept)), key=lambda i: (_worth(kept[i]), -i))  # the shortest of the best beginnings
        (bad, good), (all_bad, all_good) = kept[end - 1], whole[end - 1]
        if not bad or bad / (bad + good) < precision or all_bad + all_good < COVERED or all_bad / (all_bad + all_good) < precision:
            break
        rule = Rule(tuple(literals[:end]), all_bad + all_good, bad / (bad + good))
        rules.append(rule)
        rows = rows.filter(~rule.column(values))
    return rules


def rejected_by(rules: Sequence[Rule]) -> Column:
    """The number of the first rule that covers a row of statistics(), from 1 on; null if none does."""
    values = {f: make() for f, make in FEATURES.items()}
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(values), F.lit(i)).otherwise(out)
    return out


def training_sample(docs: DataFrame, labels: DataFrame, train: int = TRAIN, id: str = "doc_id", text: str = "text") -> DataFrame:
    """FEATURES and bad of at most train labelled documents."""
    told = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train).select(F.col("doc_id").alias("_labelled"), "bad")
    # at most train rows of two columns are broadcast
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(told), F.col("doc_id") == F.col("_labelled"))
    stats = shared_table(statistics(rows, keep=("bad",)), "labelled")
    return stats.filter(~base_failed()).select(*(make().alias(f) for f, make in FEATURES.items()), "bad")


def judged(docs: DataFrame, rules: Sequence[Rule], id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """statistics() of docs with base_failed, rule (the first learned rule that rejects, else null) and kept."""
    out = statistics(docs, id, text, keep).withColumn("base_failed", base_failed()).withColumn("rule", rejected_by(rules))
    # a filter on kept must not be pushed below the statistics, where it would compute them once for every mention;
    # Spark leaves it above an expression that depends on the task
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull() & (F.spark_partition_id() >= 0))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = learn(training_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    names = F.array(*(F.lit(str(r)) for r in rules)) if rules else F.expr("cast(array() as array<string>)")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged(docs, rules).select(*columns, F.get(names, F.col("rule") - 1).alias("rule"))
