"""Source divergence audit: how far the terms of each source of a language lie from those of every other source, and from the language.

A term's share p in a group of documents is 1 + floor(10^9 * (count + 1) / (all counts + number of terms)), and depends on its count there alone. The divergence of
a group from another one is the sum of floor((p - q)^2 / q) over all kept terms of the language. It is not summed term by term. By inclusion and exclusion over
the supports:

- terms of one of the two groups are priced by the histogram of that group's counts, against the other's share of a term that it lacks;
- terms of both, which have been priced twice, are corrected by a join of the postings (language, term, group);
- terms of neither have one constant value, times their number.

So a pair costs the distinct counts of its groups and the terms that both have, not the vocabulary. Postings are counted within tasks before they are shuffled, and
pairs of a term's groups go straight into sums by pair of groups. Numbers are whole numbers throughout: products that could pass 2^63 are decimals.

Null text, lang and source count as ''. Every row is a document, repeated rows and ids included. A group without terms is kept; a language without kept terms has
value 0 for all its pairs. Ties are ranked by the item's bytes. An empty table gives no rows, extra columns are ignored, and texts of any length are counted whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_table, table

#: Bytes of a term: letters of ASCII, and all bytes of other characters.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
LEAST_DOCS, SCALE, TOP_TERMS = 3, 1_000_000_000, 200
#: A task hands on its counts once it has so many; groups up to this number are broadcast.
HELD, FEW_GROUPS = 300_000, 50_000
GROUP = ["lang", "source"]
COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of the texts met since the last hand-over, and for each group a row of null term."""
    n: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for group, terms in n.items():
            names = [*terms]
            columns = [pa.array([x] * (len(names) + 1), pa.string()) for x in group]
            columns += [pa.array([None, *names], pa.binary()).cast(pa.string())]
            columns += [pa.array([0, *(c[x] for x in names)], pa.int64()) for c in (terms, docs[group])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    held = 0
    for batch in batches:
        lang, source, text = (pc.fill_null(batch.column(k).cast(pa.large_string()), "") for k in range(3))
        for group, data in zip(zip(lang.to_pylist(), source.to_pylist(), strict=True), text.cast(pa.large_binary()), strict=True):
            terms = TERM.findall(data.as_py().lower())  # of bytes, A-Z alone
            if group not in n:
                n[group], docs[group] = Counter(), Counter()
            held -= len(n[group])
            n[group].update(terms)
            docs[group].update(set(terms))
            held += len(n[group])
            if held > HELD:
                yield from handed()
                n, docs, held = {}, {}, 0
    yield from handed()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of each group; each group also has a row of null term."""
    slim = docs.select(*(F.col(x).cast("string").alias(y) for x, y in ((lang, "lang"), (source, "source"), (text, "text"))))
    return slim.mapInArrow(_counted, COUNTS).groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / (total + terms)), exactly."""
    exact = F.call_function("div", (count.cast("decimal(20,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)"), (total + terms).cast("decimal(20,0)"))
    return exact + 1


def price(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so the square stays below 2^63."""
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """Postings and groups of the kept terms, written once to the shared folder."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS, **names: str):
        counts = shared_table(term_counts(docs, **names), "term_counts")
        seen = counts.filter("term IS NOT NULL")
        kept = seen.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang")).filter(F.col("docs") >= least_docs).drop("docs")
        postings = shared_table(seen.drop("docs").join(kept, ["lang", "term"]), "postings")
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("of_lang").alias("all_of_lang"))
        sizes = postings.groupBy(*GROUP).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("own"))
        groups = counts.filter("term IS NULL").select(*GROUP).join(sizes, GROUP, "left").join(langs, "lang", "left").na.fill(0)
        lacking = F.when(F.col("terms") > 0, share(F.lit(0), F.col("all"), F.col("terms")))
        #: (lang, source, all, own, terms, all_of_lang, p0): occurrences, own terms, terms of the language and share of a term that the group lacks.
        self.groups = shared_table(groups.withColumn("p0", lacking), "groups")
        self.few = self.groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
        of = self.groups.select(*GROUP, "all", "terms", "all_of_lang", "p0")
        priced = postings.join(self._small(of), GROUP).withColumn("p", share(F.col("n"), F.col("all"), F.col("terms")))
        #: (lang, source, term, n, of_lang, p, p0, q): q is the share in the whole language.
        self.postings = priced.select(*GROUP, "term", "n", "p", "p0", share(F.col("of_lang"), F.col("all_of_lang"), F.col("terms")).alias("q"))

    def _small(self, groups: DataFrame) -> DataFrame:
        return F.broadcast(groups) if self.few else groups

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): the divergence of each source of a language from each other one."""
        groups = self.groups
        # one-sided: each distinct count of a group against the others' share of a term they lack, both ways
        histogram = self.postings.groupBy(*GROUP, "p").agg(F.count(F.lit(1)).alias("k"))
        other = self._small(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")))
        sided = histogram.join(other, "lang").filter("source <> item")
        costs = sided.groupBy("lang", "source", "item").agg(F.sum(F.col("k") * price(F.col("p"), F.col("q0"))).alias("as_group"), F.sum(F.col("k") * price(F.col("q0"), F.col("p"))).alias("as_item"))
        of_group = costs.select("lang", "source", "item", F.col("as_group").alias("part"))
        of_item = costs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("as_item").alias("part"))
        # terms of both: what they cost, less what the two histograms have charged
        a, b = (self.postings.select("lang", "term", *(F.col(c).alias(f"{c}_{x}") for c in ("source", "p", "p0"))) for x in "ab")
        both = a.join(b, ["lang", "term"]).filter("source_a < source_b")
        ahead = price(F.col("p_a"), F.col("p_b")) - price(F.col("p_a"), F.col("p0_b")) - price(F.col("p0_a"), F.col("p_b"))
        behind = price(F.col("p_b"), F.col("p_a")) - price(F.col("p_b"), F.col("p0_a")) - price(F.col("p0_b"), F.col("p_a"))
        shared = both.groupBy("lang", "source_a", "source_b").agg(F.sum(ahead).alias("ahead"), F.sum(behind).alias("behind"), F.count(F.lit(1)).alias("common"))
        ways = [F.struct(F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item"), F.col(way).alias("part"), "common") for x, y, way in (("a", "b", "ahead"), ("b", "a", "behind"))]
        shared = shared.select("lang", F.inline(F.array(*ways)))
        # terms of neither: a constant
        group = groups.select(*GROUP, "terms", F.col("own").alias("own_a"), F.col("p0").alias("p0_a"))
        item = self._small(groups.select("lang", F.col("source").alias("item"), F.col("own").alias("own_b"), F.col("p0").alias("p0_b")))
        every = group.join(item, "lang").filter("source <> item")
        left, each = F.col("terms") - F.col("own_a") - F.col("own_b"), F.coalesce(price(F.col("p0_a"), F.col("p0_b")), F.lit(0))
        zero, pair = F.lit(0).cast("long"), ["lang", "source", "item"]
        parts = every.select(*pair, zero.alias("part"), left.alias("left"), each.alias("each"))
        for one_sided in (of_group, of_item):
            parts = parts.unionAll(one_sided.select(*pair, "part", zero, zero))
        parts = parts.unionAll(shared.select(*pair, "part", "common", zero))
        total = parts.groupBy(*pair).agg(F.sum("part").alias("part"), F.sum("left").alias("left"), F.max("each").alias("each"))
        return total.select(*pair, (F.col("part") + F.col("each") * F.col("left")).alias("value"))

    def terms(self) -> DataFrame:
        """(lang, source, item, value) of each term of a group whose share there is above that in its language."""
        return self.postings.filter("p > q").select(*GROUP, F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))

    def report(self, top_terms: int = TOP_TERMS) -> DataFrame:
        """(lang, source, part, item, value, rank): all pairs, and the top terms of each group."""
        order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
        terms = ranked(self.terms()).filter(F.col("rank") <= top_terms)
        return ranked(self.pairs()).withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select(*GROUP, "part", "item", "value", "rank")


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return Audit(table(spark, sf_dir, "documents").select("lang", "source", "text")).report()


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
occ AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS ln FROM occ GROUP BY ALL HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(ln)::HUGEINT AS total FROM kept GROUP BY lang),
seen AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM occ JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN seen s ON s.lang = g.lang AND s.source = g.source GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(s.n, 0) AS n, 1 + (1000000000 * (coalesce(s.n, 0) + 1)) // (g.total + v) AS p, 1 + (1000000000 * (ln + 1)) // (langs.total + v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs ON langs.lang = g.lang LEFT JOIN seen s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
told AS (SELECT lang, source, 'pair' AS part, item, value FROM every UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM told) WHERE part = 'pair' OR rank <= 200"""
