"""URL filters: given rules by host and path, and rules mined from labels with FP-growth.

Given rules are an inverted index from a host to its rules; a URL looks up its host and every parent domain of it, and the
longest rule whose path it starts with wins. Where none fits, mined rules decide: FP-growth finds combinations of URL
tokens (words of the host, its domains, words of the path, query keys, scheme) that go with bad labels. Rules are pruned by support,
by confidence and by significance against the share of bad URLs (of all tokens tried), and those that a shorter
rule of at least that confidence implies are dropped. The rest are an inverted index from a token to rules: a rule matches
where all of its tokens are hit. Tokens that are found in too few bad URLs to be in any rule are left out before mining, and tokens
of the same URLs count as one; neither loses a rule.

Labels come from evidence outside of the URL and are of two kinds, mined one after the other: those of documents (a page has its document's id), and what a
page's own text is worth: bad if its main text fails the base rules of quality. Where hosts and paths say nothing about either, no
rule is significant, and the default stands. Training takes TRAIN labelled URLs of each at most, those of least hash; rules aren't
limited in number or length. They are a literal of the plan, as given ones are, and URLs are matched row by row, without a shuffle.

A null url, or one without ://, has an empty host and path, no tokens and no rule: it is allowed. Repeated rows stay as
they are and other columns are ignored, whatever their names. Null labels count as good where another label of the document is known, labels of no page
are ignored, and of contradicting labels the bad one counts. Without labels or pages no rule is mined, and an empty table gives no rows. Of
given rules of one length the greatest text wins, of mined rules that match the one of greatest confidence, then support, then the first by tokens. A very long url is
one row like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .main_text import extract
from .quality import base_failed, statistics

GIVEN = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Labelled URLs to mine, at most; least share of labelled URLs and least confidence of a rule, and the chance of any rule by accident.
TRAIN, SUPPORT, CONFIDENCE, CHANCE = 20_000, 0.001, 0.8, 0.05
BAD = "label:bad"
#: Of tokens of the same URLs the one of the first kind stands for all.
KINDS = ("word", "domain", "path", "key", "scheme")


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """A host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _index(entries: dict[str, list[Column]], kind: str) -> Column:
    """A map from keys to arrays."""
    if not entries:
        return F.expr(f"map('', cast(array() as array<{kind}>))")
    return F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), F.array(*v))))


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = GIVEN) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits; null if none does."""
    by_host: dict[str, list[Column]] = {}
    for verdict, domain, prefix in rules:
        told = F.struct(F.lit(len(domain + prefix)).alias("length"), F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(prefix).alias("path"))
        by_host.setdefault(domain, []).append(told)
    kind = "struct<length:int,rule:string,verdict:string,path:string>"
    index, none = _index(by_host, kind), F.expr(f"cast(array() as array<{kind}>)")
    listed = F.flatten(F.transform(suffixes(host), lambda s: F.coalesce(F.try_element_at(index, s), none)))
    return F.array_max(F.filter(listed, lambda r: F.startswith(path, r["path"])))


def tokens(url: Column) -> Column:
    """The distinct tokens of a url; empty without a host."""
    host, path = host_path(url)
    whole = F.coalesce(url, F.lit(""))
    tag = lambda name, values: F.transform(values, lambda x: F.concat(F.lit(f"{name}:"), x))
    known = lambda values: F.filter(values, lambda x: x != "")
    keys = F.transform(F.split(F.regexp_extract(whole, r"(?s)://[^?#]*\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1))
    found = F.concat(
        tag("word", known(F.split(host, r"[.-]"))),
        tag("domain", F.filter(suffixes(host), lambda x: F.contains(x, F.lit(".")))),
        tag("path", known(F.split(F.lower(path), r"[/._-]+"))),
        tag("key", known(keys)),
        tag("scheme", F.array(F.lower(F.substring_index(whole, "://", 1)))),
    )
    return F.when(host != "", F.array_distinct(found)).otherwise(F.expr("cast(array() as array<string>)"))


def _least_count(base: float, tried: int, chance: float = CHANCE) -> int:
    """The fewest bad URLs with which a rule without exceptions is no accident."""
    n = 1
    while n * -log(base) < log(tried / chance):
        n += 1
    return n


def _implied(rules: DataFrame) -> DataFrame:
    """The tokens of rules (tokens, confidence) that a rule of fewer of their tokens implies as surely: they say nothing new.

    A shorter rule is looked up under its rarest token, so rules meet where they share it, and no parts of rules are listed.
    """
    each = rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
    count = each.groupBy("token").agg(F.count("*").alias("n"))
    rarest = each.join(count, "token").groupBy(F.col("tokens").alias("part"), F.col("confidence").alias("other")).agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    met = each.join(rarest, "token").filter((F.size("part") < F.size("tokens")) & (F.col("other") >= F.col("confidence")))
    return met.filter(F.forall("part", lambda t: F.array_contains("tokens", t))).select("tokens").distinct()


def mine(urls: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, train: int = TRAIN) -> list[tuple[list[str], float, float]]:
    """(tokens, confidence, support) of the rules that urls (url, bad) gives, best first."""
    sample = urls.select("url", F.col("bad").cast("boolean").alias("bad")).filter(F.col("bad").isNotNull())
    sample = sample.orderBy(F.xxhash64("url", "bad"), "url", "bad").limit(train)
    rows = cut(sample.select(F.monotonically_increasing_id().alias("row"), tokens(F.col("url")).alias("tokens"), "bad").filter(F.size("tokens") > 0))
    n, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    if not bad or bad == n:
        return []
    base = bad / n
    # tokens as sets of rows: those of equal sets are one, and those in too few bad rows are in no rule
    per = rows.select("row", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_if("bad").alias("bad"), F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("mark"))
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.substring_index("token", ":", 1))
    tried = per.select("n", "mark").distinct().count()
    least = max(_least_count(base, tried), support * n)
    told = cut(per.filter(F.col("bad") >= least).groupBy("n", "mark").agg(F.min(F.struct(kind.alias("kind"), "token")).alias("t")).select(F.col("t.token").alias("token")))
    kept = rows.select("row", "bad", F.explode("tokens").alias("token")).join(told, "token").groupBy("row").agg(F.concat(F.collect_list("token"), F.when(F.max("bad"), F.array(F.lit(BAD))).otherwise(F.expr("cast(array() as array<string>)"))).alias("items"))
    baskets = cut(rows.select("row", "bad").join(kept, "row", "left").select(F.coalesce("items", F.when(F.col("bad"), F.array(F.lit(BAD)))).alias("items")).filter(F.col("items").isNotNull()))
    size = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / size), minConfidence=confidence).fit(baskets)
    p, count = F.col("confidence"), F.round(F.col("support") * size / F.col("confidence"))
    surprise = count * (p * F.log(p / base) + F.coalesce((1 - p) * F.log(F.when(p < 1, (1 - p) / (1 - base))), F.lit(0.0)))
    found = model.associationRules.filter((F.col("consequent") == F.array(F.lit(BAD))) & (p > base) & (surprise >= log(tried / CHANCE)))
    found = cut(found.select(F.array_sort("antecedent").alias("tokens"), "confidence", (F.col("support") * size / n).alias("support")))
    rules = found.join(_implied(found), "tokens", "left_anti").orderBy(F.desc("confidence"), F.desc("support"), "tokens")
    return [(list(r.tokens), r.confidence, r.support) for r in rules.collect()]


def mined_match(found: Column, rules: Sequence[tuple[list[str], float, float]]) -> Column:
    """The number of the best mined rule whose tokens are all among found; null if none matches."""
    if not rules:
        return F.lit(None).cast("int")
    index: dict[str, list[Column]] = {}
    for i, (names, *_) in enumerate(rules):
        for name in names:
            index.setdefault(name, []).append(F.lit(i))
    postings, need = _index(index, "int"), F.array(*(F.lit(len(names)) for names, *_ in rules))
    hits = F.flatten(F.transform(found, lambda t: F.coalesce(F.try_element_at(postings, t), F.expr("cast(array() as array<int>)"))))
    full = F.filter(F.array_distinct(hits), lambda r: F.size(F.filter(hits, lambda h: h == r)) == F.get(need, r))
    return F.array_min(full)


def url_verdicts(pages: DataFrame, mined: Sequence[tuple[list[str], float, float]], given: Sequence[tuple[str, str, str]] = GIVEN, id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the mined rule that spoke, as text) of each row."""
    host, path = host_path(F.col(url))
    out = pages.select(F.col(id).alias("page_id"), host.alias("host"), path.alias("path"), tokens(F.col(url)).alias("_tokens"))
    out = out.select("page_id", "host", "path", given_rule(F.col("host"), F.col("path"), given).alias("_given"), mined_match(F.col("_tokens"), mined).alias("_mined"))
    names = F.array(*(F.lit(" & ".join(t)) for t, *_ in mined)) if mined else F.expr("cast(array() as array<string>)")
    verdict = F.coalesce("_given.verdict", F.when(F.col("_mined").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_given.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("_given").isNull(), F.get(names, F.col("_mined"))).alias("mined"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): pages whose document is labelled; bad if any of its labels says low quality or toxic."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    told = labels.filter(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())).groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    return pages.select("page_id", "url").join(told, "page_id").select("url", "bad")


def content_labelled(pages: DataFrame, train: int = TRAIN) -> DataFrame:
    """(url, bad) of at most train pages (page_id, url, html): bad if the page's main text fails the base rules of quality. A page without html has no text."""
    known = pages.filter(F.col("url").isNotNull() & F.col("page_id").isNotNull())
    chosen = known.select("page_id", "url").orderBy(F.xxhash64("url", "page_id"), "url", "page_id").limit(train)
    # pages are read where they lie; only train keys at most are sent around
    sample = known.select("page_id", "url", "html").join(F.broadcast(chosen), ["page_id", "url"], "left_semi")
    texts = extract(sample).select("page_id", "url", "text")
    told = cut(statistics(texts, "page_id", keep=["url"]))  # else every use of them would compute them anew
    return told.select("url", base_failed().alias("bad"))


def mined_rules(pages: DataFrame, labels: DataFrame) -> list[tuple[list[str], float, float]]:
    """The rules of both kinds of labels, once each, best first."""
    best: dict[tuple[str, ...], tuple[float, float]] = {}
    for names, c, s in [*mine(labelled_urls(pages, labels)), *mine(content_labelled(pages))]:
        best[tuple(names)] = max((c, s), best.get(tuple(names), (0.0, 0.0)))
    return sorted(((list(t), *x) for t, x in best.items()), key=lambda r: (-r[1], -r[2], r[0]))


def op4_url_rules(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return url_verdicts(pages, mined_rules(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))
