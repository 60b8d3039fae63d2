"""Functions and operators on hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scoring, text, version
from lodestone.operators import documents, evidence, ledger, metrics, retrieval
from lodestone.plans import texts
from lodestone.streaming import events


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def words(*values):
    return F.array(*map(F.lit, values)).cast("array<string>") if values else F.expr("cast(array() as array<string>)")


LINEAGE = ("1.18", "v1.33", "1.29", "1.25")


@pytest.mark.parametrize(
    ("v", "site", "eol", "lineage", "want"),
    [
        ("1.29", "kubernetes", False, LINEAGE, 0.75),
        ("v1.33", "kubernetes", False, LINEAGE, 1.0),
        ("1.18", "kubernetes", True, LINEAGE, 0.25),
        ("latest", "prometheus", False, ("latest",), 1.0),
        ("2.4", "apache", False, ("2.4",), 0.7),
        ("2.2", "apache", True, ("2.2",), 0.3),
        ("", "apache", False, LINEAGE, 0.5),
    ],
)
def test_currency(spark, v, site, eol, lineage, want):
    got = one(spark, version.currency_fit(F.lit(v), F.lit(site), F.lit(eol), words(*lineage), ("apache", "kubernetes")).alias("x"))
    assert got.x == pytest.approx(want)


@pytest.mark.parametrize(("v", "target", "want"), [("v1.25", "1.25", 1.0), ("v1.29", "v1.33", 0.5), ("v1.18", "1.33", 0.0), ("", "1.33", 0.5)])
def test_match(spark, v, target, want):
    lineage = words("v1.18", "v1.25", "v1.29", "v1.33")
    assert one(spark, version.match_fit(F.lit(v), lineage, words(target)).alias("x")).x == want


def test_masking(spark):
    secret = "a1" * 32
    raw = f"Authorization: Bearer abc.def\npassword = hunter2\nmail a.b@example.org from 10.1.2.3 key {secret} id {'7' * 40}\n```\ncode"
    out = one(spark, text.mask_secrets(F.lit(raw)).alias("x")).x
    assert out.splitlines()[:3] == ["Authorization: Bearer [MASKED_TOKEN]", "password = [MASKED_SECRET]", f"mail [MASKED_EMAIL] from [MASKED_PRIVATE_IP] key [MASKED_SECRET] id {'7' * 40}"]
    assert out.count("```") == 2 and out.endswith("```\n")
    assert one(spark, text.mask_secrets(F.lit(None).cast("string")).alias("x")).x == ""


def test_keywords(spark):
    out = one(spark, text.keywords(F.lit("run `kubectl get pods` now, see OOMError and kubectl apply -f x\nKubectl OOMError"), words("A", "B", "C")).alias("x")).x
    assert out == ["kubectl get pods", "kubectl apply -f x", "OOMError", "B", "C"]


def test_fusion(spark):
    rows = [("dense", 0, "a", 1, 0.9), ("dense", 0, "b", 2, 0.8), ("bm25", 1, "b", 1, 12.0), ("bm25", 1, "c", 2, 8.0)]
    lists = spark.createDataFrame([(1, *r) for r in rows], "qid long, source string, source_order int, id string, rank int, score double")
    out = retrieval.rrf(lists).orderBy("rank").collect()
    assert [r.id for r in out] == ["b", "a", "c"]
    assert out[0].source_scores == {"bm25": 12.0, "dense": 0.8}


def test_dense_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rows = [(i, [float(i % 5), float(i % 7), 1.0]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = spark.createDataFrame(rows[:8], "qid long, vector array<double>")
    got = {(r.qid, r.id, r.rank) for r in retrieval.dense_topk(queries, vectors, 4, other=True).collect()}
    want = set()
    for q, x in rows[:8]:
        best = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q))[:4]
        want |= {(q, i, n) for n, (_, i) in enumerate(best, 1)}
    assert got == want


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "qid long, id string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "x")], "qid long, id string")
    at2 = metrics.retrieval_metrics(ranked, relevant, 2).first()
    assert (at2.hit, at2.rr, at2.recall) == (1.0, 0.5, 0.5)
    assert metrics.retrieval_metrics(ranked, relevant, 1).first().hit == 0.0


def test_quota(spark):
    counts = spark.createDataFrame([("a", 5479), ("b", 1264), ("c", 615), ("d", 364), ("e", 77)], "name string, n long")
    assert {r.name: r.quota for r in ledger.quota(counts, 50, 8).collect()} == {"a": 15, "b": 10, "c": 9, "d": 8, "e": 8}


def test_waiver(spark):
    columns = "qid long, chunk_id string, page_id long, doc_key string, site string, version string, is_eol boolean, raw double, score double, hash string, snippet string, recency double"
    rows = [(1, "c1", 1, "k:flag", "s", "1.33", False, 0.95, 0.9, "h1", "", 1.0), (1, "c2", 2, "k:flag", "s", "1.25", False, 0.90, 0.9, "h2", "", 1.0), (1, "c3", 3, "k:other", "s", "1.33", False, 0.30, 0.1, "h3", "", 1.0)]
    docs = spark.createDataFrame(rows, columns).withColumn("targets", words("1.33"))
    docs = evidence.annotated(evidence.with_lineage(docs, evidence.lineages(docs)))
    survivors = evidence.collapsed(docs).filter("survives")
    assert {r.chunk_id for r in survivors.collect()} == {"c1", "c3"}
    state = evidence.scored(docs.select("qid", "targets").distinct(), survivors)
    row = state.first()
    assert (row.waiver, row.coverage) == (True, 1.0)
    assert evidence.next_step(state, survivors).first().action == "proceed"


def test_router(spark):
    rows = [(["a"], ["a"], 0.9), (["a", "b"], ["a"], 0.6), (["b"], ["c"], 0.3), (["a", "b"], ["b", "a"], None)]
    df = spark.createDataFrame(rows, "gold array<string>, pred array<string>, confidence double")
    out = metrics.multi_label(df).first()
    assert (out.primary_accuracy, out.exact_ordered, out.exact_set) == (0.5, 0.25, 0.5)
    assert metrics.secondary_rates(df).first().under_rate == 0.5
    scored = df.withColumn("correct", F.get("gold", F.lit(0)) == F.get("pred", F.lit(0)))
    assert metrics.calibration_error(scored).first().excluded == 1


PAGE = """# Guide
Intro text.

## Root cause
The disk was full.

| a | b |
|---|---|
| 1 | 2 |

```bash
df -h
"""


def _pages(spark, *texts):
    return spark.createDataFrame([(f"p{i}", "Guide", t) for i, t in enumerate(texts)], "page_id string, title string, text string")


def test_blocks_and_chunks(spark):
    rows = documents.parse_blocks(_pages(spark, PAGE)).orderBy("place").collect()
    assert [r.kind for r in rows] == ["heading", "paragraph", "heading", "paragraph", "table", "code"]
    assert (rows[-1].language, rows[-1].headings) == ("bash", ["Guide", "Root cause"])
    pages = _pages(spark, PAGE, "word " * 3000 + ".", None, "")
    rows = documents.chunk_pages(pages).collect()
    for page in ("p0", "p1"):
        own = sorted((r for r in rows if r.page_id == page), key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in own] == list(range(len(own)))
        assert own[0].chunk_id == f"{page}_000"
    assert {r.page_id for r in rows} == {"p0", "p1"}
    assert documents.enriched(documents.chunk_pages(pages)).filter("embedding_text is null").count() == 0


def test_strange_blocks(spark):
    text = "- a\n  | not | table |\n\n  | x |\npara\n#  \nmore\n```py\n# code\n\n| no |\n```\n1) n\n\ttab\n# H1\n### H3\n## H2\n```\nopen to the end\n\n# still"
    rows = documents.parse_blocks(_pages(spark, text)).orderBy("place").collect()
    assert [(r.kind, r.text.split("\n")[0]) for r in rows] == [("list", "- a"), ("table", "  | x |"), ("paragraph", "para"), ("paragraph", "#  "), ("code", "```py"), ("list", "1) n"), ("heading", "# H1"), ("heading", "### H3"), ("heading", "## H2"), ("code", "```")]
    assert rows[-1].text.endswith("# still") and rows[-1].headings == ["H1", "H2"] and rows[7].headings == ["H1", "H3"]


def test_large_blocks_are_cut_to_size(spark):
    sentences = " ".join(f"Sentence number {i} has some words in it." for i in range(300))
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| cell {i} | value {i} |" for i in range(200))
    code = "```py\n" + "\n".join(f"x{i} = {i}" for i in range(500)) + "\n```"
    rows = documents.chunk_pages(_pages(spark, sentences, table, code)).orderBy("page_id", "chunk_index").collect()
    assert all(r.tokens <= documents.SIZES.child_most for r in rows) and len(rows) > 6
    assert all("| a | b |\n|---|---|\n| cell" in r.content for r in rows if r.page_id == "p1")
    assert all("```py\n" in r.content and r.content.endswith("\n```") and r.content.count("```") == (4 if r.overlap else 2) for r in rows if r.page_id == "p2")
    told = " ".join(r.content for r in rows if r.page_id == "p0")
    assert told == sentences


def test_context_and_overlap(spark):
    """Code brings the text before it along, and a child begins with the last lines of the one before."""
    intro = "How to start the service:"
    code = "```sh\n" + "\n".join(f"run step {i}" for i in range(120)) + "\n```"
    lines = "\n".join(f"line {i} of a long paragraph with words" for i in range(45))
    rows = documents.chunk_pages(_pages(spark, f"{intro}\n\n{code}\n\n{lines}\n\n{lines}")).orderBy("chunk_index").collect()
    assert rows[0].content.startswith(intro) and "```sh" in rows[0].content and rows[0].overlap == 0
    assert rows[1].overlap > 0 and rows[1].content.startswith("```\n") and rows[1].content.count("```") == 2
    for r in rows[1:]:
        assert r.overlap <= documents.SIZES.overlap + 20
    assert documents.plan_children([100, 500], ["paragraph", "code"], [[100], [250, 250]], 50, 400, 650, 120) == [([0], [], 0, 550), ([0, 1], [0], 1, 50)]


def test_short_parents_join(spark):
    text = "# Root cause one\nThe disk.\n# Root cause two\nThe net.\n# Timeline\n10:00 start\n"
    rows = documents.parent_chunks(_pages(spark, text)).orderBy("parent_id").collect()
    assert [(r.parent_id, r.section) for r in rows] == [("p0_p000", "root_cause"), ("p0_p001", "timeline")]
    assert "The disk." in rows[0].content and "The net." in rows[0].content and rows[0].blocks == ["paragraph"]


def test_flat_splits(spark):
    text = "# One\n" + "\n\n".join(f"Paragraph {i} " + "word " * 30 for i in range(20)) + "\n## Two\n" + "x" * 50 + " tail"
    pages = _pages(spark, text, None)
    for name in documents.STRATEGIES:
        rows = documents.chunked(pages, name, 100, 20).orderBy("place").collect()
        assert rows and all(r.page_id == "p0" and r.content for r in rows) and "".join(rows[-1].content.split()).endswith("tail")
    rows = documents.chunked(pages, "markdown", 100, 20).orderBy("place").collect()
    assert rows[0].headings == ["One"] and rows[-1].headings == ["One", "Two"]
    rows = documents.chunked(pages, "recursive", 100, 40).orderBy("place").collect()
    assert all(r.tokens <= 100 for r in rows) and rows[0].content.splitlines()[-1] == rows[1].content.splitlines()[0]
    with pytest.raises(ValueError):
        documents.chunked(pages, "none")
    names = {documents.index_name(s, n) for s in documents.STRATEGIES for n in (100, 200)}
    assert len(names) == 8 and documents.index_name("token") == documents.index_name("token", 400, 50)


def test_split_totals(spark, small):
    """The totals of the chunks that `chunked` makes, each page read once for all strategies; ids differ beyond 1,000 chunks."""
    sections = "\n\n".join(f"# Cause {i}\nWhat broke in step {i}? The disk.\n- a\n  b" for i in range(120))
    korean = "서버가 멈췄다! 다시 켠다. " * 300 + "\u0085end"
    code = "```py\n" + "x = f(1)\n" * 90 + "```\n\n| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 60
    pages = _pages(spark, sections, korean, code, "one " * 2500, " \n\n\t", "", None)
    for size, overlap in ((100, 20), (3, 1)):
        got = {tuple(r) for r in documents.split_totals(pages, list(documents.STRATEGIES), size, overlap).collect()}
        want = set()
        for name in documents.STRATEGIES:
            rows = documents.chunked(pages, name, size, overlap)
            want |= {tuple(r) for r in rows.groupBy("page_id").agg(F.lit(name), F.count("*"), F.sum("tokens"), F.max("tokens")).collect()}
            assert rows.count() == rows.select("chunk_id").distinct().count()
        assert got == want and max(r[2] for r in got) > (1000 if size == 3 else 25)
    with pytest.raises(ValueError):
        documents.split_totals(pages, ["token", "none"])
    # pages are dealt out before their texts are made, and only the names of pages are shuffled
    out = texts.flat_splits(spark, small)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == plan.count("Exchange") == 1 and out.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_windows(spark):
    lines = "\n".join(f"line {i}" for i in range(100))
    rows = documents.transcript_windows(_pages(spark, lines), 100, 20).orderBy("place").collect()
    assert rows[0].content == lines[: len(rows[0].content)] and rows[0].content.endswith("\n")
    assert rows[-1].begin + len(rows[-1].content) == len(lines)
    assert all(b.begin == a.begin + len(a.content) - 20 for a, b in zip(rows, rows[1:], strict=False))
    assert [(r.begin, r.content) for r in documents.transcript_windows(_pages(spark, None), 10, 2).collect()] == [(0, "")]
    with pytest.raises(ValueError):
        documents.transcript_windows(spark.range(0), 10, 10)


def test_tree_reduction(spark):
    parts = spark.createDataFrame([("a", i, f"t{i}") for i in range(17)] + [("b", 0, "only")], "page_id string, place int, text string")
    out = {r.page_id: r.text for r in documents.tree_reduced(parts, lambda t: F.array_join(t, "+")).collect()}
    assert out == {"a": "+".join(f"t{i}" for i in range(17)), "b": "only"}


def test_markdown():
    out = documents.to_markdown("<nav>x</nav><h2>T</h2><p>a <a href='https://e.org/x'>link</a> <a href='/y'>in</a><!-- c --></p><img alt='pic'><pre>code\n x</pre>")
    assert "## T" in out and "link (https://e.org/x)" in out and "in" in out and "/y" not in out and "[이미지: pic]" in out and "```\ncode\n x\n```" in out
    assert "nav" not in out and documents.to_markdown("") == ""
    macro = "<ac:structured-macro ac:name='code'><ac:parameter ac:name='language'>py</ac:parameter><ac:plain-text-body><![CDATA[a = 1\nb]]></ac:plain-text-body></ac:structured-macro><ac:structured-macro ac:name='toc'>x</ac:structured-macro>"
    assert documents.to_markdown(macro) == "```\na = 1\nb\n```\n"
    assert documents.to_markdown("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>") == "| a | b |\n| --- | --- |\n| 1 | 2 |\n"
    assert documents.to_markdown("<p class='left-column'>kept</p><p id='left-column'>gone</p><div class='a sidebar'>gone</div><div data-nav='1'>gone</div>") == "kept\n"


def test_late_events(spark):
    rows = [(1, "w", "progress", 1, "2024-01-01 00:00:01"), (3, "w", "report", 0, "2024-01-01 00:00:03"), (2, "w", "progress", 2, "2024-01-01 00:00:02")]
    df = spark.createDataFrame(rows, "event_id long, workflow string, kind string, completed long, at string").withColumn("occurred_at", F.to_timestamp("at"))
    out = events.fold_workflows(df).first()
    assert (out.status, out.completed) == ("report_ready", 2)


def test_envelopes(spark):
    df = spark.createDataFrame([("w", "t", "progress", 1, 4)], "workflow string, tenant string, kind string, completed long, total long").withColumn("occurred_at", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    sent = events.to_envelope(df, F.lit(7), F.col("kind"), F.struct(*df.columns))
    back = events.from_envelope(sent.unionByName(sent.withColumn("payload", F.lit("{"))))
    assert sorted(r.bad for r in back.collect()) == [False, True]


def test_formats(spark):
    row = one(spark, scoring.tokens_text(F.lit(1500)).alias("a"), scoring.duration_text(F.lit(2480.0)).alias("b"), scoring.backoff(F.lit(9)).alias("c"), scoring.progress(F.lit(1), F.lit(1), F.lit(3)).alias("d"), scoring.axis_top(F.lit(41.0)).alias("e"))
    assert (row.a, row.b, row.c, row.d, row.e) == ("1.5K", "2.5s", 60.0, 66.67, 50.0)


def test_domain_mode_searches_the_whole_domain(spark):
    """The vectors of a query's domain are found however many others are nearer."""
    vectors = spark.createDataFrame([(i, [1.0 - i / 1000, 0.0], 0) for i in range(150)] + [(1000 + i, [0.5 - i / 1000, 0.0], 1) for i in range(20)] + [(2000, [0.1, 0.0], 2)], "id long, vector array<double>, domain int")
    queries = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [1.0, 0.0], 3)], "qid long, vector array<double>, domain int")
    found = lambda mode: sorted((r.qid, r["rank"], r.id) for r in retrieval.domain_mode(queries, vectors, mode, 3).collect())
    hard = [(1, 1, 1000), (1, 2, 1001), (1, 3, 1002)]
    nearest = lambda q: [(q, i + 1, i) for i in range(3)]
    assert found("hard") == [*hard, (2, 1, 2000)]
    assert found("soft") == [*nearest(1), *nearest(2), *nearest(3)]
    assert found("hybrid") == [*hard, *nearest(2), *nearest(3)]


def test_percentiles_hold_no_group_in_a_row(spark):
    values = [float(i % 700) / 7 for i in range(5000)]
    rows = spark.createDataFrame([("a", v) for v in values] + [(None, 2.0), (None, 4.0), ("b", None), ("c", 5.0), ("c", None)], "g string, v double")
    df = metrics.percentiles(rows, "g", "v", 0.9)
    plan = df._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "percentile(" not in plan
    got = {r.g: (r.linear, r.nearest, r.upper) for r in df.collect()}
    ordered = sorted(values)
    place = 0.9 * (len(ordered) - 1)
    low, part = int(place), place - int(place)
    assert got["a"] == (pytest.approx(ordered[low] * (1 - part) + ordered[low + 1] * part, abs=1e-6), ordered[round(place)], ordered[round(0.9 * len(ordered) + 0.5) - 1])
    assert got[None] == (3.8, 4.0, 4.0) and got["b"] == (None, None, None) and got["c"] == (5.0, 5.0, 5.0)
