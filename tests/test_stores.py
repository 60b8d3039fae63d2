"""Stored tables and indexes: what a change rewrites, old versions, and results equal to building anew."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval, text_index, vector_index
from lodestone.sources.store import KeyedTable, Manifest


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def test_keyed_table(spark, root):
    t = KeyedTable(spark, root, "k long, v string", ["k"], buckets=16)
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    first = t.change(rows)
    assert set(first.values()) == {1} and len(first) == 16
    new = spark.createDataFrame([(3, "b"), (4, "b"), (5000, "c"), (5000, "d"), (None, "n")], "k long, v string")
    touched = {r[0] for r in new.select(t.bucket()).distinct().collect()}
    second = t.change(new)
    assert {b for b, v in second.items() if v == 2} == touched and len(touched) < 16
    written = {int(x.split("=")[1]) for x in os.listdir(root.removeprefix("file://") + "/data/version=2") if x.startswith("bucket=")}
    assert written == touched
    assert {(r.k, r.v) for r in t.read().filter("v <> 'a'").collect()} == {(3, "b"), (4, "b"), (5000, "d"), (None, "n")}
    assert t.read().count() == 1002 and t.read(1).count() == 1000 and t.read(1).filter("v <> 'a'").count() == 0
    t.change(gone=spark.createDataFrame([(3,), (None,), (77777,)], "k long"))
    assert t.read().count() == 1000 and t.read(2).count() == 1002
    assert t.lookup(spark.createDataFrame([(4,), (3,)], "k long")).collect()[0].v == "b"
    with pytest.raises(ValueError):
        t.read(9)


def test_keyed_table_order_and_emptiness(spark, root):
    t = KeyedTable(spark, root, "k long, at long, v string", ["k"], buckets=4)
    assert t.read().count() == 0 and t.change() == {}
    t.change(spark.createDataFrame([(1, 5, "x"), (1, 9, "a"), (1, 2, "z")], "k long, at long, v string"), order=F.col("at"))
    assert [r.v for r in t.read().collect()] == ["a"]
    assert t.change(gone=spark.createDataFrame([(1,)], "k long")) == {} and t.read().count() == 0 and t.read(1).count() == 1


def test_unfinished_change_leaves_the_version(spark, root, monkeypatch):
    t = KeyedTable(spark, root, "k long, v string", ["k"], buckets=4)
    t.change(spark.createDataFrame([(1, "a")], "k long, v string"))
    new = spark.createDataFrame([(1, "b")], "k long, v string")
    with monkeypatch.context() as m:
        m.setattr(Manifest, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            t.change(new)
    assert t.read().first().v == "a"
    t.change(new)
    assert t.read().first().v == "b" and t.manifest.latest() == 2


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def _docs(spark, n):
    """Documents of skewed words; a rare word in a few."""
    words = F.array(*map(F.lit, WORDS))
    pick = lambda k: F.element_at(words, (F.pmod(F.hash(F.col("id") * 31 + k), F.lit(10)) % (k % 10 + 1) + 1).cast("int"))
    text = F.concat_ws(" ", *(pick(k) for k in range(12)), F.when(F.col("id") % 97 == 0, F.repeat(F.lit("rare "), (F.col("id") % 5).cast("int"))))
    return spark.range(n).select("id", F.when(F.col("id") % 211 == 5, None).otherwise(text).alias("text"))


QUERIES = [(1, "alpha rare"), (2, "Beta, GAMMA!"), (3, "nothing here"), (4, ""), (5, None), (6, "kappa iota rare theta"), (7, "alpha alpha")]


def found(df):
    return sorted((r.qid, r["rank"], r.id, round(r.score, 5)) for r in df.collect())


def test_index_equals_scoring_everything(spark, root, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 64)
    docs, queries = _docs(spark, 3000), spark.createDataFrame(QUERIES, "qid long, text string")
    index = text_index.TextIndex(spark, root, buckets=8)
    assert index.topk(queries).count() == 0
    index.change(docs)
    assert found(index.topk(queries, 10)) == found(retrieval.bm25_topk(queries, docs, 10))
    # changed, added, repeated and deleted documents
    changed = _docs(spark, 3000).filter("id % 10 = 3").withColumn("text", F.concat(F.lit("rare gamma "), F.coalesce("text", F.lit("")))).unionAll(spark.createDataFrame([(9001, "alpha rare rare"), (9001, "rare")], "id long, text string"))
    gone = spark.createDataFrame([(k,) for k in [*range(0, 3000, 10), 424242]], "id long")
    index.change(changed, gone)
    now = docs.filter("id % 10 NOT IN (0, 3)").unionAll(changed.filter("text <> 'rare'"))
    want = found(retrieval.bm25_topk(queries, now, 10))
    assert found(index.topk(queries, 10)) == want
    index.change(changed.limit(5))  # again, the same texts
    assert found(index.topk(queries, 10)) == want
    index.merge()
    assert found(index.topk(queries, 10)) == want
    assert [s.gone for s in index._segments()] == [0]


def test_index_reads_buckets_of_its_terms_and_prunes_blocks(spark, root, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 32)
    # long documents of the common word first, so their blocks can't reach the short ones
    docs = spark.range(4000).select("id", F.when(F.col("id") % 100 == 7, "rare common").otherwise(F.concat(F.lit("common "), F.repeat(F.lit("filler "), 60))).alias("text")).repartition(1)
    index = text_index.TextIndex(spark, root, buckets=32)
    index.change(docs)
    queries = spark.createDataFrame([(1, "rare common")], "qid long, text string")
    asked, buckets, few = index.asked(queries)
    assert 1 <= len(buckets) <= 2
    files = [r.f for r in index._postings(buckets).select(F.input_file_name().alias("f")).distinct().collect()]
    assert files and all(any(f"bucket={b}/" in f for b in buckets) for f in files)
    plan = index.scores(asked, buckets, few, index.bounds(asked, buckets, few).drop("bound"))._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.split("\n") if "FileScan" in line and "block#" in line]
    assert reads and all("PartitionFilters: [bucket" in line or "PartitionFilters: [isnotnull(bucket" in line for line in reads)
    assert not any("terms#" in line for line in plan.split("\n"))
    from pyspark.sql.window import Window

    ranked = index._kept(index.bounds(asked, buckets, few).withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "segment", "block"))))
    lead = retrieval.top_k(index.scores(asked, buckets, few, ranked.filter(F.col("nth") <= text_index.LEAD).select("qid", "segment", "block"), 5), 5)
    assert index.survivors(ranked, lead, 5).count() < ranked.count()
    assert found(index.topk(queries, 5)) == found(retrieval.bm25_topk(queries, docs, 5))


def test_index_tenants(spark, root):
    docs = spark.createDataFrame([(1, "x", "alpha beta"), (2, "y", "alpha"), (3, "y", "alpha gamma"), (4, None, "alpha")], "id long, tenant string, text string")
    queries = spark.createDataFrame([(1, "x", "alpha"), (2, "y", "alpha gamma"), (3, "z", "alpha")], "qid long, tenant string, text string")
    index = text_index.TextIndex(spark, root)
    index.change(docs)
    assert found(index.topk(queries)) == found(retrieval.bm25_topk(queries, docs))
    index.change(gone=docs.filter("id = 3"))
    assert found(index.topk(queries)) == found(retrieval.bm25_topk(queries, docs.filter("id <> 3")))


def _vectors(spark, n=1500, groups=12):
    """Vectors around some centres, with a domain each."""
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(groups, 16)) * 3
    made = centres[np.arange(n) % groups] + rng.normal(size=(n, 16)) * 0.2
    rows = [(k, (v / np.linalg.norm(v)).tolist() if k % 50 else None, k % 3 if k % 7 else None) for k, v in enumerate(made)]
    return spark.createDataFrame(rows, "id long, vector array<float>, domain int")


def hits(df):
    return sorted((r.qid, r["rank"], r.id, round(r.score, 5)) for r in df.collect())


def test_vector_index(spark, root):
    rows = _vectors(spark)
    index = vector_index.VectorIndex(spark, root, "id long, vector array<float>, domain int", lists=12)
    queries = rows.filter("id % 20 = 1").select(F.col("id").alias("qid"), "vector", "domain")
    assert index.search(queries).count() == 0
    index.change(rows)
    exact = lambda v, **more: hits(retrieval.dense_topk(queries, v.select("id", "vector", "domain"), 10, other=True, **more))
    assert hits(index.search(queries, 10, 2, other=True, exact=True)) == exact(rows)
    assert hits(index.search(queries, 10, 1, other=True, within="domain", exact=True)) == exact(rows, within="domain")
    probes = index.calibrate(queries, 10, 0.9, other=True)
    assert index.recall(queries, 10, probes, other=True) >= 0.9 and probes < 12
    # only the probed lists are read
    near = index._kept(index._ranked(queries.limit(1).select("qid", "vector"), index.centroids(), __import__("numpy").zeros(12), [])).filter("place < 1")
    assert near.count() == 1
    changed = rows.filter("id % 10 = 2").withColumn("vector", F.reverse("vector"))
    index.change(changed, rows.filter("id % 10 = 7").select("id"))
    now = rows.filter("id % 10 NOT IN (2, 7)").unionAll(changed)
    assert hits(index.search(queries, 10, 2, other=True, exact=True)) == exact(now)


def test_vector_index_of_nothing(spark, root):
    index = vector_index.VectorIndex(spark, root)
    index.change(_vectors(spark).select("id", "vector").filter("1 = 0"))
    assert index.search(spark.createDataFrame([(1, [1.0])], "qid long, vector array<float>")).count() == 0


def test_ordered_scan(spark, root):
    from lodestone.sources.ordered_scan import OrderedScan

    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"), F.lit("x").alias("text"))
    scan = OrderedScan.written(df, ["a", "b"], root, rows=100)
    want = sorted((k % 7, k) for k in range(1000))
    got, last = [], None
    while rows := scan.after(last, 170).collect():
        got += [(r.a, r.b) for r in rows]
        last = got[-1]
        assert len(scan.parts_after(last, 170)) <= 4  # of ten
    assert got == want and scan.rows() == 1000
    none = OrderedScan.written(df.filter("1 = 0"), ["a", "b"], f"{root}-0")
    assert none.after(None, 5).count() == 0 and none.last_key(none.after(None, 5)) is None
