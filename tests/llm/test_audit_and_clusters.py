"""Divergence of sources and centroid clustering against brute force, and on odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import clusters, divergence
from lodestone.llm.common import table

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audited(rows, least=3, top=200):
    """The whole report of (lang, source, text) rows, term by term."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        tables = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        tables[None] = {t: sum(tables[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()} for s, c in tables.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], p[None][t]), t.encode()) for t in kept if tables[s][t] and p[s][t] > p[None][t]]
            for part, listed, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(sorted(listed)[:most], 1)}
    return out


def told(df):
    return [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect()]


def test_divergence(spark, small):
    docs = table(spark, small, "documents")
    got = told(divergence.op12_divergence(spark, small))
    assert len(got) == len(set(got)) and set(got) == audited([(r.lang, r.source, r.text) for r in docs.collect()])


def test_divergence_odd_rows(spark):
    rows = [("en", "a", "Apple apple ÉTÉ été x1y"), ("en", "b", "apple x Y"), ("en", None, "apple été x"), ("en", "a", None), ("en", "a", "x y z"), (None, "a", "solo"), (None, "b", ""), ("de", "a", "eins " * 5000), ("en", "b", "apple x Y")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("n", F.lit("clash")).withColumn("p", F.lit(2))
    got = told(divergence.Audit(df).report())
    assert len(got) == len(set(got)) and set(got) == audited(rows)
    assert {(r[0], r[4]) for r in got if r[0] == ""} == {("", 0)}
    assert told(divergence.Audit(df).report(top_terms=1)) and divergence.Audit(df.filter("1 = 0")).report().count() == 0


def test_divergence_many_groups(spark, monkeypatch):
    """Groups beyond the broadcast bound, and counts handed on often."""
    monkeypatch.setattr(divergence, "FEW_GROUPS", 2)
    rows = [("en", f"s{k % 7}", " ".join("w" + chr(97 + (k * j) % 23) for j in range(k % 11))) for k in range(60)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert set(told(divergence.Audit(df).report())) == audited(rows)


def clustered(vectors, k=16, rounds=3):
    """(id, vector) rows by plain comparison; rows of id, cluster, distance, sums and digest."""
    chosen = sorted(vectors, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in chosen]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        by = defaultdict(list)
        for _, v in vectors:
            by[near(v)[1]].append(v)
        for n, members in by.items():
            centroids[n] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *near(v)) for i, v in vectors]
    sums = Counter()
    for _, d, n in found:
        sums[n] += d
    return sorted(((i, n, d, sums[n], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in found), key=str)


def test_clusters(spark, small):
    rows = [(r.vec_id, [math.floor(64 * x) for x in r.embedding]) for r in table(spark, small, "embeddings").collect() if r.embedding]
    assert sorted((tuple(r) for r in clusters.op13_clusters(spark, small).collect()), key=str) == clustered(rows)


def test_clusters_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    plain = [(i, [float(x) for x in rng.integers(-3, 4, 64) / 64]) for i in range(60)]
    ties = [(100 + i, [1.0] * 64) for i in range(30)] + [(200, [0.5] * 63 + [-0.001])] * 3 + [(None, [2.0] * 64)]
    bad = [(300, None), (301, [1.0] * 63), (302, [1.0] * 65), (303, [float("nan")] + [0.0] * 63), (304, [float("inf")] + [0.0] * 63), (305, [None] + [0.0] * 63), (306, [])]
    df = spark.createDataFrame(plain + ties + bad, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash")).withColumn("vector", F.lit(1))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    want = clustered([(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in plain + ties])
    assert sorted((tuple(r) for r in clusters.op13_clusters(spark, str(tmp_path)).collect()), key=str) == want
    for k, part in enumerate(("vec_id >= 300", "vec_id < 5")):
        df.filter(part).write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
    assert clusters.op13_clusters(spark, f"{tmp_path}/0").count() == 0
    assert sorted((tuple(r) for r in clusters.op13_clusters(spark, f"{tmp_path}/1").collect()), key=str) == clustered([(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in plain[:5]])


def test_bounds_spare_comparisons(spark):
    """Far groups of vectors are compared with all centroids in the first round alone, and the result is that of plain comparison."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-2, 3, (200, 8)) + 1000 * k for k in range(4)])
    first, compared = x[[0, 200, 400, 600]] + 3, []
    old, centroids = first, np.stack([x[200 * k : 200 * (k + 1)].mean(axis=0).astype(int) for k in range(4)])
    plain = clusters._scan
    try:
        clusters._scan = lambda v, c: compared.append(len(v)) or plain(v, c)
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"vec_id": list(range(800)), "vector": pa.array(x.tolist(), pa.list_(pa.int32()))})
        [state] = clusters._first(first)([batch])
        [again] = clusters._again(centroids, old)([state])
    finally:
        clusters._scan = plain
    assert compared[0] == 800 and sum(compared[1:]) == 0
    assert again.column("cluster").to_pylist() == plain(x, centroids)[0].tolist()
