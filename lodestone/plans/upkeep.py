"""Queries over the upkeep of indexes: scans, projections, bulk writes, runs, owners, outbox, streams, keywords of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import classify
from lodestone.operators import graph, ledger, monitoring
from lodestone.sources import files
from lodestone.streaming import events as stream
from lodestone.streaming import processor, sinks

from .inputs import graph_rows, shared_folder, table

NOW = "2024-01-10 00:00:00"


def _now():
    return F.to_timestamp(F.lit(NOW))


# scans and files


def page_scan(spark, sf_dir: str) -> DataFrame:
    """The first 50 pages in order of title and id."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_name").alias("title"))
    return files.page_scan(p, 50)


def chunk_scan(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 6 != 0, F.col("doc_id")).alias("chunk_id"), F.col("text").alias("content"))
    return files.chunk_scan(d).select("chunk_id")


def recent_pages(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("page_id"), F.col("ts").alias("last_modified"))
    return files.recent_pages(e, _now(), 48, 40).select("page_id")


def listed_once(spark, sf_dir: str) -> DataFrame:
    """Pages of a paged listing that repeats some of them."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), "event_id")
    return files.distinct_pages(e, "event_id")


def repository_docs(spark, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.element_at(F.array(F.lit("README.md"), F.concat(F.lit("docs/"), "p_brand", F.lit("/"), k.cast("string"), F.lit(".MD")), F.concat(F.lit("src/"), k.cast("string"), F.lit(".md")), F.lit("docs/x.txt"), F.lit("docs.md")), (k % 5 + 1).cast("int"))
    return files.repository_docs(table(spark, sf_dir, "part").select(path.alias("path"), F.col("p_name").alias("text")), "own/repo")


def issue_texts(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    rows = o.select(
        k.alias("number"), F.col("o_orderpriority").alias("title"), F.when(k % 2 == 0, "open").otherwise("closed").alias("state"), (k % 5 == 0).alias("is_pull"), F.when(k % 3 != 0, "body").alias("body"), F.when(k % 4 == 0, none).otherwise(F.array(F.lit(" "), F.lit("c1"), F.lit("c2"))).alias("comments")
    )
    return files.issues(rows, "own/repo", "open")


def chunk_previews(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 3).alias("page_id"), F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"))
    out = files.previews(d, 20).select("page_id", F.explode("chunks").alias("c"))
    return out.select("page_id", "c.chunk_id", "c.preview")


SCHEMA = "p_partkey long, p_name string, p_retailprice double"


def jsonl_replaced(spark, sf_dir: str) -> DataFrame:
    """Rows written as JSON lines twice; what is read are those of the second time."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    path = shared_folder(spark, "lines")
    files.replace_jsonl(p.filter("p_partkey < 5"), path)
    files.replace_jsonl(p, path)
    return files.read_current(spark, path, SCHEMA)


def index_records(spark, sf_dir: str) -> DataFrame:
    """The nested records of chunks, flattened again."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 4).alias("parent_id"), F.col("doc_id").alias("page_id"), F.col("source").alias("title"), F.col("text").alias("content"), F.lit("").alias("embedding_text"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "lang", "n_chars")
    out = files.index_records(d)
    return out.select("chunk_id", "parent_id", "hash", F.col("metadata.lang").alias("lang"), F.col("metadata.n_chars").alias("n_chars"))


# indexes


def _ledger(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select((k % 3).alias("tenant"), F.concat(F.lit("p"), k.cast("string")).alias("page_id"), "source", F.substring_index(F.coalesce("text", F.lit("")), " ", 1).alias("title"), F.when(k % 4 != 0, F.col("lang")).alias("domain"), F.when(k % 5 != 0, F.col("text")).alias("cleaned"))


def index_documents(spark, sf_dir: str) -> DataFrame:
    return ledger.index_documents(_ledger(spark, sf_dir), F.lit(1)).select("id", "doc_id", "source", "domain", F.length("content").alias("n"))


def document_upsert(spark, sf_dir: str) -> DataFrame:
    """Documents upserted by tenant and id, and some of them got back."""
    stored = ledger.index_documents(_ledger(spark, sf_dir), F.lit(1)).select("id", "source")
    new = stored.filter(F.substring("id", -1, 1) == "4").withColumn("source", F.lit("new"))
    return ledger.upsert(stored, new, ["id"]).filter(F.substring("id", -1, 1).isin("4", "7"))


def chunk_delete(spark, sf_dir: str) -> DataFrame:
    """Chunks without those deleted; ids that aren't there do no harm."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    gone = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("chunk_id"))
    return d.join(gone, "chunk_id", "left_anti")


def point_payload(spark, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.lit("x").alias("embedding_text"), "label")
    return ledger.payload(v, F.lit("default"))


def bulk_batches(spark, sf_dir: str) -> DataFrame:
    """All chunks are in some batch, and batches are about of the size asked for."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    per = ledger.batches(d, "doc_id", 50, F.lit(None).cast("string")).groupBy("batch").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("rows"), (F.max("n") < 150).alias("even"))


def changed_postings(spark, sf_dir: str) -> DataFrame:
    """The postings of an index after some documents have changed: theirs are replaced, the others stay."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    listed = lambda df: df.select("doc_id", F.explode(F.split("text", "[\\x20\\x09-\\x0D]+")).alias("term")).filter("term <> ''").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    new = d.filter("doc_id % 10 = 0").withColumn("text", F.lit("changed text changed"))
    return ledger.upsert(listed(d), listed(new), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("words"))


def store_counts(spark, sf_dir: str) -> DataFrame:
    """Documents by source, and the chunks and pages of the index; its fingerprint changes with any chunk."""
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 4).alias("page_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    a, b = ledger.fingerprint(chunks), ledger.fingerprint(chunks.withColumn("hash", F.when(F.col("chunk_id") == 7, "x").otherwise(F.col("hash"))))
    by_source = d.groupBy("source").agg(F.count("*").alias("n"))
    both = a.join(F.broadcast(b.select(F.col("fingerprint").alias("_other"))), F.lit(True)).select("chunks", "pages", (F.col("fingerprint") != F.col("_other")).alias("moves"))
    return by_source.join(F.broadcast(both), F.lit(True))  # one row


def missing_candidates(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("p_"), F.floor(F.col("doc_id") / 5).cast("string"), F.lit("_"), F.lpad((F.col("doc_id") % 5).cast("string"), 3, "0")).alias("chunk_id"), F.concat(F.lit("p_"), F.floor(F.col("doc_id") / 5).cast("string")).alias("page_id"), F.col("text").alias("content"), "doc_id")
    return ledger.candidates(d.filter("doc_id % 7 = 0"), d.filter("doc_id % 7 <> 0 and doc_id % 60 >= 5"), 10)


def adjacent_chunks(spark, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("chunk_index")).agg(F.min("l_partkey").alias("chunk_id"))
    return ledger.adjacent(line, 2, 2).select("page_id", "number", F.array_join(F.col("chunks").cast("array<string>"), ",").alias("chunks"))


# runs, owners, integrity


def _runs(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("success", "failed", "queued", "success", "running"))), (k % 5 + 1).cast("int"))
    return o.select(k.alias("run_id"), (k % 4).alias("tenant"), status.alias("status"), F.lit("stage").alias("stage"), (k % 7).alias("skipped"), F.col("o_orderdate").alias("created_at"))


def active_runs(spark, sf_dir: str) -> DataFrame:
    return ledger.active_runs(_runs(spark, sf_dir)).select("tenant", "run_id", "status")


def claimed_run(spark, sf_dir: str) -> DataFrame:
    return ledger.claimed(_runs(spark, sf_dir)).groupBy("status", "stage").agg(F.count("*").alias("n"))


def finished_runs(spark, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    results = table(spark, sf_dir, "orders").filter(k % 5 == 4).select(k.alias("run_id"), (k % 10).alias("indexed"), (k % 3).alias("failed"), (k % 20).alias("chunks"), F.lit(0).alias("deleted"), F.when(k % 4 == 0, F.repeat(F.lit("e"), 2000)).alias("error"))
    return ledger.finished(_runs(spark, sf_dir), results).filter("status <> 'queued'").select("run_id", "status", "stage", "processed", F.length("error").alias("error"))


def owned_rows(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("tenant"), F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("user_id"))
    return ledger.owned(e, F.lit(1), F.lit(5)).select("event_id")


def report_owners(spark, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("report"), F.col("l_orderkey").alias("workflow")).distinct()
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("workflow"), (F.col("o_custkey") % 4).alias("tenant"), F.col("o_custkey").alias("user_id"))
    return ledger.with_owner(reports, o).select("report", "tenant", "user_id")


def total_join(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return ledger.total(o.select(F.col("o_orderkey").alias("qid"), "o_orderstatus"), o.select(F.col("o_orderkey").alias("qid"), "o_orderpriority"))


def report_integrity(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    jobs = o.select(k.alias("job"), k.alias("transcription"), (k % 4).alias("tenant"), F.lit("a").alias("raw_sha"), F.lit("b").alias("corrected_sha"), F.lit("v1").alias("dictionary"))
    results = jobs.withColumn("tenant", F.when(F.col("job") % 5 == 0, 9).otherwise(F.col("tenant"))).withColumn("corrected_sha", F.when(F.col("job") % 7 == 0, None).otherwise(F.col("corrected_sha"))).withColumn("dictionary", F.when(F.col("job") % 11 == 0, "v2").otherwise("v1"))
    return ledger.integrity(jobs, results)


# outbox and streams


def _outbox(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select("event_id", F.col("ts").alias("created_at"), F.col("ts").alias("available_at"), F.when(i % 3 == 0, F.col("ts")).alias("published_at"), (i % 8).alias("attempts"), F.lit("old").alias("last_error"))


def outbox_publish(spark, sf_dir: str) -> DataFrame:
    out = stream.published(_outbox(spark, sf_dir), _now(), F.when(F.col("event_id") % 5 == 0, "Timeout"))
    wait = F.unix_timestamp("available_at") - F.unix_timestamp(_now())
    return out.select("event_id", "attempts", (F.col("published_at") == _now()).alias("now"), F.when(F.col("last_error") == "Timeout", wait).alias("wait"), "last_error")


def queue_depths(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.element_at(F.array(*map(F.lit, ("queued", "processing", "done"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("status"))
    return monitoring.queue_depths(o, _outbox(spark, sf_dir), _now())


def expired_jobs(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    jobs = e.select("event_id", F.when(F.col("event_id") % 2 == 0, "processing").otherwise("done").alias("status"), F.col("ts").alias("updated_at"), (F.col("event_id") % 5).alias("retries"))
    return stream.expired(jobs, _now()).select("event_id", "next_status")


def reclaimed_messages(spark, sf_dir: str) -> DataFrame:
    """What a consumer reads next: messages left idle for too long before new ones."""
    e = table(spark, sf_dir, "events")
    m = e.select(F.col("event_id").alias("message"), F.lit("c").alias("consumer"), F.when(F.col("event_id") % 4 == 0, F.col("ts")).alias("delivered_at"))
    return stream.reclaimed(m, _now()).select("message", "place")


def acknowledged(spark, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(k.alias("message"), F.when(k % 3 == 0, "E").alias("error"), F.when(k % 2 == 0, k % 4 == 0).alias("recoverable"))
    return stream.acknowledged(rows).groupBy("action").agg(F.count("*").alias("n"))


def stream_lag(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("message"))
    groups = e.select("stream").distinct().unionByName(spark.range(1).select(F.lit("none").alias("stream"))).select("stream", F.lit("g").alias("group"), F.lit(600).alias("delivered"), F.lit(400).alias("acked"))
    return stream.lag(e, groups)


def status_mapping(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    told = F.element_at(F.array(*map(F.lit, ("failed", "transcribing", "nonsense", "deleted"))), (k % 4 + 1).cast("int"))
    return o.select("o_orderkey", stream.mapped_status(told, F.lit("correcting"), k % 3 == 0).alias("status"))


def transcript_lifecycle(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    workflows = o.select(k.alias("workflow"), F.when(k % 2 == 0, "deleting").otherwise("correcting").alias("status"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("workflow"), F.element_at(F.array(*map(F.lit, ("transcript", "completed", "deleted", "progress"))), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("kind"))
    return stream.lifecycle(line, workflows)


def accepted_events(spark, sf_dir: str) -> DataFrame:
    """Events whose envelope is known and whose tenant is that of their workflow; the rest are dead letters."""
    e = table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    body = F.struct(F.concat(F.lit("w"), u.cast("string")).alias("workflow"), F.when(i % 6 == 0, "x").otherwise("t").alias("tenant"), F.col("event_type").alias("kind"), i.alias("completed"), i.alias("total"), F.col("ts").alias("occurred_at"))
    sent = stream.to_envelope(e, i, F.col("event_type"), body)
    sent = sent.withColumn("schema_version", F.when(F.col("event_id").cast("long") % 10 == 0, "9").otherwise(F.col("schema_version")))
    tenants = e.select(F.concat(F.lit("w"), u.cast("string")).alias("workflow"), F.lit("t").alias("tenant")).distinct()
    good, bad = stream.accepted(stream.from_envelope(sent), tenants)
    return good.select("event_id", F.lit(True).alias("accepted")).unionByName(bad.select("event_id", F.lit(False).alias("accepted")))


def late_stream_events(spark, sf_dir: str) -> DataFrame:
    """The workflow states of a stream whose first half arrives in a second batch, after the later half."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("w"), (F.col("user_id") % 50).cast("string")).alias("workflow"), F.when(F.col("event_type") == "purchase", "report").otherwise("progress").alias("kind"), F.col("event_id").alias("completed"), F.col("ts").alias("occurred_at"))
    root = shared_folder(spark, "late")
    half = F.col("event_id") < F.lit((e.agg(F.max("event_id")).first()[0] or 0) // 2)
    for part, rows in (("a", e.filter(~half)), ("b", e.filter(half))):
        rows.coalesce(1).write.mode("append").parquet(f"{root}/in")
        fed = spark.readStream.schema(e.schema).parquet(f"{root}/in")
        stream.run_once(stream.workflow_state(fed), f"{root}/out")
    out = spark.read.schema(stream.STATE).parquet(f"{root}/out")
    return out.groupBy("workflow").agg(F.max("completed").alias("completed"), F.max_by("status", F.length("status")).alias("status"), F.unix_timestamp(F.max("updated_at")).alias("updated_at"))


def workflow_jobs(spark, sf_dir: str) -> DataFrame:
    """Events through the state of their workflows: what was done, repeated or dead, the last progress, and the one job that a completed transcript makes.

    Every event is delivered twice; workflows of every fifth user were never created, and errors are of no known kind.
    """
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    u = F.concat(F.lit("w"), F.col("user_id").cast("string"))
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "signup", "transcript").when(F.col("event_type") == "error", "odd").otherwise("progress")
    told = e.select(F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("event_id"), u.alias("workflow"), F.lit("t").alias("tenant"), kind.alias("kind"), F.col("event_id").alias("completed"), F.col("ts").alias("occurred_at"))
    begun = e.filter("user_id % 5 <> 0").select(u.alias("workflow")).distinct().select(F.concat(F.lit("c"), "workflow").alias("event_id"), "workflow", F.lit("t").alias("tenant"), F.lit("created").alias("kind"), F.lit(0).cast("long").alias("completed"), F.to_timestamp(F.lit("2000-01-01")).alias("occurred_at"))
    root = shared_folder(spark, "jobs")
    for part in (begun.unionByName(told), told):
        part.repartition(4, "workflow").write.mode("append").parquet(f"{root}/in")
    fed = spark.readStream.schema(processor.EVENTS).parquet(f"{root}/in")
    settings = {"spark.sql.streaming.stateStore.providerClass": processor.PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        stream.run_once(processor.processed(fed), f"{root}/out")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(processor.OUTCOMES).parquet(f"{root}/out")
    of = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return out.groupBy("workflow").agg(of("done"), of("repeated"), of("dead"), F.max("job").alias("job"))


def routed_once(spark, sf_dir: str) -> DataFrame:
    """Events written to their routes by micro-batches, each of which is written twice, as after a failure: every row is there once."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), "user_id", F.col("event_id").alias("n"))
    root = shared_folder(spark, "routes")
    for k in range(2):
        e.filter(F.col("n") % 2 == k).repartition(2).write.mode("append").parquet(f"{root}/in")
    sink = sinks.BatchSink(f"{root}/sink", lambda rows: sinks.routed(rows, F.when(F.col("n") % 3 == 0, "E"), F.col("n") % 2 == 0, _now()))

    def twice(rows: DataFrame, batch: int) -> None:
        sink.write(rows, batch)
        sink.write(rows, batch)

    fed = spark.readStream.option("maxFilesPerTrigger", 2).schema(e.schema).parquet(f"{root}/in")
    fed.writeStream.foreachBatch(twice).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = "event_id string, user_id long, n long, attempts int, available_at timestamp, last_error string"
    read = [sink.read(spark, route, schema).select("event_id", F.lit(route).alias("route"), "attempts", (F.unix_timestamp("available_at") - F.unix_timestamp(_now())).alias("wait")) for route in sinks.ROUTES]
    return read[0].unionAll(read[1]).unionAll(read[2])


# graph


def _graph_chunks(spark, sf_dir: str) -> DataFrame:
    return graph_rows(spark, sf_dir).withColumn("page_id", F.concat(F.when(F.col("place") % 8 < 4, "gh:").otherwise("p"), F.floor(F.col("place") / 4).cast("string"))).withColumn("site", F.when(F.col("place") % 3 == 0, "kubernetes"))


def graph_from_chunks(spark, sf_dir: str) -> DataFrame:
    out = graph.from_chunks(_graph_chunks(spark, sf_dir))
    return out.select("page_id", "title", "source", "domain", "version", F.array_join("keywords", "|").alias("keywords"))


def keyword_noise(spark, sf_dir: str) -> DataFrame:
    """Made-up keywords of parts: which are noise, and how often they occur."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    made = F.element_at(F.array("p_name", F.lit("Overview:"), F.lit("[MASKED_TOKEN]"), F.concat(F.lit("@"), "p_brand"), F.lit("x"), F.repeat(F.lit("long "), 12), F.lit("배경")), (k % 7 + 1).cast("int"))
    docs = p.select(k.cast("string").alias("page_id"), F.array(made, "p_type").alias("keywords"))
    return graph.keyword_diagnosis(docs)


def cleaned_keywords(spark, sf_dir: str) -> DataFrame:
    docs = graph.documents(graph_rows(spark, sf_dir), "place").withColumn("keywords", F.concat("keywords", F.array(F.lit("see also"), F.lit("n/a"))))
    return graph.cleaned(docs).select("page_id", F.size("keywords").alias("n"))


def graph_snapshot(spark, sf_dir: str) -> DataFrame:
    """How many lines of each kind a snapshot of the graph has, read back from JSON."""
    lines = graph.snapshot(graph.documents(graph_rows(spark, sf_dir), "place"))
    told = lines.select(F.from_json("line", "is string, type string, rel string").alias("x"))
    return told.groupBy(F.col("x.is").alias("is"), F.coalesce("x.type", "x.rel").alias("kind")).agg(F.count("*").alias("n"))


def profile_of_pages(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", classify.control_domain(F.col("source"), F.expr("cast(array() as array<string>)"), F.col("text")).alias("domain"))


QUERIES = {f.__name__: f for f in (page_scan, chunk_scan, recent_pages, listed_once, repository_docs, issue_texts, chunk_previews, jsonl_replaced, index_records)}
QUERIES |= {f.__name__: f for f in (index_documents, document_upsert, chunk_delete, point_payload, bulk_batches, changed_postings, store_counts, missing_candidates, adjacent_chunks)}
QUERIES |= {f.__name__: f for f in (active_runs, claimed_run, finished_runs, owned_rows, report_owners, total_join, report_integrity)}
QUERIES |= {f.__name__: f for f in (outbox_publish, queue_depths, expired_jobs, reclaimed_messages, acknowledged, stream_lag, status_mapping, transcript_lifecycle, accepted_events, late_stream_events, workflow_jobs, routed_once)}
QUERIES |= {f.__name__: f for f in (graph_from_chunks, keyword_noise, cleaned_keywords, graph_snapshot, profile_of_pages)}

_AT = f"TIMESTAMP '{NOW}'"
_DOCS = """docs AS (SELECT '1:p' || doc_id AS id, 'p' || doc_id AS doc_id, source, CASE WHEN doc_id % 4 <> 0 THEN lang ELSE '' END AS domain, text AS content FROM documents WHERE doc_id % 3 = 1 AND doc_id % 5 <> 0 AND trim(coalesce(text, '')) <> '')"""
_RUNS = """runs AS (SELECT o_orderkey AS run_id, o_orderkey % 4 AS tenant, ['success', 'failed', 'queued', 'success', 'running'][o_orderkey % 5 + 1] AS status, o_orderkey % 7 AS skipped, o_orderdate AS created_at FROM orders)"""
_OUTBOX = f"""outbox AS (SELECT event_id AS i, ts, event_id % 8 AS attempts, event_id % 3 = 0 AS done FROM events), due AS (SELECT i FROM outbox WHERE NOT done AND ts <= {_AT} ORDER BY ts, i LIMIT 100)"""
SQL = {
    "page_scan": "SELECT p_partkey AS page_id, p_name AS title FROM part ORDER BY p_name, p_partkey LIMIT 50",
    "chunk_scan": "SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 6 <> 0 AND coalesce(text, '') <> ''",
    "recent_pages": f"SELECT event_id AS page_id FROM events WHERE ts >= {_AT} - INTERVAL 48 HOUR ORDER BY ts DESC, event_id LIMIT 40",
    "listed_once": "SELECT user_id AS page_id, min(event_id) AS event_id FROM events GROUP BY 1",
    "repository_docs": "SELECT 'gh:own/repo:' || CASE p_partkey % 5 WHEN 0 THEN 'README.md' ELSE 'docs/' || p_brand || '/' || p_partkey || '.MD' END AS page_id, p_name AS text FROM part WHERE p_partkey % 5 IN (0, 1)",
    "issue_texts": """SELECT 'gh:own/repo#' || o_orderkey AS page_id, o_orderpriority AS title, array_to_string(list_filter([CASE WHEN o_orderkey % 3 <> 0 THEN 'body' END, CASE WHEN o_orderkey % 4 <> 0 THEN 'c1' END, CASE WHEN o_orderkey % 4 <> 0 THEN 'c2' END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS text
      FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0""",
    "chunk_previews": "SELECT doc_id // 3 AS page_id, doc_id AS chunk_id, left(coalesce(text, ''), 20) AS preview FROM documents",
    "jsonl_replaced": "SELECT p_partkey, p_name, p_retailprice FROM part",
    "index_records": "SELECT doc_id AS chunk_id, doc_id // 4 AS parent_id, sha256(coalesce(text, '')) AS hash, lang, n_chars FROM documents",
    "index_documents": f"WITH {_DOCS} SELECT id, doc_id, source, domain, length(content)::INT AS n FROM docs",
    "document_upsert": f"WITH {_DOCS} SELECT id, CASE WHEN right(id, 1) = '4' THEN 'new' ELSE source END AS source FROM docs WHERE right(id, 1) IN ('4', '7')",
    "chunk_delete": "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)",
    "point_payload": "SELECT vec_id AS chunk_id, label, md5(vec_id::VARCHAR) AS point, 'default' AS tenant FROM embeddings",
    "bulk_batches": "SELECT count(*) AS rows, true AS even FROM documents",
    "changed_postings": r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(CASE WHEN doc_id % 10 = 0 THEN 'changed text changed' ELSE coalesce(text, '') END, '[^\x20\x09-\x0D]+')) AS term FROM documents)
      SELECT doc_id, count(DISTINCT term) AS terms, count(*) AS words FROM t GROUP BY doc_id""",
    "store_counts": "SELECT source, count(*) AS n, (SELECT count(*) FROM documents) AS chunks, (SELECT count(DISTINCT doc_id // 4) FROM documents) AS pages, true AS moves FROM documents GROUP BY source",
    "missing_candidates": """WITH d AS (SELECT doc_id, 'p_' || (doc_id // 5) AS page, 'p_' || (doc_id // 5) || '_00' || (doc_id % 5) AS chunk, text FROM documents)
      SELECT m.chunk AS chunk_id, l.chunk AS candidate, CASE WHEN l.chunk IS NOT NULL THEN left(coalesce(l.text, ''), 10) END AS preview FROM d m LEFT JOIN d l ON l.page = m.page AND l.doc_id % 7 <> 0 AND l.doc_id % 60 >= 5 WHERE m.doc_id % 7 = 0""",
    "adjacent_chunks": """WITH c AS (SELECT l_orderkey AS page_id, l_linenumber AS i, min(l_partkey) AS id FROM lineitem GROUP BY ALL), r AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1) // 2 AS run FROM c),
      g AS (SELECT page_id, run, string_agg(id::VARCHAR, ',' ORDER BY i) AS chunks FROM r GROUP BY page_id, run HAVING count(*) = 2 AND max(i) - min(i) = 1)
      SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY run) AS number, chunks FROM g QUALIFY number <= 2""",
    "active_runs": f"WITH {_RUNS} SELECT tenant, run_id, status FROM runs WHERE status IN ('queued', 'running') QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY created_at DESC, run_id DESC) = 1",
    "claimed_run": f"""WITH {_RUNS}, n AS (SELECT min_by(run_id, (created_at, run_id)) AS id FROM runs WHERE status = 'queued')
      SELECT CASE WHEN run_id = id THEN 'running' ELSE status END AS status, CASE WHEN run_id = id THEN 'fetching' ELSE 'stage' END AS stage, count(*) AS n FROM runs, n GROUP BY 1, 2""",
    "finished_runs": f"""WITH {_RUNS} SELECT run_id, CASE WHEN run_id % 5 = 4 AND run_id % 4 = 0 THEN 'failed' WHEN run_id % 5 = 4 THEN 'success' ELSE status END AS status, CASE WHEN run_id % 5 = 4 THEN 'completed' ELSE 'stage' END AS stage,
      CASE WHEN run_id % 5 = 4 AND run_id % 4 <> 0 THEN skipped + run_id % 10 + run_id % 3 END AS processed, CASE WHEN run_id % 5 = 4 AND run_id % 4 = 0 THEN 1000 END AS error FROM runs WHERE status <> 'queued'""",
    "owned_rows": "SELECT event_id FROM events WHERE user_id = 5 AND event_id % 5 <> 0",
    "report_owners": "SELECT DISTINCT l_orderkey * 10 + l_linenumber AS report, o_custkey % 4 AS tenant, o_custkey AS user_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 3 <> 0",
    "total_join": "SELECT o_orderkey AS qid, o_orderstatus, o_orderpriority FROM orders",
    "report_integrity": "SELECT o_orderkey AS job, CASE WHEN o_orderkey % 5 = 0 THEN 'tenant' WHEN o_orderkey % 7 = 0 THEN 'corrected_sha' WHEN o_orderkey % 11 = 0 THEN 'dictionary' END AS mismatch FROM orders",
    "outbox_publish": f"""WITH {_OUTBOX}, t AS (SELECT o.*, d.i IS NOT NULL AS tried, o.i % 5 = 0 AS bad FROM outbox o LEFT JOIN due d USING (i))
      SELECT i AS event_id, attempts + (tried AND bad)::INT AS attempts, CASE WHEN tried AND NOT bad THEN true WHEN done THEN ts = {_AT} END AS now, CASE WHEN tried AND bad THEN least(60, pow(2, attempts + 1))::BIGINT END AS wait, CASE WHEN NOT tried THEN 'old' WHEN bad THEN 'Timeout' END AS last_error FROM t""",
    "queue_depths": f"""SELECT 'report_jobs_queued' AS queue, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS depth FROM orders UNION ALL SELECT 'report_jobs_processing', count(*) FILTER (WHERE o_orderkey % 3 = 1) FROM orders
      UNION ALL SELECT 'event_outbox_pending', count(*) FROM events WHERE event_id % 3 <> 0 AND ts <= {_AT}""",
    "expired_jobs": f"""WITH j AS (SELECT event_id, event_id % 2 = 0 AND floor(epoch({_AT})) - floor(epoch(ts)) >= 300 AS late FROM events)
      SELECT event_id, CASE WHEN late AND event_id % 5 >= 3 THEN 'failed' WHEN late THEN 'queued' WHEN event_id % 2 = 0 THEN 'processing' ELSE 'done' END AS next_status FROM j""",
    "reclaimed_messages": f"SELECT event_id AS message, row_number() OVER (ORDER BY event_id) AS place FROM events WHERE event_id % 4 = 0 AND floor(epoch({_AT})) - floor(epoch(ts)) >= 300 ORDER BY event_id LIMIT 10",
    "acknowledged": "SELECT CASE WHEN event_id % 3 <> 0 THEN 'ack' WHEN event_id % 4 = 0 THEN 'pending' ELSE 'dead_letter' END AS action, count(*) AS n FROM events GROUP BY 1",
    "stream_lag": """SELECT event_type AS stream, 'g' AS "group", count(*) AS length, count(*) FILTER (WHERE event_id > 400 AND event_id <= 600) AS pending, count(*) FILTER (WHERE event_id > 600) AS lag FROM events GROUP BY 1 UNION ALL SELECT 'none', 'g', 0, 0, 0""",
    "status_mapping": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'correction_failed' ELSE 'transcription_failed' END WHEN 1 THEN 'transcribing' WHEN 2 THEN 'correcting' ELSE 'deleted' END AS status FROM orders",
    "transcript_lifecycle": """WITH e AS (SELECT l_orderkey AS w, bool_or(l_linenumber % 4 IN (0, 1)) AS t, bool_or(l_linenumber % 4 = 1) AS c, bool_or(l_linenumber % 4 = 2) AS d FROM lineitem GROUP BY 1)
      SELECT o_orderkey AS workflow, CASE WHEN o_orderkey % 2 = 0 THEN 'deleting' ELSE 'correcting' END AS status, coalesce(t, false) AS has_transcript, CASE WHEN coalesce(d, false) AND o_orderkey % 2 = 0 THEN 0 ELSE coalesce(c, false)::INT END AS jobs,
        NOT (coalesce(d, false) AND o_orderkey % 2 = 0) AS exists FROM orders LEFT JOIN e ON w = o_orderkey""",
    "accepted_events": "SELECT event_id::VARCHAR AS event_id, event_id % 6 <> 0 AND event_id % 10 <> 0 AS accepted FROM events",
    "workflow_jobs": """SELECT 'w' || user_id AS workflow, CASE WHEN user_id % 5 = 0 THEN 0 ELSE 1 + count(*) FILTER (WHERE event_type <> 'error') END AS done, count(*) AS repeated,
      CASE WHEN user_id % 5 = 0 THEN count(*) ELSE count(*) FILTER (WHERE event_type = 'error') END AS dead, CASE WHEN user_id % 5 <> 0 AND bool_or(event_type = 'purchase') THEN 'queued' END AS job FROM events GROUP BY user_id""",
    "routed_once": """SELECT event_id::VARCHAR AS event_id, CASE WHEN event_id % 3 <> 0 THEN 'published' WHEN event_id % 2 = 0 THEN 'retry' ELSE 'dead_letters' END AS route, (event_id % 3 = 0)::INT AS attempts, CASE WHEN event_id % 6 = 0 THEN 2 ELSE 0 END::BIGINT AS wait FROM events""",
    "late_stream_events": """WITH e AS (SELECT event_id, 'w' || (user_id % 50) AS workflow, event_type = 'purchase' AS report, ts FROM events)
      SELECT workflow, coalesce(max_by(event_id, (ts, event_id)) FILTER (WHERE NOT report), 0) AS completed, CASE WHEN bool_or(report) THEN 'report_ready' ELSE 'in_progress' END AS status, floor(epoch(max(ts)))::BIGINT AS updated_at FROM e GROUP BY workflow""",
    "graph_from_chunks": """WITH c AS (SELECT CASE WHEN p_partkey % 8 < 4 THEN 'gh:' ELSE 'p' END || (p_partkey // 4) AS page_id, p_partkey AS place, p_name AS title, p_type AS domain, '1.' || (p_partkey % 5) AS version,
        CASE WHEN p_partkey % 17 <> 0 THEN p_brand WHEN p_partkey % 3 = 0 THEN 'kubernetes' ELSE 'confluence' END AS source, string_split(p_name, ' ') || ['size ' || p_size, 'lot ' || (p_partkey // 3)] AS keywords FROM part)
      SELECT page_id, min_by(title, place) AS title, CASE WHEN starts_with(page_id, 'gh:') THEN 'github' ELSE min_by(source, place) END AS source, min_by(domain, place) AS domain, min_by(version, place) AS version,
        array_to_string(list_sort(list_distinct(flatten(list(keywords)))), '|') AS keywords FROM c GROUP BY page_id""",
    "keyword_noise": """WITH k AS (SELECT unnest([CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN 'Overview:' WHEN 2 THEN '[MASKED_TOKEN]' WHEN 3 THEN '@' || p_brand WHEN 4 THEN 'x' WHEN 5 THEN repeat('long ', 12) ELSE '배경' END, p_type]) AS keyword FROM part),
      c AS (SELECT keyword, count(*) AS n, keyword IN ('Overview:', '[MASKED_TOKEN]', 'x', '배경') OR keyword LIKE '@%' OR keyword LIKE 'long %' AS noise FROM k GROUP BY keyword)
      SELECT noise, row_number() OVER (PARTITION BY noise ORDER BY n DESC, keyword DESC) AS place, keyword, n FROM c QUALIFY place <= 25""",
    "cleaned_keywords": "SELECT 'p' || p_partkey AS page_id, len(list_distinct(string_split(p_name, ' ') || ['size ' || p_size, 'lot ' || (p_partkey // 3)]))::INT AS n FROM part",
    "graph_snapshot": "",
    "profile_of_pages": f"""WITH t AS (SELECT doc_id, lower(source || '  ' || left(coalesce(text, ''), 1200)) AS x FROM documents) SELECT doc_id, CASE WHEN {' OR '.join(f"contains(x, '{w}')" for w in classify.CONTROL_PLANNING)} THEN '기획서' ELSE '회의록' END AS domain FROM t""",
}


def _snapshot_sql() -> str:
    from . import reports

    return f"SELECT 'node' AS \"is\", type AS kind, count(*) AS n FROM ({reports.SQL['graph_nodes']}) GROUP BY type UNION ALL SELECT 'edge', rel, count(*) FROM ({reports.SQL['graph_edges']}) GROUP BY rel"


SQL["graph_snapshot"] = _snapshot_sql()
