"""Queries over texts: scalar functions, classification, cleaning, chunks, events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import classify, scoring
from lodestone.functions import text as X
from lodestone.operators import documents
from lodestone.streaming import events as stream

from .inputs import shared_folder, table


def _docs(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def token_count(spark, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.token_count(F.col("text")).cast("long").alias("n"))


def sha256(spark, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.text_of(F.col("text")), 256).alias("hash"), X.sha12(F.col("text")).alias("short"))


def slugify(spark, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    title = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, " [a78792-639072]").otherwise(""))
    site = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.lower("p_brand"))
    return parts.select("p_partkey", X.slugify(title).alias("slug"), X.doc_key(site, title).alias("doc_key"))


def title(spark, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.title_from(F.col("text")).alias("title"))


def clean_urls(spark, sf_dir: str) -> DataFrame:
    url = F.regexp_replace("url", "(?<=[a-z])/", "//")
    return table(spark, sf_dir, "pages").select("page_id", X.clean_url(url).alias("url"))


def snippets(spark, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.length(X.snippet(F.col("text"))).alias("n"))


def mask_pii(spark, sf_dir: str) -> DataFrame:
    masked = X.mask_secrets(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", masked.alias("text")).withColumn("masks", X.mask_count(F.col("text")))


def profile(spark, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", classify.profile(F.col("source"), F.col("text")).alias("profile"))


NONE = "cast(array() as array<string>)"


def domain_rules(spark, sf_dir: str) -> DataFrame:
    out = _docs(spark, sf_dir).select("doc_id", classify.chunk_domain(F.col("source"), F.expr(NONE), F.col("text")).alias("chunk_domain"), "text", "source")
    whole = classify.haystack(F.col("source"), F.expr(NONE), F.col("chunk_domain"), F.lit("general"), F.col("text"))
    return out.select("doc_id", "chunk_domain", classify.final_domain(whole, F.col("chunk_domain")).alias("domain"))


def section_rules(spark, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", classify.section(F.expr(NONE), F.col("text")).alias("section"), classify.control_section(F.expr(NONE), F.col("text")).alias("control"))


def _cases(text: str, rules: dict, default: str) -> str:
    when = " ".join(f"WHEN {' OR '.join(f'contains({text}, {chr(39)}{w.lower()}{chr(39)})' for w in words)} THEN '{name}'" for name, words in rules.items())
    return f"CASE {when} ELSE {default} END"


def result_bucket(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("answerable", "not_enough_evidence", "partially_answerable"))), (k % 3 + 1).cast("int"))
    return o.select("o_orderkey", scoring.result_bucket(k % 11 == 0, k % 2, status).alias("bucket"))


def _chats(spark, sf_dir: str) -> DataFrame:
    """Conversations as transcripts."""
    c = table(spark, sf_dir, "conversations")
    told = F.struct("turn", "role", F.concat("role", F.lit(": "), X.text_of(F.col("text"))).alias("line"))
    whole = c.groupBy(F.col("conv_id").alias("page_id")).agg(F.sort_array(F.collect_list(told)).alias("t"))
    return whole.select("page_id", F.lit("").alias("title"), F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("text"))


def transcript_windows(spark, sf_dir: str) -> DataFrame:
    return documents.transcript_windows(_chats(spark, sf_dir), 2000, 200).select("page_id", "place", "begin", F.sha2("content", 256).alias("content"))


def baseline_token_split(spark, sf_dir: str) -> DataFrame:
    """Windows of tokens; what stands between the tokens of a window isn't compared."""
    out = documents.token_windows(_chats(spark, sf_dir))
    bare = F.regexp_extract_all("content", F.lit(f"({X.TOKEN})"), F.lit(1))
    return out.select("page_id", "place", "tokens", F.sha2(F.array_join(bare, " "), 256).alias("content"))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows dealt out by page: a small file is read by one task, however much there is to do for a page of it."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "page_id")


def _markdown(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("title"), F.col("html").alias("text"))
    done = documents.clean_html(_dealt(pages))
    broken = F.raise_error(F.concat(F.lit("page "), F.col("page_id"), F.lit(": "), F.col("error")))
    return done.select("page_id", "title", X.mask_secrets(F.when(F.col("error").isNotNull(), broken).otherwise(F.col("content"))).alias("text"))


def clean_html(spark, sf_dir: str) -> DataFrame:
    return _markdown(spark, sf_dir).select("page_id", F.length("text").alias("n"), F.sha2("text", 256).alias("hash"))


def page_chunks(spark, sf_dir: str) -> DataFrame:
    """The chunks of the web pages, with what an embedder reads of them."""
    out = documents.enriched(documents.chunk_pages(_markdown(spark, sf_dir)))
    return out.select("chunk_id", "domain", "section", F.array_join("tags", ",").alias("tags"), "tokens", "overlap", F.sha2("embedding_text", 256).alias("embedding_text"))


# Manuals made of parts, whose blocks and chunks are known.


def _manuals(spark, sf_dir: str) -> DataFrame:
    """A page a part: headings, a paragraph, a list, a table and code, some of them left out."""
    k = F.col("p_partkey")
    parts = _dealt(table(spark, sf_dir, "part").select(F.format_string("%06d", k).alias("page_id"), k, "p_name", "p_brand", "p_type"))
    text = F.concat(
        F.lit("# "), "p_name", F.lit("\nIntro of "), "p_brand", F.lit(".\nmore\n\n"),
        F.when(k % 2 == 0, F.lit("## Root cause\n- one\n  inner\n- two\n\n")).otherwise(""),
        F.when(k % 3 == 0, F.lit("| a | b |\n|---|---|\n| 1 | 2 |\n")).otherwise(""),
        F.lit("```bash\n# no heading\nls\n```\n### Deep "), "p_type", F.lit("\nlast"),
    )
    return parts.select("page_id", F.col("p_name").alias("title"), text.alias("text"))


def parse_blocks(spark, sf_dir: str) -> DataFrame:
    out = documents.parse_blocks(_manuals(spark, sf_dir))
    return out.select("page_id", F.col("place").cast("int").alias("place"), "kind", "text", F.array_join("headings", ">").alias("headings"), "language")


def _long(spark, sf_dir: str) -> DataFrame:
    """A page a part, without headings: sentences of ten tokens, 40 to 200 of them. Parts are dealt out before they grow to pages."""
    k = F.col("p_partkey")
    parts = _dealt(table(spark, sf_dir, "part").select(F.format_string("%06d", k).alias("page_id"), (F.lit(40) + k % 161).cast("int").alias("n")))
    begin, end = "This sentence ", " has nine words before its dot."
    text = F.concat(F.lit(begin), F.array_join(F.sequence(F.lit(1), F.col("n")).cast("array<string>"), f"{end} {begin}"), F.lit(end))
    return parts.select("page_id", F.lit("t").alias("title"), text.alias("text"))


def chunk_parents(spark, sf_dir: str) -> DataFrame:
    """Manuals have one or two parents: the second begins at a known heading and joins the first where both are of one section."""
    return documents.parent_chunks(_manuals(spark, sf_dir)).select("parent_id", "section", F.array_join("blocks", ",").alias("blocks"), "tokens")


def chunk_children(spark, sf_dir: str) -> DataFrame:
    """Pages of long texts: pieces of at most 650 tokens, each led in by the last one's end."""
    return documents.chunk_pages(_long(spark, sf_dir)).select("chunk_id", "parent_id", "tokens", "overlap")


def chunk_overlaps(spark, sf_dir: str) -> DataFrame:
    """Pages of short paragraphs, some with code behind the thirteenth: children are led in by four paragraphs of the one before, and code brings the paragraph before it along."""
    k = F.col("p_partkey")
    words = F.lit("word " * 28 + ".")
    paragraph = lambda i: F.concat(F.lit("p"), i.cast("string"), F.lit(" "), words)
    code = F.lit("```\n" + "run " * 24 + "\n```")
    paragraphs = F.transform(F.sequence(F.lit(1), (F.lit(20) + k % 60).cast("int")), paragraph)
    whole = F.when(k % 3 == 0, F.concat(F.slice(paragraphs, 1, 13), F.array(code), F.slice(paragraphs, 14, 100))).otherwise(paragraphs)
    parts = _dealt(table(spark, sf_dir, "part").select(F.format_string("%06d", k).alias("page_id"), k))
    pages = parts.select("page_id", F.lit("t").alias("title"), F.array_join(whole, "\n\n").alias("text"))
    return documents.chunk_pages(pages).select("chunk_id", "parent_id", "tokens", "overlap", F.array_join("blocks", ",").alias("blocks"))


def embedding_text(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    none = F.expr(NONE)
    words = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("k1"), F.lit("k2"))).otherwise(none)
    path = F.when(F.col("p_partkey") % 3 == 0, none).otherwise(F.array(F.lit("A"), F.lit("B")))
    text = X.embedding_text(F.col("p_name"), path, F.col("p_brand"), F.lit("manual"), F.lit("general"), F.array(F.lit("code")), none, words, F.lit("runbook_like"))
    return p.select("p_partkey", text.alias("text"))


def keyword_lists(spark, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.lit("use `docker run "), "p_brand", F.lit("` and see "), F.when(k % 2 == 0, "OutOfMemoryError").otherwise("nothing"), F.lit(" or `Docker Run "), "p_brand", F.lit("`, `x`"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.keywords(text, F.array(F.lit("H1"), F.col("p_type"), F.lit(" H3: "))), "|").alias("words"))


def normalized_markdown(spark, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.lit("\n "), "p_name", F.lit("  \r\n\n\n\nb\u00a0c\t\n"), F.when(k % 2 == 0, "```py\nx").otherwise(""), F.lit("\n \n"))
    return table(spark, sf_dir, "part").select("p_partkey", X.normalize_markdown(F.when(k % 5 != 0, text)).alias("text"))


def flat_splits(spark, sf_dir: str) -> DataFrame:
    """All strategies over the long pages: how many chunks a page has and of how many tokens together, with a target of 200 and an overlap of 40."""
    return documents.split_totals(_long(spark, sf_dir), ("token", "recursive", "markdown", "structured"), 200, 40)


def size_sweep(spark, sf_dir: str) -> DataFrame:
    """What chunks of three target sizes come to over the long pages."""
    return documents.size_sweep(_long(spark, sf_dir), (100, 200, 400))


def tree_reduction(spark, sf_dir: str) -> DataFrame:
    """The lines of an order merged four at a time: how texts stand in the tree shows in the brackets."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id"), "l_linenumber").agg(F.count("*").alias("n"))
    line = line.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("l_linenumber")) - 1)
    parts = line.select("page_id", "place", F.concat(F.lit("p"), F.col("place").cast("string")).alias("text"))
    return documents.tree_reduced(parts, lambda t: F.concat(F.lit("("), F.array_join(t, " "), F.lit(")")))


def _events(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "report").when(F.col("event_type") == "error", "failed").when((F.col("event_type") == "signup") & (F.col("event_id") % 97 == 0), "deleted").otherwise("progress")
    return rows.select("event_id", F.concat(F.lit("w"), (F.col("user_id") * 31 + F.col("event_id") % 7).cast("string")).alias("workflow"), kind.alias("kind"), F.col("event_id").alias("completed"), F.col("ts").alias("occurred_at"))


def workflow_state(spark, sf_dir: str) -> DataFrame:
    out = stream.fold_workflows(_events(table(spark, sf_dir, "events")))
    return out.select("workflow", "status", "completed", F.unix_timestamp("updated_at").alias("updated_at"))


def _streamed(spark, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")  # a stream takes one file only by a pattern


def stream_inbox_dedupe(spark, sf_dir: str) -> DataFrame:
    """Every event delivered twice to two groups, kept once a group."""
    twice = _streamed(spark, sf_dir).select("event_id", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery")).drop("delivery")
    path = shared_folder(spark, "stream")
    stream.run_once(stream.inbox(twice, "updater").select("event_id", "event_type", "consumer_group"), path)
    return spark.read.parquet(path)


def stream_workflow_state(spark, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "stream")
    stream.run_once(stream.workflow_state(_events(_streamed(spark, sf_dir))), path)
    out = spark.read.schema(stream.STATE).parquet(path)
    # a state row a batch: the last one stands
    last = out.groupBy("workflow").agg(F.max_by(F.struct("status", "completed", "updated_at"), "updated_at").alias("s"))
    return last.select("workflow", "s.status", "s.completed", F.unix_timestamp("s.updated_at").alias("updated_at"))


def outbox_pending(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created_at"), F.col("ts").alias("available_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("published_at"))
    return stream.pending(e, F.to_timestamp(F.lit("2024-01-10 00:00:00"))).select("event_id")


QUERIES = {f.__name__: f for f in (token_count, sha256, slugify, title, clean_urls, snippets, mask_pii, profile, domain_rules, section_rules, result_bucket)}
QUERIES |= {f.__name__: f for f in (transcript_windows, baseline_token_split, clean_html, page_chunks, parse_blocks, chunk_parents, chunk_children, chunk_overlaps, embedding_text, keyword_lists, normalized_markdown, flat_splits, size_sweep, tree_reduction)}
QUERIES |= {f.__name__: f for f in (workflow_state, stream_inbox_dedupe, stream_workflow_state, outbox_pending)}

_WHOLE = "lower(source || '  ' || left(coalesce(text, ''), {n}))"
_EVENTS = """events_ AS (SELECT event_id, 'w' || (user_id * 31 + event_id % 7) AS workflow, ts,
  CASE WHEN event_type = 'purchase' THEN 'report' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' AND event_id % 97 = 0 THEN 'deleted' ELSE 'progress' END AS kind FROM events)"""
_STATE = f"""WITH {_EVENTS} SELECT workflow, CASE WHEN bool_or(kind = 'deleted') THEN 'deleted' WHEN bool_or(kind = 'report') THEN 'report_ready' WHEN bool_or(kind = 'failed') THEN 'failed' ELSE 'in_progress' END AS status,
  coalesce(max_by(event_id, (ts, event_id)) FILTER (WHERE kind = 'progress'), 0) AS completed, floor(epoch(max(ts)))::BIGINT AS updated_at FROM events_ GROUP BY workflow"""
_CHATS = "chats AS (SELECT conv_id AS page_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, coalesce(text, '')) AS text FROM conversations GROUP BY conv_id)"
_MANUALS = """m AS (SELECT printf('%06d', p_partkey) AS page_id, p_partkey AS k, p_name, p_brand, p_type FROM part),
listed AS (SELECT *, list_filter([{'kind': 'heading', 'text': '# ' || p_name, 'path': p_name, 'language': ''}, {'kind': 'paragraph', 'text': 'Intro of ' || p_brand || '.' || chr(10) || 'more', 'path': p_name, 'language': ''},
  CASE WHEN k % 2 = 0 THEN {'kind': 'heading', 'text': '## Root cause', 'path': p_name || '>Root cause', 'language': ''} END, CASE WHEN k % 2 = 0 THEN {'kind': 'list', 'text': '- one' || chr(10) || '  inner' || chr(10) || '- two', 'path': p_name || '>Root cause', 'language': ''} END,
  CASE WHEN k % 3 = 0 THEN {'kind': 'table', 'text': '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |', 'path': p_name || CASE WHEN k % 2 = 0 THEN '>Root cause' ELSE '' END, 'language': ''} END,
  {'kind': 'code', 'text': '```bash' || chr(10) || '# no heading' || chr(10) || 'ls' || chr(10) || '```', 'path': p_name || CASE WHEN k % 2 = 0 THEN '>Root cause' ELSE '' END, 'language': 'bash'},
  {'kind': 'heading', 'text': '### Deep ' || p_type, 'path': p_name || CASE WHEN k % 2 = 0 THEN '>Root cause' ELSE '' END || '>Deep ' || p_type, 'language': ''}, {'kind': 'paragraph', 'text': 'last', 'path': p_name || CASE WHEN k % 2 = 0 THEN '>Root cause' ELSE '' END || '>Deep ' || p_type, 'language': ''}],
  lambda b: b IS NOT NULL) AS blocks FROM m)"""
_SIZE = r"len(regexp_extract_all({}, '[\pL\pN_]+|[^\pL\pN_\pZ\s]'))"
# the last mask spares digits alone, which RE2 can't look ahead for: digits are marked before it and freed after it
MASKED = r"""WITH m1 AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '(^|\n)(\s*authorization\s*:\s*(?:bearer|basic)\s+)([^\s`]+)', '\1\2[MASKED_TOKEN]', 'gi') AS t FROM documents),
m2 AS (SELECT doc_id, regexp_replace(t, '(^|\n)(\s*(?:api[_-]?key|token|secret|password|passwd|access[_-]?key|client[_-]?secret)\s*[:=]\s*)([^\n]+)', '\1\2[MASKED_SECRET]', 'gi') AS t FROM m1),
m3 AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b', '[MASKED_TOKEN]', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[MASKED_EMAIL]', 'g') AS t FROM m2),
m4 AS (SELECT doc_id, regexp_replace(t, '\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[0-1])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b', '[MASKED_PRIVATE_IP]', 'g') AS t FROM m3),
m5 AS (SELECT doc_id, regexp_replace(t, '\b[A-Za-z0-9_./+=-]{32,}\b', '[MASKED_SECRET]', 'g') AS t FROM m4),
n1 AS (SELECT doc_id, regexp_replace(regexp_replace(replace(t, chr(160), ' '), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM m5),
n2 AS (SELECT doc_id, trim(regexp_replace(t, '[ \t\f\x0b]+(\n|$)', '\1', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM n1)
SELECT doc_id, CASE WHEN t = '' THEN '' ELSE t || chr(10) END AS text, len(regexp_extract_all(t, '\[MASKED_'))::INT AS masks FROM n2"""
#: Long pages have m sentences of ten tokens. Held are the sentences that fit a piece, left those of the last one, which joins the one before where it is too short.
_SENTENCES = "pages_ AS (SELECT printf('%06d', p_partkey) AS page_id, (40 + p_partkey % 161)::INT AS m FROM part)"
_PIECES = """SELECT *, (pieces > 1 AND 10 * left_ < least_)::INT AS joins FROM (SELECT *, m - held * (pieces - 1) AS left_ FROM (SELECT page_id, m, target, held, least_, ceil(m / held::DOUBLE)::INT AS pieces FROM pages_, (VALUES (100, 16, 12), (200, 32, 25), (400, 65, 50)) t(target, held, least_)))"""

SQL = {
    "token_count": r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\pL\pN_]+|[^\pL\pN_\pZ\s]')) AS n FROM documents",
    "sha256": "SELECT doc_id, sha256(coalesce(text, '')) AS hash, left(sha256(coalesce(text, '')), 12) AS short FROM documents",
    "slugify": """SELECT p_partkey, replace(lower(p_name), ' ', '-') || CASE WHEN p_partkey % 3 = 0 THEN '-[a78792-639072]' ELSE '' END AS slug,
      CASE WHEN p_partkey % 5 = 0 THEN '' ELSE lower(p_brand) || ':' || replace(lower(p_name), ' ', '-') END AS doc_key FROM part""",
    "title": r"SELECT doc_id, CASE WHEN trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = '' THEN 'New conversation' ELSE left(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 80) END AS title FROM documents",
    "clean_urls": "SELECT page_id, url FROM pages",
    "snippets": "SELECT doc_id, least(500, length(coalesce(text, '')))::INT AS n FROM documents",
    "profile": r"WITH t AS (SELECT doc_id, lower(trim(regexp_replace(source || ' ' || left(coalesce(text, ''), 4000), '\s+', ' ', 'g'))) AS x FROM documents) SELECT doc_id, CASE WHEN "
    + " + ".join(f"contains(x, '{w}')::INT" for w in classify.CONTROL)
    + " > "
    + " + ".join(f"contains(x, '{w}')::INT" for w in classify.RUNBOOK)
    + " THEN 'control_like' ELSE 'runbook_like' END AS profile FROM t",
    "domain_rules": f"""WITH t AS (SELECT doc_id, source, text, {_cases(_WHOLE.format(n=1200), classify.CHUNK_DOMAINS, f"'{classify.CHUNK_DOMAIN_DEFAULT}'")} AS chunk_domain FROM documents),
      w AS (SELECT *, lower(source || '  ' || chunk_domain || ' general ' || left(coalesce(text, ''), 1500)) AS x FROM t)
      SELECT doc_id, chunk_domain, {_cases("x", classify.DOMAINS, "CASE chunk_domain " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in classify.DOMAIN_NAMES.items()) + " END")} AS domain FROM w""",
    "section_rules": f"""WITH t AS (SELECT doc_id, lower(left(coalesce(text, ''), 800)) AS x FROM documents), s AS (SELECT *, {_cases("x", classify.SECTIONS, "'general'")} AS section FROM t)
      SELECT doc_id, section, {_cases("x", classify.CONTROL_SECTIONS, "section")} AS control FROM s""",
    "result_bucket": """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 3 = 1 THEN 'failure' WHEN o_orderkey % 2 > 0 THEN 'requery' ELSE 'success' END AS bucket FROM orders""",
    "transcript_windows": f"""WITH RECURSIVE {_CHATS}, w AS (SELECT page_id, text, 0 AS place, 0::BIGINT AS begin, CASE WHEN length(text) > 2000 AND contains(substring(text, 1001, 1000), chr(10)) THEN 2000 - position(chr(10) IN reverse(substring(text, 1001, 1000))) + 1 ELSE least(2000, length(text)) END AS stop FROM chats
      UNION ALL SELECT page_id, text, place + 1, b, CASE WHEN length(text) > b + 2000 AND contains(substring(text, b + 1001, 1000), chr(10)) THEN b + 2000 - position(chr(10) IN reverse(substring(text, b + 1001, 1000))) + 1 ELSE least(b + 2000, length(text)) END
        FROM (SELECT page_id, text, place, greatest(stop - 200, begin + 1) AS b, stop FROM w) WHERE stop < length(text))
      SELECT page_id, place, begin::INT AS begin, sha256(substring(text, begin + 1, stop - begin)) AS content FROM w""",
    "baseline_token_split": rf"""WITH {_CHATS}, t AS (SELECT page_id, regexp_extract_all(text, '[\pL\pN_]+|[^\pL\pN_\pZ\s]') AS t FROM chats), w AS (SELECT page_id, t, unnest(range(0, greatest(1, len(t) - 50), 350)) AS a FROM t)
      SELECT page_id, (a // 350)::INT AS place, len(t[a + 1:a + 400])::INT AS tokens, sha256(array_to_string(t[a + 1:a + 400], ' ')) AS content FROM w WHERE len(t) > 0""",
    "parse_blocks": f"WITH {_MANUALS}, b AS (SELECT page_id, unnest(blocks) AS b, generate_subscripts(blocks, 1) - 1 AS place FROM listed) SELECT page_id, place::INT AS place, b.kind AS kind, b.text AS text, b.path AS headings, b.language AS language FROM b",
    "chunk_parents": f"""WITH {_MANUALS}, t AS (SELECT page_id, k, blocks, list_transform(blocks, lambda b: {_SIZE.format("b.text")}) AS n FROM listed),
      p AS (SELECT page_id, 0 AS i, 'general' AS section, CASE WHEN k % 2 = 0 THEN blocks[1:2] ELSE blocks END AS b, CASE WHEN k % 2 = 0 THEN n[1:2] ELSE n END AS n FROM t UNION ALL SELECT page_id, 1, 'root_cause', blocks[3:], n[3:] FROM t WHERE k % 2 = 0)
      SELECT page_id || '_p00' || i AS parent_id, section, array_to_string(list_sort(list_distinct(list_filter(list_transform(b, lambda x: x.kind), lambda v: v <> 'heading'))), ',') AS blocks, list_sum(n)::INT AS tokens FROM p""",
    "chunk_children": """WITH k AS (SELECT printf('%06d', p_partkey) AS page, 40 + p_partkey % 161 AS n FROM part), m AS (SELECT *, ceil(n / 65.0)::INT - (n > 65 AND n % 65 BETWEEN 1 AND 4)::INT AS pieces FROM k)
      SELECT page || '_00' || i AS chunk_id, page || '_p000' AS parent_id, (10 * CASE WHEN i < pieces - 1 THEN 65 ELSE n - 65 * i END)::INT AS tokens, 0 AS overlap FROM m, range(4) r(i) WHERE i < pieces""",
    "chunk_overlaps": """WITH k AS (SELECT printf('%06d', p_partkey) AS page, 20 + p_partkey % 60 AS n, (p_partkey % 3 = 0)::INT AS code FROM part),
      p AS (SELECT page, 0 AS parent, least(46, n + code) AS m, code FROM k UNION ALL SELECT page, 1, n + code - 46, 0 FROM k WHERE n + code > 46),
      g AS (SELECT *, CASE g WHEN 0 THEN 0 WHEN 1 THEN 13 ELSE 13 * g - code END AS first, 13 * (g + 1) - CASE WHEN g > 0 THEN code ELSE 0 END AS stop FROM p, range(5) r(g)),
      c AS (SELECT *, least(m, stop) - first + (code = 1 AND g = 1)::INT AS size, code = 1 AND g = 1 AS coded FROM g WHERE first < m),
      joined AS (SELECT *, g > 0 AND size = 1 AND NOT coded AS lone, coalesce(lead(size) OVER w = 1 AND NOT lead(coded) OVER w, false)::INT AS more FROM c WINDOW w AS (PARTITION BY page, parent ORDER BY g))
      SELECT page || '_' || printf('%03d', row_number() OVER (PARTITION BY page ORDER BY parent, g) - 1) AS chunk_id, page || '_p00' || parent AS parent_id, (30 * (size + more) + CASE WHEN g > 0 THEN 120 ELSE 0 END)::INT AS tokens,
        CASE WHEN g > 0 THEN 120 ELSE 0 END AS overlap, CASE WHEN coded THEN 'code,paragraph' ELSE 'paragraph' END AS blocks FROM joined WHERE NOT lone""",
    "embedding_text": """SELECT p_partkey, '문서: ' || p_name || chr(10) || '도메인: manual' || chr(10) || '경로: ' || CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'A > B' END || chr(10) || '청킹 프로필: runbook_like' || chr(10) || '섹션 유형: general' || chr(10) || '블록 유형: code'
      || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '키워드: k1, k2' ELSE '' END || chr(10) || chr(10) || p_brand AS text FROM part""",
    "keyword_lists": "SELECT p_partkey, 'docker run ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN '|OutOfMemoryError' ELSE '' END || '|' || p_type || '|H3' AS words FROM part",
    "normalized_markdown": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name || chr(10) || chr(10) || 'b c' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '```py' || chr(10) || 'x' || chr(10) || '```' ELSE '' END || chr(10) END AS text FROM part",
    "flat_splits": f"""WITH {_SENTENCES}, cut AS (SELECT *, ceil(9 * m / 100.0)::INT AS units FROM pages_),
      token AS (SELECT page_id, 'token' AS strategy, count(*) AS chunks, sum(least(200, 10 * m - a)) AS tokens, max(least(200, 10 * m - a)) AS most FROM (SELECT *, unnest(range(0, greatest(1, 10 * m - 40), 160)) AS a FROM pages_) GROUP BY page_id),
      unit AS (SELECT page_id, m, units, u, least(9 * m, 100 * (u + 1)) + least(9 * m, 100 * (u + 1)) // 9 - 100 * u - 100 * u // 9 AS size FROM (SELECT *, unnest(range(0, units)) AS u FROM cut)),
      packed AS (SELECT page_id, m, units, max(size) AS whole, sum(size) FILTER (WHERE u >= units - 2) AS ends FROM unit GROUP BY ALL),
      recursive_ AS (SELECT page_id, units - (ends <= 200)::INT AS chunks, 10 * m AS tokens, greatest(whole, CASE WHEN ends <= 200 THEN ends ELSE 0 END) AS most FROM packed)
      SELECT page_id, strategy, chunks, tokens::BIGINT AS tokens, most::INT AS most FROM token
      UNION ALL SELECT page_id, unnest(['recursive', 'markdown']), chunks, tokens::BIGINT, most::INT FROM recursive_
      UNION ALL SELECT page_id, 'structured', pieces - joins, 10 * m, 10 * CASE WHEN joins AND pieces = 2 THEN m WHEN joins THEN held + left_ ELSE least(m, held) END FROM ({_PIECES}) WHERE target = 200""",
    "size_sweep": f"WITH {_SENTENCES} SELECT target::INT AS target, sum(pieces - joins)::BIGINT AS chunks, sum(10 * m)::BIGINT AS tokens, 0::BIGINT AS overlap FROM ({_PIECES}) GROUP BY target",
    "tree_reduction": """WITH n AS (SELECT l_orderkey AS page_id, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1), p AS (SELECT page_id, n, list_transform(range(0, n), lambda i: 'p' || i) AS p FROM n)
      SELECT page_id, CASE WHEN n = 1 THEN p[1] WHEN n <= 4 THEN '(' || array_to_string(p, ' ') || ')' ELSE '((' || array_to_string(p[1:4], ' ') || ') ' || CASE WHEN n = 5 THEN p[5] ELSE '(' || array_to_string(p[5:], ' ') || ')' END || ')' END AS text FROM p""",
    "mask_pii": MASKED,
    "workflow_state": _STATE,
    "stream_inbox_dedupe": "SELECT event_id, event_type, 'updater' AS consumer_group FROM events",
    "stream_workflow_state": _STATE,
    "outbox_pending": "SELECT event_id FROM events WHERE event_id % 3 <> 0 AND ts <= TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 100",
}
