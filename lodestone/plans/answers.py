"""Queries over the answer stage: contexts, router output, statuses, domains of chunks, labels and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import answer, classify, scoring, version
from lodestone.functions import text as X
from lodestone.operators import ledger

from .inputs import table

WINDOW = 40
NONE = "cast(array() as array<string>)"


def _parents(spark, sf_dir: str) -> DataFrame:
    """Parts as parents: a long text with their name in it."""
    p = table(spark, sf_dir, "part")
    content = F.concat(F.repeat(F.lit("before "), (F.col("p_partkey") % 9).cast("int")), "p_name", F.lit(" "), "p_brand", F.repeat(F.lit(" after"), (F.col("p_partkey") % 7).cast("int")))
    return p.filter(F.col("p_partkey") % 5 != 0).select(F.col("p_partkey").alias("parent_id"), content.alias("content"))


def _found(spark, sf_dir: str) -> DataFrame:
    """Lines as retrieved chunks of parts."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("parent_id"), "l_extendedprice")
    line = ledger.latest(line, ["qid", "place"], F.col("parent_id"), F.col("l_extendedprice"))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("parent_id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 4 == 0, "elsewhere").otherwise(F.col("p_brand")).alias("snippet"))
    return line.join(names, "parent_id").select("qid", "place", "title", "snippet", "parent_id")


def parent_contexts(spark, sf_dir: str) -> DataFrame:
    return answer.contexts(_found(spark, sf_dir), _parents(spark, sf_dir), WINDOW)


def context_text(spark, sf_dir: str) -> DataFrame:
    return answer.context_text(parent_contexts(spark, sf_dir))


CONTEXTS = f"""line AS (SELECT l_orderkey AS qid, l_linenumber AS place, l_partkey AS parent_id FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_extendedprice) = 1),
found AS (SELECT qid, place, parent_id, p_name AS title, CASE WHEN p_partkey % 4 = 0 THEN 'elsewhere' ELSE p_brand END AS snippet,
  CASE WHEN p_partkey % 5 <> 0 THEN repeat('before ', (p_partkey % 9)::BIGINT) || p_name || ' ' || p_brand || repeat(' after', (p_partkey % 7)::BIGINT) END AS whole FROM line JOIN part ON p_partkey = parent_id),
once AS (SELECT *, instr(whole, snippet) - 1 AS pos FROM found QUALIFY whole IS NULL OR row_number() OVER (PARTITION BY qid, parent_id ORDER BY place) = 1),
contexts AS (SELECT qid, place, title, CASE WHEN whole IS NULL THEN snippet WHEN length(whole) <= {WINDOW} THEN whole WHEN pos < 0 THEN rtrim(left(whole, {WINDOW}))
  ELSE trim(substring(whole, greatest(0, pos - greatest(0, ({WINDOW} - length(snippet)) // 2)) + 1, {WINDOW})) END AS content FROM once)"""


def element_lines(spark, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 2 == 0, F.col("c_name")).alias("situation"), F.when(k % 3 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("cause"), F.lit("").alias("evidence"), F.concat(F.lit(" x "), k.cast("string")).alias("solution"), F.lit(None).cast("string").alias("infra_context")
    )
    return c.select("c_custkey", answer.flatten_elements().alias("text"), answer.evaluable(F.col("situation"), F.array("solution")).alias("evaluable"))


def _outputs(spark, sf_dir: str) -> DataFrame:
    """What a router may have said of an order: well-formed, of too many, unknown or repeated domains, of no search, not JSON."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    one = lambda use, domains: F.concat(F.lit(f'{{"use_case": "{use}", "domains": {domains}, "refined_query": "q", "confidence": '), ((k % 11) / 10.0).cast("string"), F.lit(', "target_versions": ["1.2", "latest", " v3"]}'))
    said = F.element_at(
        F.array(
            one(answer.SEARCH, '["manual"]'), one(answer.SEARCH, '["incident", "planning"]'), one(answer.SEARCH, '["manual", "manual"]'), one(answer.SEARCH, "[]"), one(answer.SEARCH, '["other"]'),
            one(answer.UNANSWERABLE, '["manual", "manual", "x"]'), F.lit("no json"), one("else", '["manual"]'), one(answer.SEARCH, '["manual", "incident", "planning"]'),
        ),
        (k % 9 + 1).cast("int"),
    )
    return o.withColumn("said", said)


def router_validation(spark, sf_dir: str) -> DataFrame:
    out = _outputs(spark, sf_dir).withColumn("r", answer.routed(F.col("said")))
    listed = lambda c: F.array_join(F.col(f"r.{c}"), ",").alias(c)
    return out.select("o_orderkey", "r.ok", "r.use_case", listed("domains"), "r.confidence", listed("target_versions"))


ROUTED = f"""WITH k AS (SELECT o_orderkey, o_orderkey % 9 AS kind, (o_orderkey % 11) / 10.0::DOUBLE AS c FROM orders), v AS (SELECT *, kind IN (0, 1, 5) AND c <= 1 AS ok FROM k)
SELECT o_orderkey, ok, CASE WHEN ok AND kind = 5 THEN '{answer.UNANSWERABLE}' ELSE '{answer.SEARCH}' END AS use_case, CASE WHEN ok AND c >= 0.5 AND kind = 0 THEN 'manual' WHEN ok AND c >= 0.5 AND kind = 1 THEN 'incident,planning' ELSE '' END AS domains,
  CASE WHEN ok THEN c ELSE 0 END::DOUBLE AS confidence, CASE WHEN ok THEN '1.2,v3' ELSE '' END AS target_versions FROM v"""


def router_gate(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    domains = F.array("o_orderpriority", "o_orderstatus")
    gated = scoring.router_gate(domains, (F.col("o_orderkey") % 10) / 10.0)
    return o.select("o_orderkey", F.array_join(gated, ",").alias("domains"), answer.answer_format(gated, ["1-URGENT", "F"]).alias("format"))


def query_versions(spark, sf_dir: str) -> DataFrame:
    """Versions in made-up questions, letters of another script right behind them."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.concat(F.lit("how from v1."), (k % 7).cast("string"), F.lit("에서 to 2."), (k % 5).cast("string"), F.lit(".1, not 3 nor 1.2.x.5 again v1."), (k % 7).cast("string"), F.lit("?"))
    return o.select("o_orderkey", F.array_join(version.versions_in(text), ",").alias("versions"))


def final_status(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    claim = answer.claimed_status(F.element_at(F.array(*map(F.lit, (" Answerable", "partially_answerable", "outdated_evidence", ""))), (k % 4 + 1).cast("int")))
    score = F.when(k % 3 != 0, (k % 100) / 100.0)
    status = answer.final_answerability(k % 13 == 0, k % 17 == 0, k % 5, score, claim)
    sources = F.when(k % 7 == 0, F.expr(NONE)).otherwise(F.array("o_orderpriority"))
    missing = F.when(k % 6 == 0, F.array(F.lit("1.2"), F.lit("1.3"))).otherwise(F.expr(NONE))
    out = o.select("o_orderkey", answer.guarded(status, sources, missing).alias("g"))
    return out.select("o_orderkey", "g.status", "g.reason", "g.shows_answer", F.size("g.sources").cast("long").alias("sources"))


_R = answer.REASONS
STATUS = f"""WITH k AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS s, CASE o_orderkey % 4 WHEN 0 THEN 'answerable' WHEN 1 THEN 'partially_answerable' ELSE 'not_enough_evidence' END AS claim FROM orders),
t AS (SELECT k, CASE WHEN k % 13 = 0 THEN 'conflicting_evidence' WHEN k % 17 = 0 THEN 'outdated_evidence' WHEN k % 5 = 0 THEN 'not_enough_evidence' WHEN s >= 0.8 THEN 'answerable' WHEN s >= 0.6 THEN 'partially_answerable' WHEN s IS NOT NULL THEN 'not_enough_evidence' ELSE claim END AS was FROM k),
f AS (SELECT *, was = 'answerable' AND k % 7 = 0 AS bare, CASE WHEN was = 'answerable' AND k % 7 = 0 THEN 'partially_answerable' ELSE was END AS status FROM t)
SELECT k AS o_orderkey, status, CASE WHEN k % 6 = 0 AND status = 'partially_answerable' THEN '1.2, 1.3{answer.MISSING}' WHEN bare THEN '{answer.NO_SOURCE}' {" ".join(f"WHEN status = '{n}' THEN '{x}'" for n, x in _R.items())} ELSE '' END AS reason,
  status IN ('answerable', 'partially_answerable') AS shows_answer, CASE WHEN status = 'not_enough_evidence' OR k % 7 = 0 THEN 0 ELSE 1 END::BIGINT AS sources FROM f"""


def answer_coercions(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    value = F.element_at(F.array(F.lit('["a", "b"]'), F.lit('"text"'), F.lit("null"), F.lit("12")), (k % 4 + 1).cast("int"))
    kept = answer.cited(F.array(F.lit(-1), (k % 6).cast("int"), F.lit(2)), (k % 4).cast("int"))
    return o.select("o_orderkey", answer.as_text(value).alias("text"), F.array_join(kept.cast("array<string>"), ",").alias("cited"))


def label_formats(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    share = (k % 1000) / 8.0
    return o.select("o_orderkey", scoring.usd_text(price).alias("usd"), scoring.token_label(k * 1000).alias("tokens"), scoring.duration_label((k % 5000) * 1.0).alias("duration"), scoring.percent_label(share).alias("percent"), scoring.bar_width(share).alias("width"))


def curves(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", F.round(scoring.sigmoid((k % 21 - 10) / 2.0), 9).alias("sigmoid"), scoring.backoff(k % 9).alias("backoff"), scoring.progress(k % 5, k % 3, k % 11).alias("progress"), scoring.axis_top((k % 500) / 7.0).alias("axis_top"))


def file_names(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    raw = F.element_at(F.array(F.concat(F.lit("C:\\dir\\"), "p_name", F.lit(".wav")), F.concat(F.lit("/a/b/.."), "p_type", F.lit(" (1).mp3")), F.lit("///"), F.concat(F.lit("회의 "), "p_brand")), (k % 4 + 1).cast("int"))
    return p.select("p_partkey", X.safe_filename(raw).alias("name"), X.content_type(F.concat(F.lit(" Audio/"), "p_type", F.lit("; codecs=x"))).alias("type"))


FILES = r"""WITH r AS (SELECT p_partkey, p_type, CASE p_partkey % 4 WHEN 0 THEN p_name || '.wav' WHEN 1 THEN '..' || p_type || ' (1).mp3' WHEN 2 THEN '' ELSE '회의 ' || p_brand END AS last FROM part),
s AS (SELECT *, trim(regexp_replace(last, '[^0-9A-Za-z가-힣._-]+', '_', 'g'), '._') AS safe FROM r) SELECT p_partkey, CASE WHEN safe = '' THEN 'audio' ELSE safe END AS name, 'audio/' || lower(p_type) AS type FROM s"""


def source_names(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", X.source_name(F.element_at(F.array(*map(F.lit, ("github", "DATADOG", "", "wiki", "my Site"))), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("name"))


def spans(spark, sf_dir: str) -> DataFrame:
    """Whether a text's 11th to 60th characters, without white space, are found in it, and the page of a chunk."""
    d = table(spark, sf_dir, "documents")
    part = F.regexp_replace(F.substring(X.text_of(F.col("text")), 11, 50), r"(?U)\s+", "")
    chunk = F.concat(F.lit("gh:a_b_"), F.lpad(F.col("doc_id").cast("string"), 3, "0"))
    return d.select("doc_id", X.span_in(F.col("text"), part).alias("found"), X.page_of_chunk(chunk).alias("page"))


def _chunks(spark, sf_dir: str) -> DataFrame:
    """Documents as chunks of parents of four, with keywords."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), X.text_of(F.col("text")).alias("text"))
    none = F.expr(NONE)
    whole = classify.haystack(F.col("title"), none, classify.chunk_domain(F.col("title"), none, F.col("text")), F.lit("general"), F.col("text"))
    d = d.withColumn("own", classify.final_domain(whole, F.lit(classify.CHUNK_DOMAIN_DEFAULT))).withColumn("whole", whole)
    return d.withColumn("parent_id", F.floor(F.col("doc_id") / 4))


def refined_sections(spark, sf_dir: str) -> DataFrame:
    d = _chunks(spark, sf_dir)
    return d.select("doc_id", classify.refined_section(F.col("whole"), F.lit("general")).alias("section"), classify.refined_section(F.col("whole"), F.lit("impact")).alias("known"))


def chunk_tags(spark, sf_dir: str) -> DataFrame:
    d = _chunks(spark, sf_dir)
    blocks = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("code"), F.lit("list"))).otherwise(F.array(F.lit("paragraph")))
    found = classify.tags(F.col("whole"), F.col("own"), F.array(F.lit("kubectl")), blocks, F.array(F.lit("bash"), F.lit("code")))
    return d.select("doc_id", F.array_join(found, ",").alias("tags"))


_CHUNK_DOMAIN = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(x, {chr(39)}{w.lower()}{chr(39)})' for w in ws)} THEN '{n}'" for n, ws in classify.CHUNK_DOMAINS.items()) + f" ELSE '{classify.CHUNK_DOMAIN_DEFAULT}' END"


def _any(words) -> str:
    return " OR ".join(f"contains(whole, '{w.lower()}')" for w in words)


CHUNKS = f"""raw AS (SELECT doc_id, source AS title, coalesce(text, '') AS text, lower(source || '  ' || left(coalesce(text, ''), 1200)) AS x FROM documents),
parts AS (SELECT doc_id, doc_id // 4 AS parent_id, lower(title || '  ' || {_CHUNK_DOMAIN} || ' general ' || left(text, 1500)) AS whole FROM raw),
chunks AS (SELECT *, CASE {" ".join(f"WHEN {_any(ws)} THEN '{n}'" for n, ws in classify.DOMAINS.items())} ELSE 'manual' END AS own FROM parts)"""
TAGGED = ", ".join(f"CASE WHEN {_any(ws)}{' OR true' if 'kubectl' in ws else ''} THEN '{n}' END" for n, ws in classify.TAGS.items())


def inherited_domains(spark, sf_dir: str) -> DataFrame:
    """Chunks take the domain of their parent, which is that of its first chunk here, or none for some."""
    d = _chunks(spark, sf_dir)
    names = F.create_map(*(F.lit(x) for a, b in classify.DOMAIN_NAMES.items() for x in (b, a)))
    first = F.min_by("own", "doc_id")
    parents = d.groupBy("parent_id").agg(F.when(F.col("parent_id") % 3 == 0, F.element_at(names, first)).when(F.col("parent_id") % 3 == 1, "planning").otherwise("unknown").alias("parent_domain"))
    out = d.join(parents, "parent_id", "left")
    domain, tags = classify.inherited(F.col("own"), F.col("parent_domain"), F.array(F.lit("t")))
    return out.select("doc_id", domain.alias("domain"), F.array_join(tags, ",").alias("tags"))


def model_domains(spark, sf_dir: str) -> DataFrame:
    """Domains of a model, given as JSON, in place of those of rules, where they are known."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    said = F.element_at(
        F.array(*map(F.lit, ('{"domain": "planning", "secondary": "manual", "confidence": 1.5}', '{"domain": "other"}', "[1]", '{"domain": " incident ", "secondary": "incident", "confidence": "x"}', '{"domain": "manual", "confidence": 0.25}'))), (k % 5 + 1).cast("int")
    )
    out = o.withColumn("told", classify.model_domain(said))
    domain, tags, source, sure = classify.by_model(F.lit("api_reference"), F.array(F.lit("t")), F.col("told"))
    return out.select("o_orderkey", domain.alias("domain"), F.array_join(tags, ",").alias("tags"), source.alias("source"), sure.alias("confidence"))


def control_keywords(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Owner: team "), (k % 3).cast("string"), F.lit("\n기한: 2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("\nrun `ls -l` now"))
    return o.select("o_orderkey", F.array_join(X.control_keywords(text, F.array(F.lit("A"), F.lit("b"), F.lit("C"))), "|").alias("words"))


QUERIES = {f.__name__: f for f in (parent_contexts, context_text, element_lines, router_validation, router_gate, query_versions, final_status, answer_coercions, label_formats, curves, file_names, source_names, spans)}
QUERIES |= {f.__name__: f for f in (refined_sections, chunk_tags, inherited_domains, model_domains, control_keywords)}

SQL = {
    "parent_contexts": f"WITH {CONTEXTS} SELECT * FROM contexts",
    "context_text": f"WITH {CONTEXTS} SELECT qid, string_agg('[' || place || '] title: ' || title || chr(10) || 'content: ' || content, chr(10) || chr(10) ORDER BY place) AS context FROM contexts GROUP BY qid",
    "element_lines": f"""SELECT c_custkey, (CASE WHEN c_custkey % 2 = 0 THEN '{answer.ELEMENTS["situation"]}: ' || c_name || chr(10) ELSE '' END) || (CASE WHEN c_custkey % 3 <> 0 THEN '{answer.ELEMENTS["cause"]}: ' || c_mktsegment || chr(10) ELSE '' END)
      || '{answer.ELEMENTS["solution"]}: x ' || c_custkey AS text, c_custkey % 2 = 0 AS evaluable FROM customer""",
    "router_validation": ROUTED,
    "router_gate": """SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 5 THEN '' ELSE o_orderpriority || ',' || o_orderstatus END AS domains,
      CASE WHEN o_orderkey % 10 >= 5 AND (o_orderpriority = '1-URGENT' OR o_orderstatus = 'F') THEN 'structured' ELSE 'freeform' END AS format FROM orders""",
    "query_versions": "SELECT o_orderkey, 'v1.' || (o_orderkey % 7) || ',2.' || (o_orderkey % 5) || '.1' AS versions FROM orders",
    "final_status": STATUS,
    "answer_coercions": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a' || chr(10) || 'b' WHEN 1 THEN 'text' WHEN 2 THEN '' ELSE '12' END AS text,
      array_to_string(list_filter([o_orderkey % 6, 2], lambda i: i < o_orderkey % 4), ',') AS cited FROM orders""",
    "label_formats": """WITH k AS (SELECT o_orderkey, o_totalprice, o_orderkey % 5000 AS ms, (o_orderkey % 1000) / 8.0::DOUBLE AS share FROM orders)
      SELECT o_orderkey, '$' || format('{:,.2f}', o_totalprice) AS usd, format('{:,}', o_orderkey * 1000) || ' 토큰' AS tokens, CASE WHEN ms <= 0 THEN '0ms' WHEN ms < 1000 THEN ms || 'ms' ELSE printf('%.1f', round(ms / 1000.0::DOUBLE, 1)) || '초' END AS duration,
      CASE WHEN abs(share - round_even(share, 0)) < 0.05 THEN round_even(share, 0)::BIGINT || '%' ELSE printf('%.1f', CASE WHEN share * 1000 % 100 = 50 OR share * 1000 % 100 >= 50 THEN ceil(share * 10) / 10 ELSE floor(share * 10) / 10 END) || '%' END AS percent, round_even(greatest(6, least(100, share)), 0)::DOUBLE AS width FROM k""",
    "curves": """WITH k AS (SELECT o_orderkey AS k, (o_orderkey % 500) / 7.0::DOUBLE AS v FROM orders) SELECT k AS o_orderkey, round(1 / (1 + exp(-(k % 21 - 10) / 2.0::DOUBLE)), 9) AS sigmoid, least(60.0, pow(2.0, k % 9))::DOUBLE AS backoff,
      CASE WHEN k % 11 > 0 THEN round_even((k % 5 + k % 3) / (k % 11)::DOUBLE * 100, 2) ELSE 0 END::DOUBLE AS progress, (CASE WHEN v >= 10 THEN ceil(v / 10) * 10 WHEN v >= 1 THEN ceil(v) ELSE ceil(v * 100) / 100 END)::DOUBLE AS axis_top FROM k""",
    "file_names": FILES,
    "source_names": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'GitHub' WHEN 1 THEN 'Datadog' WHEN 2 THEN '기타' WHEN 3 THEN 'Wiki' ELSE 'My site' END AS name FROM orders",
    "spans": r"SELECT doc_id, regexp_replace(substring(coalesce(text, ''), 11, 50), '\s+', '', 'g') <> '' AS found, 'gh:a_b' AS page FROM documents",
    "refined_sections": f"WITH {CHUNKS} SELECT doc_id, CASE {' '.join(f'WHEN {_any(ws)} THEN {chr(39)}{n}{chr(39)}' for n, ws in classify.REFINED.items())} ELSE 'general' END AS section, 'impact' AS known FROM chunks",
    "chunk_tags": f"""WITH {CHUNKS}, t AS (SELECT doc_id, list_filter([own, {TAGGED}, CASE WHEN doc_id % 2 = 0 THEN 'code' END, CASE WHEN doc_id % 2 = 0 THEN 'list' END, 'bash', 'code'], lambda v: v IS NOT NULL) AS v FROM chunks)
      SELECT doc_id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i)[1:12], ',') AS tags FROM t""",
    "inherited_domains": f"""WITH {CHUNKS}, p AS (SELECT parent_id, CASE parent_id % 3 WHEN 0 THEN min_by(own, doc_id) WHEN 1 THEN 'planning' END AS above FROM chunks GROUP BY parent_id)
      SELECT doc_id, coalesce(above, own) AS domain, CASE WHEN above <> own THEN 'domain:' || own || ',t' ELSE 't' END AS tags FROM chunks JOIN p USING (parent_id)""",
    "model_domains": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'planning' WHEN 3 THEN 'incident' WHEN 4 THEN 'manual' ELSE 'api_reference' END AS domain, CASE WHEN o_orderkey % 5 = 0 THEN 'domain2:manual,t' ELSE 't' END AS tags,
      CASE WHEN o_orderkey % 5 IN (0, 3, 4) THEN 'llm' ELSE 'rule' END AS source, CASE o_orderkey % 5 WHEN 0 THEN 1.0 WHEN 3 THEN 1.0 WHEN 4 THEN 0.25 END::DOUBLE AS confidence FROM orders""",
    "control_keywords": "SELECT o_orderkey, 'ls -l|b|C|team ' || (o_orderkey % 3) || '|2024-01-' || lpad((o_orderkey % 28 + 1)::VARCHAR, 2, '0') AS words FROM orders",
}
