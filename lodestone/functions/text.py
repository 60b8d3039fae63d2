"""Column expressions over text. All are built-in expressions; none runs Python on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: \w and \s of Java are ASCII; these classes cover all letters, digits and blanks.
TERM = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\s]"
# Fixed pattern: what an upload adds to a title.
UPLOAD_SUFFIX = r"(?U)\s*\[[0-9a-f]{6}-[0-9a-f]{6}\]\s*$"


def text_of(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def token_count(text: Column) -> Column:
    """Runs of word characters, and single other visible characters."""
    return F.regexp_count(text_of(text), F.lit(TOKEN))


def terms(text: Column) -> Column:
    """Lower-cased word terms in order."""
    return F.regexp_extract_all(F.lower(text_of(text)), F.lit(f"({TERM})"), F.lit(1))


def term_count(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(TERM))


def squeeze(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text_of(text), r"(?U)\s+", " "))


def strip_upload_suffix(title: Column) -> Column:
    return F.trim(F.regexp_replace(text_of(title), UPLOAD_SUFFIX, ""))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text_of(text))), r"(?U)\s+", "-")


def doc_key(site: Column, title: Column) -> Column:
    """Key of the versions of one document; empty without a site."""
    site = text_of(site)
    return F.when(site == "", "").otherwise(F.concat(site, F.lit(":"), slugify(strip_upload_suffix(title))))


def title_from(text: Column, length: int = 80, default: str = "New conversation") -> Column:
    short = F.substring(squeeze(text), 1, length)
    return F.when(short == "", default).otherwise(short)


def clean_url(url: Column) -> Column:
    """Repeated slashes after the scheme as one."""
    return F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?<!:)/{2,}", "/")).otherwise(url)


def snippet(text: Column, length: int = 500) -> Column:
    return F.substring(text_of(text), 1, length)


def sha12(text: Column) -> Column:
    return F.substring(F.sha2(text_of(text), 256), 1, 12)


def span_in(text: Column, span: Column) -> Column:
    """Whether span is found in text, regardless of case and white space; an empty span isn't."""
    plain = lambda x: F.lower(F.regexp_replace(text_of(x), r"(?U)\s+", ""))
    return (plain(span) != "") & F.contains(plain(text), plain(span))


def page_of_chunk(chunk_id: Column) -> Column:
    return F.regexp_replace(chunk_id, r"_\d+$", "")


# Fixed patterns of what is masked, in the order in which they apply.
MASKS = (
    (r"(?imd)^(\s*authorization\s*:\s*(?:bearer|basic)\s+)([^\s`]+)", "$1[MASKED_TOKEN]"),
    (r"(?imd)^(\s*(?:api[_-]?key|token|secret|password|passwd|access[_-]?key|client[_-]?secret)\s*[:=]\s*)(.+)$", "$1[MASKED_SECRET]"),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "[MASKED_TOKEN]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[MASKED_EMAIL]"),
    (r"\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[0-1])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b", "[MASKED_PRIVATE_IP]"),
    # long tokens, unless they are digits alone (then punctuation at most follows in the run)
    (r"\b(?!\d+[./+=-]*(?![A-Za-z0-9_./+=-]))[A-Za-z0-9_./+=-]{32,}\b", "[MASKED_SECRET]"),
)


# Fixed pattern: the beginning of a fence line.
FENCE = r"(?m)^[ \t]{0,3}```"


def balance_fences(text: Column) -> Column:
    """A closing code fence where the number of fence lines is odd."""
    odd = F.regexp_count(text, F.lit(FENCE)) % 2 == 1
    return F.when(odd, F.concat(F.regexp_replace(text, r"(?U)\s+\z", ""), F.lit("\n```\n"))).otherwise(text)


def normalize_markdown(text: Column) -> Column:
    out = F.translate(text_of(text), "\u00a0", " ")
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    out = balance_fences(F.regexp_replace(out, r"\n{3,}", "\n\n"))
    out = F.regexp_replace(F.regexp_replace(out, r"\r\n?", "\n"), r"(?m)[ \t\f\x0b]+$", "")
    bare = F.regexp_replace(out, r"(?U)^\s+|\s+\z", "")
    return F.when(bare == "", "").otherwise(F.concat(bare, F.lit("\n")))


def mask_secrets(text: Column) -> Column:
    """Secrets, addresses and tokens as placeholders, then normalized white space."""
    out = text_of(text)
    for pattern, replacement in MASKS:
        out = F.regexp_replace(out, pattern, replacement)
    return normalize_markdown(out)


def mask_count(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(r"\[MASKED_"))


def unique_words(values: Column, limit: int) -> Column:
    """The first `limit` distinct values, trimmed of blanks and punctuation, regardless of case."""
    plain = F.filter(F.transform(values, lambda v: F.btrim(F.regexp_replace(v, r"(?U)\s+", " "), F.lit(" .,;:()[]"))), lambda v: v != "")
    start = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("kept"))

    def add(was: Column, v: Column) -> Column:
        known = F.array_contains(was["keys"], F.lower(v)) | (F.size(was["kept"]) >= limit)
        keys = F.when(known, was["keys"]).otherwise(F.concat(was["keys"], F.array(F.lower(v))))
        kept = F.when(known, was["kept"]).otherwise(F.concat(was["kept"], F.array(v)))
        return F.struct(keys.alias("keys"), kept.alias("kept"))

    return F.aggregate(plain, start, add, lambda x: x["kept"])


# Fixed patterns of keywords: code spans, commands, error names.
KEYWORDS = (
    (r"`([^`\n]{2,80})`", 1),
    (r"(?U)\b(?:kubectl|docker|helm|curl|systemctl|journalctl)\s+[^\n`]{1,80}", 0),
    (r"(?U)\b[A-Z][A-Za-z0-9_]*(?:Error|Exception|BackOff|Failed|Timeout)\b", 0),
)


def keywords(text: Column, headings: Column, limit: int = 8) -> Column:
    """Code spans, commands, error names and the last two headings."""
    found = [F.regexp_extract_all(text_of(text), F.lit(p), F.lit(g)) for p, g in KEYWORDS]
    last = F.when(F.size(headings) > 2, F.slice(headings, -2, 2)).otherwise(headings)
    return unique_words(F.concat(*found, last), limit)


def embedding_text(title: Column, headings: Column, content: Column, domain: Column, section: Column, blocks: Column, tags: Column, words: Column, profile: Column) -> Column:
    """What an embedder reads: a line for each known attribute, an empty line, the content."""
    path = F.when(F.size(headings) > 0, F.array_join(headings, " > ")).otherwise(title)
    part = lambda label, value: F.when(text_of(value) != "", F.concat(F.lit(f"{label}: "), value))
    # fixed labels of the text format
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("문서: "), text_of(title)),
        F.concat(F.lit("도메인: "), text_of(domain)),
        F.concat(F.lit("경로: "), text_of(path)),
        part("청킹 프로필", profile),
        part("섹션 유형", section),
        part("블록 유형", F.array_join(blocks, ", ")),
        part("태그", F.array_join(tags, ", ")),
        part("키워드", F.array_join(words, ", ")),
    )
    return F.concat(lines, F.lit("\n\n"), text_of(content))


# Fixed patterns: fields of control documents, as keywords.
CONTROL_FIELDS = (r"(?i)(?:담당자|owner|assignee)\s*[:：]\s*([^\n|]{1,40})", r"(?i)(?:기한|due date|마감)\s*[:：]\s*([^\n|]{1,40})")


def control_keywords(text: Column, headings: Column, limit: int = 12) -> Column:
    """keywords() with owners and dates of control documents."""
    found = [F.regexp_extract_all(text_of(text), F.lit(p), F.lit(1)) for p in CONTROL_FIELDS]
    last = F.when(F.size(headings) > 2, F.slice(headings, -2, 2)).otherwise(headings)
    return unique_words(F.concat(keywords(text, headings), *found, last), limit)


def safe_filename(name: Column) -> Column:
    """The last part of a path with letters of two scripts, digits, dots, hyphens and underlines alone."""
    last = F.substring_index(F.regexp_replace(text_of(name), r"[/\\]+", "/"), "/", -1)
    plain = F.btrim(F.regexp_replace(F.substring(last, 1, 512), "[^0-9A-Za-z가-힣._-]+", "_"), F.lit("._"))
    return F.when(plain == "", "audio").otherwise(F.substring(plain, 1, 255))


def content_type(value: Column) -> Column:
    return F.lower(F.trim(F.substring_index(text_of(value), ";", 1)))


# Fixed names: how sources are shown.
SOURCE_NAMES = {"apache": "Apache", "datadog": "Datadog", "prometheus": "Prometheus", "kubernetes": "Kubernetes", "confluence": "Confluence", "github": "GitHub"}


def source_name(source: Column, other: str = "기타") -> Column:
    """The shown name of a source; unknown ones begin with a capital letter."""
    plain = F.when(text_of(source) == "", other).otherwise(source)
    lower = F.lower(plain)
    out = F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(lower, 2, 1 << 20))
    for name, shown in SOURCE_NAMES.items():
        out = F.when(lower == name, shown).otherwise(out)
    return out


def page_of_any_chunk(chunk_id: Column) -> Column:
    """The page of a chunk id: what stands before its last underline."""
    return F.when(F.contains(chunk_id, F.lit("_")), F.regexp_replace(chunk_id, r"_[^_]*$", "")).otherwise(chunk_id)
