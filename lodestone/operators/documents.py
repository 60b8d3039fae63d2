"""Documents to chunks: HTML to Markdown, Markdown blocks, parent and child chunks, flat baselines, transcript windows, tree reduction.

A page is a row and is cut as a whole, by the functions of pages.py over Arrow batches: pages need no shuffle, and their chunks come out as rows.
Windows of transcripts are told by built-in folds over the places of line ends. A page that can't be parsed is a row with its error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from html.parser import HTMLParser
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lodestone.functions import classify
from lodestone.functions import text as X

from . import pages as whole
from .pages import Sizes, plan_children  # noqa: F401

SIZES = Sizes()


def _whole(make: Callable[[str | None], Iterable[tuple]], kind: str) -> Callable[[Column], Column]:
    """A function of a column of texts: the rows that make gives for each, as an array of structs. Columns of a batch are made at once."""
    fields = to_arrow_type(StructType.fromDDL(kind))

    def run(texts: pa.Array) -> pa.Array:
        rows = [[*make(t)] for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        columns = zip(*chain.from_iterable(rows), strict=True) if ends[-1] else [()] * len(fields)
        structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=list(fields))
        return pa.ListArray.from_arrays(pa.array(ends), structs)

    told = F.arrow_udf(run, f"array<struct<{kind}>>")
    return lambda text: told(text.cast("string"))


def _numbered(name: Column, number: str) -> Column:
    """Ids of at least three digits behind a name."""
    return F.concat(name, F.format_string("%03d", F.col(number)))


BLOCK = "kind string, text string, level int, name string, language string, size int, headings array<string>"


def parse_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, place, title, kind, text, level, name, language, size, headings) of the blocks of pages (page_id, title, text as Markdown).

    A fence goes on to the next one or the end of the page; lists take indented lines along; headings are those above a block.
    """
    told = _whole(lambda t: ((b.kind, b.text, b.level, b.name, b.language, b.size, b.headings) for b in whole.blocks(t)), BLOCK)
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "title", F.posexplode(told(F.col("text"))).alias("place", "b"))
    return rows.select("page_id", F.col("place").cast("long").alias("place"), "title", "b.*")


def parent_chunks(pages: DataFrame, sizes: Sizes = SIZES, control: bool = False) -> DataFrame:
    """(page_id, title, parent_id, content, headings, blocks, section, tokens, parts) of pages.

    Parents begin at headings of known sections and where the size is reached. A short one joins the one before it if both are of one
    section; all of its kinds of blocks are kept.
    """

    def run(text: str | None) -> Iterator[tuple]:
        place = count()
        for p in whole.parents(text, sizes, control):
            parts = [{"place": next(place), **vars(b)} for b in p.parts]
            yield whole.joined([b.text for b in p.parts]), p.headings, whole.kinds_of(p.parts), p.section, p.tokens, parts

    told = _whole(run, "content string, headings array<string>, blocks array<string>, section string, tokens int, parts array<struct<place bigint, kind string, text string, level int, name string, language string, size int, headings array<string>>>")
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "title", F.posexplode(told(F.col("text"))).alias("group", "p"))
    return rows.select("page_id", "title", _numbered(F.concat("page_id", F.lit("_p")), "group").alias("parent_id"), "p.*")


def chunk_pages(pages: DataFrame, sizes: Sizes = SIZES, control: bool = False) -> DataFrame:
    """(page_id, title, parent_id, chunk_id, chunk_index, content, headings, blocks, languages, tokens, overlap): child chunks; ids count over the page."""
    told = _whole(lambda t: whole.page_children(t, sizes, control), "parent int, content string, headings array<string>, blocks array<string>, languages array<string>, tokens int, overlap int")
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "title", F.posexplode(told(F.col("text"))).alias("chunk_index", "c"))
    parent, name = _numbered(F.concat("page_id", F.lit("_p")), "c.parent"), _numbered(F.concat("page_id", F.lit("_")), "chunk_index")
    return rows.select("page_id", "title", parent.alias("parent_id"), name.alias("chunk_id"), "chunk_index", "c.content", "c.headings", "c.blocks", "c.languages", "c.tokens", "c.overlap")


def enriched(chunks: DataFrame, profile: str = "runbook_like", parents: DataFrame | None = None) -> DataFrame:
    """chunks with domain, section, keywords, tags, hash and embedding_text; of parents (parent_id, domain) they take the domain."""
    title, headings, content = F.col("title"), F.col("headings"), F.col("content")
    out = chunks.withColumn("chunk_domain", classify.chunk_domain(title, headings, content)).withColumn("section", classify.section(headings, content))
    out = out.withColumn("_whole", classify.haystack(title, headings, F.col("chunk_domain"), F.col("section"), content))
    out = out.withColumn("domain", classify.final_domain(F.col("_whole"), F.col("chunk_domain"))).withColumn("section", classify.refined_section(F.col("_whole"), F.col("section")))
    words = X.control_keywords if profile == "control_like" else X.keywords
    out = out.withColumn("keywords", words(content, headings)).withColumn("tags", classify.tags(F.col("_whole"), F.col("domain"), F.col("keywords"), F.col("blocks"), F.col("languages")))
    if parents is not None:
        out = out.join(parents.select("parent_id", F.col("domain").alias("_above")), "parent_id", "left")
        domain, tags = classify.inherited(F.col("domain"), F.col("_above"), F.col("tags"))
        out = out.withColumn("tags", tags).withColumn("domain", domain).drop("_above")
    text = X.embedding_text(title, headings, content, F.col("domain"), F.col("section"), F.col("blocks"), F.col("tags"), F.col("keywords"), F.lit(profile))
    return out.withColumn("hash", F.sha2("content", 256)).withColumn("embedding_text", text).drop("_whole")


# flat baselines


def _flat(pages: DataFrame, strategy: str, size: int, overlap: int, *more: int) -> DataFrame:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be between 0 and size")
    told = _whole(lambda t: whole.STRATEGIES[strategy](t, size, overlap, *more), "content string, tokens int, headings array<string>")
    rows = pages.select("page_id", "title", F.posexplode(told(F.col("text"))).alias("place", "c"))
    return rows.select("page_id", "title", "place", "c.content", "c.headings", "c.tokens")


def token_windows(pages: DataFrame, size: int = 400, overlap: int = 50) -> DataFrame:
    """(page_id, title, place, content, headings, tokens): windows of `size` tokens, each `overlap` into the one before."""
    return _flat(pages, "token", size, overlap)


def recursive_split(pages: DataFrame, size: int = 400, overlap: int = 50) -> DataFrame:
    """(page_id, title, place, content, headings, tokens): text cut at the widest separators that keep parts to size, packed again with overlap."""
    return _flat(pages, "recursive", size, overlap)


def heading_split(pages: DataFrame, size: int = 400, overlap: int = 50, levels: int = 3) -> DataFrame:
    """recursive_split of the sections between headings of the first levels, with the headings above each."""
    return _flat(pages.withColumn("page_id", F.col("page_id").cast("string")), "markdown", size, overlap, levels)


#: Strategies by name: each takes pages, a size and an overlap in tokens.
STRATEGIES: dict[str, Callable[[DataFrame, int, int], DataFrame]] = {"token": token_windows, "markdown": heading_split, "recursive": recursive_split}
STRATEGIES["structured"] = lambda pages, size, overlap: chunk_pages(pages, Sizes.around(size)).select("page_id", "title", F.col("chunk_index").alias("place"), "content", "headings", "tokens")


def _known(strategy: str) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}, one of {sorted(STRATEGIES)}")


def chunked(pages: DataFrame, strategy: str, size: int = 400, overlap: int = 50) -> DataFrame:
    """(page_id, title, place, content, headings, tokens, chunk_id) by a strategy."""
    _known(strategy)
    out = STRATEGIES[strategy](pages, size, overlap)
    return out.withColumn("chunk_id", _numbered(F.concat(F.col("page_id").cast("string"), F.lit("_")), "place"))


def split_totals(pages: DataFrame, strategies: Sequence[str], size: int = 400, overlap: int = 50) -> DataFrame:
    """(page_id, strategy, chunks, tokens, most): how many chunks each strategy makes of a page, of how many tokens together and at most.

    They are the chunks of `chunked`; a page is read once for all strategies, and chunks are counted where they are made.
    """
    for name in strategies:
        _known(name)
    if not 0 <= overlap < size:
        raise ValueError("overlap must be between 0 and size")
    told = _whole(lambda t: whole.totals(t, strategies, size, overlap), "strategy string, chunks bigint, tokens bigint, most int")
    return pages.select("page_id", F.explode(told(F.col("text"))).alias("c")).select("page_id", "c.*")


def index_name(strategy: str, size: int = 400, overlap: int = 50, prefix: str = "eval") -> str:
    """A name for the index of a configuration, different for every one of them."""
    return f"{prefix}-{strategy}-{hashlib.sha256(f'{strategy}:{size}:{overlap}'.encode()).hexdigest()[:8]}"


def size_sweep(pages: DataFrame, targets: tuple[int, ...] = (200, 400, 800)) -> DataFrame:
    """(target, chunks, tokens, overlap): what chunks of several sizes come to."""
    out = None
    for t in targets:
        one = chunk_pages(pages, Sizes.around(t)).agg(F.lit(t).alias("target"), F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.sum("overlap").alias("overlap"))
        out = one if out is None else out.unionByName(one)
    return out


# transcripts


def transcript_windows(pages: DataFrame, size: int, overlap: int) -> DataFrame:
    """(page_id, title, place, begin, content): windows of `size` characters, each `overlap` into the one before.

    A window ends behind the last line end of its second half, if there is one. Where windows begin follows from the line ends alone,
    so a fold over their places tells the windows, as many as fit the text.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, overlap between 0 and size")
    text = X.text_of(F.col("text"))
    rows = pages.select("page_id", "title", text.alias("text"))
    # places behind line ends
    lengths = F.transform(F.split("text", "\n"), lambda x: F.length(x) + 1)
    ends = F.aggregate(lengths, F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + n)))
    rows = rows.withColumn("ends", ends).withColumn("n", F.length("text"))
    # a step moves on by more than half a window less the overlap, or one character
    step = max(1, size // 2 - overlap)

    def on(was: Column, _: Column) -> Column:
        stop = F.least(was["begin"] + size, F.col("n"))
        line = F.array_max(F.filter("ends", lambda e: (e > was["begin"] + size // 2) & (e <= stop)))
        end = F.when((stop < F.col("n")) & line.isNotNull(), line).otherwise(stop)
        told = F.concat(was["told"], F.array(F.struct(was["begin"].alias("begin"), end.alias("end"))))
        return F.when(was["done"], was).otherwise(F.struct(F.greatest(end - overlap, was["begin"] + 1).alias("begin"), (end >= F.col("n")).alias("done"), told.alias("told")))

    start = F.struct(F.lit(0).alias("begin"), F.lit(False).alias("done"), F.expr("cast(array() as array<struct<begin:int,end:int>>)").alias("told"))
    steps = F.sequence(F.lit(0), F.floor(F.col("n") / step).cast("int"))
    rows = rows.select("page_id", "title", "text", F.posexplode(F.aggregate(steps, start, on)["told"]).alias("place", "w"))
    return rows.select("page_id", "title", "place", F.col("w.begin").alias("begin"), F.substr("text", F.col("w.begin") + 1, F.col("w.end") - F.col("w.begin")).alias("content"))


def tree_reduced(parts: DataFrame, merge: Callable[[Column], Column], batch: int = 4) -> DataFrame:
    """(page_id, text): the parts (page_id, place, text) of each page merged `batch` at a time, level by level, until one is left.

    merge makes one text of an array of texts in order. A level is one shuffle; there are as many as the longest page has powers of batch.
    """
    rows = parts.select("page_id", "place", "text")
    most = rows.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0] + 1
    while most > 1:
        told = F.sort_array(F.collect_list(F.struct("place", "text")))
        rows = rows.groupBy("page_id", F.floor(F.col("place") / batch).cast("int").alias("level")).agg(told.alias("t"))
        rows = rows.select("page_id", F.col("level").alias("place"), F.when(F.size("t") == 1, F.element_at("t.text", 1)).otherwise(merge(F.col("t.text"))).alias("text"))
        most = -(-most // batch)
    return rows.select("page_id", "text")


# HTML

# Elements, class names and ids that hold no content of documentation pages; lines that tools leave behind.
SKIPPED = frozenset("nav header footer aside script style".split())
SKIPPED_CLASSES = frozenset("cookie-banner td-sidebar td-toc feedback-widget navbar footer edit-page sidebar feedback".split())
SKIPPED_IDS = frozenset("pre-footer left-column footer".split())
LEFT_OVER = re.compile(r"(?m)^(?:#[0-9A-Fa-f]{6}|page,whiteboard,database,blog\d+concisetrue)\s*$\n?")
BREAKS = frozenset("p div section article ul ol table blockquote br hr main body".split())
VOID = frozenset("br img hr meta link input".split())


class _Markdown(HTMLParser):
    """Pages as Markdown: headings, lists, tables, code, links to other sites, alternative texts; code macros of wikis, no others."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[str] = []
        self.link: tuple[int, str] | None = None
        self.pre = self.rows = 0

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        macro = tag == "ac:structured-macro" and given.get("ac:name") != "code"
        noise = tag in SKIPPED or macro or "data-nav" in given or given.get("id") in SKIPPED_IDS or not SKIPPED_CLASSES.isdisjoint(given.get("class", "").split())
        if self.skip or noise or tag == "ac:parameter":
            if tag not in VOID:
                self.skip.append(tag)
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("pre", "ac:plain-text-body"):
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "tr":
            self.rows += 1
            self.out.append("\n|")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag == "img" and given.get("alt", "").strip():
            self.out.append(f"[이미지: {given['alt'].strip()}]")
        elif tag == "a":
            self.link = (len(self.out), given.get("href", "").strip())
        elif tag in BREAKS:
            self.rows = 0 if tag == "table" else self.rows
            self.out.append("\n" if tag == "br" else "\n\n")

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
        elif re.fullmatch("h[1-6]", tag) or tag in BREAKS:
            self.out.append("\n\n")
        elif tag in ("pre", "ac:plain-text-body") and self.pre:
            self.pre -= 1
            self.out[-1:] = [self.out[-1].rstrip("\n")] if self.out[-1] != "\n\n```\n" else ["\n\n```"]
            self.out.append("\n```\n\n")
        elif tag in ("td", "th"):
            self.out.append(" |")
        elif tag == "tr" and self.rows == 1:  # a line parts the first row from the others
            width = 0
            for piece in reversed(self.out):
                width += piece == " |"
                if piece == "\n|":
                    break
            self.out.append("\n|" + " --- |" * width)
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag == "a" and self.link:
            at, href = self.link
            if "".join(self.out[at:]).strip() and re.match(r"https?://[^/]", href):
                self.out.append(f" ({href})")
            self.link = None

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def to_markdown(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    text = LEFT_OVER.sub("", "".join(parser.out).replace("\xa0", " "))
    lines, code = [], False
    for line in text.splitlines():
        code ^= line.startswith("```")
        lines.append(line.rstrip() if code else line.strip(" \t"))
    bare = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    return bare + "\n" if bare else ""


def clean_html(pages: DataFrame) -> DataFrame:
    """(page_id, title, content, error) of pages (page_id, title, text as HTML); content is null where the error says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told: list[tuple[str | None, str | None]] = []
            for text in batch.column("text").to_pylist():
                try:
                    told.append((to_markdown(text or ""), None))
                except Exception as e:  # one bad page is a row, not a failed job
                    told.append((None, f"{type(e).__name__}: {e}"))
            made = [pa.array([t[i] for t in told], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("title"), *made], ["page_id", "title", "content", "error"])

    slim = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("title").cast("string").alias("title"), "text")
    return slim.mapInArrow(run, "page_id string, title string, content string, error string")
