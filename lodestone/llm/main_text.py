"""HTML extraction by composite text density.

Every node of the DOM has the density C / T * log_b(C / LC * T / LT), link-adjusted characters per tag: C characters and T tags in
it, LC and LT of these in links, C' = C - LC, and b = ln(C / C' * LC + LCbody / Cbody * C + e). The container whose children's
densities have the greatest sum is the main subtree; the least density on the path from body to it is the threshold at
which other branches off this path belong to the text as well. Where the main subtree stands in an <article> or <main>,
that element is the text.

Before that, what can't be text is cut out of the tree: scripts, styles, forms, menus, headers, footers, sidebars, and
elements whose class, id or role names an advert, a notice, a comment list or the like.

Pages are parsed one at a time inside mapInArrow, in time and memory linear in a page. Null and empty pages give an empty text;
broken markup is closed as browsers do. Rows stay as they are, repeated or not; an empty table gives no rows, and other columns
aren't read, whatever their names. Depth changes nothing: places of open elements are kept by tag. Of subtrees of equal sums the
densest is the main one, of equally dense ones the last in page order. A form stays where forms hold over half of the text, since some pages are one form.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr img".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li dd dt main menu nav ol p pre section table tbody tr td th ul".split()
)
SCOPE = frozenset("article aside body div section main td th caption table button object blockquote figure li dd html form nav footer header".split())
#: Elements that a start of one of the same kind closes, and what stops that.
SIBLINGS = {
    "li": (("li",), frozenset(("ul", "ol", "menu"))),
    "dt": (("dt", "dd"), frozenset(("dl",))),
    "dd": (("dt", "dd"), frozenset(("dl",))),
    "tr": (("tr",), frozenset(("table",))),
    "td": (("td", "th"), frozenset(("table",))),
    "th": (("td", "th"), frozenset(("table",))),
    "option": (("option",), frozenset(("select",))),
}
IN_HEAD = frozenset("head html meta link title style script base noscript template".split())
CONTAINERS = frozenset("html body div article section main td table tbody tr blockquote center figure dl ul ol details".split())
NOISE = frozenset(
    "script style noscript template head title nav menu header footer aside form fieldset button select option textarea input label iframe object embed applet canvas svg math audio video map dialog".split()
)
#: Words of a class, id or role that tell what isn't main text.
NOISE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored sponsors promo promotion promoted
    nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc header masthead footer colophon copyright sidebar aside complementary contentinfo
    notice notices notification alert cookie cookies consent gdpr disclaimer popup modal overlay subscribe subscription newsletter signup login paywall
    comment comments commentlist disqus reply replies respond discussion feedback share sharing social related recommended recommendations widget widgets toolbar search form hidden""".split()
)
#: Words that may as well be those of an article: links decide there.
WEAK_WORDS = frozenset("discussion social related search form share sharing".split())
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*+\"|=\s*'[^']*+'|[=\"'])*+)>",
    re.DOTALL,
)
HINT = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
GONE = re.compile(r"(?:^|\s)(?:hidden(?=$|[\s=/])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A name such as has-sidebar speaks of something else than the element.
ABOUT = frozenset(("has", "with", "no", "is", "without"))
#: Elements whose ids are mostly made from their titles.
TITLED = frozenset("h1 h2 h3 h4 h5 h6 section p article main".split())


def _noise_name(name: str) -> int:
    """2 if the whole name, its first or its last word tells noise, 1 if only weak words do, else 0."""
    found = [w.lower() for w in WORDS.findall(name)]
    if not found or not ABOUT.isdisjoint(found):
        return 0
    hits = NOISE_WORDS.intersection((found[0], found[-1], "".join(found)))
    return 0 if not hits else 1 if hits <= WEAK_WORDS else 2


def _noisy(tag: str, attributes: str, slugs: bool, forms: bool) -> int:
    """2 for noise, 1 where links decide, 0 for none. slugs: ids are made from titles here; forms: a form is like a div."""
    if tag in NOISE and not (forms and tag == "form"):
        return 2
    if not attributes or tag in ("body", "html"):
        return 0
    if GONE.search(attributes):
        return 2
    slugs = slugs or tag in TITLED
    return max((_noise_name(name) for kind, *values in HINT.findall(attributes) if not (slugs and kind.lower() == "id") for name in "".join(values).split()), default=0)


class Page:
    """The nodes of a page, in page order: tag, parent and last node inside, and pieces of text with their nodes.

    A None piece parts blocks. An element that is noise is one empty node, #noise.
    """

    def __init__(self, source: str, forms: bool = False):
        self._forms, self.form = forms, False
        self.chars, self._links, self._a, self._main = 0, 0, 0, 0
        #: Where links decide: nodes with what was there when they began. Places of open elements by tag, and of those that aren't inline.
        self._weak: dict[int, tuple[int, int, int]] = {}
        self._places: dict[str, list[int]] = {}
        self._outer: list[int] = [0]
        self.tags, self.parents, self.last = ["#"], [-1], [0]
        self.pieces: list[tuple[int, str | None]] = []
        self._stack, self._names, self._quiet = [0], ["#"], 0
        at, end = 0, source.rfind(">") + 1
        while (m := TAG.search(source, at, end)) is not None:
            if m.start() > at:
                self._text(source[at : m.start()])
            at, tag = m.end(), (m[2] or "").lower()
            if not tag:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    at = len(source)
                    break
            elif m[1]:
                self._close(tag)
            elif tag in RAW:  # ends at its own closing tag alone
                stop = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(source, at)
                at = (source.find(">", stop.end()) + 1 or len(source)) if stop else len(source)
            else:
                self._open(tag, m[3])
        if at < len(source):
            self._text(source[at:])
        while len(self._stack) > 1:
            self._pop()
        self.last[0] = len(self.tags) - 1

    def _text(self, text: str) -> None:
        if not self._quiet:
            size = len("".join(text.split()))
            self.chars += size
            self._links += size if self._a else 0
            self.pieces.append((self._stack[-1], entities.unescape(text) if "&" in text else text))

    def _break(self) -> None:
        if not self._quiet and self.pieces and self.pieces[-1][1] is not None:
            self.pieces.append((self._stack[-1], None))

    def _node(self, tag: str) -> int:
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.last.append(len(self.tags) - 1)
        return len(self.tags) - 1

    def _open(self, tag: str, attributes: str) -> None:
        self.form |= tag == "form"
        if tag not in IN_HEAD:
            self._up_to(("head",), ("body",))
        if tag in CLOSES_P:
            self._up_to(("p",), SCOPE)
        if tag in SIBLINGS:
            same, until = SIBLINGS[tag]
            self._up_to(same, until)
        if tag not in INLINE:
            self._break()
        noisy = 2 if self._quiet else _noisy(tag, attributes, self._main > 0, self._forms)
        if tag in VOID:
            if noisy < 2:
                self._node(tag)
            return
        node = -1 if self._quiet else self._node("#noise" if noisy == 2 else tag)
        if noisy == 1:
            self._weak[node] = (len(self.pieces), self.chars, self._links)
        self._places.setdefault(tag, []).append(len(self._stack))
        if tag not in INLINE:
            self._outer.append(len(self._stack))
        self._stack.append(node)
        self._names.append(tag)
        self._quiet += noisy == 2
        self._a += tag == "a"
        self._main += tag in ("article", "main")

    def _pop(self) -> None:
        node, tag = self._stack.pop(), self._names.pop()
        self._places[tag].pop()
        if tag not in INLINE:
            self._outer.pop()
        self._a -= tag == "a"
        self._main -= tag in ("article", "main")
        if self._quiet:
            self._quiet -= 1
        if node in self._weak:
            at, chars, links = self._weak.pop(node)
            if 2 * (self._links - links) >= self.chars - chars:  # mostly links, or nothing
                del self.pieces[at:], self.tags[node + 1 :], self.parents[node + 1 :], self.last[node + 1 :]
                self.tags[node], self.chars, self._links = "#noise", chars, links
        if node >= 0:
            self.last[node] = len(self.tags) - 1
        if tag not in INLINE:
            self._break()

    def _up_to(self, names: tuple[str, ...], until) -> None:
        """Close the innermost open element of these names, if none of until stands above it."""
        at = max((self._places[n][-1] for n in names if self._places.get(n)), default=0)
        if at and not any(self._places.get(u) and self._places[u][-1] > at for u in until):
            while len(self._stack) > at:
                self._pop()

    def _close(self, tag: str) -> None:
        if tag in ("p", "br"):
            self._break()
        if tag in INLINE:  # a stray end doesn't reach out of its block
            if self._places.get(tag) and self._places[tag][-1] > self._outer[-1]:
                self._up_to((tag,), ())
        elif tag in ("p", "li", "dd", "dt"):
            self._up_to((tag,), SCOPE - {"li", "dd"})
        elif tag in ("div", "section", "ul", "ol", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"):
            self._up_to((tag,), ("article", "main", "body", "td", "th"))
        else:
            self._up_to((tag,), ())


def _density(c: int, lc: int, t: int, lt: int, whole: float) -> float:
    if not c:
        return 0.0
    t, lt = max(1, t), max(1, lt)
    base = math.log(c / max(1, c - lc) * lc + whole * c + math.e)
    return max(0.0, c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / base)


def _densities(page: Page) -> tuple[list[float], list[float], list[int]]:
    """Of each node: the composite text density, the sum of its children's (its own text is a child), the characters."""
    n = len(page.tags)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = page.tags[i] == "a" or linked[page.parents[i]]
    for node, text in page.pieces:
        if text:
            size = len("".join(text.split()))
            chars[node] += size
            if linked[node]:
                links[node] += size
    own = chars[:]
    for i in range(n - 1, 0, -1):
        up, counts = page.parents[i], page.tags[i] != "#noise"
        chars[up] += chars[i]
        links[up] += links[i]
        tags[up] += tags[i] + counts
        link_tags[up] += link_tags[i] + (counts and page.tags[i] == "a")
    whole = links[0] / max(1, chars[0])
    density = [_density(chars[i], links[i], tags[i], link_tags[i], whole) for i in range(n)]
    sums = [_density(own[i], 0, 1, 1, whole) if not linked[i] else 0.0 for i in range(n)]
    for i in range(1, n):
        sums[page.parents[i]] += density[i]
    return density, sums, chars


def _selected(page: Page) -> list[tuple[int, int]]:
    """Ranges of nodes (first, last) that are the main text."""
    density, sums, chars = _densities(page)
    n, tags = len(page.tags), page.tags
    body = next((i for i in range(n) if tags[i] == "body"), 0)
    if chars[body] < chars[0]:  # text outside of body
        body = 0
    best = max((i for i in range(body, n) if i == body or tags[i] in CONTAINERS), key=lambda i: (sums[i], density[i], i))
    path = [best]
    while path[-1] != body and page.parents[path[-1]] >= 0:
        path.append(page.parents[path[-1]])
    for name in ("article", "main"):
        outer = [i for i in path if tags[i] == name][-1:]
        if not outer:  # several of them may make up the main subtree
            i = best + 1
            while i <= page.last[best]:
                if tags[i] == name:
                    outer.append(i)
                    i = page.last[i]
                i += 1
            if 2 * sum(chars[i] for i in outer) < chars[best]:
                outer = []
        if outer:
            return [(i, page.last[i]) for i in outer]
    threshold, on_path, out = min(density[i] for i in path), set(path), [(best, page.last[best])]
    for i in range(1, n):
        if page.parents[i] in on_path and i not in on_path and page.parents[i] != best and density[i] >= max(threshold, 1e-9):
            out.append((i, page.last[i]))
    return sorted(out)


def main_text(source: str | None) -> str:
    """The main text of a page: its blocks joined by single spaces."""
    page = Page(source or "")
    if page.form:  # forms that hold most of the text are the page
        whole = Page(source or "", forms=True)
        page = whole if whole.chars > 2 * page.chars else page
    if not any(text and not text.isspace() for _, text in page.pieces):
        return ""
    out: list[str] = []
    for first, last in _selected(page):
        out += [" " if text is None else text for node, text in page.pieces if text is None or first <= node <= last]
        out.append(" ")
    return " ".join("".join(out).split())


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    slim = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    out = slim.mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op8_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
