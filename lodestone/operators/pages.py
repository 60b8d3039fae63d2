"""What is made of a page as a whole: tokens, blocks, parents, children, flat chunks. Plain functions over a text, which documents.py runs over Arrow batches.

Where the tokens of a text begin is found once, by a table of kinds of characters; the size of a part is the number of beginnings in it,
so that parts within parts aren't cut into tokens again, nor is a text that several strategies read one after the other.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cache, lru_cache
from itertools import accumulate, zip_longest

import numpy as np

from lodestone.functions import classify

#: White space as Unicode has it: what is trimmed, and what sets the marks of Markdown apart from texts.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed patterns: headings, list items, languages and fences of Markdown, the ends of sentences, tokens.
HEADING = re.compile(rf"(#{{1,6}})[{WHITE}]+([^\n\r\x85\u2028\u2029]*[^{WHITE}])[{WHITE}]*\Z")
HEADED = re.compile(rf"#{{1,6}}[{WHITE}]+")
LIST_ITEM = re.compile(rf"[{WHITE}]*(?:[-*+][{WHITE}]+|\d+[.)][{WHITE}]+)")
LANGUAGE = re.compile(r"`{3}[ \t\n\x0b\f\r]*([^ \t\n\x0b\f\r]*)")
FENCE = "```"
SENTENCE_ENDS = ".!?。！？"
EMPTY_LINES = re.compile(r"\n{2,}")
TOKEN = re.compile(r"\w+|[^\w\s]")
#: Deepest heading at which a parent may begin.
TOP_LEVEL = 3


@dataclass(frozen=True)
class Sizes:
    """Token sizes of chunks."""

    child_least: int = 50
    child_target: int = 400
    child_most: int = 650
    parent_most: int = 1400
    overlap: int = 120

    @classmethod
    def around(cls, target: int) -> Sizes:
        """Sizes in fixed proportion to the target of a child."""
        return cls(round(target * 0.125), target, round(target * 1.625), round(target * 3 * 7 / 6), round(target * 0.15 * 2))


# tokens

BLANK, WORD, MARK, CONTROL = range(4)


def _kind(c: str) -> int:
    """Runs of word characters and single marks are tokens. A control character that is a blank to Python's patterns alone counts in sizes of blocks and units."""
    if c.isalnum() or c == "_":
        return WORD
    return (CONTROL if c in "\x1c\x1d\x1e\x1f\x85" else BLANK) if c.isspace() else MARK


@cache
def _table(n: int) -> bytes:
    """The kinds of the first n characters."""
    return bytes(map(_kind, map(chr, range(n))))


class Text:
    """A text with the codes and kinds of its characters, and where its tokens begin; sized has the control characters too."""

    def __init__(self, text: str):
        self.text = text
        if text.isascii():
            data = text.encode()
            self.codes, told = np.frombuffer(data, np.uint8), data.translate(_table(256))
        else:
            self.codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            told = np.frombuffer(_table(0x10000 if self.codes.max() < 0x10000 else 0x110000), np.uint8)[self.codes].tobytes()
        self.kinds = np.frombuffer(told, np.uint8)
        word = self.kinds == WORD
        begins = self.kinds == MARK
        begins[:1] |= word[:1]
        begins[1:] |= word[1:] > word[:-1]
        self.begins = self.sized = np.flatnonzero(begins)
        if CONTROL in told:
            self.sized = np.flatnonzero(begins | (self.kinds == CONTROL))

    def spans(self, gaps: Sequence[tuple[int, int]], begin: int, end: int) -> list[tuple[int, int, int]]:
        """(begin, end, size) of what lies between gaps of a part."""
        begins, ends = [begin, *(b for _, b in gaps)], [*(a for a, _ in gaps), end]
        ranks = np.searchsorted(self.sized, begins + ends).tolist()
        return [(a, b, n - m) for a, b, m, n in zip(begins, ends, ranks, ranks[len(begins) :], strict=False)]

    def sentences(self) -> tuple[list[int], list[int], list[int], bool]:
        """Where sentences begin and end, the running sums of their tokens, and whether one space each parts them.

        A sentence ends with a mark before blanks; the next begins with the first token behind them.
        """
        mark = self.codes == ord(SENTENCE_ENDS[0])
        for c in SENTENCE_ENDS[1:] if self.codes.itemsize > 1 else SENTENCE_ENDS[1:3]:
            mark |= self.codes == ord(c)
        ends = np.flatnonzero(mark[:-1]) + 1
        kinds = self.kinds[ends]
        ends = ends[(kinds == BLANK) | (kinds == CONTROL)]
        ranks = np.searchsorted(self.begins, ends)
        begins = np.append(self.begins, len(self.text))[ranks]
        spaced = bool((begins - ends == 1).all() and (self.codes[ends] == 32).all())
        return [0, *begins.tolist()], [*ends.tolist(), len(self.text)], [0, *ranks.tolist(), len(self.begins)], spaced

    def units(self, most: int) -> list[tuple[int, int, int]]:
        """(begin, end, tokens) of a text cut at empty lines, parts over most tokens at line ends, and lines over it every half as many words."""
        text, step, out = self.text, max(1, most // 2), []

        def gaps(sign: str, begin: int, end: int, every: int = 1) -> list[tuple[int, int]]:
            found = np.flatnonzero(self.codes[begin:end] == ord(sign))[every - 1 :: every]
            return [(begin + i, begin + i + 1) for i in found.tolist()]

        for part in self.spans([m.span() for m in EMPTY_LINES.finditer(text)] if "\n\n" in text else [], 0, len(text)):
            if part[2] <= most:
                out.append(part)
                continue
            for line in self.spans(gaps("\n", *part[:2]), *part[:2]) if text.find("\n", *part[:2]) >= 0 else [part]:
                out.extend([line] if line[2] <= most else self.spans(gaps(" ", *line[:2], step), *line[:2]))
        return [u for u in out if u[2] or text[u[0] : u[1]].strip(" ")]


#: The last texts, which several steps or strategies read one after the other.
read = lru_cache(maxsize=2)(Text)


def _token_counts(texts: list[str]) -> list[int]:
    """The number of tokens of each text, as TOKEN finds them."""
    if sum(map(len, texts)) < 200:
        return [len(TOKEN.findall(t)) for t in texts]
    stops = np.fromiter(accumulate(len(t) + 1 for t in texts), np.int64, len(texts))  # a line end parts them
    return np.diff(np.searchsorted(Text("\n".join(texts)).begins, stops), prepend=0).tolist()


# blocks


@dataclass(frozen=True)
class Block:
    kind: str
    text: str
    level: int
    name: str
    language: str
    size: int
    headings: tuple[str, ...]


def _below(path: tuple[str, ...], level: int, name: str) -> tuple[str, ...]:
    """The path of a heading below path: one of level n keeps n - 1 of those before it."""
    return (*path[: max(0, level - 1)], name)


@lru_cache(maxsize=1)
def blocks(text: str | None) -> Sequence[Block]:
    """The blocks of a page: a fence goes on to the next one or the end of the page; lists take indented lines along; headings are those above a block."""
    text = re.sub(r"\r\n?", "\n", text or "")
    found: list[list] = []  # kind, begin, end, match of a heading
    last, inside, in_list, at = None, False, False, 0
    for line in text.split("\n"):
        fence = line.startswith(FENCE)
        code, indented, heading = inside or fence, line.startswith(("  ", "\t")), None
        item = not code and LIST_ITEM.match(line) is not None
        if code:
            kind = "code"
        elif in_list and indented:
            kind = "list"
        elif not (bare := line.strip(WHITE)):
            kind = None
        elif heading := HEADING.match(line):
            kind = "heading"
        elif bare[0] == bare[-1] == "|":
            kind = "table"
        else:
            kind = "list" if item else "paragraph"
        if kind is not None:
            if (fence and not inside) if code else (heading or kind != last or (kind == "paragraph" and HEADED.match(line))):
                found.append([kind, at, 0, heading])
            found[-1][2] = at + len(line)
        if code or item or not indented:  # lines that don't depend on the one before
            in_list = item
        last, inside, at = kind, inside ^ fence, at + len(line) + 1
    if not found:
        return ()
    ranks = np.searchsorted(read(text).sized, [b[1:3] for b in found])
    out, path = [], ()
    for (kind, begin, end, heading), size in zip(found, (ranks[:, 1] - ranks[:, 0]).tolist(), strict=True):
        level, name = (len(heading[1]), heading[2]) if heading else (0, "")
        path = _below(path, level, name) if heading else path
        whole = text[begin:end]
        language = LANGUAGE.match(whole.split("\n", 1)[0])[1] if kind == "code" else ""
        out.append(Block(kind, whole, level, name, language, size, path))
    return tuple(out)


def joined(texts: list[str]) -> str:
    return "\n\n".join(t for t in (x.strip(WHITE) for x in texts) if t)


def kinds_of(parts: list[Block]) -> list[str]:
    return sorted({b.kind for b in parts} - {"heading"})


# parents and children


@dataclass(frozen=True)
class Parent:
    headings: tuple[str, ...]
    section: str
    tokens: int
    parts: list[Block]


def parents(text: str | None, sizes: Sizes, control: bool) -> list[Parent]:
    """The parents of a page: they begin at headings of known sections and where the size is reached; a short one joins the one before it if both are of one section."""
    known = classify.CONTROL_SECTIONS if control else classify.SECTIONS
    section = classify.control_section_of if control else classify.section_of
    runs: list[list[Block]] = []
    total = 0
    for b in blocks(text):
        begins = b.kind == "heading" and b.level <= TOP_LEVEL and section(b.headings, b.text) in known
        if not runs or begins or (total > 0 and total + b.size > sizes.parent_most):
            runs.append([])
            total = 0
        runs[-1].append(b)
        total += b.size
    out: list[Parent] = []
    for run in runs:
        headings, size = next((b.headings for b in run if b.headings), ()), sum(b.size for b in run)
        name = section(headings, joined([b.text for b in run]))
        if out and size < sizes.child_least and name == out[-1].section and out[-1].tokens + size <= sizes.parent_most:
            out[-1].parts.extend(run)
            out[-1] = replace(out[-1], tokens=out[-1].tokens + size)
        else:
            out.append(Parent(headings, name, size, run))
    return out


def cut_block(text: str | None, kind: str, most: int) -> list[str] | None:
    """The pieces of a text of more than most tokens: tables repeat their two header lines, code its fences, text ends at sentences."""
    return None if text is None else [t for t, _ in _cut(text, kind, most)]


def _cut(text: str, kind: str, most: int) -> list[tuple[str, int | None]]:
    """The pieces with their tokens, where these are known."""
    if kind not in ("table", "code"):
        starts, stops, sums, spaced = read(text).sentences()
        joined_rows = lambda a, b: text[starts[a] : stops[b - 1]] if spaced else " ".join(text[x:y] for x, y in zip(starts[a:b], stops[a:b], strict=True))
        return [(joined_rows(a, b), sums[b] - sums[a]) for a, b in _filled(sums, most)]
    lines = text.split("\n")
    if len(lines) <= 3:
        return [(text, None)]
    head = lines[: 2 if kind == "table" else 1]
    closed = kind == "code" and lines[-1].startswith(FENCE)
    rows, foot = lines[len(head) : len(lines) - closed], [FENCE] * (kind == "code")
    room = most - len(TOKEN.findall(" ".join([*head, *foot])))
    return [("\n".join([*head, *rows[a:b], *foot]), None) for a, b in _filled([0, *accumulate(_token_counts(rows))], room)]


def _filled(sums: list[int], room: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with as many tokens as there is room for, one row at least; sums are the running sums of the rows' tokens."""
    begin = 0
    while begin < len(sums) - 1:
        stop = max(begin + 1, bisect_right(sums, sums[begin] + room) - 1)
        yield begin, stop
        begin = stop


def plan_children(sizes: list[int], kinds: list[str], lines: list[list[int]], least: int, target: int, most: int, overlap: int) -> list[tuple]:
    """Which pieces make up each child of a parent, and how many last lines of the child before it lead it in.

    sizes, kinds and lines are the tokens of each piece, its kind, and the tokens of its lines. A child is closed when the next piece would
    take it over the target. Code and tables bring the text before them along. A child under the least size joins the
    one before, unless it has code or a table. Lines lead in until they have `overlap` tokens, if there is room.
    """
    groups: list[list[int]] = [[]]
    context, total = None, 0
    for i, kind in enumerate(kinds):
        hard, group = kind in ("code", "table"), groups[-1]
        if group and total + sizes[i] > target:
            groups.append([])
            group, total = groups[-1], 0
        if hard and not group and context is not None:
            group.append(context)
            total += sizes[context]
        group.append(i)
        total += sizes[i]
        context = i if kind in ("paragraph", "list") else context
    out: list[tuple] = []
    for group in filter(None, groups):
        size = sum(sizes[k] for k in group)
        if out and size < least and not {"code", "table"} & {kinds[k] for k in group}:
            out[-1] = ([*out[-1][0], *group], *out[-1][1:])
            continue
        room = max(0, most - size)
        before, taken = (out[-1][0], 0) if out and room else ([], 0)
        if before:
            counts = [x for k in before for x in (*lines[k], 0)][-2::-1]  # from the end; an empty line parts pieces
            taken = min(len(counts), bisect_left([*accumulate(counts)], min(overlap, room)) + 1)
        out.append((group, before, taken, room))
    return out


def _paired(text: str) -> str:
    """text with its code fences in pairs: an open one is closed, one whose begin is missing gets it."""
    if len(re.findall(r"(?m)^```", text)) % 2 == 0:
        return text
    return f"{text}\n{FENCE}" if text.startswith(FENCE) else f"{FENCE}\n{text}"


def children(texts: list[str], kinds: list[str], sizes: Sizes, known: Sequence[int | None] = ()) -> list[tuple]:
    """(pieces, content, tokens, overlap) of each child that plan_children finds for the pieces of a parent, whose tokens may be known."""
    lines = [[n] if n is not None and "\n" not in t else None for t, n in zip_longest(texts, known)]
    split = [t.split("\n") for t, n in zip(texts, lines, strict=True) if n is None]
    counts = iter(_token_counts([x for t in split for x in t]))
    told = iter([[next(counts) for _ in t] for t in split])
    lines = [next(told) if n is None else n for n in lines]
    out = []
    for group, before, taken, room in plan_children([sum(n) for n in lines], kinds, lines, sizes.child_least, sizes.child_target, sizes.child_most, sizes.overlap):
        content, overlap = "\n\n".join(texts[k] for k in group), 0
        ahead = sum([x for k in before for x in (*lines[k], 0)][-2::-1][:taken])
        if 0 < taken and ahead <= room:
            bare = "\n".join("\n\n".join(texts[k] for k in before).split("\n")[-taken:]).strip()
            lead = _paired(bare)
            ahead += len(FENCE) * (lead != bare)
            if lead and ahead <= room:
                content, overlap = f"{lead}\n\n{content}", ahead
        out.append((group, content, overlap + sum(sum(lines[k]) for k in group), overlap))
    return out


def page_children(text: str | None, sizes: Sizes, control: bool = False) -> Iterator[tuple]:
    """(parent, content, headings, kinds, languages, tokens, overlap) of the children of a page; parent is the number of theirs."""
    for number, parent in enumerate(parents(text, sizes, control)):
        pieces: list[tuple[str, int | None, Block]] = []
        path: tuple[str, ...] = ()  # headings begin anew in each parent
        for b in parent.parts:
            path = _below(path, b.level, b.name) if b.kind == "heading" else path
            here = replace(b, headings=path)
            pieces.extend((t.strip(WHITE), n, here) for t, n in (_cut(b.text, b.kind, sizes.child_most) if b.size > sizes.child_most else [(b.text, None)]))
        texts, known, parts = zip(*pieces, strict=True) if pieces else ((), (), ())
        for group, content, tokens, overlap in children([*texts], [b.kind for b in parts], sizes, known):
            own = [parts[k] for k in group]
            headings = next((b.headings for b in own if b.headings), parent.headings)
            yield number, content, headings, kinds_of(own), sorted({b.language for b in own} - {""}), tokens, overlap


# flat chunks: (content, tokens, headings) each


def token_chunks(text: str | None, size: int, overlap: int) -> Iterator[tuple]:
    """Windows of size tokens, each overlap into the one before."""
    page = read(text or "")
    n = len(page.begins)
    first = np.arange(0, max(1, n - overlap) if n else 0, size - overlap)
    stop = np.minimum(first + size, n)
    for begin, last, tokens in zip(page.begins[first].tolist(), page.begins[stop - 1].tolist(), (stop - first).tolist(), strict=True):
        yield page.text[begin : TOKEN.match(page.text, last).end()], tokens, ()


def _packed(sizes: list[int], size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first, stop, tokens) of runs of at most size tokens; each begins with the last units of the one before, up to overlap tokens of them."""
    sums = [0, *accumulate(sizes)]
    out, first = [], 0
    while first < len(sizes):
        stop = max(first + 1, bisect_right(sums, sums[first] + size) - 1)
        out.append((first, stop, sums[stop] - sums[first]))
        if stop == len(sizes):
            break
        first = max(first + 1, bisect_left(sums, sums[stop] - overlap))
        if sums[min(stop + 1, len(sizes))] - sums[first] > size:  # the next unit wouldn't fit behind them
            first = stop
    return out


@lru_cache(maxsize=1)
def _flat(text: str, size: int, overlap: int) -> Sequence[tuple[str, int]]:
    units = read(text).units(size)
    return tuple(("\n".join(text[a:b] for a, b, _ in units[first:stop]), tokens) for first, stop, tokens in _packed([u[2] for u in units], size, overlap))


def flat_chunks(text: str | None, size: int, overlap: int, headings: tuple[str, ...] = ()) -> Iterator[tuple]:
    """A text cut at the widest separators that keep parts to size, packed again with overlap."""
    for content, tokens in _flat(text or "", size, overlap):
        yield content, tokens, headings


def section_chunks(text: str | None, size: int, overlap: int, levels: int = 3) -> Iterator[tuple]:
    """flat_chunks of the sections between headings of the first levels, with the headings above each."""
    sections: list[list[Block]] = []
    for b in blocks(text):
        if not sections or (b.kind == "heading" and b.level <= levels):
            sections.append([])
        sections[-1].append(b)
    for parts in sections:
        yield from flat_chunks("\n\n".join(b.text for b in parts), size, overlap, parts[0].headings)


def structured_chunks(text: str | None, size: int, overlap: int) -> Iterator[tuple]:
    """Children of a target size; their overlap goes with it."""
    for _, content, headings, _, _, tokens, _ in page_children(text, Sizes.around(size)):
        yield content, tokens, headings


#: Strategies by name: each takes a text, a size and an overlap in tokens.
STRATEGIES: dict[str, Callable[[str | None, int, int], Iterator[tuple]]] = {"token": token_chunks, "markdown": section_chunks, "recursive": flat_chunks, "structured": structured_chunks}


def totals(text: str | None, strategies: Sequence[str], size: int, overlap: int) -> Iterator[tuple[str, int, int, int]]:
    """(strategy, chunks, tokens, most tokens of one) of the strategies that make chunks of a page."""
    for name in strategies:
        tokens = [c[1] for c in STRATEGIES[name](text, size, overlap)]
        if tokens:
            yield name, len(tokens), sum(tokens), max(tokens)
