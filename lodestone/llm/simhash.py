"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is a row of bytes at fixed positions. Each distinct fingerprint is posted under its bytes at the positions of
every key in a family. Fingerprints that meet in a posting list are tallied: pairs that share fewer positional bytes
than a link guarantees are dropped, the rest are verified bit by bit.

simhash_groups: 64 bits, links at `radius` (3) bits. Two such fingerprints agree in at least 8 - radius (5) of 8 bytes, and
every set of five positions holds a key of the covering family, so no link is lost. The keys' width follows from the number of
fingerprints, so that chance meetings stay rarer than fingerprints.

similar_groups: sets of the distinct shingles of a text, five words each, linked at a Jaccard similarity of 0.8 or more. Byte p
of a fingerprint is here the last byte of the set's least hash under function p, so two sets share a positional byte with
the probability of their similarity; signs of sums, as SimHash has them, differ too much at 0.8 for any key to be sure of a
pair (README). Sets are posted under KEYS keys of four bytes; pairs that meet and share MATCHES of the bytes are candidates. A
pair at 0.8 is missed in 0.02 % of cases, one at 0.85 in 0.001 %, alike at every size. Candidates connect families, and each family
is compared by its whole sets: no link stands on an estimate. Families over BLOCK members or BLOCK_BYTES are dealt
out in blocks, each with some members that all blocks get; only where these leave a family unconnected, all pairs of its blocks meet.

Only what keeps fingerprints connected leaves a posting list (a spanning forest of its links), so large groups
give as many links as members, not pairs. Lists longer than BLOCK are dealt out by pairs of blocks over tasks. Connected
components alternate large-star and small-star steps, each checkpointed.

Null and empty texts have fingerprint zero and link like any other. A null id is kept as a row, but it never
names a component unless no other id is in it. Rows may repeat. An empty table gives no rows; other columns than
id and text aren't read, whatever their names. A very long text is hashed as a whole, in slices of bounded memory where it stands with others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, shared_table
from .hashing import U, Slice, mix, slices

SHINGLE, SEED, RADIUS, BLOCK = 3, 42, 3, 4096
#: Words in a shingle and least similarity of similar_groups; keys of four bytes each, and shared bytes of a candidate (of 4 * KEYS).
WIDE_SHINGLE, SIMILARITY, KEYS, MATCHES = 5, 0.8, 16, 36
#: Bytes of the sets of a block; members of a large family that all of its blocks get.
BLOCK_BYTES, SHARED = 4 << 20, 8
#: Parts over which the rows of one text are dealt.
SALTS = 16
#: Pairs of short lists are compared at once, PAIRS at a time; longer lists row by row.
SHORT, PAIRS = 64, 1 << 19
#: Posting lists or families above BLOCK that are broadcast; of more, both sides are shuffled.
BROADCAST_LISTS = 50_000
#: Texts of more shingles are counted in pieces of this many.
PIECE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: bit i is set if it is in over half of the shingles' XXH64."""
    words = text.lower().split()  # bytes: A-Z alone, and ASCII white space
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    hashes = np.empty(n, "<u8")
    if n == 1:
        hashes[0] = xxhash.xxh64_intdigest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes[:] = [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        bits = np.unpackbits(hashes[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, code): the SimHash of each row's text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint((t or "").encode(), shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(codes, np.uint64).view(np.int64))], ["doc_id", "code"])

    slim = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, code long")


def covering(width: int, agree: int = 8 - RADIUS, bytes_: int = 8) -> list[tuple[int, ...]]:
    """Sets of `width` byte positions such that any `agree` positions hold at least one of them.

    Positions are split evenly into as many parts as still force `width` of them into one part.
    """
    parts = max(1, (agree - 1) // (width - 1)) if width > 1 else bytes_ - agree + 1
    if width == 1:
        return [(i,) for i in range(parts)]
    groups = [list(range(bytes_))[i::parts] for i in range(parts)]
    return sorted({c for g in groups for c in combinations(g, width)})


def _width(n: int) -> int:
    """Bytes in a key: 3 (8 keys each) up to 2 ** 26 fingerprints, 5 (56 keys each) beyond."""
    return 3 if n <= 1 << 26 else 5


class _Forest:
    """Links that were not connected by earlier ones."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.a: list[int] = []
        self.b: list[int] = []

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def add(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.a.append(a)
            self.b.append(b)


def _near(x: np.ndarray, y: np.ndarray, radius: int, least: int) -> np.ndarray:
    """Which rows of x and y (64-bit words) share enough positional bytes and differ in few enough bits."""
    differ = x ^ y
    at = np.flatnonzero((differ.view(np.uint8).reshape(len(differ), 8 * x.shape[1]) == 0).sum(axis=1) >= least)  # count filter
    return at[np.bitwise_count(differ[at]).sum(axis=1) <= radius]


def _short_links(forest: _Forest, node: np.ndarray, code: np.ndarray, sizes: np.ndarray, radius: int, least: int) -> None:
    """All lists at once: node, code are their members one list after the other."""
    later = np.concatenate([np.arange(n - 1, -1, -1) for n in sizes.tolist()]) if len(sizes) else sizes
    first = np.repeat(np.arange(len(node)), later)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)
    at = _near(code[first], code[second], radius, least)
    for a, b in set(zip(node[first[at]].tolist(), node[second[at]].tolist(), strict=True)):
        forest.add(a, b)


def _long_links(forest: _Forest, node: np.ndarray, code: np.ndarray, radius: int, least: int) -> None:
    """One list, row by row against the rows not yet connected to it."""
    root = np.arange(len(node))
    for i in range(len(node) - 1):
        rest = np.flatnonzero(root != root[i])
        near = rest[_near(code[rest], np.broadcast_to(code[i], (len(rest), code.shape[1])), radius, least)]
        _, firsts = np.unique(root[near], return_index=True)
        for j in near[firsts]:
            forest.add(int(node[i]), int(node[j]))
            root[root == root[j]] = root[i]


def _list_links(words: int, radius: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            members, sizes = lists.flatten(), np.diff(np.asarray(lists.offsets))
            node = members.field("node").to_numpy(zero_copy_only=False)
            code = np.ascontiguousarray(np.stack([members.field(f"c{i}").to_numpy(zero_copy_only=False) for i in range(words)], axis=1)).view(np.uint64)
            ends, forest = np.cumsum(sizes), _Forest()
            short = np.where(sizes <= SHORT, sizes * (sizes - 1) // 2, 0)
            pairs, at = np.cumsum(short), 0
            while at < len(sizes):
                stop = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + PAIRS, "right")))
                chosen = np.repeat(sizes[at:stop] <= SHORT, sizes[at:stop])
                lo = ends[at] - sizes[at]
                rows = lo + np.flatnonzero(chosen)
                _short_links(forest, node[rows], code[rows], sizes[at:stop][sizes[at:stop] <= SHORT], radius, least)
                at = stop
            for i in np.flatnonzero(sizes > SHORT):
                _long_links(forest, node[ends[i] - sizes[i] : ends[i]], code[ends[i] - sizes[i] : ends[i]], radius, least)
            yield pa.RecordBatch.from_arrays([pa.array(forest.a, pa.int64()), pa.array(forest.b, pa.int64())], ["a", "b"])

    return run


def links(codes: DataFrame, keys: list[tuple[int, ...]], radius: int, least: int) -> DataFrame:
    """(a, b): links between the nodes of codes (node, c0, c1, ...), one row each, that connect all within `radius` bits.

    Byte p of a fingerprint is byte p % 8 of the word c{p // 8}. Only pairs that share `least` bytes and the bytes of a key meet.
    """
    words = len(codes.columns) - 1
    parts = [f"c{i}" for i in range(words)]
    octet = [F.shiftrightunsigned(F.col(f"c{p // 8}"), 8 * (p % 8)).bitwiseAND(F.lit(255)) for p in range(8 * words)]
    listed = []
    for k, positions in enumerate(keys):
        value = F.lit(k).cast("long")  # the key's number and its bytes
        for p in positions:
            value = F.shiftleft(value, 8).bitwiseOR(octet[p])
        listed.append(value)
    posted = codes.select("node", *parts, F.explode(F.array(*listed)).alias("key"))
    long = cut(posted.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select(F.col("key").alias("long"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    member, group = F.struct("node", *parts), F.collect_list("member").alias("members")
    n_long = long.count()
    if not n_long:
        lists = posted.select("key", member.alias("member")).groupBy("key").agg(group)
    else:
        dealt = posted.join(F.broadcast(long) if n_long <= BROADCAST_LISTS else long, F.col("key") == F.col("long"), "left")
        blocks = F.coalesce("blocks", F.lit(1))
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        # every pair of blocks is a list of its own: of n blocks, a member is in n lists
        pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(own, j) * F.lit(1 << 20).cast("long") + F.greatest(own, j))
        lists = dealt.select("key", member.alias("member"), F.explode(pairs).alias("pair")).groupBy("key", "pair").agg(group)
    return lists.filter(F.size("members") > 1).select("members").mapInArrow(_list_links(words, radius, least), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each node's connected component, for the nodes of edges (a, b)."""
    edges = cut(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    before = state(edges)
    while before[0]:
        # large star: a node's larger neighbours go to its least neighbour
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array("b", "a")).alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()
        edges = cut(small)
        after = state(edges)
        if after == before:
            break
        before = after
    stars = edges.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("node"), "component").unionAll(stars.select(F.col("component").alias("node"), "component").distinct())


def _grouped(rows: DataFrame, parts: list[str], keys_of, radius: int, least: int) -> DataFrame:
    """rows (doc_id, parts) with component_id: the least id reachable over links of fingerprints."""
    own = rows.groupBy(*parts).agg(F.min("doc_id").alias("least"))
    own = cut(own.select(F.monotonically_increasing_id().alias("node"), *parts, "least"))
    joined = components(links(own.select("node", *parts), keys_of(own.count()), radius, least))
    named = own.join(joined.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    named = cut(named.select(*parts, "least", F.coalesce("component", "node").alias("component")))
    moved = named.groupBy("component").agg(F.min("least").alias("component_id"))
    told = named.join(moved, "component").select(*(F.col(p).alias(f"_{p}") for p in parts), "component_id")
    same = F.lit(True)
    for p in parts:
        same = same & (F.col(p) == F.col(f"_{p}"))
    return rows.join(told, same).select("doc_id", *parts, "component_id")


def simhash_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row: the component's least id stands for it."""
    codes = cut(fingerprints(docs, id, text, shingle).withColumnRenamed("code", "c0"))
    out = _grouped(codes, ["c0"], lambda n: covering(_width(n), 8 - radius), radius, 8 - radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex("c0"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(words: Slice, doc: int, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles of a document of the slice; the whole sequence if it has fewer words."""
    a, b = int(words.first[doc]), int(words.first[doc + 1])
    if a == b:
        return np.zeros(0, U)
    begin = np.arange(a, max(a + 1, b - shingle + 1))
    return np.unique(words.spans(begin, np.minimum(begin + shingle, b)))


def _ratio(similarity: float) -> tuple[int, int]:
    return Fraction(str(similarity)).as_integer_ratio()


FACTORS = mix(np.arange(1, 4 * KEYS + 1, dtype=U)) | U(1)
PARTS = [f"c{i}" for i in range(-(-4 * KEYS // 8))]


def least_bytes(hashes: np.ndarray) -> np.ndarray:
    """The positional bytes of a set of hashes: of each function's least value the last one; an empty set has 255."""
    least = np.full(len(FACTORS), U(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), PIECE >> 4):
        least = np.minimum(least, (hashes[None, at : at + (PIECE >> 4)] * FACTORS[:, None]).min(axis=1))
    return least.astype(np.uint8)


def set_fingerprints(docs: DataFrame, id: str, text: str, shingle: int, keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep, digest, c0, c1, ...) of each row: a digest of the set of its shingles and the set's positional bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [n for n in batch.schema.names if n != text]
            for row, stop, part in slices(batch.column(batch.schema.get_field_index(text)), lower=True):
                sets = [shingle_hashes(part, d, shingle) for d in range(stop - row)]
                found = np.stack([least_bytes(x) for x in sets]).view(np.int64)
                made = [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(PARTS)))]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)).slice(row, stop - row) for n in rest), *made], [*rest, "digest", *PARTS])

    slim = docs.select(id, *keep, text)
    kinds = "".join(f"`{c}` {slim.schema[c].dataType.simpleString()}, " for c in (id, *keep))
    return slim.mapInArrow(run, kinds + "digest binary, " + ", ".join(f"{c} long" for c in PARTS))


def _whole_sets(rows: DataFrame, text: str, shingle: int) -> DataFrame:
    """rows without text, with the hashes of its shingles as bytes, in order."""
    names = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, part in slices(batch.column(batch.schema.get_field_index(text)), lower=True):
                told = pa.array([shingle_hashes(part, d, shingle).tobytes() for d in range(stop - row)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)).slice(row, stop - row) for n in names), told], [*names, "hashes"])

    return rows.mapInArrow(run, "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in names) + "hashes binary")


def _set_links(forest: _Forest, node: np.ndarray, part: np.ndarray, code: np.ndarray, sets: list[np.ndarray], top: int, bottom: int) -> None:
    """Links that connect the similar sets of one block, member by member against those of other parts that may be similar."""
    root = np.unique(part, return_inverse=True)[1]
    size = np.array([len(x) for x in sets], np.int64)
    for i in range(len(node) - 1):
        rest = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        rest = rest[np.minimum(size[rest], size[i]) * bottom >= np.maximum(size[rest], size[i]) * top]
        rest = rest[(code[rest] == code[i]).sum(axis=1) >= MATCHES]
        if not len(rest) or not size[i]:
            continue
        ends = np.cumsum(size[rest])
        values = np.concatenate([sets[k] for k in rest.tolist()])
        at = np.minimum(np.searchsorted(sets[i], values), size[i] - 1)
        same = np.add.reduceat(sets[i][at] == values, ends - size[rest], dtype=np.int64)
        for j in rest[same * (top + bottom) >= (size[rest] + size[i]) * top].tolist():
            if root[j] != root[i]:
                forest.add(int(node[i]), int(node[j]))
                root[root == root[j]] = root[i]


def _family_links(similarity: float):
    top, bottom = _ratio(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            members, ends = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            node, part = (members.field(c).to_numpy(zero_copy_only=False) for c in ("node", "part"))
            code = np.ascontiguousarray(np.stack([members.field(c).to_numpy(zero_copy_only=False) for c in PARTS], axis=1)).view(np.uint8)[:, : 4 * KEYS]
            sets, forest = [np.frombuffer(x.as_buffer(), U) for x in members.field("hashes")], _Forest()
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                _set_links(forest, node[a:b], part[a:b], code[a:b], sets[a:b], top, bottom)
            yield pa.RecordBatch.from_arrays([pa.array(forest.a, pa.int64()), pa.array(forest.b, pa.int64())], ["a", "b"])

    return run


def _similar_links(held: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect all similar sets of a family, of held (family, node, c0, ..., hashes)."""
    sizes = held.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("hashes")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    large = cut(sizes.filter("blocks > 1").withColumnRenamed("family", "_family"))
    few = large.count() <= BROADCAST_LISTS
    large = F.broadcast(large) if few else large
    member = F.struct("node", "part", *PARTS, "hashes")

    def linked(rows: DataFrame, *keys: str) -> DataFrame:
        lists = rows.groupBy(*keys).agg(F.collect_list(member).alias("members")).filter(F.size("members") > 1).select("members")
        return lists.mapInArrow(_family_links(similarity), "a long, b long").distinct()

    own = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = held.join(large, F.col("family") == F.col("_family"), "left").withColumn("part", F.col("node")).withColumn("block", own)
    big = dealt.filter("blocks > 1")
    order = Window.partitionBy("family").orderBy(F.xxhash64(F.lit(1), "node"), "node")
    shared = big.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SHARED).drop("_n")
    others = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block")))
    shared = shared.select(*(c for c in dealt.columns if c != "block"), others.alias("block")).select(*dealt.columns)
    first = cut(linked(dealt.unionAll(shared), "family", "block"))
    if large.isEmpty():
        return first
    known = components(first).withColumnRenamed("node", "_node")
    parts = big.drop("part").join(known, F.col("node") == F.col("_node"), "left").withColumn("part", F.coalesce("component", "node")).drop("_node", "component")
    several = parts.groupBy("family").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("family")
    rest = parts.join(several, "family", "left_semi")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least("block", j) * F.lit(1 << 20).cast("long") + F.greatest("block", j))
    return first.unionAll(linked(rest.withColumn("pair", F.explode(pairs)), "family", "pair"))


def _nodes(docs: DataFrame, id: str, text: str, shingle: int, similarity: float, keep: Sequence[str], best: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): id, keep and digest of each row; digest, best of its rows and component of each distinct set."""
    # whole sets are made again for families alone, of one text each, rather than stored for all
    mark = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    marked = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("_text"), mark.alias("_mark"), *keep)
    rows = shared_table(set_fingerprints(marked, "doc_id", "_text", shingle, ["_mark", *keep]), "sets")
    own = rows.groupBy("digest").agg(best.alias("best"), F.min("_mark").alias("mark"), *(F.first(c).alias(c) for c in PARTS))
    own = cut(own.withColumn("node", F.monotonically_increasing_id()))
    keys = [tuple(range(4 * k, 4 * k + 4)) for k in range(KEYS)]
    families = components(links(own.select("node", *PARTS), keys, 64 * len(PARTS), MATCHES)).select(F.col("node").alias("_node"), F.col("component").alias("family"))
    members = own.join(families, F.col("node") == F.col("_node")).select("family", "node", "mark", *PARTS)
    # one text may be that of most rows: its rows are dealt over parts, each of which hands on one
    wanted = members.select(F.col("mark").alias("_wanted"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_part"))
    salt = F.pmod(F.xxhash64("doc_id", *keep), F.lit(SALTS)).cast("int")
    texts = marked.join(wanted, (F.col("_mark") == F.col("_wanted")) & (salt == F.col("_part")), "left_semi").groupBy("_mark").agg(F.first("_text").alias("_text"))
    held = shared_table(_whole_sets(members.join(texts, F.col("mark") == F.col("_mark")).drop("mark", "_mark"), "_text", shingle), "families")
    joined = components(_similar_links(held, similarity)).withColumnRenamed("node", "_node")
    named = own.join(joined, F.col("node") == F.col("_node"), "left").select("digest", "best", F.coalesce("component", "node").alias("component"))
    return rows, named


def similar_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, component_id, component, keep) of each row: groups of texts that links of this Jaccard similarity of shingles or more connect.

    component numbers the group, component_id is its least id: null where no row of it has one, and of several groups where ids repeat.
    """
    rows, named = _nodes(docs, id, text, shingle, similarity, keep, F.min("doc_id"))
    named = cut(named)
    moved = named.groupBy("component").agg(F.min("best").alias("component_id"))
    told = named.join(moved, "component").select("digest", "component_id", "component")
    return rows.select("doc_id", "digest", *keep).join(told, "digest").select("doc_id", "component_id", "component", *keep)


def similar_firsts(docs: DataFrame, key: str, id: str = "doc_id", text: str = "text", shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, key) of one row of each group: that of the least id, without id only where no row of it has one, then of the least key."""
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("doc_id"), F.col(key).alias("key"))
    _, named = _nodes(docs, id, text, shingle, similarity, [key], F.min(order))
    return named.groupBy("component").agg(F.min("best").alias("b")).select("b.doc_id", F.col("b.key").alias(key))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
