"""Byte-level BPE encoding and decoding.

The pieces of a text are merged with a segment tree over the ranks of adjacent pairs: its root gives the leftmost pair
of lowest rank, a merge changes three leaves, and each change climbs to the root in logarithmic time. A piece of n
bytes takes O(n log n), whatever its length. Short pieces of one size stand side by side as the rows of arrays, a tree a row,
and each round merges the root's pair of every row; long ones have a tree of their own.

Texts are cut at spaces where a piece always starts. Arrow numbers the distinct chunks of some texts, trees run for those
that a worker doesn't remember, and the ids of all chunks are gathered by number. Memories are bounded by bytes. The vocabulary
goes from the driver to the tasks as a broadcast of the file's fixed size, so executors need no file.

A null text is encoded like an empty one, to no ids; null ids decode to an empty text. Repeated rows and clashing extra
columns are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed: the split of byte-level BPE vocabularies, with white space as Unicode defines it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bytes of texts encoded at a time, and of a memory's generation; longest piece that shares arrays with others.
AT_ONCE, REMEMBERED, SIDE_BY_SIDE = 4 << 20, 24 << 20, 64
#: A mark after letters is a piece of its own.
MARKS = frozenset(",.;:!?")
NEVER = 1 << 62
#: A space inside a run of white space, where no piece starts; more than Unicode's white space, which only costs time.
BLANK = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
INSIDE = f"{BLANK} (?:{BLANK}|$)"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Merge ranks and token bytes of a tokenizer file (its JSON text)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        self.byte_id = [vocab[c] for c in letters]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if len(vocab) >= 1 << 20:
            raise ValueError("the vocabulary is too large for the keys of pairs")
        self.rank = {vocab[a] << 20 | vocab[b]: i << 32 for i, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        keys = np.array(list(self.rank), np.int64)
        self._sorted = np.argsort(keys)
        self._keys, self._merged, self._bytes = keys[self._sorted], np.array(self.merged, np.int64), np.array(self.byte_id, np.int64)
        byte_of = {c: b for b, c in enumerate(letters)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in vocab.items():
            tokens[i] = bytes(byte_of[c] for c in token)
        for token, i in special.items():
            tokens[i] = token.encode()
        self.tokens, self.decimals = pa.array(tokens, pa.large_binary()), pa.array([b"%d," % i for i in range(len(tokens))], pa.large_binary())
        self.special = special
        self._special = re.compile("|".join(f"({re.escape(t)})" for t in sorted(special, key=len, reverse=True))) if special else None
        self._slow = "|".join([INSIDE, *(re.escape(t) for t in special)])
        self._pieces = regex.compile(PIECES)
        self.pieces = _Memory(self._merge_all)
        self.others = _Memory(lambda parts: self._joined([self._pieces.findall(" " + part) for part in parts]))

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ids = [self.byte_id[x] for x in piece]
        n, get, merged = len(ids), self.rank.get, self.merged
        if n == 1:
            return ids
        size = 1 << (n - 2).bit_length()
        tree = [NEVER] * (2 * size)
        for i in range(n - 1):
            r = get(ids[i] << 20 | ids[i + 1])
            if r is not None:
                tree[size + i] = r | i
        for i in range(size - 1, 0, -1):
            x, y = tree[2 * i], tree[2 * i + 1]
            tree[i] = y if y < x else x
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := tree[1]) != NEVER:
            i = top & 0xFFFFFFFF
            gone, left = after[i], before[i]
            ids[i] = new = merged[top >> 32]
            ids[gone] = -1
            right = after[i] = after[gone]
            # three leaves change: the pairs before and after the new token, and the one that began with the token gone
            r = None
            if right < n:
                before[right] = i
                r = get(new << 20 | ids[right])
            tree[size + i] = NEVER if r is None else r | i
            changed = [size + i]
            if gone < n - 1:
                tree[size + gone] = NEVER
                changed.append(size + gone)
            if left >= 0:
                r = get(ids[left] << 20 | new)
                tree[size + left] = NEVER if r is None else r | left
                changed.append(size + left)
            for at in changed:
                at >>= 1
                while at:
                    x, y = tree[2 * at], tree[2 * at + 1]
                    if y < x:
                        x = y
                    if tree[at] == x:
                        break
                    tree[at] = x
                    at >>= 1
        return [x for x in ids if x >= 0]

    def _leaves(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The leaves of the pairs (a, b) that begin at place: rank and place, NEVER of no pair; a negative id is none."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (a >= 0) & (b >= 0), self._sorted[at] << 32 | place, NEVER)

    def _side_by_side(self, pieces: list[bytes], size: int) -> list[bytes]:
        """merge() of pieces of at most size + 1 bytes, as bytes of 32-bit ids: row i of every array is that of piece i."""
        m, width = len(pieces), size + 2  # a column before and after the tokens
        lengths = np.fromiter(map(len, pieces), np.int64, m)
        ids = np.full((m, width + 1), -1, np.int64)
        ids[np.repeat(np.arange(m), lengths), 1 + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = self._bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        tree = np.full((m, 2 * size), NEVER, np.int64)
        tree[:, size:] = self._leaves(ids[:, 1 : size + 1], ids[:, 2 : size + 2], np.arange(size))
        level = size // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        links = np.arange(width + 1)
        after, before = np.tile(np.minimum(links + 1, width), (m, 1)).ravel(), np.tile(np.maximum(links - 1, 0), (m, 1)).ravel()
        flat, nodes, rows = ids.ravel(), tree.ravel(), np.arange(m)
        while len(rows := rows[nodes[rows * 2 * size + 1] != NEVER]):
            base, root = rows * (width + 1), rows * 2 * size
            top = nodes[root + 1]
            i = (top & 0xFFFFFFFF) + 1
            gone, left, new = after[base + i], before[base + i], self._merged[top >> 32]
            right = after[base + gone]
            flat[base + i], flat[base + gone] = new, -1
            after[base + i], before[base + right] = right, i
            # the same three leaves as in merge(); left 0 and gone beyond the last pair have no leaf
            both = self._leaves(np.concatenate([new, flat[base + left]]), np.concatenate([flat[base + right], new]), np.concatenate([i, left]) - 1)
            leaf = size - 1
            nodes[root + leaf + i] = both[: len(rows)]
            nodes[(root + leaf + gone)[gone <= size]] = NEVER
            inner = left > 0
            nodes[(root + leaf + left)[inner]] = both[len(rows) :][inner]
            at = np.concatenate([i, np.minimum(gone, size), np.maximum(left, 1)]) + leaf
            root = np.concatenate([root, root, root])
            for _ in range(size.bit_length() - 1):
                at >>= 1
                nodes[root + at] = np.minimum(nodes[root + 2 * at], nodes[root + 2 * at + 1])
        kept = ids >= 0
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        told = ids[kept].astype("<i4").tobytes()
        return [told[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _merge_all(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        raw = [p.encode() for p in pieces]
        for k, x in enumerate(raw):
            n = len(x)
            by_size.setdefault(0 if n < 2 else 1 << (n - 2).bit_length() if n <= SIDE_BY_SIDE else -1, []).append(k)
        for size, chosen in by_size.items():
            if size > 0:
                found = self._side_by_side([raw[k] for k in chosen], size)
            else:
                found = [np.array(self.merge(raw[k]), "<i4").tobytes() if raw[k] else b"" for k in chosen]
            for k, told in zip(chosen, found, strict=True):
                out[k] = told
        return out

    def _chunks(self, parts: list[str]) -> list[bytes]:
        """The ids of " " + part for each of parts."""
        words, marked, other = [], [], []
        for k, part in enumerate(parts):
            if part.isalpha():
                words.append(k)
            elif part[-1:] in MARKS and part[:-1].isalpha():
                marked.append(k)
            else:
                other.append(k)
        stems = [" " + parts[k] for k in words] + [" " + parts[k][:-1] for k in marked]
        found = self.pieces.all(stems)
        marks = self.pieces.all([parts[k][-1] for k in marked])
        out = [b""] * len(parts)
        for k, told in zip(words, found, strict=False):
            out[k] = told
        for k, told, mark in zip(marked, found[len(words) :], marks, strict=True):
            out[k] = told + mark
        for k, told in zip(other, self.others.all([parts[k] for k in other]), strict=True):
            out[k] = told
        return out

    def _joined(self, listed: list[list[str]]) -> list[bytes]:
        ids = iter(self.pieces.all([p for pieces in listed for p in pieces]))
        return [b"".join([next(ids) for _ in pieces]) for pieces in listed]

    def _alone(self, text: str) -> bytes:
        """The ids of a text with special tokens or spaces inside of white space."""
        found = []
        for part in self._special.split(text) if self._special else [text]:
            if part and part in self.special:
                found.append(np.array([self.special[part]], "<i4").tobytes())
            elif part:
                first, *rest = re.split(r"(?<!\s) | (?=\S)", part)
                found += self._joined([self._pieces.findall(first)]) + self._chunks(rest)
        return b"".join(found)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(ends, ids) of texts without nulls: the ids of text k are ids[ends[k]:ends[k + 1]]."""
        slow = pc.match_substring_regex(texts, self._slow)
        alone = {k: self._alone(texts[k].as_py()) for k in np.flatnonzero(slow.to_numpy(zero_copy_only=False)).tolist()}
        # a text of its own ids is one chunk; of the others, the first chunk has no space before it
        parts = pc.split_pattern(pc.if_else(slow, "", texts), " ")
        begins = np.asarray(parts.offsets)
        coded = parts.flatten().dictionary_encode()
        number, table = coded.indices.to_numpy().copy(), self._chunks(coded.dictionary.to_pylist())
        firsts = parts.flatten().take(pa.array(begins[:-1])).to_pylist()
        number[begins[:-1]] = len(table) + np.arange(len(texts))
        first = self._joined([self._pieces.findall(x) for x in firsts])
        for k, told in alone.items():
            first[k] = told
        table += first
        ends = np.cumsum([0, *map(len, table)]) // 4
        taken = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(table), np.int32))).take(pa.array(number))
        return np.asarray(taken.offsets)[begins], taken.flatten()

    def decode_all(self, ends: np.ndarray, ids: pa.Array) -> list[bytes]:
        """The bytes of each text; ids are within the vocabulary."""
        return _cut(self.tokens, ends, ids)

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.encode_all(pa.array([text], pa.large_string()))[1])

    def decode(self, ids) -> str:
        """The text of ids; those outside the vocabulary are skipped, broken UTF-8 becomes U+FFFD."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.tokens))]
        return self.decode_all(np.array([0, len(ids)]), pa.array(ids, pa.int64()))[0].decode("utf-8", "replace")


def _cut(table: pa.Array, ends: np.ndarray, ids: pa.Array) -> list[bytes]:
    """What table has for ids, joined between each two of ends."""
    taken = table.take(ids)
    places = np.frombuffer(taken.buffers()[1], np.int64)[ends].tolist() if len(ids) else [0] * len(ends)
    data = taken.buffers()[2]
    data = memoryview(data) if data is not None and len(ids) else memoryview(b"")
    return [bytes(data[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]


class _Memory:
    """The ids of the keys last seen, in two generations of REMEMBERED bytes; make(keys) gives those of new ones."""

    def __init__(self, make: Callable[[list[str]], list[bytes]]):
        self._make, self._new, self._old, self._size = make, {}, {}, 0

    def all(self, keys: list[str]) -> list[bytes]:
        new, old = self._new, self._old
        wanted = [x for x in dict.fromkeys(keys) if x not in new]
        fresh = [x for x in wanted if x not in old]
        for x in wanted:
            if x in old:
                new[x] = old[x]
        new.update(zip(fresh, self._make(fresh), strict=True))
        out = list(map(new.__getitem__, keys))
        self._size += sum(map(len, wanted)) + 250 * len(wanted)
        if self._size > REMEMBERED:
            self._old, self._new, self._size = new, {}, 0
        return out


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    text = shared.value
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(text)
    return _loaded[key]


def _share(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _stretches(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows (begin, end) of texts of about AT_ONCE bytes together."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)))
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + AT_ONCE, "right")))
        yield begin, end
        begin = end


def _texts(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.large_string()), "")


def _with(df: DataFrame, source: str, made: list[T.StructField], convert) -> DataFrame:
    """df with columns that convert gives for each stretch of the column source, in place of those of the same names."""
    new = [f.name for f in made]
    names = [c for c in df.columns if c not in new]
    schema = T.StructType([*(df.schema[c] for c in names), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(source))
            for begin, end in _stretches(column if not pa.types.is_list(column.type) else pc.cast(pc.list_value_length(column), pa.string())):
                part = batch.slice(begin, end - begin)
                rest = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*rest, *convert(column.slice(begin, end - begin))], [*names, *new])

    return df.mapInArrow(run, schema)


def _lists(ends: np.ndarray, ids: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids)


IDS = T.ArrayType(T.IntegerType())


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the token ids of text (array of int) in the column ids, which replaces one of that name."""
    shared = _share(df, path)
    return _with(df, text, [T.StructField(ids, IDS)], lambda column: [_lists(*_vocabulary(shared).encode_all(_texts(column)))])


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of the token ids in the column text, which replaces one of that name."""
    shared = _share(df, path)

    def convert(column: pa.Array) -> list[pa.Array]:
        vocabulary = _vocabulary(shared)
        return [pa.array([vocabulary.decode(np.asarray(x.values.fill_null(-1)) if x.is_valid else []) for x in column], pa.string())]

    return _with(df, ids, [T.StructField(text, T.StringType())], convert)


def bpe_round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", same: str = "decodes") -> DataFrame:
    """df with the token ids of text, and whether they decode to it, in one pass."""
    shared = _share(df, path)

    def convert(column: pa.Array) -> list[pa.Array]:
        vocabulary, texts = _vocabulary(shared), _texts(column)
        ends, found = vocabulary.encode_all(texts)
        back = vocabulary.decode_all(ends, found)
        return [_lists(ends, found), pc.equal(texts.cast(pa.large_binary()), pa.array(back, pa.large_binary()))]

    return _with(df, text, [T.StructField(ids, IDS), T.StructField(same, T.BooleanType())], convert)


def digests(df: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: the number of tokens and digests of the ids and of the text decoded from them, in one pass."""
    shared = _share(df, path)

    def convert(column: pa.Array) -> list[pa.Array]:
        vocabulary = _vocabulary(shared)
        ends, ids = vocabulary.encode_all(_texts(column))
        told = [hashlib.sha256(x[:-1]).hexdigest() for x in _cut(vocabulary.decimals, ends, ids)]
        back = [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in vocabulary.decode_all(ends, ids)]
        return [pa.array(np.diff(ends)), pa.array(told), pa.array(back)]

    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    slim = df.select(df[id].alias("doc_id"), df[text].alias("text"))
    return _with(slim, "text", made, convert).drop("text")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.json"))
