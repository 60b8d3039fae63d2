"""SentencePiece encoding and decoding with source offsets.

A text is normalised by the longest prefixes that the model's compiled character map knows; for each normalised character the byte of
the source where it began is recorded. The normalised text is cut wherever no piece of the vocabulary holds both neighbours, the parts are merged
by score (the best pair first, of equals the leftmost), and the recorded bytes project every piece to its span of the source. Characters
without a piece become pieces of bytes, the last of which has the character's span.

A part of n characters takes O(n log n), whatever its length. Parts last seen are remembered, bounded by bytes; texts go through in stretches
of bounded size, or one longer text. The model goes from the driver to the tasks as a broadcast of the file's fixed size.

A null text is encoded like an empty one, to the end id alone where that is asked for; null ids decode to an empty text. Repeated rows and
clashing extra columns are kept as they are, but for columns that have the names of results, which are replaced; an empty table gives no rows. Ties of
scores are defined above. Very long texts and parts are encoded whole.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import _Memory, _cut, _lists, _texts, _with

MARK = "▁"
MARKED = MARK.encode()
UNKNOWN = " ⁇ "
#: Kinds of pieces in a model file; fixed.
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Parts of at most so many characters stand side by side as rows of arrays; longer ones have a heap of their own.
SIDE_BY_SIDE = 32
NEVER = (1 << 31) - 1
IDS = T.ArrayType(T.IntegerType())
SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _byte_by_byte(e: UnicodeError) -> tuple[str, int]:
    """Each byte that belongs to no character counts by itself."""
    return "�", e.start + 1


codecs.register_error("lodestone.bytes", _byte_by_byte)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            x = data[at]
            at += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled map of a model: a double array over UTF-8 bytes whose values are places in a pool of replacements."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.pool = compiled[4 + size :] if size else b""
        #: First bytes at which an entry may start.
        self.first = bytes(b for b in range(1, 256) if self.units and self._child(self._root(), b) is not None)

    def _root(self) -> int:
        return self._offset(self.units[0])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)

    def _child(self, node: int, byte: int) -> tuple[int, int] | None:
        place = node ^ byte
        if place >= len(self.units) or (unit := self.units[place]) & (1 << 31 | 0xFF) != byte:
            return None
        return place ^ self._offset(unit), unit

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest entry that data has at a place."""
        if not self.units:
            return None
        node, found = self._root(), None
        for k in range(at, len(data)):
            step = self._child(node, data[k])
            if step is None:
                break
            node, unit = step
            if unit >> 8 & 1:
                found = k + 1 - at, self.units[node] & (1 << 31) - 1
        if found is None:
            return None
        return found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])]


class Normaliser:
    """The bytes that a model sees, a blank for its mark, and the source byte of each of them."""

    def __init__(self, spec: dict[int, int | bytes]):
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if not spec.get(5, 1):
            raise ValueError("only models that mark blanks are read")
        self.identity = not self.map.units and not self.squeeze

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(data, begins, source) of texts without nulls: text k is data[begins[k]:begins[k + 1]], its byte i comes from source[begins[k] + k + i],
        and the last of its source, beyond its bytes, is where it ends."""
        if self.identity and not pc.any(pc.match_substring(texts, MARK)).as_py():
            return self._unchanged(texts)
        found = [self._mapped(x) for x in texts.cast(pa.large_binary()).to_pylist()]
        begins = np.cumsum([0, *(len(x) for x, _ in found)])
        return np.frombuffer(b"".join(x for x, _ in found), np.uint8), begins, np.concatenate([x for _, x in found] or [np.zeros(0, np.int32)])

    def _unchanged(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        more = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " " * self.prefix).cast(pa.large_string())
        joined = pc.binary_join_element_wise(more, texts, pa.scalar("", pa.large_string()))
        begins = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        raw = joined.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[begins[0] : begins[-1]] if raw is not None else np.zeros(0, np.uint8)
        begins = begins - begins[0]
        sizes = np.diff(begins) + 1
        first = np.cumsum(sizes) - sizes
        source = np.arange(sizes.sum()) - np.repeat(first + (sizes > 1) * self.prefix, sizes)
        return data, begins, np.maximum(source, 0).astype(np.int32)

    def _units(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(from, to, replacement) of each longest prefix; a character without one stands for itself."""
        at, first = 0, self.map.first
        while at < len(data):
            entry = self.map.longest(data, at) if data[at] in first else None
            if entry:
                size, told = entry
            else:
                size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                told = data[at : at + size]
            yield at, at + size, told
            at += size

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, source = bytearray(), []
        begun, blank, end = False, self.squeeze, 0
        for begin, stop, told in self._units(data):
            if not begun:
                if self.squeeze and told == b" ":
                    continue  # blanks before the text
                begun = True
                if self.prefix:
                    out += b" "
                    source.append(begin)
            end = stop
            if blank:
                told = told.lstrip(b" ")
            if told:
                blank = self.squeeze and told.endswith(b" ")
                told = told.replace(MARKED, b" ")  # a mark in a text isn't squeezed, but goes with the blanks at its end
                out += told
                source += [begin] * len(told)
        while self.squeeze and out.endswith(b" "):
            end = source.pop()
            del out[-1]
        return bytes(out), np.array([*source, end], np.int32)


class PieceModel:
    """A BPE model with bytes for unknown characters, from the bytes of its file. Models with user-defined or unused pieces aren't read."""

    def __init__(self, data: bytes):
        pieces, spec, trainer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                pieces.append({1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(_fields(value)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                spec = dict(_fields(value))
        kinds = [p[3] for p in pieces]
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or {UNUSED, USER} & {*kinds}:
            raise ValueError("only BPE models with bytes for unknown characters, and without user-defined or unused pieces, are read")
        self.normalise = Normaliser(spec)
        names = [p[1].decode() for p in pieces]
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.ids = {names[i].replace(MARK, " "): i for i, k in enumerate(kinds) if k == NORMAL}
        self.byte = {int(names[i][3:5], 16): i for i, k in enumerate(kinds) if k == BYTE}
        score = {name: struct.unpack("<f", pieces[i][2])[0] for name, i in self.ids.items()}
        order = {s: r for r, s in enumerate(sorted({*score.values()}, reverse=True))}
        #: Rank of each piece by score; equal scores, equal ranks.
        self.rank = {name: order[s] for name, s in score.items()}
        self._number_pairs()
        surface = trainer.get(44, UNKNOWN.encode())
        shown = [b"" if k == CONTROL else surface if k == UNK else bytes([int(n[3:5], 16)]) if k == BYTE else n.replace(MARK, " ").encode() for n, k in zip(names, kinds, strict=True)]
        #: What decoding gives for each id, and its decimal digits.
        self.shown, self.decimals = pa.array(shown, pa.large_binary()), pa.array([b"%d " % i for i in range(len(names))], pa.large_binary())
        self.marked, self.silent = np.array([n.startswith(MARK) for n in names]), np.array([k == CONTROL for k in kinds])
        # bytes that stand alone in all pieces; and whether a mark is always the first of what isn't a mark
        longer = [n for n in self.rank if len(n) > 1]
        self._alone = np.array([c < 128 and chr(c) != " " and not any(chr(c) in n for n in longer) for c in range(256)])
        self._leading = not any(" " in n.lstrip(" ") for n in longer)
        self.parts = _Memory(self._merge_all)

    def _number_pairs(self) -> None:
        """Numbers of symbols (pieces and their characters), and the pairs that make a piece, by key: rank and number of the union."""
        self.symbols = [*self.ids, *sorted({c for n in self.ids for c in n} - {*self.ids})]
        number = {s: k for k, s in enumerate(self.symbols)}
        pairs = {}
        for name in self.ids:
            for k in range(1, len(name)):
                a, b = number.get(name[:k]), number.get(name[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = self.rank[name], number[name]
        keys = sorted(pairs)
        self._keys = np.array([*keys, 1 << 40], np.int64)
        self._rank, self._union = (np.array([*(pairs[k][j] for k in keys), NEVER], np.int32) for j in (0, 1))
        points = [(ord(s), k) for s, k in number.items() if len(s) == 1]
        self._of_point = np.full(0x110000, -1, np.int32)
        self._of_point[[p for p, _ in points]] = [k for _, k in points]
        self._id = np.array([self.ids.get(s, -1) for s in self.symbols], np.int32)
        self._bytes = np.array([len(s.encode()) for s in self.symbols], np.int32)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the pairs (a, b) in the table; the last place, of rank NEVER, for those that make no piece."""
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self._keys, key)
        at[(at >= len(self._keys)) | (self._keys[np.minimum(at, len(self._keys) - 1)] != key) | (a < 0) | (b < 0)] = len(self._keys) - 1
        return at

    def _side_by_side(self, parts: list[str], width: int) -> list[bytes | None]:
        """_merged() of parts of at most width characters, a row each: in turn the best pair of every row is merged. None where a character has no piece."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        rows = np.repeat(np.arange(len(parts)), lengths)
        ids = np.full((len(parts), width + 1), -1, np.int32)
        ids[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = self._of_point[np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")]
        odd = np.zeros(len(parts), bool)
        odd[rows[self._id[ids[ids >= 0]] < 0] if (ids[:, :width] >= 0).sum() == len(rows) else slice(None)] = True
        place = self._pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(parts), width)
        live, columns = np.arange(len(parts)), np.arange(width + 1)
        sub, at = ids.copy(), place
        while len(live):
            rank = self._rank[at]
            k = rank.argmin(axis=1)  # the leftmost of the best
            on = rank[np.arange(len(live)), k] != NEVER
            ids[live[~on]] = sub[~on]
            live, sub, at, k = live[on], sub[on], at[on], k[on]
            every = np.arange(len(live))
            sub[every, k] = self._union[at[every, k]]
            move = columns + (columns > k[:, None])
            sub = np.take_along_axis(np.pad(sub, ((0, 0), (0, 1)), constant_values=-1), move, 1)
            at = np.take_along_axis(np.pad(at, ((0, 0), (0, 1)), constant_values=len(self._keys) - 1), move[:, :-1], 1)
            both = self._pairs(np.concatenate([sub[every, k], sub[every, k - 1]]), np.concatenate([sub[every, k + 1], sub[every, k]]))
            inner = k < width
            at[every[inner], k[inner]] = both[: len(live)][inner]
            inner = k > 0
            at[every[inner], k[inner] - 1] = both[len(live) :][inner]
        kept = ids >= 0
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        told = np.stack([self._id[ids[kept]], self._bytes[ids[kept]]], 1).astype("<i4").tobytes()
        return [None if x else told[8 * a : 8 * b] for x, a, b in zip(odd.tolist(), [0, *ends[:-1]], ends, strict=True)]

    def _merge(self, part: str) -> list[str]:
        """The pieces of a part: again and again the pair whose union ranks best, of equals the leftmost."""
        symbols, get, n = list(part), self.rank.get, len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, k, 2) for k in range(n - 1) if (rank := get(part[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, size = heapq.heappop(heap)
            right = after[left]
            if not symbols[left] or right >= n or len(symbols[left]) + len(symbols[right]) != size:
                continue  # one of the two has changed since
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = right = after[right]
            for a, b in ((before[left], left), (left, right)):
                if a >= 0 and b < n and (rank := get(joined := symbols[a] + symbols[b])) is not None:
                    heapq.heappush(heap, (rank, a, len(joined)))
            if right < n:
                before[right] = left
        return [s for s in symbols if s]

    def _merged(self, part: str) -> bytes:
        """Of a part: its ids, and how many bytes each stands for (0 of a byte that isn't a character's last), as 32-bit numbers in turn."""
        out = []
        for symbol in self._merge(part):
            raw = symbol.encode()
            i = self.ids.get(symbol)
            if i is not None:
                out += [i, len(raw)]
            else:
                for k, x in enumerate(raw, 1):
                    out += [self.byte[x], len(raw) * (k == len(raw))]
        return np.array(out, "<i4").tobytes()

    def _merge_all(self, parts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(parts)
        by_width: dict[int, list[int]] = {}
        for k, part in enumerate(parts):
            if len(part) <= SIDE_BY_SIDE:
                by_width.setdefault(max(4, 1 << (len(part) - 1).bit_length()), []).append(k)
        for width, chosen in by_width.items():
            for k, told in zip(chosen, self._side_by_side([parts[k] for k in chosen], width), strict=True):
                out[k] = told
        return [self._merged(part) if told is None else told for part, told in zip(parts, out, strict=True)]

    def _cuts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where parts begin: at texts, runs of marks, and around bytes that stand alone."""
        starts = np.zeros(len(data), bool)
        starts[begins[:-1][np.diff(begins) > 0]] = True
        alone = self._alone[data]
        starts |= alone
        starts[1:] |= alone[:-1]
        if self._leading:
            blank = data == 0x20
            starts[1:] |= blank[1:] & ~blank[:-1]
        return np.flatnonzero(starts)

    def encode_all(self, texts: pa.Array, begin: bool = False, end: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ends, ids, from, to) of texts without nulls: the ids of text k are ids[ends[k]:ends[k + 1]], from and to their source bytes. Begin and end ids have empty spans."""
        data, begins, source = self.normalise(texts)
        at = self._cuts(data, begins)
        coded = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)).dictionary_encode()
        table = self.parts.all(coded.dictionary.to_pylist())
        pairs = pa.LargeListArray.from_arrays(pa.array(np.cumsum([0, *map(len, table)]) // 8), pa.array(np.frombuffer(b"".join(table), np.int64)))
        taken = pairs.take(coded.indices.cast(pa.int64()))
        told = np.asarray(taken.flatten()).view("<i4").reshape(-1, 2)
        ends = np.asarray(taken.offsets)[np.searchsorted(at, begins)]
        # the source of each piece's first byte, of texts in turn with one place more each
        stop = np.cumsum(told[:, 1].astype(np.int64))
        text = np.repeat(np.arange(len(texts)), np.diff(ends))
        starts, stops = source[stop - told[:, 1] + text], source[stop + text]
        if not begin and not end:
            return ends, told[:, 0], starts, stops
        last = source[begins[1:] + np.arange(len(texts))]
        ids = told[:, 0]
        for wanted, places, symbol, span in ((end, ends[1:], self.end, last), (begin, ends[:-1], self.begin, np.zeros(len(texts), np.int32))):
            if wanted:
                ids, starts, stops = np.insert(ids, places, symbol), np.insert(starts, places, span), np.insert(stops, places, span)
                ends = ends + np.arange(len(ends))
        return ends, ids, starts, stops

    def encode(self, text: str, begin: bool = False, end: bool = False) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and source spans of one text."""
        _, ids, starts, stops = self.encode_all(pa.array([text], pa.large_string()), begin, end)
        return ids.tolist(), list(zip(starts.tolist(), stops.tolist(), strict=True))

    def decode_all(self, ends: np.ndarray, ids: np.ndarray) -> list[str]:
        """The text of each list of ids: the mark that encoding puts before a text is taken off, and bytes that form no character become U+FFFD one by one."""
        first, live = ends[:-1].copy(), np.ones(len(ends) - 1, bool)
        while (live := live & (first < ends[1:])).any() and (quiet := live & self.silent[ids[np.minimum(first, len(ids) - 1)]]).any():
            first[quiet] += 1
            live = quiet
        full = first < ends[1:]
        drops = np.zeros(len(full), bool)
        if self.normalise.prefix or self.normalise.squeeze:
            drops[full] = self.marked[ids[first[full]]]
        out = []
        for drop, data in zip(drops.tolist(), _cut(self.shown, ends, pa.array(ids, pa.int64())), strict=True):
            if drop:
                data = data.lstrip(b" ") if self.normalise.squeeze else data[1:]
            out.append(data.decode("utf-8", "lodestone.bytes"))
        return out

    def decode(self, ids) -> str:
        """The text of ids; those outside the vocabulary are skipped."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.silent))]
        return self.decode_all(np.array([0, len(ids)]), ids)[0]


_loaded: dict[str, PieceModel] = {}


def _model(shared) -> PieceModel:
    key = hashlib.sha256(shared.value).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceModel(shared.value)
    return _loaded[key]


def _share(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def piece_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", spans: str = "spans", begin: bool = False, end: bool = False) -> DataFrame:
    """df with the ids of text, and for each the bytes [begin, end) of the text's UTF-8 that it stands for."""
    shared = _share(df, path)

    def convert(column: pa.Array) -> list[pa.Array]:
        ends, found, starts, stops = _model(shared).encode_all(_texts(column), begin, end)
        places = pa.StructArray.from_arrays([pa.array(starts), pa.array(stops)], ["begin", "end"])
        return [_lists(ends, pa.array(found)), _lists(ends, places)]

    return _with(df, text, [T.StructField(ids, IDS), T.StructField(spans, SPANS)], convert)


def piece_decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of the ids in the column text, which replaces one of that name."""
    shared = _share(df, path)

    def convert(column: pa.Array) -> list[pa.Array]:
        model = _model(shared)
        return [pa.array([model.decode(np.asarray(x.values.fill_null(-1)) if x.is_valid else []) for x in column], pa.string())]

    return _with(df, ids, [T.StructField(text, T.StringType())], convert)


def digests(df: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: the number of ids with an end id, digests of the ids, of the text decoded from them and of the ends of their spans, and whether the spans join without a gap."""
    shared = _share(df, path)

    def convert(column: pa.Array) -> list[pa.Array]:
        model = _model(shared)
        ends, ids, starts, stops = model.encode_all(_texts(column), end=True)
        told = [hashlib.sha256(x[:-1]).hexdigest() for x in _cut(model.decimals, ends, pa.array(ids, pa.int64()))]
        back = [hashlib.sha256(x.encode()).hexdigest() for x in model.decode_all(ends, ids)]
        joined = np.ones(len(ids), bool)
        joined[1:] = starts[1:] == stops[:-1]
        joined[ends[:-1]] = starts[ends[:-1]] == 0
        places = stops.astype("<i4")
        spans = [hashlib.sha256(places[a:b].tobytes()).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return [pa.array(np.diff(ends)), pa.array(told), pa.array(back), pa.array(spans), pa.array(np.logical_and.reduceat(joined, ends[:-1]) if len(ids) else [], pa.bool_())]

    made = [T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256", "spans_sha256")), T.StructField("spans_join", T.BooleanType())]
    slim = df.select(df[id].alias("doc_id"), df[text].alias("text"))
    return _with(slim, "text", made, convert).drop("text")


def op11_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
