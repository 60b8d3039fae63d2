"""SentencePiece encoding against the library: ids, decoding, source spans, the compiled character map; and odd rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
STRANGE = [
    "", " ", "  a  b ", "ﬁ Ａ①　x", "a\tb\nc", "</s> <s> <unk> <0x41>", "▁a▁", "é é \x00b", "🙂", "    x" * 5, "a" * 5000, " " * 3000 + "b", "日本語テスト" * 300,
    "word, (word) [x] -- 12345 3.14 foo_bar fooBar\r\n" * 20, "▁▁ ▁ x", "� ﻿", "antidisestablishmentarianismantidisestablishmentarianism",
]


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return pieces.PieceModel(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def made(count: int, alphabet: str, most: int = 40) -> list[str]:
    rng = random.Random(7)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(count)]


def test_op11(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r for r in pieces.op11_pieces(spark, small).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text, add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert got[i].spans_join


def test_ids_and_text(model, library):
    texts = STRANGE + made(2000, "ab cde  ▁\n\té日🙂Ａ.,!?12 ")
    ends, ids, _, _ = model.encode_all(pa.array(texts, pa.large_string()), end=True)
    told = model.decode_all(ends, ids)
    for text, a, b, back in zip(texts, ends[:-1], ends[1:], told, strict=True):
        want = library.encode(text, add_eos=True)
        assert ids[a:b].tolist() == want
        assert back == library.decode(want)


def test_spans(model, library):
    for text in STRANGE + made(500, "ab cde  ▁\n\té日🙂Ａ.,!?12 "):
        ids, spans = model.encode(text)
        raw, at = text.encode(), 0
        for i, (begin, end) in zip(ids, spans, strict=True):
            assert begin == at and begin <= end
            at = end
            if i in model.byte.values():
                assert end == begin or raw[begin:end].decode()
            else:
                assert raw[begin:end].replace("▁".encode(), b" ") in (model.shown[i].as_py(), model.shown[i].as_py()[1:])
        assert at == len(raw)
        want = library.encode_as_proto(text)
        assert not hasattr(want, "pieces") or spans == [(p.begin, p.end) for p in want.pieces]


def test_decoding_of_any_ids(model, library):
    rng = random.Random(3)
    for _ in range(1500):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(262) for _ in range(rng.randint(0, 10))]
        assert model.decode(ids) == library.decode(ids)
    assert model.decode([-1, 99999, 287]) == "b"


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
def test_character_map(rule, squeeze, prefix):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    own = pieces.Normaliser(dict(pieces._fields(library.serialized_normalizer_spec())))
    texts = STRANGE + made(400, "aB  \t　é́ﬁ①ＡK㍿ﾞｶ▁日​\xad\xa0")
    data, begins, source = own(pa.array(texts, pa.large_string()))
    for k, text in enumerate(texts):
        shown, offsets = library.normalize(text, with_offsets=True)
        a, b = begins[k], begins[k + 1]
        assert bytes(data[a:b]).decode() == shown.replace("▁", " ")
        # the library counts characters, and three bytes of a mark
        chars = np.cumsum([0, *(len(c.encode()) for c in text)])
        want = [int(chars[offsets[j]]) for j in range(len(shown))]
        lead = [i for i, x in enumerate(bytes(data[a:b])) if x & 0xC0 != 0x80]
        assert [int(source[a + k + i]) for i in lead] == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (None, "a b c"), (5, "word " * 3000), (6, "Ünïcode  text x 🙂 " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    out = pieces.piece_decode(pieces.piece_encode(df, PATH, end=True), PATH).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in out) == sorted((i or 0, t or "") for i, t in rows)
    assert all(len(r.ids) == len(r.spans) and r.n_tokens == 1 for r in out)
    assert {tuple(r.ids) for r in out if r.doc_id in (1, 2)} == {(2,)}
    assert pieces.piece_encode(df.filter("1 = 0"), PATH).count() == 0
    assert {r.n_tokens for r in pieces.digests(df, PATH).filter("doc_id = 4").collect()} == {2}
