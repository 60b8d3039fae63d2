"""The numbered operators against brute force, and on nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import html
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, main_text, media, mixing, quality, simhash, substring_dedup, url_rules, warc
from lodestone.llm import queries as registered

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (None, "a b c"), (5, "word " * 3000), (6, "Ünïcode  text x 🙂 " * 20), (None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("key", F.lit(7)).withColumn("source", F.lit("s"))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("1 = 0")


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_sql(spark, small, same, name):
    same(registered.queries()[name](spark, small), registered.oracle_sql()[name])


def test_bpe(spark, small, texts):
    tok = tokenizers.Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    got = {r.doc_id: r for r in bpe.op1_bpe(spark, small).collect()}
    assert got.keys() == texts.keys()
    for i, e in zip(texts, tok.encode_batch([t or "" for t in texts.values()], add_special_tokens=False), strict=True):
        assert got[i].n_tokens == len(e.ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tok.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_strange_texts():
    tok = tokenizers.Tokenizer.from_file(PATH)
    vocabulary = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    for t in ["  a", "x<|endoftext|> y", "it's  don't\n\n  z", "　  é" * 5, "a" * 5000, "🙂🙂 b", "\x1c a\x85b", " \t\r\n", "日本語 テスト123abc !!?", "a,b c. d' 's"]:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert vocabulary.encode(t).tolist() == ids
        assert vocabulary.decode(ids) == tok.decode(ids, skip_special_tokens=False)


def test_bpe_odd_rows(odd, empty):
    df = odd.withColumnRenamed("key", "ids")
    out = bpe.bpe_decode(bpe.bpe_encode(df, PATH), PATH).collect()
    assert len(out) == len(ODD) and all(r.decoded == (r.text or "") for r in out)
    assert bpe.bpe_encode(empty, PATH).count() == 0


def _kept(texts, length=13):
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][k : k + length]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def test_substring_dedup(spark, small, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op2_substring_dedup(spark, small).collect()}
    assert got == _kept(texts)


def test_substring_dedup_odd_rows(odd, empty):
    out = substring_dedup.substring_dedup(odd).collect()
    assert len(out) == len(ODD) and {r.text for r in out if r.doc_id is None} == {"a b c", None}
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_chat_order_and_escapes(spark):
    rows = [(1, 0, "user", "</s> \\ [INST] <|im_end|>\n"), (1, 1, "assistant", None), (2, 0, "assistant", "x"), (3, 0, "user", "a"), (3, 1, "user", "b"), (None, 0, None, "n"), (4, 0, "tool\n", "<|im_sep|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    chats = chat.format_chats(df)
    got = {r.conv_id: r for r in chats.select("*", chat.read_back(F.col("formatted")).alias("back")).collect()}
    assert [(t.role, t.text) for t in got[1].back] == [("user", rows[0][3]), ("assistant", "")]
    assert [(t.role, t.text) for t in got[4].back] == [("tool\n", "<|im_sep|>")]
    assert {i: r.valid for i, r in got.items()} == {1: True, 2: False, 3: False, None: False, 4: False}
    assert got[3].valid_turns == 1
    assert all("[INST]" not in r.formatted and "</s>" not in r.formatted for r in got.values())
    assert chat.format_chats(df.filter("1 = 0")).count() == 0


def test_url_parts_and_given_rules(spark):
    rows = [(1, "HTTP://A.Example.COM/en/72?x"), (2, "http://x.org/es/1"), (3, None), (4, "no scheme"), (5, "https://net/de/#a"), (6, "http://a.example.net/de/81"), (7, "http://notcom/en/"), (8, "http://É.COM"), (1, "HTTP://A.Example.COM/en/8")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(0))
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.url_verdicts(df, []).orderBy("page_id", "path").collect()]
    assert got == [
        (1, "a.example.com", "/en/72", "example.com/en/7", "allow"),
        (1, "a.example.com", "/en/8", "com/en/", "block"),
        (2, "x.org", "/es/1", "org/es/", "block"),
        (3, "", "", None, "allow"),
        (4, "", "", None, "allow"),
        (5, "net", "/de/", "net/de/", "block"),
        (6, "a.example.net", "/de/81", "example.net/de/8", "allow"),
        (7, "notcom", "/en/", None, "allow"),
        (8, "É.com", "", None, "allow"),
    ]


@pytest.mark.parametrize(
    "rule, verdict",
    [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")],
)
def test_words_of_given_rules(spark, rule, verdict):
    """Each rule says what the contract says, on its host and below it, also where a shorter rule says otherwise."""
    df = spark.createDataFrame([(1, f"http://{rule}"), (2, f"https://a.B.{rule}1/x?y#z")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in url_rules.url_verdicts(df, []).collect()] == [(rule, verdict)] * 2


def test_mined_url_rules(spark):
    rows = [(f"http://{'casino' if i % 4 == 0 else 'news'}{i % 7}.test/{'win' if i % 4 == 0 else 'post'}/{i}", i % 4 == 0) for i in range(800)]
    mined = url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean"), support=0.02)
    assert mined and all(c >= url_rules.CONFIDENCE for _, c, _ in mined)
    held = spark.createDataFrame([(1, "http://fresh.test/win/x"), (2, "http://fresh.test/post/x")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_rules.url_verdicts(held, mined).collect()} == {1: "block", 2: "allow"}
    assert url_rules.mine(spark.createDataFrame([], "url string, bad boolean")) == []


def _statistics(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    counts = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if counts[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, small, texts):
    got = {r.doc_id: r for r in quality.op5_quality(spark, small).collect()}
    for i, t in texts.items():
        r = got[i]
        want = _statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)


def test_quality_learns_and_holds_out(spark, small):
    large = small.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{large}/documents.parquet"), spark.read.parquet(f"{large}/labels.parquet")
    train, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    rules = quality.learn(quality.training_sample(docs, train))
    assert rules
    out = quality.judged(docs, rules).join(held, "doc_id").filter("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in out) / len(out) > 0.95
    assert sum(r.kept for r in out if r.quality == 1) / sum(r.quality == 1 for r in out) > 0.98


def test_quality_odd_rows(spark, odd, empty):
    out = quality.judged(odd, []).collect()
    assert len(out) == len(ODD) and all(r.base_failed for r in out if not r.n_words)
    assert quality.judged(empty, []).count() == 0
    assert quality.learn(quality.training_sample(empty, spark.createDataFrame([], "doc_id long, quality int"))) == []


def _simhash(t):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = WORD.findall(words)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {i: root(i) for i in ids}


def test_simhash(spark, small, texts):
    codes = {i: _simhash(t) for i, t in texts.items()}
    ids = sorted(codes)
    values = np.array([codes[i] for i in ids], np.uint64)
    linked = [(ids[k], ids[m]) for k in range(len(ids)) for m in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 3) if m > k]
    want = _components(ids, linked)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash(spark, small).collect()}
    assert got == {i: (f"{codes[i]:016x}", want[i]) for i in ids}


def test_simhash_links_are_complete(spark, monkeypatch):
    """Chains of near fingerprints, in one large list too."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(1)
    codes = []
    for _ in range(40):
        code = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            codes.append(code)
            for b in rng.integers(0, 63, 3):
                code ^= 1 << int(b)
    codes = sorted(set(codes))
    df = spark.createDataFrame([(c, c) for c in codes], "node long, c0 long")
    found = simhash.components(simhash.links(df, simhash.covering(simhash._width(len(codes))), 3, 5))
    got = {r.node: r.component for r in found.collect()}
    linked = [(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 3]
    want = _components(codes, linked)
    assert {i: got.get(i, i) for i in codes} == want


def test_covering_sets():
    from itertools import combinations

    for width in (1, 2, 3, 5):
        sets = [set(s) for s in simhash.covering(width)]
        assert all(any(s <= set(c) for s in sets) for c in combinations(range(8), 5))


@pytest.mark.parametrize(("similarity", "least"), [(0.8, 0.999), (0.85, 0.9996), (0.9, 0.9999)])
def test_similar_sets_meet(similarity, least):
    """The share of pairs of this similarity that meet under a key and share enough positional bytes."""
    rng = np.random.default_rng(2)
    pairs, met = 3000, 0
    for _ in range(pairs):
        values = rng.integers(0, 1 << 63, 450, dtype=np.int64).view(np.uint64)
        alike = round(450 * similarity)
        a, b = np.concatenate([values[:alike], values[alike::2]]), np.concatenate([values[:alike], values[alike + 1 :: 2]])
        same = simhash.least_bytes(a) == simhash.least_bytes(b)
        met += same.reshape(-1, 4).all(axis=1).any() and same.sum() >= simhash.MATCHES
    assert met / pairs >= least


def test_similar_groups(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    rows, n = [], 0
    for g in range(30):
        base = rng.choice(words, 300).tolist()
        for c in range(4):
            copy = list(base)
            for k in rng.choice(300, c, replace=False):
                copy[k] = f"x{g}_{c}_{k}"
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, "")]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[n + 1] == n
    for i in range(n):
        assert got[i] // 4 == i // 4  # never another text
    assert sum(got[i] == i - i % 4 for i in range(n)) / n > 0.97


@pytest.mark.parametrize("block", [4096, 64])
def test_similar_groups_are_exact(spark, monkeypatch, block):
    """Every pair at 0.8 or just above is linked, and no pair just below, alone or through a third text; large lists and families too."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows, n = [], 0
    for g in range(400):
        total, cut = (108, 12) if g % 2 else (107, 12)  # 96 of 120 shingles alike, or 95 of 119
        base = [f"{g}_{i}" for i in range(total + 4)]
        rows += [(n, " ".join(base)), (n + 1, " ".join([*base[:-cut], *(f"x{g}_{i}" for i in range(cut))]))]
        n += 2
    for c in range(200):  # a line that many texts begin with, and near copies of one text
        rows.append((n + c, " ".join([*(f"line{i}" for i in range(12)), *(f"{c}y{i}" for i in range(40))])))
        rows.append((n + 200 + c, " ".join(f"z{c}" if i == c else f"copy{i}" for i in range(200))))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for g in range(400):
        assert (got[2 * g] == got[2 * g + 1]) == bool(g % 2)
    assert all(got[n + c] == n + c and got[n + 200 + c] == n + 200 for c in range(200))


def test_simhash_odd_rows(odd, empty):
    out = simhash.simhash_groups(odd).collect()
    assert len(out) == len(ODD) and {r.component_id for r in out if r.fingerprint == "0" * 16} == {1}
    assert simhash.simhash_groups(empty).count() == 0


def test_media(spark, small, texts):
    import zlib

    got = {r.doc_id: r for r in media.op7_media(spark, small).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(payload[-32:])
        stored = media.wav(payload)
        assert (got[i].media_bytes, got[i].media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


        assert got[i].feature == _feature(payload)


def _feature(payload):
    n, total = len(payload), sum(payload)
    crossings = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:], strict=False))
    return f"wav/8000/1/8;ms={n * 1000 // 8000};mean={total * 1000 // n};var={(sum(x * x for x in payload) * n - total * total) // (n * n)};zc={crossings}"


def test_media_odd_rows(odd, empty):
    rows, shards = media.pack(odd)
    assert media.with_members(rows, shards).count() == len(ODD)
    assert media.metadata(shards).filter("samples % 576 <> 0").count() == 0
    rows, shards = media.pack(empty)
    assert media.with_members(rows, shards).count() == 0 and shards.count() == 0


def test_media_stores_each_digest_once(spark):
    docs = spark.createDataFrame([(i, f"text {i % 50}") for i in range(400)] + [(900 + i, f"own {i}") for i in range(100)], "doc_id long, text string").repartition(7)
    rows, shards = media.pack(docs)
    members = shards.select(F.inline("index")).select("digest")
    assert members.count() == members.distinct().count() == rows.select("digest").distinct().count() == 150
    bytes_of = {r.shard: bytes(r.tar) for r in shards.collect()}
    for r in rows.join(docs, "doc_id").collect():
        stored = bytes_of[r.shard][r.offset : r.offset + r.length]
        assert hashlib.sha256(stored).digest() == bytes(r.digest) and stored[44 : 44 + len(r.text)].decode() == r.text


def test_media_metadata_reads_headers_alone(odd):
    _, shards = media.pack(odd)
    plan = media.metadata(shards)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: (\S+)", plan)
    assert schemas and all("index" in x and "tar" not in x for x in schemas)


def test_main_text(spark, small):
    got = {r.page_id: r for r in main_text.op8_main_text(spark, small).collect()}
    for page in spark.read.parquet(f"{small}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page.html or "", re.DOTALL)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner[1])).split()) if inner else ""
        assert (got[page.page_id].text, got[page.page_id].n_chars) == (want, len(want))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<p>a<p>b", "a b"),
        ("<body><div class='content has-sidebar'><p>one two</p><p>three</p></div><div class='sidebar-x'>no</div>", "one two three"),
        ("<main><h1>T</h1><p>foo<b>bar</b> x</p><ul><li>q<li>z</ul><div class='comments'><p>c</p></div></main><div id=cookieNotice>n</div>", "T foobar x q z"),
        ("<article><p>a <!-- x > y --> b</p><form>f</form><script>if(a<b){}</script></article>", "a b"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("a < b <c", "a < b <c"),
    ],
)
def test_main_text_of_odd_pages(source, want):
    assert main_text.main_text(source) == want


def _targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in sizes if s not in capped)
        out = {s: most * sizes[s] if s in capped else rest * weight[s] / free for s in sizes}
        over = {s for s in sizes if s not in capped and out[s] > most * sizes[s]}
        if not over:
            return out
        capped |= over


def test_mixing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    sizes, size = defaultdict(int), {}
    for d in docs:
        size[d.doc_id] = len(WORD.findall(d.text or ""))
        sizes[d.source] += size[d.doc_id]
    want = _targets(sizes)
    got = {r.doc_id: r for r in mixing.op9_mixing(spark, small).collect()}
    again = {r.doc_id: r for r in mixing.op9_mixing(spark, small).collect()}
    assert got == again
    taken = defaultdict(int)
    for d in docs:
        r = got[d.doc_id]
        assert (r.size, r.source_size) == (size[d.doc_id], sizes[d.source])
        assert r.target == pytest.approx(want[d.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[d.source] += r.taken
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.02, abs=200)


def test_mixing_odd_rows(odd, empty):
    out = mixing.mix(mixing.sized(odd)).collect()
    assert len(out) == len(ODD) and all(r.taken <= 3 * r.size for r in out)
    whole = mixing.whole_documents(odd)
    assert whole.columns == odd.columns and whole.filter("doc_id = 1").count() == 0
    assert mixing.mix(mixing.sized(empty)).count() == 0


def test_warc(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        first.setdefault(p.html or "", p.page_id)
    got = {r.page_id: r for r in warc.op10_warc(spark, small).collect()}
    assert len(got) == len(pages)
    for p in pages:
        payload, least = (p.html or "").encode(), first[p.html or ""]
        kind, refers = ("response", None) if least == p.page_id else ("revisit", least)
        r = got[p.page_id]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(payload), warc.digest(payload), kind, refers)


def test_broken_archives():
    records = [warc.build(i, "u", "2024-01-01T00:00:00Z", f"page {i}".encode() * 50, warc.digest(f"page {i}".encode() * 50), None) for i in range(20)]
    archive = bytearray(warc.pack(records))
    assert [r for _, r, e in warc.unpack(memoryview(bytes(archive))) if e is None] == records
    assert any(e for _, _, e in warc.unpack(memoryview(bytes(archive[:-5]))))
    with pytest.raises(ValueError):
        warc.parse(records[0][:-1])


def test_main_text_keeps_article_text_with_noisy_names():
    words = " ".join(f"word{i}" for i in range(60))
    page = lambda body: main_text.main_text(f"<html><body>{body}</body></html>")
    kept = "<p>{0}</p><section id='discussion'><h2 id='social-history'>Social history</h2><p>a {0}</p></section><p id='form-of-government'>b {0}</p><div class='related-work'>c {0}</div>".format(words)
    assert page(f"<article>{kept}</article>") == f"{words} Social history a {words} b {words} c {words}"
    links = "".join(f"<a href='/{i}'>more{i}</a> " for i in range(30))
    assert "more" not in page(f"<article><p>{words}</p><div class='related'>{links}</div><div class='ad-box'>buy</div></article>")
    assert page(f"<form action='/page'><div><p>{words}</p></div></form>") == words
    assert page(f"<div><p>{words}</p></div><form>login <input></form>") == words
    deep = "<div>" * 600 + "deep" + "</div>" * 600
    assert page(f"<article><p>{words}</p>{deep}<p>after {words}</p></article><div class='ads'>buy</div>") == f"{words} deep after {words}"
    hidden = "<div>" * 600 + "<div class='ads'>buy</div>" + "</div>" * 600
    assert page(f"<article><p>{words}</p>{hidden}<p>after</p></article>") == f"{words} after"


def test_attributes_of_any_length():
    title = "x > y " * 20_000
    assert main_text.main_text(f'<article><p title="{title}">text</p></article>') == "text"


def test_main_text_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<article>a</article>"), (2, "", "<p>" + "long words " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("c"))
    got = sorted(((r.page_id or 0, r.url or "", r.n_chars) for r in main_text.extract(df).collect()))
    assert got == [(0, "", 1), (1, "u", 0), (1, "u", 0), (2, "", 50_000 * 11 - 1)]
    assert main_text.extract(df.filter("1 = 0")).count() == 0


def _density_by_hand(node, whole):
    """(C, LC, T, LT) of nested lists ["tag", children...] with texts as strings, and what each container's children sum up to."""
    def count(n, linked):
        if isinstance(n, str):
            size = len("".join(n.split()))
            return np.array([size, size if linked else 0, 0, 0])
        inner = sum((count(x, linked or n[0] == "a") for x in n[1:]), np.zeros(4, int))
        return inner + np.array([0, 0, 1, int(n[0] == "a")])

    def density(n):
        c, lc, t, lt = count(n, False)
        t, lt = max(1, t - (0 if isinstance(n, str) else 1)), max(1, lt - (0 if isinstance(n, str) or n[0] != "a" else 1))
        base = np.log(c / max(1, c - lc) * lc + whole * c + np.e)
        return max(0.0, c / t * np.log(max(1.0, c / max(1, lc) * t / lt)) / base) if c else 0.0

    return {tuple(map(str, n)): sum(density(x) for x in n[1:] if not isinstance(x, str)) for n in _inner(node)}


def _inner(node):
    yield node
    for x in node[1:]:
        if not isinstance(x, str):
            yield from _inner(x)


def test_main_subtree_has_the_greatest_density_sum():
    words = [" ".join(f"w{k}{i}" for i in range(30 + 10 * k)) for k in range(4)]
    text = ["div", *(["p", w] for w in words)]
    links = ["div", *(["p", ["a", f"link {i}"]] for i in range(12))]
    tree = ["body", links, text]
    share = sum(len(f"link{i}") for i in range(12))
    whole = share / (share + sum(len(w.replace(" ", "")) for w in words))
    sums = _density_by_hand(tree, whole)
    assert max(sums, key=sums.get) == tuple(map(str, text))
    render = lambda n: n if isinstance(n, str) else f"<{n[0]}>" + "".join(map(render, n[1:])) + f"</{n[0]}>"
    assert main_text.main_text("<html>" + render(tree) + "</html>") == " ".join(words)


def test_mined_rules_equal_brute_force(spark):
    from itertools import combinations
    from math import log

    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        host, path = rng.choice(["alpha", "beta-gamma", "delta"]), "/".join(rng.choice(["p", "q", "r", "s"], 2))
        bad = (host == "beta-gamma" and "p" in path) or (host == "delta" and path == "q/r")
        rows.append((f"http://{host}.test/{path}", bool(bad) != (rng.random() < 0.03)))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    told = df.select(url_rules.tokens(F.col("url")).alias("t"), "bad").collect()
    cover = defaultdict(set)
    for i, r in enumerate(told):
        for t in r.t:
            cover[t].add(i)
    bad = {i for i, r in enumerate(told) if r.bad}
    base, tried = len(bad) / len(told), len({frozenset(x) for x in cover.values()})
    names = {}
    for t in sorted(cover, key=lambda t: (url_rules.KINDS.index(t.split(":")[0]), t)):
        names.setdefault(frozenset(cover[t]), t)
    found = {}
    for k in range(1, 6):
        for c in combinations(sorted(names.values()), k):
            rows_ = set.intersection(*(cover[t] for t in c))
            n, hits = len(rows_), len(rows_ & bad)
            p = hits / n if n else 0
            if p < url_rules.CONFIDENCE or p <= base:
                continue
            surprise = n * (p * log(p / base) + ((1 - p) * log((1 - p) / (1 - base)) if p < 1 else 0))
            if surprise >= log(tried / url_rules.CHANCE):
                found[frozenset(c)] = p
    want = {s: p for s, p in found.items() if not any(o < s and q >= p for o, q in found.items())}
    got = {frozenset(t): c for t, c, _ in url_rules.mine(df)}
    assert got.keys() == want.keys() and len(got) >= 2
    assert all(got[s] == pytest.approx(want[s]) for s in got)


def test_url_labels_and_empty_tables(spark):
    page = lambda n: "<html><body><p>" + " ".join(f"word{k}" for k in range(n)) + "</p></body></html>"
    pages = spark.createDataFrame([(1, "http://a.test/", page(40)), (2, "http://casino-x.test/", page(5)), (3, None, page(40)), (4, "http://b.test/", None)], "page_id long, url string, html string").withColumn("verdict", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (None, 0, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    assert [(r.url, r.bad) for r in url_rules.labelled_urls(pages, labels).collect()] == [("http://a.test/", True)]
    assert sorted((r.url, r.bad) for r in url_rules.content_labelled(pages).collect()) == [("http://a.test/", False), ("http://b.test/", True), ("http://casino-x.test/", True)]
    none = pages.filter("1 = 0")
    assert url_rules.mined_rules(none, labels) == [] and url_rules.url_verdicts(none, []).count() == 0
    assert url_rules.url_verdicts(pages, []).count() == 4


def _web(spark, n, bad_hosts, seed):
    """Pages whose text is poor on some hosts, and now and then elsewhere."""
    rng = np.random.default_rng(seed)
    hosts = ["news.one.test", "blog.two.test", "win-prizes.test", "docs.three.test"]
    rows = []
    for k in range(n):
        host = hosts[rng.integers(4)]
        poor = rng.random() < (0.95 if host in bad_hosts else 0.02)
        words = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 6 if poor else 60))
        rows.append((k, f"http://{host}/{rng.choice(['a', 'b', 'c'])}/{k}", f"<html><body><p>{words}</p></body></html>"))
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_mined_url_rules_hold_out(spark, small):
    """Rules from what pages are worth hold on pages that weren't mined; where hosts don't matter, there are none."""
    none = spark.read.parquet(f"{small}/labels.parquet").filter("1 = 0")
    rules = url_rules.mined_rules(_web(spark, 800, {"win-prizes.test"}, 1), none)
    assert rules and all("win" in " ".join(t) or "prizes" in " ".join(t) for t, *_ in rules)
    held = _web(spark, 600, {"win-prizes.test"}, 2)
    told = url_rules.url_verdicts(held, rules, []).join(held, "page_id").join(url_rules.content_labelled(held), "url").select("verdict", "bad").collect()
    blocked = [r.bad for r in told if r.verdict == "block"]
    assert len(blocked) > 100 and sum(blocked) / len(blocked) > 0.9 and sum(blocked) / sum(r.bad for r in told) > 0.85
    assert url_rules.mined_rules(_web(spark, 800, set(), 3), none) == []


def test_rules_with_many_tokens_in_common(spark):
    """Rules of many tokens are compared without listing their parts."""
    rows = [([f"t{k}" for k in range(n)], 0.9) for n in (1, 12, 25)] + [(["t3", "x"], 0.95), (["x", "y"], 0.9), (["y"], 0.8)]
    got = {tuple(r.tokens) for r in url_rules._implied(spark.createDataFrame(rows, "tokens array<string>, confidence double")).collect()}
    assert {len(t) for t in got} == {12, 25}


def test_warc_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "x"), (2, "a\r\nb", "x"), (3, "u", "é" * 300_000), (4, "u", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("archive", F.lit("c"))
    got = sorted((r.record_id, r.record_type, r.payload_bytes, r.refers_to or "") for r in warc.read_archives(warc.write_archives(df)).collect())
    assert [(i, k, n) for i, k, n, _ in got] == [("<urn:page:1>", "response", 0)] * 2 + [("<urn:page:2>", "response", 1), ("<urn:page:3>", "response", 600_000), ("<urn:page:4>", "revisit", 1), ("<urn:page:none>", "response", 1)]
    assert {f for *_, f in got} == {"", "<urn:page:2>"}
    assert warc.read_archives(warc.write_archives(df.filter("1 = 0"))).count() == 0


def test_chat_ties(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x")]
    got = [chat.format_chats(spark.createDataFrame(r, "conv_id long, turn long, role string, text string")).select("formatted", "valid").collect() for r in (rows, rows[::-1])]
    assert got[0] == got[1] and not got[0][0].valid
