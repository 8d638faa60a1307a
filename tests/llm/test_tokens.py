"""Encoding, packing and splitting: exact against the tokenizer libraries, round trips and invariants."""

import base64
import random

import numpy as np
import pytest

from loomgraph.llm import packing, splitting, tokenize
from loomgraph.llm.bpe import encoder, read_vocabulary, vocabulary_path

TEXTS = [
    "", None, "a", " ", "\n\n\n", "Hello, world! It's 12345 o'clock; we'll see.", "  leading and trailing  ", "tabs\tand\r\nlines\n\n  indented\n", "naïve café öffentlich Straße", "日本語のテキスト、そして句点。次の文！", "Привет, мир — ещё раз", "emoji 👩‍👩‍👧 and \U0001f600\U0001f600", "a b c　d e",
    "<|endoftext|> is text", "x" * 47, "x" * 48, "y" * 3000, "é" * 700, "-" * 500, "\n" * 300 + "z", "ab" * 900, "aaaaaaaaaaaaaaaa", "don't DON'T 's't", "code: for(i=0;i<10;i++){x[i]+=1;}", "漢" * 40, "dregunatu zuloditi kedikeve " * 60, "\x00\x01\x7f", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢 mixed ASCII",
]


@pytest.fixture(scope="module")
def enc():
    return encoder(read_vocabulary(vocabulary_path()))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    words = ["the", "quorum", "dregunatu", "keeps", "a", "pebble", "Straße", "日本", "x1y2", "don't", "riklagofo", "(see", "12.5%)", "—", "naïve"]
    out = list(enumerate(TEXTS))
    for i in range(60):
        out.append((100 + i, "".join(r.choice(words) + r.choice([" ", " ", " ", ", ", ". ", "\n", "\n\n", "。", "  "]) for _ in range(r.randrange(1, 900)))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, k int")


def test_ids(spark, enc, corpus):
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode(frame(spark, corpus)).collect()}
    for k, t in corpus:
        assert got[k] == (None if t is None else enc.fast.encode_ordinary(t)), t[:50]
    back = {r["doc_id"]: r["text"] for r in tokenize.decode(spark.createDataFrame(list(got.items()), "doc_id bigint, ids array<int>")).collect()}
    assert back == dict(corpus)


def test_ids_without_the_cache_of_frequent_words(spark, enc, corpus, monkeypatch):
    monkeypatch.setattr(tokenize, "SAMPLE", 0)
    monkeypatch.setattr(tokenize, "STRETCH", 16)
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode(frame(spark, corpus[:40])).collect()}
    assert all(got[k] == (None if t is None else enc.fast.encode_ordinary(t)) for k, t in corpus[:40])


def test_long_words_in_blocks(spark, enc, monkeypatch):
    """Words above a window: folded in blocks with seams, and whole where a seam fails its test."""
    r = random.Random(3)
    words = ["q" * 5000, "".join(r.choice("abcdefgh") for _ in range(6000)), "".join(r.choice("漢字の仮名交じり文です") for _ in range(700)), "-=" * 900, "ab" * 255 + "c", "ab" * 256 + "c", "é" * 257]
    rows = [(i, "see " + w + " end") for i, w in enumerate(words)]
    got = {x["doc_id"]: x["ids"] for x in tokenize.encode(frame(spark, rows)).collect()}
    assert all(got[k] == enc.encode(t) for k, t in rows)
    monkeypatch.setattr(tokenize, "_blocks", lambda codes: "cast(null as array<int>)")
    got = {x["doc_id"]: x["ids"] for x in tokenize.encode(frame(spark, rows[3:])).collect()}
    assert all(got[k] == enc.encode(t) for k, t in rows[3:])


def test_fold_by_the_ranks_of_parts(spark, enc):
    """One step of the fold for each token in the word: every token by itself comes from its bytes, half characters too; random bytes."""
    r = random.Random(5)
    words = [t for t in enc.ranks if len(t) > 1] + [bytes(r.choice(b" aeinrst\xe3\x81\x82\xff") for _ in range(r.randrange(2, 60))) for _ in range(2000)]
    with tokenize.Constants(spark) as constants:
        constants.add(tokenize._merges(enc.data), tokenize.MERGES_TYPES)
        got = spark.createDataFrame([(w.decode("latin-1"),) for w in words], "b string").selectExpr("b", constants.bound(tokenize._fold("b")) + " AS ids").collect()
    assert len(got) == len(words) and all(x["ids"] == enc.word(x["b"].encode("latin-1")) for x in got)


def test_a_token_without_a_merge_of_its_own_is_refused(spark, tmp_path):
    """abc would come from ab, which ranks after it: then ranks are not in order."""
    tokens = [bytes([i]) for i in range(256)] + [b"abc", b"ab"]
    (tmp_path / "v").write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    with pytest.raises(ValueError):
        tokenize.encode(frame(spark, [(1, "xabc")]), path=str(tmp_path / "v"))


def test_constants_leave_the_session(spark, corpus):
    tokenize.encode(frame(spark, corpus[:5]))
    assert not [r for r in spark.sql("SHOW VIEWS").collect() if r["viewName"].startswith("loomgraph")]


def test_buckets_are_those_of_the_hash(spark):
    words = [t for t in TEXTS if t]
    got = [r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr(f"hash(w) & {tokenize.WORD_BUCKETS - 1} AS h").collect()]
    assert got == [tokenize._word_bucket(w.encode()) for w in words]


def test_no_documents_and_repeated_rows(spark, corpus):
    assert tokenize.encode(frame(spark, [])).count() == 0
    assert tokenize.encode(frame(spark, [(1, "a b"), (1, "a b"), (None, "c")])).count() == 3


def test_own_merges(enc):
    for t in TEXTS:
        if t:
            assert [i for w in enc.words.findall(t) for i in enc.word(w.encode())] == enc.fast.encode_ordinary(t)


LIMITS = [(1, 16), (2, 100), (3, 5000)]


def test_packing(spark, enc, corpus):
    df = packing.token_counts(frame(spark, corpus))
    sizes = {r["doc_id"]: r["n_tokens"] for r in df.collect()}
    assert sizes == {k: None if t is None else len(enc.encode(t)) for k, t in corpus}
    rows = packing.pack(df, LIMITS).collect()
    for limit, capacity in LIMITS:
        mine = [r for r in rows if r["limit_id"] == limit]
        load, parts = {}, {}
        for r in mine:
            parts.setdefault(r["doc_id"], []).append((r["part"], r["first_token"], r["n_tokens"]))
            if r["container_id"] is None:
                assert not sizes[r["doc_id"]]
            else:
                load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
        assert max(load.values()) <= capacity and set(parts) == set(sizes)
        for k, p in parts.items():
            p.sort()
            n = sizes[k] or 0
            assert sum(x[2] for x in p) == n and [x[0] for x in p] == list(range(len(p))) and [x[1] for x in p] == [i * capacity for i in range(len(p))]
            assert len(p) == max(1, -(-n // capacity))  # split only if it exceeds the capacity, and then as little as possible
        least = -(-sum(load.values()) // capacity)
        assert len(load) <= least * 1.15 + 1
    assert packing.pack(df.limit(0), LIMITS).count() == 0


def test_assignment():
    r = np.random.default_rng(1)
    sizes = np.sort(np.minimum(r.lognormal(4, 1.2, 3000).astype(int) + 1, 512))[::-1]
    box = packing.assign(sizes, 512)
    load = np.bincount(box, sizes)
    assert load.max() <= 512 and len(load) <= sizes.sum() / 512 * 1.03 + 1
    assert packing.assign(np.array([], int), 8).tolist() == [] and packing.assign(np.array([8, 8, 1]), 8).tolist() == [0, 1, 2]


@pytest.mark.parametrize(("most", "overlap"), [(16, 0), (16, 5), (64, 16), (300, 40)])
def test_splitting(spark, enc, corpus, most, overlap):
    rows = splitting.split(frame(spark, corpus), [(9, most, overlap)]).collect()
    texts, by = dict(corpus), {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {k for k, t in corpus if t and len(enc.encode(t)) > most}
    for k, pieces in by.items():
        pieces.sort(key=lambda r: r["piece"])
        ids, end = enc.encode(texts[k]), 0
        width = np.cumsum([0] + [len(enc.fast.decode_single_token_bytes(i)) for i in ids])
        raw = texts[k].encode()
        for n, p in enumerate(pieces):
            first, last = p["first_token"], p["first_token"] + p["n_tokens"]
            assert p["piece"] == n and p["n_tokens"] <= most and first == end - p["shared_tokens"]
            assert raw[width[first] : width[last]].decode() == p["text"]
            assert len(enc.encode(p["text"])) <= most
            if n:
                assert overlap - 3 <= p["shared_tokens"] <= overlap
            end = last
        assert end == len(ids)


def test_boundaries(spark):
    text = "One two three. Four five six.\n\nSeven eight nine ten eleven. Twelve"
    pieces = [r["text"] for r in splitting.split(frame(spark, [(1, text)]), [(1, 10, 0)]).orderBy("piece").collect()]
    assert pieces[0] == "One two three. Four five six.\n\n" and "".join(pieces) == text
    with pytest.raises(ValueError):
        splitting.split(frame(spark, []), [(1, 8, 8)])
    assert splitting.split(frame(spark, []), [(1, 8, 2)]).count() == 0
