"""Byte-pair encoding against the tokenizers library."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from compare import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import bpe, queries
from sparkloom.llm.shared import table

PATH = public_tokenizers.path("word_bpe_49k.json")
THEIRS = Tokenizer.from_file(PATH)
with open(PATH, "rb") as f:
    FILE = f.read()
OURS = bpe.Codec.get(FILE)


def want(text):
    ids = THEIRS.encode(text or "", add_special_tokens=False).ids
    return ids, THEIRS.decode(ids, skip_special_tokens=False)


def same(text):
    ids, decoded = want(text)
    got = OURS.encode(text)
    assert got.tolist() == ids and OURS.decode(got).decode() == decoded


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_documents(spark):
    texts = {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}
    rows = queries.op13_bpe(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, decoded = want(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


@pytest.mark.parametrize("alphabet", ["ab", "aab", "etaoin", "aeé", "0a.! ", "!?.,-", "ßʼ'sSdΣσς ", "日本語a", "İıǅ ŉ", "🙂🏽a1 ", "\x1c\x85\xa0 a.", "'re've'LL"])
def test_small_alphabets(alphabet):
    r = random.Random(len(alphabet))
    for n in range(300):
        same("".join(r.choice(alphabet) for _ in range(1 + n % 60)))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


def test_characters():
    """Every character, as a letter, number or sign, in upper or lower case."""
    points = [x for x in range(1, 0x110000) if not 0xD800 <= x <= 0xDFFF]
    texts = ["".join(f"a{chr(x)}{chr(x)}b {chr(x)}!" for x in points[k : k + 400]) for k in range(0, len(points), 400)]
    for t, e in zip(texts, THEIRS.encode_batch(texts, add_special_tokens=False), strict=True):
        assert OURS.encode(t).tolist() == e.ids


def test_special_tokens():
    for text in ("<|endoftext|>", "a<|startoftext|>b<|endoftext|><|endoftext|> c", "<|EndOfText|>", "<|endoftext|", "é<|endoftext|>́"):
        same(text)


def test_pairs_and_prefixes():
    """Every token is its own encoding, so that its pairs can be judged; compatible pairs are those that merging leaves."""
    vocab = json.loads(FILE)["model"]["vocab"]
    assert len(vocab) == 49406 and all(OURS.shorter[i] != i for i in vocab.values())
    r = random.Random(5)
    shown = bpe.shown_bytes()
    inner = [t for t in vocab if not t.endswith("</w>") and t.isascii() and t.isalpha() and t.islower()]
    last = [t for t in vocab if t.endswith("</w>") and t[:-4].isascii() and t[:-4].isalpha() and t[:-4].islower()]
    for _ in range(4000):
        a, b = r.choice(inner), r.choice(last)
        assert all(c in shown for c in a)
        assert OURS.fits(vocab[a], vocab[b]) == (THEIRS.encode(a + b[:-4], add_special_tokens=False).ids == [vocab[a], vocab[b]])


def test_long_words(monkeypatch):
    """Words without an end: linear, and the same tokens; long texts are cut piece by piece."""
    r = random.Random(3)
    for text in ("a" * 100_000, "ab" * 50_000, "".join(r.choice("thesand") for _ in range(50_000)), "!" * 30_000):
        same(text)
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    same("some words, " * 50)
    monkeypatch.setattr(bpe, "BATCH_TOKENS", 7)
    same("some words, " * 50)


def test_remembered(monkeypatch):
    """Tables of words and pairs that overflow change nothing."""
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    r = random.Random(8)
    for _ in range(50):
        same(" ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 12))) for _ in range(20)))


def test_rows(spark):
    """Nulls, empty and long texts, repeated rows, no rows, columns of our own names, ids that aren't there."""
    codec = bpe.load(spark, PATH)
    texts = [None, "", " \n", "Two words", "Two words", "x" * 5000, "é" * 700, "\0 zero"]
    rows = [(k if k else None, t, k, "d", "i") for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string, ids_ string")
    got = bpe.decode(bpe.encode(frame, codec), codec, "ids__").collect()
    assert sorted((r.ids, tuple(r.ids__), r.decoded_) for r in got) == sorted((k, tuple(want(t)[0]), want(t)[1]) for k, t in enumerate(texts))
    assert bpe.decode(bpe.encode(frame.limit(0), codec), codec).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [320, None, -1, 10**6, 49407])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in bpe.decode(odd, codec).collect()} == {1: "", 2: "", 3: THEIRS.decode([320, 49407], skip_special_tokens=False)}


def test_other_vocabularies_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        bpe.load(spark, public_tokenizers.path("byte_bpe_50k.json"))
    d = json.loads(FILE)
    d["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(d))
    with pytest.raises(ValueError):
        bpe.load(spark, str(path))
