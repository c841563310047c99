import hashlib
import random
import struct
import unicodedata

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wardline.llm import bpe, token_counts
from wardline.llm.pretokens import Memo

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
TEXTS = st.text(st.sampled_from(" \n\t'abcdehilnorst's ABC019éüñß中文字😀٣\x1c\x85　ßİ.,!?-ǅªµ²¼́<|>"), max_size=60)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(text=TEXTS)
def test_bpe_is_what_the_library_says(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode_bytes(ids) == text.encode()
    assert "".join(bpe.decode_stream(ids, codec.table, chunk=1)) == text


def test_bpe_long_pieces_and_small_tables(codec, library):
    small = bpe.Transducer(codec.ranks, max_states=20)
    for text in ("a" * 3000, " " * 2000, "ab" * 1500, "中" * 400, "-" * 700 + "=" * 300):
        assert codec.encode(text) == library.encode_ordinary(text)
        for piece in codec.split(text):
            assert small.encode_piece(piece.encode()) == library.encode_ordinary(piece)


def test_utf8_machine_splits_nowhere_and_replaces_like_the_codec():
    for data in ("aé中😀".encode(), b"\xff\xc3\xa9\xe4\xb8", b"\xf0\x9f\x98", b"\xed\xa0\x80x", b"\xc3"):
        m = bpe.Utf8Machine()
        out = [m.feed(data[i : i + 1]) for i in range(len(data))] + [m.end()]
        assert "".join(out) == data.decode("utf-8", "replace")
        assert all(c != "�" for c in "".join(out[:-1])) or b"\xff" in data or b"\xed" in data


def test_bpe_documents(spark, library):
    rows = [(1, "Hello the world"), (1, "Hello the world"), (None, "x"), (2, None), (3, ""), (4, "é" * 5000)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id bigint, text string, n_tokens int")
    got = sorted(map(repr, bpe.encode_documents(df, RANKS, P.PATTERN, ids=True).collect()))
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids, t or ""))
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "input_ids", "decoded_text")
    assert got == sorted("Row(" + ", ".join(f"{n}={v!r}" for n, v in zip(names, w, strict=True)) + ")" for w in want)
    assert bpe.encode_documents(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_utf8_machine_on_every_cut_and_on_broken_bytes():
    r = random.Random(5)
    lead = [0x41, 0x7F, 0x80, 0xBF, 0xC1, 0xC2, 0xDF, 0xE0, 0xA0, 0x9F, 0xED, 0xEF, 0xF0, 0x90, 0x8F, 0xF4, 0xF5, 0xFF]
    samples = ["aé中😀b\ud7ffz".encode("utf-8", "surrogatepass"), *(bytes(r.choice(lead) for _ in range(r.randint(0, 9))) for _ in range(1500))]
    for data in samples:
        for cut in range(len(data) + 1):
            m = bpe.Utf8Machine()
            assert m.feed(data[:cut]) + m.feed(data[cut:]) + m.end() == data.decode("utf-8", "replace"), (data, cut)


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(WORDS)


@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_counts_are_what_the_library_says(words, text):
    assert token_counts.counter(WORDS).count(text) == len(words.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=40))
def test_counts_of_any_text(words, text):
    assert token_counts.counter(WORDS).count(text) == len(words.encode(text, add_special_tokens=False).ids)


def test_counts_special_strings_and_long_words(words):
    c = token_counts.counter(WORDS)
    odd = ["<|startoftext|> a<|endoftext|>", "<|startoftext|><|startoftext|>", "<|START", "ΑΣ ΑΣΑ Σ", "ÅÅ Å", "한국어 \u1112\u1161\u11ab", "— “quoted” … 漢字かな", "x" * 5000, "ab" * 4000, "漢字" * 3000, "a\u0301" * 900]
    for text in odd:
        assert c.count(text) == len(words.encode(text, add_special_tokens=False).ids), text[:40]
    assert all(len(words.model.tokenize("".join(c.letters[b] for b in s.encode()))) == 1 for s in c.single)


def test_counts_of_every_code_point(words):
    c = token_counts.counter(WORDS)
    known = [chr(i) for i in range(0x110000) if unicodedata.category(chr(i)) != "Cs"]
    texts = [f"{x} a{x}b\u0301" for x in known if x < "\U0001ffff" and not "\uac00" < x < "\ud7a3"]
    texts += [" ".join(known[at : at + 40]) for at in range(0, len(known), 40)]
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        for text, found in zip(part, words.encode_batch(part, add_special_tokens=False), strict=True):
            assert c.count(text) == len(found.ids), [hex(ord(x)) for x in text]


def test_merges_in_rank_order_and_leftmost():
    ranks = {("a", "a"): 0, ("aa", "a"): 1, ("b", "a"): 2}
    assert token_counts.merged(list("aaaba"), ranks) == ["aaa", "ba"] and token_counts.merged([], ranks) == []


def test_count_documents(spark):
    df = spark.createDataFrame([(1, "the cat", 0), (2, None, 0), (3, "", 0), (None, "a " * 3000, 0)], "doc_id bigint, text string, n_bytes int")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_documents(df, WORDS, 2048).collect()}
    assert got == {1: (7, 2, False), 2: (0, 0, False), 3: (0, 0, False), None: (6000, 3000, True)}
    assert token_counts.count_documents(df.limit(0), WORDS, 1).count() == 0


def test_memo_is_bounded():
    m = Memo(lambda k: k * 2, 10)
    assert [m[i] for i in range(1000)] == [2 * i for i in range(1000)] and len(m) <= 10 and len(m.old) <= 10
