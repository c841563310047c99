"""The registered queries on the smallest tables, against libraries, SQL and plain code."""

import base64
import hashlib
import math
import struct
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import public_tokenizers as P
import pytest

from wardline.llm import queries

from .test_ppm import code_length, trie_of
from .test_simhash import naive_components, naive_fingerprint

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def run(spark, name):
    return queries.queries()[name](spark, str(DATA)).collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, con, name):
    got = queries.queries()[name](spark, str(DATA))
    r = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(x[n] for n in sorted(names)) for x in got.collect()), key=repr) == sorted((tuple(row[names.index(n)] for n in sorted(names)) for row in r.fetchall()), key=repr)


def test_tokens(spark, docs):
    import tiktoken
    from tokenizers import Tokenizer

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in run(spark, "op2_bpe"):
        ids = enc.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in run(spark, "op10_token_counts"):
        n = len(t.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


def test_toxicity_and_scores(spark, docs, con):
    rows = run(spark, "op1_toxicity")
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    words = Counter()
    train = [d.encode().lower().split() for i, d in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    for w in train:
        words.update(w)
    total = sum(words.values()) + len(train)
    low = {i: d.encode().lower() for i, d in docs.items()}
    model = trie_of([low[i] for i in docs if zlib.crc32(str(i).encode()) % 7 != 2])
    base = {w: math.log10((n + 1) / (total + len(words) + 2)) for w, n in words.items()}
    for r in run(spark, "op4_lm_score"):
        own = docs[r.doc_id].encode().lower().split()
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.train_tokens == total
        assert (r.n_tokens, r.n_known) == (len(own) + 1, sum(w in words for w in own) + 1)
        assert r.base_score == pytest.approx(math.fsum(base.get(w, math.log10(1 / (total + len(words) + 2))) for w in own) + math.log10((len(train) + 1) / (total + len(words) + 2)), rel=1e-9)
        if r.doc_id % 3 == 0 or len(own) < 30:
            assert r.score == pytest.approx(code_length(model, low[r.doc_id]), rel=1e-9)


def test_components(spark, docs):
    fps = {i: naive_fingerprint(t) for i, t in docs.items()}
    root = naive_components(sorted(set(fps.values())))
    first = {}
    for i, f in sorted(fps.items()):
        first.setdefault(root[f], i)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in run(spark, "op5_simhash")} == {(i, f"{f:016x}", first[root[f]]) for i, f in fps.items()}


def test_passages(spark, docs, con):
    items = dict(con.execute("SELECT item_id, text FROM benchmark").fetchall())
    exact = {(i, k) for i, t in docs.items() for k, b in items.items() if b in t}
    found = {(r.doc_id, r.item_id) for r in run(spark, "op3_decontaminate")}
    assert exact and exact <= found and len(found - exact) <= 0.2 * len(exact) + 2


def test_conversations(spark, con):
    turns = {}
    for c, role, text in con.execute("SELECT conv_id, role, coalesce(text, '') FROM conversations ORDER BY conv_id, turn").fetchall():
        turns.setdefault(c, []).append((role, text))
    odd = "\\### Assistant: </turn> ok"
    turns[-7] = [("user", odd), ("assistant", odd)]
    got = {r.conv_id: r for r in run(spark, "op7_chat")}
    assert set(got) == set(turns)
    for c, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(own), len(loss)) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest() and got[c].formatted_chars > sum(len(t) for _, t in own)


def test_records(spark, con):
    pages = dict(con.execute("SELECT page_id, coalesce(html, '') FROM pages").fetchall())
    last = {}
    for i, h in pages.items():
        last[h] = max(i, last.get(h, i))
    want = {(i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if last[h] == i else "revisit", None if last[h] == i else last[h]) for i, h in pages.items()}
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in run(spark, "op9_warc")} == want
