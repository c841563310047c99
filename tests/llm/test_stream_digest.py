import hashlib

import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql.types import LongType

from wardline.llm import bpe

TEXTS = ["plain words", "", None, "naïve 😀 漢字 " * 3000]


class Docs:
    """Runs the function given to mapInArrow in this process."""

    schema = {"doc_id": type("Field", (), {"dataType": LongType()})}

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return list(run(iter([pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS, pa.string())], ["doc_id", "text"])])))


@pytest.mark.parametrize("ids", [False, True])
def test_query_path_decodes_by_the_machine(monkeypatch, ids):
    fed = []
    feed = bpe.Utf8Machine.feed
    monkeypatch.setattr(bpe.Utf8Machine, "feed", lambda self, chunk: fed.append(len(chunk)) or feed(self, chunk))
    rows = [r for b in bpe.encode_documents(Docs(), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ids=ids) for r in b.to_pylist()]
    assert [r["decoded_sha256"] for r in rows] == [hashlib.sha256((t or "").encode()).hexdigest() for t in TEXTS]
    assert sum(fed) == sum(len((t or "").encode()) for t in TEXTS)
    assert not ids or [r["decoded_text"] for r in rows] == [t or "" for t in TEXTS]


def test_chunks_that_split_code_points():
    table = {k: bytes([k]) for k in range(256)}
    data = "é漢😀x".encode() * 5
    for chunk in range(1, 9):
        assert bpe.digest_stream(list(data), table, chunk) == hashlib.sha256(data).hexdigest()
