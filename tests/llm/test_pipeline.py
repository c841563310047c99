import random

import public_tokenizers as P
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from wardline.llm import bpe, decontaminate, simhash  # noqa: E402

from .test_line_dedup import by_hand as lines_left  # noqa: E402
from .test_quality import by_hand as rated  # noqa: E402
from .test_simhash import naive_components, naive_fingerprint  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    common = ["the", "of", "and", "to", "in", "is", "it", "was"]
    sentence = lambda: " ".join(r.choice(common) if r.random() < 0.4 else "".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(14)).capitalize() + "."
    text = lambda: "\n".join(sentence() for _ in range(8))
    passage, item = "\n".join(sentence() for _ in range(4)), " ".join(sentence() for _ in range(3))
    docs = [(i, text(), "en") for i in range(20)]
    docs += [(20, docs[3][1], "en"), (21, docs[3][1] + " end", "en"), (22, text() + "\n" + passage, "en"), (23, text() + "\n" + passage + "\n" + text(), "en")]
    docs += [(24, text() + " " + item + " " + text(), "en"), (25, "too short", "en"), (26, None, "en"), (27, text().upper().replace(" ", "!! "), "en"), (None, text(), "en"), (5, docs[5][1], "en")]
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, t, lang, f"s{k % 3}", len(t or "")) for k, (i, t, lang) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), docs, item


def test_stages_against_brute_force(spark, folder):
    path, docs, item = folder
    out, columns = spark.read.parquet(f"{path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    state = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, path)
        if name == "quality_rules":
            kept = {r[0] for r in rated(state) if r[-1]}
            state = [d for d in state if d[0] in kept]
            assert {25, 26, 27}.isdisjoint(kept) and len(state) > 20
        elif name == "line_dedup":
            state = [(i, t, "en") for i, t, _ in lines_left([(i, t) for i, t, _ in state])]
        elif name == "simhash_near_dedup":
            fps = {i: naive_fingerprint(t) for i, t, _ in state if i is not None}
            root = naive_components(sorted(set(fps.values())))
            first = {}
            for i in sorted(fps):
                first.setdefault(root[fps[i]], i)
            state = list({(i, t): (i, t, lang) for i, t, lang in state if i is None or i in first.values()}.values())
        elif name == "decontamination":
            index = decontaminate.Index([(1, item)])
            state = [d for d in state if not decontaminate.find(d[1] or "", index)]
            assert 24 not in {d[0] for d in state}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            assert sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=repr) == sorted(((i, t, len(t or "")) for i, t, _ in state), key=repr)
    codec = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    got = sorted(((r.doc_id, r.input_ids) for r in out.collect()), key=repr)
    assert got == sorted(((i, codec.encode(t or "")) for i, t, _ in state), key=repr)
    assert sorted(((r.doc_id, r.input_ids) for r in corpus_pipeline.run(spark, path).collect()), key=repr) == got


def test_empty(spark, tmp_path):
    for name, schema in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert simhash.SHARD > 0
