import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.llm import chat

PIECE = st.sampled_from(["a", "\\", "#", "###", " </turn>", "</turn>", "\n", " ", "### Assistant:", "<", "n", ": ", "é😀"])
TEXT = st.lists(PIECE, max_size=8).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXT), TEXT), max_size=5))
def test_round_trip(turns):
    text, spans = chat.format_turns(turns)
    assert chat.parse_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "### Assistant: </turn>"), (1, 1, "assistant", "again"), (2, 5, None, None), (3, 0, "user", "x"), (3, 0, "user", "x"), (None, 0, "assistant", "lost")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(70)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, tree string")
    got = {r.conv_id: r for r in chat.digests(chat.format_trees(chat.linear_messages(df))).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv in got:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv].formatted_chars == len(chat.format_turns(turns)[0])
    assert chat.digests(chat.format_trees(chat.linear_messages(df.limit(0)))).count() == 0


def test_best_branch_of_a_tree(spark):
    # 1 -> 2 -> 4 (mean 2), 1 -> 3 -> 5 -> 6 (mean 3), a cycle 8 <-> 9 with 10 below it, a lone root 7
    nodes = [(0, 1, None, 1.0), (0, 2, 1, 2.0), (0, 4, 2, 3.0), (0, 3, 1, 3.0), (0, 5, 3, 4.0), (0, 6, 5, 4.0), (1, 7, 99, None), (2, 8, 9, 1.0), (2, 9, 8, 1.0), (2, 10, 9, 5.0)]
    df = spark.createDataFrame(nodes, "tree bigint, node bigint, parent bigint, score double")
    got = sorted((r.tree, r.depth, r.node) for r in chat.reply_paths(df).collect())
    assert got == [(0, 1, 1), (0, 2, 3), (0, 3, 5), (0, 4, 6), (1, 1, 7)]


def test_repeated_nodes_text_nodes_and_null_nodes(spark):
    rows = [("t", "a", None, 1.0, "user", "hi"), ("t", "b", "a", 2.0, "assistant", "yes"), ("t", "b", "a", 2.0, "assistant", "yes"), ("t", "b", "a", 1.0, "assistant", "yes"),
            ("t", "c", "a", 2.0, "assistant", "no"), ("t", None, "a", 9.0, "assistant", "lost"), (None, "x", None, None, None, None)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "tree string, node string, parent string, score double, role string, text string, depth string")
    got = {r.tree: chat.parse_turns(r.formatted) for r in chat.format_trees(df).collect()}
    assert got == {"t": [("user", "hi"), ("assistant", "yes")], None: [("", "")]}
    assert chat.format_trees(df.limit(0)).count() == 0
