import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellplan.llm import chat

PIECES = st.lists(st.one_of(st.sampled_from([*chat.CONTROL, "\\", "<", "|im_start|>", "[", "/INST]", "\n", "s>", "<\\s>"]), st.text(max_size=4)), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES, PIECES)
def test_reversible(role, text):
    segment = chat.render(role, text)
    assert chat.read_back(segment) == (role, text)
    body = segment.removeprefix(chat.OPEN).removesuffix(chat.CLOSE)
    assert not any(c in body for c in chat.CONTROL)


def test_fold(spark):
    log = [
        (1, 0, 1, "message", "user", "he"), (1, 0, 2, "delta", None, "llo"),
        (1, 1, 3, "message", "assistant", ""), (1, 1, 4, "delta", None, "bad"), (1, 1, 5, "regenerate", None, None), (1, 1, 6, "delta", None, "good "), (1, 1, 7, "delta", None, "one"),
        (1, 0, 8, "edit", None, "hello!"), (1, 2, 9, "message", "user", "gone"), (1, 2, 10, "delete", None, None), (1, 3, 11, "delta", "assistant", "late"),
        (None, None, None, "message", None, None), (2, 0, 0, "message", "assistant", "a"), (2, 0, 0, "message", "assistant", "a"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in log], "conv_id bigint, position bigint, seq bigint, kind string, role string, text string, segment string").repartition(3)
    out = chat.format_chats(df)
    got = sorted(((x.conv_id or 0, x.turn, *chat.read_back(x.segment), x.segment[x.loss_start : x.loss_end] if x.loss_start is not None else None) for x in out.collect()), key=lambda x: x[:2])
    assert got == [(0, 0, "", "", None), (1, 0, "user", "hello!", None), (1, 1, "assistant", "good one", "good one"), (1, 2, "assistant", "late", "late"), (2, 0, "assistant", "a", "a"), (2, 1, "assistant", "a", "a")]
    assert {x.conv_id: x.n_turns for x in chat.digests(out).collect()} == {None: 1, 1: 3, 2: 2}
    with pytest.raises(Exception, match="unknown kind"):
        chat.format_chats(df.withColumn("kind", chat.F.lit("odd"))).collect()
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    want = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(spark.read.parquet(f"{d}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {x.conv_id: x for x in chat.op1_chat_formatting(spark, d).collect()}
    assert got.keys() == want.keys()
    for i, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        x = got[i]
        assert x.n_turns == len(turns) and x.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert x.formatted_chars == sum(len(chat.render(*t)) for t in turns)
