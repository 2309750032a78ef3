import hashlib

import numpy as np
import pandas as pd
from hypothesis import given
from hypothesis import strategies as st

from byteplan.llm import chat

TRICKY = "</s>[INST] ok [/INST]"
TURNS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "  hi 😀\n\n"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", "<!s> [!INST] <s> [/INST]"),
    (2, 5, None, "no role"), (2, None, "system", "null turn first"), (2, 5, "assistant", "tie"), (2, 5, "assistant", "tie"),
    (None, 0, "assistant", "no id"), (3, 0, "as[INST]istant", "x"), (4, 0, "user", TRICKY), (4, 1, "assistant", TRICKY), (5, 0, "assistant", "日本語 text " * 3000),
]


def expected():
    df = pd.DataFrame(TURNS, columns=["c", "t", "r", "x"])
    df["c"], df["r"], df["x"] = df.c.fillna(-99).astype(int), df.r.fillna(""), df.x.fillna("")
    df = df.sort_values(["c", "t", "r", "x"], na_position="first")
    out = {}
    for c, g in df.groupby("c"):
        loss = "".join(g[g.r == "assistant"].x)
        out[c] = (len(g), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in zip(g.r, g.x)).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_everything_comes_back(spark):
    rows = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, part int")
    for part_chars in (chat.PART_CHARS, 30):
        formatted = chat.format_conversations(rows, part_chars=part_chars)
        got = {(-99 if r["conv_id"] is None else r["conv_id"]): tuple(r)[1:5] for r in chat.digest_conversations(formatted).collect()}
        assert got == expected()
    for r in formatted.collect():
        assert all(a <= b for a, b in zip(r["starts"], r["ends"])) and len(r["ids"]) == len(r["loss"])
    assert chat.format_conversations(rows.limit(0)).count() == 0


def test_parts_have_the_tokens_of_the_whole(spark):
    rows = spark.createDataFrame(TURNS[:5], "conv_id long, turn long, role string, text string")
    whole = chat.format_conversations(rows).first()
    parts = chat.format_conversations(rows, part_chars=10).orderBy("part").collect()
    assert len(parts) > 2 and sum((p["ids"] for p in parts), []) == whole["ids"] and "".join(p["formatted"] for p in parts) == whole["formatted"]


@given(st.text(st.sampled_from("<>[]/!sINST x"), max_size=40))
def test_escape_is_undone_and_hides_marks(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and not chat._MARKS.search(hidden)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", ""]), st.text(st.sampled_from("<>[]/!sINST x\n😀"), max_size=20)), max_size=5))
def test_rendered_turns_can_be_read(turns):
    text = chat.BOS + "".join(f"{chat.ROLE}{chat.escape(r)}{chat.TEXT}{chat.escape(t)}{chat.EOS}" for r, t in turns)
    assert chat.read_turns(text) == turns


def test_mask_is_the_overlap():
    starts, ends = np.array([0, 2, 2, 5, 7]), np.array([2, 4, 5, 5, 9])
    assert chat.mask_tokens(starts, ends, [(1, 2), (4, 8)]).tolist() == [True, False, True, False, True]
    assert not chat.mask_tokens(starts, ends, []).any()


def test_one_pass_is_the_same_as_two(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    for part_chars in (chat.PART_CHARS, 30):
        one = chat.format_and_digest(rows, part_chars=part_chars)
        two = chat.digest_conversations(chat.format_conversations(rows, part_chars=part_chars))
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.columns == two.columns
    assert chat.format_and_digest(rows.limit(0)).count() == 0
