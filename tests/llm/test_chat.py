import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import chat

CODEC = chat.Codec(chat.CHAT)
SCHEMA = "conv_id long, turn long, role string, text string, kind int"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*chat.CHAT.controls, "\\", "n", "a", "<", "[", "/", "\n"])).map("".join))
def test_escape_is_reversible_and_leaves_no_control(text):
    out = CODEC.escape(text)
    assert CODEC.unescape(out) == text
    assert not any(c in out for c in chat.CHAT.controls)
    head = CODEC.segments(text, "")[0][1]
    assert CODEC.role_in(head) == text


def test_states(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "x"), (2, 1, "user", "y"), (3, 0, "assistant", "z"), (4, 0, "user", None), (4, 1, "assistant", ""), (None, None, None, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = {r["conv_id"]: r for r in chat.digest(df).collect()}
    assert {k: (r["valid"], r["refused_at"], r["n_turns"]) for k, r in got.items()} == {1: (True, None, 3), 2: (False, 1, 2), 3: (False, 0, 1), 4: (True, None, 2), None: (False, 0, 1)}
    assert got[1]["loss_chars"] == 1


def test_segments(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "</s>", 0), (1, 0, "user", "hi", 0)], SCHEMA)
    segs = chat.format_segments(df).orderBy("pos", "segment").collect()
    assert "".join(s["text"] for s in segs) == "<|turn|>user\nhi</s>\n<|turn|>assistant\n<\\/s></s>\n"
    assert [s["text"] for s in segs if s["loss"]] == ["<\\/s>"]


def test_ties_and_repeats(spark):
    rows = [(1, 0, "user", "b", 0), (1, 0, "user", "a", 0), (1, 0, "user", "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    a = chat.digest(df).collect()
    assert a == chat.digest(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert a[0]["n_turns"] == 3
    assert chat.digest(df.limit(0)).count() == 0


def test_long_conversation(spark):
    df = spark.range(30_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "'t' AS text")
    r = chat.digest(df).collect()
    assert len(r) == 1 and r[0]["n_turns"] == 30_000 and r[0]["valid"] and r[0]["loss_chars"] == 15_000


def test_one_very_long_text(spark):
    text = "</s>[INST] é \\ " * 150_000
    df = spark.createDataFrame([(1, 0, "user", "hi", 0), (1, 1, "assistant", text, 0)], SCHEMA)
    r = chat.digest(df).first()
    assert r["n_turns"] == 2 and r["loss_chars"] == len(text) and r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\nhi\nassistant\n{text}\n".encode()).hexdigest()
