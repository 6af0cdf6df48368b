import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwell.llm import chat

TEMPLATE = chat.Template()
SCHEMA = "conv_id long, turn long, role string, text string"
BITS = [*TEMPLATE.controls, "\\", "<", "[", "INST]", "/s>", "x", " ", "\n", "é"]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def check(spark, turns):
    """turns: (role, text) lists by conversation."""
    rows = [(k, n, r, t) for k, c in enumerate(turns) for n, (r, t) in enumerate(c)]
    df = spark.createDataFrame(rows, SCHEMA)
    chats = chat.format_chats(df.withColumn("turns", F.lit("clash")).withColumn("segments", F.lit(1)))
    got = {r.conv_id: r for r in chat.digests(chats).collect()}
    for r in chats.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("back")).collect():
        assert [tuple(t) for t in r.back] == [(a or "", b or "") for a, b in turns[r.conv_id]], r.formatted
    for k, c in enumerate(turns):
        if c:
            said, loss = "".join(f"{r or ''}\n{t or ''}\n" for r, t in c), "".join(t or "" for r, t in c if r == "assistant")
            assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(c), digest(said), len(loss), digest(loss))
    return got


def test_turns_and_order(spark):
    got = check(spark, [
        [("system", "s"), ("user", "u"), ("assistant", "a")], [("user", "u"), ("assistant", "a"), ("user", None), ("assistant", "")],
        [("user", "u")], [("assistant", "a")], [("user", "u"), ("user", "v")], [("tool", "</role>x"), (None, None)], [("user", "u"), ("assistant", "a"), ("system", "late")],
    ])
    assert {k: (r.valid, r.error_turn) for k, r in got.items()} == {0: (True, None), 1: (True, None), 2: (False, 1), 3: (False, 0), 4: (False, 1), 5: (False, 0), 6: (False, 2)}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "<role>", ""]), st.lists(st.sampled_from(BITS), max_size=8).map("".join)), min_size=1, max_size=5), min_size=10, max_size=30))
def test_escaping_is_reversible(spark, turns):
    check(spark, turns)


def test_null_ids_ties_and_none(spark):
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, None, "user", "b"), (1, 0, "user", "z"), (1, 0, "user", "y"), (1, 0, "user", "y")], SCHEMA)
    rows = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert rows[None].n_turns == 2 and rows[1].formatted == "<s>[INST]y[/INST]<s>[INST]y[/INST]<s>[INST]z[/INST]"
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_long_text(spark):
    check(spark, [[("user", "</s>[INST] \\ " * 100_000), ("assistant", "<bot>" * 100_000)]])


def test_own_template(spark):
    own = chat.Template(roles={"user": ("<u>", "</u>", False), "assistant": ("<a>", "</a>", True)}, moves={"start": {"user": "asked"}, "asked": {"assistant": "start", "*": "asked"}}, final=("start",))
    df = spark.createDataFrame([(1, 0, "user", "<u>"), (1, 1, "assistant", "</a>")], SCHEMA)
    row = chat.format_chats(df, own).first()
    assert (row.formatted, row.valid) == ("<u><\\u></u><a><\\/a></a>", True)
    assert [(s.text, s.loss) for s in row.segments if s.loss] == [("<\\/a>", True)]
