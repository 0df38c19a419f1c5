import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cloakwork.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, mask string"


def back(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}


def test_merges_runs_and_reads_turns_back(spark):
    rows = [(1, 2, "assistant", "b", "x"), (1, 0, "user", "q", "x"), (1, 1, "assistant", "a", "x"), (1, 3, "user", "r", "x")]
    got = back(spark, rows)[1]
    assert got.formatted == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_sep|>b<|im_end|>\n<|im_start|>user\nr<|im_end|>\n"
    assert [tuple(t) for t in got.turns] == [("user", "q"), ("assistant", "a"), ("assistant", "b"), ("user", "r")]
    assert got.loss_text == "ab"
    assert sum(m.n_chars for m in got.mask) == len(got.formatted)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (2, 0, "user", "a", "x"), (2, 0, "user", "a", "x"), (2, None, "assistant", None, None)]
    got = back(spark, rows)
    assert [tuple(t) for t in got[None].turns] == [("", "")]
    assert [tuple(t) for t in got[2].turns] == [("assistant", ""), ("user", "a"), ("user", "a")]
    assert back(spark, []) == {}


CONTROL = st.lists(st.sampled_from(["<", "|", "\\", ">", "im_end", "<|im_end|>", "<|im_sep|>", "<|im_nl|>", "\n", "ä", ""]), max_size=8).map("".join)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), CONTROL), CONTROL), min_size=1, max_size=5), min_size=1, max_size=12))
def test_any_control_string_comes_back(spark, conversations):
    rows = [(c, t, role, text, "") for c, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)]
    got = back(spark, rows)
    for c, turns in enumerate(conversations):
        assert [tuple(t) for t in got[c].turns] == turns
        assert got[c].loss_text == "".join(text for role, text in turns if role == "assistant")
        assert got[c].formatted.count("<|im_start|>") == 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))


def test_long_conversation(spark):
    turns = [(7, t, "assistant" if t % 3 else "user", f"text {t} " * 20, "") for t in range(3000)]
    got = back(spark, turns)[7]
    assert len(got.turns) == 3000
    assert got.loss_text == "".join(x[3] for x in turns if x[2] == "assistant")


def test_query_has_the_own_conversation(llm):
    from cloakwork.llm import queries

    got = {r.conv_id: r for r in queries.op1_chat_format(llm, "/root/testdata/sf0.001").collect()}
    text = "<|im_end|><|im_start|>assistant ok"
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(text)
    assert got[-1].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
