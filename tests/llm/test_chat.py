import hashlib
import os
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quadrel.llm.chat import BracketTemplate, common_start, format_digests, format_turns, spans
from quadrel.llm.queries import OP3_SQL, op3_chat_format
from tests.oracle import same

TEXT = st.one_of(st.text(max_size=20), st.lists(st.sampled_from(["</s>", "[INST]", "<", "\\", "<<SYS>>", "<s>", "[/ROLE]", "\n", " ", "x"]), max_size=9).map("".join))


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXT), TEXT), max_size=6))
def test_turns_are_read_back(turns):
    template = BracketTemplate()
    found = list(spans(turns, template))
    assert "".join(s.piece for s in found) == template(turns)
    assert [template.read(s.piece) for s in found] == turns
    assert [template.unescape(s.piece[s.text_start : s.text_end]) for s in found] == [t for _, t in turns]
    assert not any(s.rewritten for s in found)


@given(st.text("ab", max_size=30), st.text("ab", max_size=30))
def test_common_start_by_brute_force(a, b):
    assert common_start(a, b) == len(os.path.commonprefix([a, b]))


def test_every_prefix_is_rendered_whole(spark):
    class Watched(BracketTemplate):
        context = 0  # what a template says of itself is not believed

        def __call__(self, turns):
            longest[0] = max(longest[0], len(turns))
            return super().__call__(turns) if len(turns) < 6 else "*" + super().__call__(turns)[1:]

    longest = [0]
    turns = [("user", f"question {i}") if i % 2 == 0 else ("assistant", f"answer {i}") for i in range(10)]
    got = [s.rewritten for s in spans(turns, Watched())]
    assert longest[0] == 10 and got[5] == len(BracketTemplate()(turns[:5])) and not any(got[:5] + got[6:])


def test_long_conversation_takes_little_time():
    turns = [("user" if i % 2 == 0 else "assistant", f"text {i} " * 40) for i in range(1500)]
    template, begin = BracketTemplate(), time.process_time()
    assert [template.read(s.piece) for s in spans(turns, template)] == turns
    assert time.process_time() - begin < 20


@given(TEXT)
def test_escaped_text_has_no_mark(text):
    assert not BracketTemplate.CONTROL.search(BracketTemplate.escape(text))
    assert BracketTemplate.unescape(BracketTemplate.escape(text)) == text


def test_rewriting_template_is_reported():
    def last_only(turns):  # drops earlier turns' texts
        return "".join(f"<{role}>{text if i == len(turns) - 1 else ''}" for i, (role, text) in enumerate(turns))

    assert [s.rewritten > 0 for s in spans([("a", "xy"), ("b", "z")], last_only)] == [False, True]


def test_templates_that_look_far_back(spark):
    def last_five(turns):  # drops what is before the last five turns
        return "".join(f"<{role}>{text}" for role, text in turns[-5:])

    def numbered(turns):
        return "".join(f"{i}<{role}>{text}" for i, (role, text) in enumerate(turns))

    turns = [("user", f"question {i}") if i % 2 == 0 else ("assistant", f"answer {i}") for i in range(9)]
    frame = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    out = format_turns(frame, last_five).orderBy("n").collect()
    assert [r.rewritten > 0 for r in out] == [False] * 5 + [True] * 4
    out = format_turns(frame, numbered).orderBy("n").collect()
    assert "".join(r.piece for r in out) == numbered(turns) and not any(r.rewritten for r in out)
    assert [r.piece[r.loss_start : r.loss_end] for r in out if r.loss_start is not None] == [t for r, t in turns if r == "assistant"]


@pytest.mark.parametrize("size", [8, 200])
def test_rewriting_is_found_at_any_turn(spark, size):
    def strips_answers(turns):  # from the sixth turn on, every answer but the last loses its text
        last = max((i for i, (role, _) in enumerate(turns) if role == "assistant"), default=-1)
        return "".join(f"<{role}>{'' if role == 'assistant' and i < last and len(turns) >= 6 else text}" for i, (role, text) in enumerate(turns))

    def only_late(turns):  # rewrites its first turn once, at the last but one
        return "".join(f"<{role}>{text if i or len(turns) < size - 1 else '*'}" for i, (role, text) in enumerate(turns))

    turns = [("user", f"question {i}") if i % 2 == 0 else ("assistant", f"answer {i}") for i in range(size)]
    frame = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id int, turn long, role string, text string")
    for template in (strips_answers, only_late):
        got = [r.rewritten for r in format_turns(frame, template).orderBy("n").collect()]
        texts = ["", *(template(turns[: n + 1]) for n in range(size))]
        want = [len(a) - next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(texts, texts[1:], strict=False)]
        assert got == want and any(want)


@pytest.mark.parametrize("kind", ["int", "decimal(20,0)", "string", "smallint", "double", "date", "timestamp", "binary"])
def test_keys_of_any_type(spark, kind):
    rows = spark.createDataFrame([("1", 0, "user", "a"), ("1", 1, "assistant", "b"), (None, 0, "assistant", "c")], "k string, turn long, role string, text string")
    value = {"date": "date'2020-02-02'", "timestamp": "timestamp'2020-02-02 01:02:03'"}.get(kind, f"cast(k as {kind})")
    frame = rows.selectExpr(f"CASE WHEN k IS NOT NULL THEN {value} END AS conv_id", "turn", "role", "text")
    digests = format_digests(frame)
    assert digests.schema["conv_id"].dataType == frame.schema["conv_id"].dataType
    assert sorted(r.n_turns for r in digests.collect()) == [1, 2]
    want = {r.conv_id for r in frame.collect()}
    assert {r.conv_id for r in format_turns(frame).collect()} == {r.conv_id for r in digests.collect()} == want


def test_nulls_ties_and_empty(spark):
    rows = [(1, 0, None, None, "c"), (1, 0, "user", "b", "c"), (1, 0, "user", "b", "c"), (1, None, "assistant", "a", "c"), (None, 1, "assistant", "q" * 100_000, "c")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    out = {r.conv_id: r for r in format_digests(frame).collect()}
    order = [("assistant", "a"), ("", ""), ("user", "b"), ("user", "b")]
    assert out[1].n_turns == 4 and out[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in order).encode()).hexdigest()
    assert (out[1].loss_chars, out[None].loss_chars) == (1, 100_000)
    assert out[1].formatted_chars == len(BracketTemplate()(order))
    assert format_digests(frame.limit(0)).collect() == []
    pieces = format_turns(frame).where("conv_id = 1").orderBy("n").collect()
    assert "".join(p.piece for p in pieces) == BracketTemplate()(order)
    assert [p.piece[p.loss_start : p.loss_end] for p in pieces if p.loss_start is not None] == ["a"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    assert same(spark, f"/root/testdata/{sf}", op3_chat_format, OP3_SQL)
