"""Templates, escapes and the loss mask."""

from __future__ import annotations

import random

import pytest

from utilscope.llm.chat_format import Escapes, compiled, digests, format_conversations, from_line, read_back, to_line
from utilscope.llm.template import Const, If, Output, Template, TemplateError, fold, parse, FILTERS

PARTS = ["<", "s", ">", "/", "[", "]", "INST", "</s>", "<s>", "[INST]", "[/INST]", "\\", "\n", " ", "é", "😀", "a"]


def test_escapes_are_reversible_and_leave_no_control_string():
    rng, escapes = random.Random(1), Escapes()
    for _ in range(5000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))
        escaped = escapes.escape(text)
        assert escapes.unescape(escaped) == text and from_line(to_line(text)) == text
        assert not any(c in escaped for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_what_is_formatted_is_read_back():
    rng, template, escapes = random.Random(2), compiled(), Escapes()
    for _ in range(2000):
        messages = [
            {"role": rng.choice(["user", "assistant", "system", "", "odd\n</s>\\"]),
             "content": "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))}
            for _ in range(rng.randint(1, 4))
        ]
        text, spans = template.render({"messages": messages})
        assert read_back(text) == [(m["role"], m["content"]) for m in messages]
        loss = [escapes.unescape(text[a:b]) for a, b in spans]
        assert loss == [m["content"] for m in messages if m["role"] == "assistant"]


def test_constants_are_folded_and_dead_branches_go():
    tree = fold(parse("a{{ 1 + 2 * 3 }}{% if 1 > 2 %}x{% elif y %}b{% else %}c{% endif %}{{ 'D' | lower }}"), FILTERS)
    assert tree[0] == Output(Const("a7")) and isinstance(tree[1], If) and len(tree[1].branches) == 1
    assert tree[2] == Output(Const("d"))


def test_loops_choices_and_trimming():
    source = "{% for x in xs -%}  {{ loop.index }}{{ '-' if not loop.last else '.' }} {%- endfor %}{% set y = xs[0] %}{{ y ~ z.k }}"
    assert Template(source).render({"xs": [4, 5], "z": {"k": "v"}})[0] == "1-2.4v"


@pytest.mark.parametrize("source", [
    "{{ a.__class__ }}", "{{ a() }}", "{% if %}x{% endif %}", "{% for x in y %}", "{{ 'a' * 9 }}", "{{ a", "{% do x %}",
    "{{ a | nope }}", "{{ missing }}",
])
def test_the_sandbox_refuses(source):
    with pytest.raises(TemplateError):
        Template(source).render({"a": "text"})


def test_nulls_ties_repeated_rows_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    rows = [(1, 1, "assistant", "b", "x"), (1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (2, None, None, "q", "x"),
            (None, 3, "assistant", "", "x"), (None, 1, "user", "n" * 100_000, "x")]
    df = spark.createDataFrame(rows, schema)
    got = {r["conv_id"]: r for r in format_conversations(df).collect()}
    assert read_back(got[1]["formatted"]) == [("user", ""), ("user", ""), ("assistant", "b")]
    assert read_back(got[2]["formatted"]) == [("", "q")] and got[2]["loss_spans"] == []
    assert read_back(got[None]["formatted"]) == [("user", "n" * 100_000), ("assistant", "")]
    assert format_conversations(df.limit(0)).collect() == [] and digests(format_conversations(df.limit(0))).collect() == []
