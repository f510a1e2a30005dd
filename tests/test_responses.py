"""Mending of damaged JSON: sound texts stay what they are, any damage ends in a list or nothing."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators.responses import _results, tokens_of

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(st.characters(codec="utf-8", exclude_characters='"'), max_size=8), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text("abc ", max_size=4), v, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_sound_json_keeps_its_value(value):
    control = lambda v: "".join(c for c in v if not 127 <= ord(c) <= 159) if isinstance(v, str) else [control(x) for x in v] if isinstance(v, list) else {k: control(x) for k, x in v.items()} if isinstance(v, dict) else v
    assert json.loads(tokens_of(json.dumps(value, ensure_ascii=False))) == control(value)


@settings(max_examples=200, deadline=None)
@given(st.text('{}[]",:\\ ab1\n', max_size=30))
def test_any_damage_ends(text):
    out, _ = _results(text, text)
    assert out is None or isinstance(json.loads(out), list)


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": "b "c", d"}', {"a": 'b "c", d'}),
        ('{"a": "x",}', {"a": "x"}),
        ('[{"a": 1} {"a": 2}]', [{"a": 1}, {"a": 2}]),
        ('{"a": "x\ny\\q", "b": "\\u00e9\\n"}', {"a": "x\ny\\q", "b": "é\n"}),
        ('{"a": "' + "<p>" * 50_000 + '"}', {"a": "<p>" * 50_000}),
    ],
)
def test_damage(text, want):
    assert json.loads(tokens_of(text)) == want


def test_nothing():
    assert _results(None, None) == (None, False)
    assert _results("", "") == (None, False)
    assert _results("[" * 100_000, "[" * 100_000)[0] is None
