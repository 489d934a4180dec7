import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltline.functions.json_text import _read, _written, read_json, write_json

values = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text()), lambda x: st.one_of(st.lists(x, max_size=4), st.dictionaries(st.text(max_size=5), x, max_size=4)), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(values, st.sampled_from([None, 2]))
def test_round_trip(value, indent):
    text = json.dumps(value, indent=indent)
    assert _read(text) == value == read_json(text) and "".join(_written(value)) == write_json(value)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='[]{}",:0123456789.eE+-truefalsn \\\\/ab', max_size=14))
def test_the_same_texts_are_json(text):
    try:
        wanted = json.loads(text, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError):
        with pytest.raises(ValueError):
            _read(text)
    else:
        assert _read(text) == wanted


def test_any_depth():
    text = "[" * 200_000 + "1" + "]" * 200_000
    value = read_json(text)
    assert write_json(value) == text and read_json(' {"a":' * 100_000 + "{}" + "}" * 100_000)["a"]["a"]
    for bad in ("[" * 200_000, "[" * 200_000 + "NaN" + "]" * 200_000, text + "]"):
        with pytest.raises(ValueError):
            read_json(bad)
