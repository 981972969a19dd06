import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from formline.functions import shapes
from formline.functions.strictjson import Limits, Number, Rejected, _Scanner, parse

LIMITS = Limits()


@pytest.mark.parametrize(
    ("data", "reason"),
    [
        (b"", "parse_error"),
        (b'{"a":1} x', "parse_error"),
        (b'{"a":01}', "parse_error"),
        (b'{"a":NaN}', "parse_error"),
        (b'{"a":1.}', "parse_error"),
        (b"[1,]", "parse_error"),
        (b'"\x01"', "parse_error"),
        (b'{"a":1,"a":2}', "duplicate_key"),
        (b'{"a":1,"\\u0061":2}', "duplicate_key"),
        (b'{"a":1,"a":NaN}', "duplicate_key"),
        (b'{"a":NaN,"a":1}', "parse_error"),
        (b'"\\udc00"', "utf8_error"),
        (b'"\\ud800x"', "parse_error"),
        (b'"\xff"', "utf8_error"),
        (b"[" * 33 + b"]" * 33, "depth_exceeded"),
        (b"[" * 33, "depth_exceeded"),
        (b'{"' + b"k" * 257 + b'":1}', "key_length_exceeded"),
        (b'"' + b"x" * 65537 + b'"', "size_exceeded"),
        (b" " * (1 << 20) + b"1", "size_exceeded"),
        (b"{" + b",".join(b'"k%d":1' % i for i in range(1025)) + b"}", "field_count_exceeded"),
    ],
)
def test_rejected(data, reason):
    with pytest.raises(Rejected) as e:
        parse(data)
    assert e.value.reason == reason


def test_tail_of_long_arrays_is_lax_on_keys_alone():
    head = b"[" + b"1," * 4096
    node = parse(head + b'{"a":1,"a":2}]')
    assert node.truncated and len(node) == 4096
    with pytest.raises(Rejected):
        parse(head + b'{"a":}]')


def test_numbers_keep_their_text():
    assert parse(b"[1e400,-0,1.50]") == ["1e400", "-0", "1.50"]
    assert all(isinstance(x, Number) for x in parse(b"[1,2.0]"))


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(values, st.booleans())
def test_both_paths_agree(value, ascii_only):
    data = json.dumps(value, ensure_ascii=ascii_only).encode("utf-8", "surrogatepass")

    def result(f):
        try:
            return shapes.canonical(shapes.shape_of(f()))
        except Rejected as e:
            return e.reason

    assert result(lambda: parse(data)) == result(lambda: _Scanner(data, LIMITS).document())


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40))
def test_any_bytes_parse_or_are_rejected(data):
    try:
        parse(data)
    except Rejected:
        pass


def shape(text):
    return shapes.canonical(shapes.shape_of(parse(text.encode())))


def test_shapes():
    assert shape('{"b":1,"a":"x"}') == shape('{"a":"y","b":2}') == '{"t":"obj","f":{"a":{"t":"str"},"b":{"t":"num"}}}'
    assert shape("1") == shape("1.0") == shape("1e0")
    assert shape("[]") != shape("[1]")
    assert shape('[{"a":1},"x",null,[1],true]') == shape('[true,[2,3],null,"y",{"a":0}]')
    assert shape('[[1],[]]') == '{"t":"arr","e":"nonempty","of":[{"t":"arr","e":"empty","of":[]},{"t":"arr","e":"nonempty","of":[{"t":"num"}]}]}'
    assert shape('{"a\\n\\"":1}') == '{"t":"obj","f":{"a\\u000a\\"":{"t":"num"}}}'
    assert shapes.depth(shapes.shape_of(parse(b'{"a":[{"b":1}]}'))) == 4
    assert [shapes.field_band(n) for n in (0, 1, 2, 3, 4, 5, 9)] == [0, 1, 2, 4, 4, 8, 16]
