from __future__ import annotations

import uuid

import pytest
from hypothesis import given
from hypothesis import strategies as st

from fathom.functions.cursor import DOUBLE, INTEGER, RELEVANCE, Cursor, InvalidCursor

U = uuid.UUID("70cd116f-b552-5373-8992-307bfe11f178")


def test_known_text():
    text = "AAAAAABAy6c0cM0Rb7VSU3OJkjB7_hHxeA"
    got = Cursor.decode(text)
    assert got.uuid == U
    assert got.tag == RELEVANCE
    assert got.value == pytest.approx(6.36416, abs=1e-5)
    assert got.encode() == text


@given(st.sampled_from([RELEVANCE, DOUBLE]), st.floats(width=32, allow_nan=False))
def test_round_trip_of_floats(tag, value):
    c = Cursor(tag, value, U)
    assert Cursor.decode(c.encode()) == c
    assert len(c.encode()) == 34


@given(st.integers(0, 2**64 - 1))
def test_round_trip_of_integers(value):
    c = Cursor(INTEGER, value, U)
    assert Cursor.decode(c.encode()) == c


@given(st.text())
def test_anything_else_is_refused_or_read(text):
    try:
        Cursor.decode(text)
    except InvalidCursor:
        pass


@pytest.mark.parametrize("text", ["", "AAAA", "AwAAAABAy6c0cM0Rb7VSU3OJkjB7_hHxeA", "é" * 34])
def test_refused(text):
    with pytest.raises(InvalidCursor):
        Cursor.decode(text)
