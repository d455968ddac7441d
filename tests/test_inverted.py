from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pytest

from fathom import catalog
from fathom.functions import text

DATA = Path("/root/testdata/sf0.001")
ODD = ["", None, "...", "Straße ΟΔΟΣ İstanbul ﬁ x_y a1b2 ½ Ⅷ १२ 中文 字", "x" * 39 + " " + "y" * 40 + " é" * 3, "é" * 19 + " " + "é" * 20, " lead trail ", "a\nb\tA"]
ALL = ["".join(" " if 0xD800 <= c <= 0xDFFF else chr(c) for c in range(b, b + 256)) for b in range(0, 0x20000, 256)]


def _plain(values):
    places, n = {}, 0
    for k, t in enumerate(values):
        found = text.tokenize(t) if t else []
        n += len(found)
        for i, w in enumerate(found, k * text.ELEMENT_GAP):
            places.setdefault(w, []).append(i)
    return n, places


@pytest.mark.parametrize("size", [4_000_000, 50])
@pytest.mark.parametrize("column", [pa.array(ODD + ALL, pa.string()), pa.array([ODD, [], None, ["a b", None, "b"]] + [[x] for x in ALL], pa.list_(pa.string()))])
def test_documents_are_turned_over_as_in_plain_loops(column, size, monkeypatch):
    monkeypatch.setattr(text, "BATCH_BYTES", size)
    keys, got = pa.array(range(len(column))), {}
    for s in text._slices(column):
        n = s.stop - s.start
        batch = text._inverted(keys.slice(s.start, n), "f", column.slice(s.start, n), "k")
        batch.validate(full=True)
        for r in batch.to_pylist():
            assert r["tfs"] == [len(p) for p in r["positions"]] and r["k"] not in got
            got[r["k"]] = r["dl"], dict(zip(r["terms"], r["positions"]))
    want = {i: _plain(v if isinstance(v, list) else [v]) for i, v in enumerate(column.to_pylist()) if v}
    assert got == {i: x for i, x in want.items() if x[0]}


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_the_registered_index_holds_no_second_copy_of_the_texts(spark):
    index = catalog.index_of(spark, str(DATA))
    assert "text" not in index.docs.columns and {"lang", "source", "n_chars", "quality", "toxic"} <= set(index.docs.columns)
