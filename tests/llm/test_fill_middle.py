import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assetsweep.llm import fill_middle as M

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXT = st.text(st.sampled_from("ab<PSM> \n\t\x1c\x85é漢🙂"), max_size=60)


def brute(doc_id, text):
    """The contract, word by word."""
    text = text or ""
    units = TOKEN.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10_000), TEXT)
def test_cut_follows_the_contract(doc_id, text):
    assert M.cut(text, str(doc_id)) == brute(doc_id, text)


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1 << 20])
def test_units_do_not_depend_on_the_step(step):
    for text in ("", " ", "a", " a b ", "é 漢字\n\n🙂 x\x0b", "\x1c a\x85b  "):
        got = M.unit_points(np.frombuffer(text.encode(), np.uint8), step)
        assert got.tolist() == [len(x) for x in TOKEN.findall(text)]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 64, 1000, 20_000])
def test_skip_list_reaches_every_rank(n):
    widths = np.random.default_rng(n).integers(1, 9, n)
    lanes = M.SkipList(widths)
    before = np.concatenate([[0], np.cumsum(widths)])
    for rank in range(n + 1) if n <= 1000 else range(0, n + 1, 37):
        assert lanes.reach(rank) == before[rank]
    for down, units, points in lanes.lanes:
        assert units.sum() == n and points.sum() == widths.sum()
    with pytest.raises(IndexError):
        lanes.reach(n + 1)


def test_search_steps_grow_with_the_logarithm():
    lanes = M.SkipList(np.ones(200_000, np.int64))
    assert 4 <= len(lanes.lanes) <= 9
    # The longest walk in any lane between two nodes of the lane above stays short.
    for (_, _, _), (down, _, _) in zip(lanes.lanes, lanes.lanes[1:]):
        assert np.diff(down).max() < 200


ROWS = [(1, "plain words here and more", "x"), (2, "", "x"), (3, None, "x"), (None, "null key with some words", "x"),
        (4, "has <M> inside of it", "x"), (5, " \n\t ", "x"), (6, "w " * 30_000, "x"), (7, "é" * 70_000, "x"),
        (1, "plain words here and more", "x"), (1, "other text under the same key", "x")]
ROWS += [(k, f"row {k} with a few words\nand lines 漢字 🙂", "x") for k in range(10, 60)]


def test_every_row_comes_out_and_is_restored(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, form string")
    out = M.restore(M.transform(docs)).collect()
    want = sorted([(i, *brute(i, t), t or "") for i, t, _ in ROWS], key=str)
    got = sorted([(r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars, r.restored) for r in out], key=str)
    assert got == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_empty_table_and_other_parameters(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert M.report(M.transform(docs)).count() == 0
    docs = spark.createDataFrame([(k, f"a b c {k}") for k in range(20)], "doc_id long, text string")
    forms = {r.form for r in M.transform(docs, fim_percent=100, spm_percent=0).collect()}
    assert forms == {"psm"}
    rows = M.restore(M.transform(docs, fim_percent=100, spm_percent=100, seed=7)).collect()
    assert {r.form for r in rows} == {"spm"} and all(r.restored == f"a b c {r.doc_id}" for r in rows)
