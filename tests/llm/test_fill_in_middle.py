from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyhour.llm.fill_in_middle import Sentinels, SkipList, digests, fill_in_middle, restore, unit_widths

TEXTS = [
    "",
    None,
    "a",
    "naïve café – 漢字 😀 é",
    "holds <P> itself",
    "ends in <S>",
    "<M>",
    "<" * 40 + "P>"[:1],
    "x" * 30000 + "é" * 30000,
    "one two  three\nfour " * 40,
]


def by_hand(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_equals_slices_of_the_text(documents):
    rows = [(n, text) for n, text in enumerate(TEXTS * 12)] + [(None, "no id"), (7, "again"), (7, "again")]
    found = fill_in_middle(documents(*rows)).collect()
    assert sorted(((r.doc_id, *r[1:]) for r in found), key=repr) == sorted(((i, *by_hand(i, t)) for i, t in rows), key=repr)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_digests_are_those_of_output_and_text(documents):
    rows = [(n, text) for n, text in enumerate(TEXTS * 12)]
    for r in digests(fill_in_middle(documents(*rows))).collect():
        text = rows[r.doc_id][1] or ""
        assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(by_hand(r.doc_id, text)[4].encode()).hexdigest()


def test_units_of_a_pattern_are_not_cut(documents, spark):
    rows = [(n, f"{n} some words of their own, and more ".strip() * (n + 1)) for n in range(60)]
    pattern = r"\S+\s*"
    found = fill_in_middle(documents(*rows), unit=pattern, rate=100)
    back = {r.doc_id: r for r in found.withColumn("back", restore(F.col("output"), F.col("form"))).collect()}
    for doc_id, text in rows:
        row, units = back[doc_id], re.findall(pattern, text)
        assert row.back == text and row.n == len(units)
        edges = {0, *np.cumsum([len(u) for u in units]).tolist()}
        assert {row.prefix_chars, row.prefix_chars + row.middle_chars} <= edges


def test_empty_table(documents):
    assert fill_in_middle(documents((1, "x")).limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5000), st.integers(2, 16))
def test_every_rank_of_a_list_of_points(n, fan):
    units = SkipList(n, None, fan)
    assert [units.seek(r) for r in range(0, n + 1, max(1, n // 50))] == list(range(0, n + 1, max(1, n // 50)))
    assert units.seek(n) == n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=900), st.integers(2, 16))
def test_every_rank_of_a_list_of_widths(widths, fan):
    units = SkipList(len(widths), np.array(widths), fan)
    assert [units.seek(r) for r in range(len(widths) + 1)] == [0, *np.cumsum(widths).tolist()]


def test_lanes_thin_out_and_keep_their_widths():
    units = SkipList(1_000_000)
    assert [len(lane[0]) for lane in units.lanes] == sorted((len(lane[0]) for lane in units.lanes), reverse=True)
    assert all(lane[0].sum() == lane[1].sum() == 1_000_000 for lane in units.lanes)
    assert len(units.lanes[0][0]) < 1_000_000 / 8


def test_widths_of_matches_and_gaps():
    assert unit_widths("  ab cd", re.compile(r"\w+")).tolist() == [2, 2, 1, 2]


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("", "b", "c"), ("<P", "P>", "x")])
def test_sentinels_that_could_be_mistaken_are_refused(marks):
    with pytest.raises(ValueError):
        Sentinels(*marks)
