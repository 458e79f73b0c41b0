from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyhour.llm import best_fit_packing as packing
from tallyhour.llm import tokens
from tallyhour.llm.best_fit_packing import best_fit_decreasing, best_fit_packing, lower_bound, runs_of
from tallyhour.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SIGNS = [*"ab  st'''  relvdm \n\t1 2.!?éß", "\r\n", "<|endoftext|>", "漢", "’", "'ll", "'re", "\x85", "\x1c", "\xa0"]


def ids(text: str) -> list[int]:
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SIGNS), max_size=150).map("".join), min_size=1, max_size=8))
def test_tokens_equal_the_library(texts):
    counts, found = tokens.tokenize(pa.array(texts, pa.string()), PATH, True)
    assert [one.tolist() for one in found] == [ids(text) for text in texts]
    assert counts.tolist() == [len(ids(text)) for text in texts]


def test_chunk_maps_compose_to_the_state_after_them():
    rng = np.random.default_rng(1)
    classes = rng.integers(0, 22, 64 * 9).astype(np.uint8)
    following, _ = tokens.transducer()
    composed = tokens.prefix_scan(tokens.chunk_maps(classes.reshape(9, 64)))
    for start in range(11):
        state = start
        for place, kind in enumerate(classes.tolist()):
            state = int(following[kind * 11 + state])
            if place % 64 == 63:
                assert composed[place // 64, start] == state


def test_counts_of_rows(documents):
    long = "word " * 40000
    rows = documents(None, "", "Hello  world's\n", (7, "x"), (7, "x"), (None, "y"), long)
    found = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(rows).collect()}
    assert found == {
        (0, 0, 0, False), (1, 0, 0, False), (2, 15, len(ids("Hello  world's\n")), False),
        (7, 1, 1, False), (None, 1, 1, False), (6, len(long), len(ids(long)), True),
    }
    assert token_counts(rows.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60))
def test_bounds_hold_and_sequences_fit(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets = best_fit_decreasing(lengths, 60)
    used = len(set(bins.tolist()))
    assert lower_bound(lengths, 60) <= used
    for one in set(bins.tolist()):
        inside = sorted((int(o), int(n)) for o, n, b in zip(offsets, lengths, bins) if b == one)
        assert inside[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(inside, inside[1:]))
        assert sum(inside[-1]) <= 60


def test_a_bound_beyond_the_sum_of_lengths():
    # three of more than half: one each, though their sum would fit two
    assert lower_bound(np.array([31, 31, 31]), 60) == 3
    assert lower_bound(np.array([21, 21, 21]), 60) == 2


@pytest.mark.parametrize("partition", [4000, 9])
def test_packing_gives_every_id_back(documents, partition):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta's", "γ", "12"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = [*enumerate(texts), (60, None), (61, ""), (62, "tail " * 300), (5, texts[5]), (None, "no id")]
    found = [r.asDict() for r in best_fit_packing(documents(*rows), capacity=64, partition=partition).collect()]
    want = []
    for doc_id, text in rows:
        whole = [*ids(text or ""), 0]
        first = len(whole) % 64 or 64
        stops = range(first, len(whole) + 1, 64)
        for piece, stop in enumerate(stops):
            start = max(0, stop - 64) if piece else 0
            raw = np.array(whole[start:stop], "<u4").tobytes()
            want.append((str(doc_id), piece, start, stop - start, zlib.crc32(raw)))
    key = lambda r: (str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, found)) == sorted(want)
    sequences: dict[int, list] = {}
    for row in found:
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for pieces in sequences.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
        assert sum(pieces[-1]) <= 64
    assert len(sequences) <= lower_bound(np.array([row["length"] for row in found]), 64) + 2
    assert best_fit_packing(documents("x").limit(0)).count() == 0


def test_open_pieces_are_packed_together_without_one_large_group(spark, documents, monkeypatch):
    """Lengths that leave a gap everywhere: groups stay small, and sequences are as few as in one packing of all."""
    sizes = []
    monkeypatch.setattr(packing, "_round", lambda *args, made=packing._round: (sizes.append(args[0].count() / args[2]), made(*args))[1])
    rng = random.Random(4)
    lengths = [rng.randint(9, 13) for _ in range(3000)]
    rows = spark.createDataFrame([(k, k, 0, 0, n, 0) for k, n in enumerate(lengths)], packing._PIECES)
    monkeypatch.setattr(packing, "pieces", lambda *_: rows)
    packed = packing.best_fit_packing(documents("x"), capacity=30, partition=50).collect()
    assert sorted(r.length for r in packed) == sorted(lengths) and {r.doc_id for r in packed} == set(range(3000))
    sequences: dict[int, list] = {}
    for row in packed:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for inside in sequences.values():
        inside.sort()
        assert inside[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(inside, inside[1:])) and sum(inside[-1]) <= 30
    whole, _ = best_fit_decreasing(np.array(lengths), 30)
    assert len(sequences) <= 1.01 * len(set(whole.tolist()))
    assert {(r.n_sequences, r.least_sequences) for r in packed} == {(len(sequences), lower_bound(np.array(lengths), 30))}
    assert max(sizes) <= 50


def test_pieces_alike_are_packed_two_by_two(documents):
    packed = packing.best_fit_packing(documents(*[(k, "word " * 11) for k in range(160)]), capacity=30, partition=1).collect()
    assert len(packed) == 160 and len({r.sequence_id for r in packed}) == 80
    assert {r.n_sequences for r in packed} == {80} and packed[0].least_sequences <= 80


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=200))
def test_runs_are_best_fit_decreasing(lengths):
    sizes, counts = np.unique(np.array(lengths), return_counts=True)
    runs, made = runs_of(sizes, counts, 60)
    bins, _ = best_fit_decreasing(np.array(lengths), 60)
    assert made == len(set(bins.tolist()))
    places: dict[int, list] = {}
    seen = dict.fromkeys(sizes.tolist(), 0)
    for length, rank, n_bins, each, first, offset in runs.tolist():
        assert rank == seen[length]
        seen[length] += n_bins * each
        for k in range(n_bins * each):
            places.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert seen == dict(zip(sizes.tolist(), counts.tolist()))
    for inside in places.values():
        inside.sort()
        assert inside[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(inside, inside[1:])) and sum(inside[-1]) <= 60
