from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyhour.llm import pii
from tallyhour.llm.pii import KINDS, Taken, base_spans, calibrated_threshold, luhn, personal_data, proposed_spans, redacted

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def by_hand(text):
    found = []
    for number, kind in enumerate(KINDS):
        found += [(m.start(), number, m.end()) for m in re.finditer(PLAIN[kind], text or "") if passes(kind, m[0])]
    return sorted(found)


def written(edges):
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in edges)


def card(rng, size=16):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(size - 2))
    return next(digits + last for last in "0123456789" if luhn(digits + last))


TEXTS = [
    "write to a.b+c@mail.example.com, or x@y.z@q.rr and @no.where",
    "10.0.0.1 and 300.1.1.1 and 1.2.3.4.5.6.7.8 and 01.002.3.4",
    "4111 1111 1111 1111 but not 4111 1111 1111 1112",
    "4465758382889437 4465758382889437",
    "+1 (830) 555-5433; +49 30 1234567; +12; +1 (((((",
    "é漢😀 a@b.cc 漢",
    "x" * 50000,
    "1" * 6000 + "." + "2" * 6000,
    "1 " * 30000,
    "123 456 " * 20000,
    "x@" + "a" * 100 + ".com and y@dotcom.dot and z @ a dot b",
    "a.b" * 20000 + "@",
    "+1" + " (" * 20000,
    "",
    None,
]


@pytest.mark.parametrize("text", TEXTS[:7])
def test_base_spans_of_texts(text):
    assert base_spans(text)[0] == by_hand(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("a1.@-+ ()%9") + ["@a.b", "1.2.3.4", "+12 345 678 90", "4111111111111111", " at ", "é"]), max_size=30).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert base_spans(text)[0] == by_hand(text)
    assert all(0 <= start < end <= len(text) for start, _, end in proposed_spans(text))


def test_result_of_a_small_table(documents):
    rows = [(n, text) for n, text in enumerate(TEXTS)] + [(3, TEXTS[0]), (None, TEXTS[1])]
    found = personal_data(documents(*rows)).collect()
    assert len(found) == len(rows)
    assert sorted((str(r.doc_id), r.base_spans, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in found) == sorted(
        (str(i), written(by_hand(t)), *[sum(k == n for _, k, _ in by_hand(t)) for n in range(4)]) for i, t in rows
    )
    # too few spans to show any precision: nothing is added
    assert all(r.spans == r.base_spans for r in found)
    assert personal_data(documents((1, "x")).limit(0)).count() == 0
    assert [r.spans for r in personal_data(documents((1, "nothing here"))).collect()] == [""]


def test_trees_add_forms_the_patterns_miss_and_no_others(documents):
    rng = random.Random(8)
    words = "the of and over under while old new house river token item order".split()

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    rows, added, clean = [], {}, []
    for n in range(400):
        one, two = prose(8), prose(5)
        rows.append((n, f"{one} user.{n}@mail{n % 9}.example.com {two} {rng.randrange(1, 250)}.{rng.randrange(256)}.0.{n % 256} {one}"))
        rows.append((1000 + n, f"{two} {card(rng)} {one} +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} {two}"))
        rows.append((2000 + n, f"{one} {rng.randrange(10**15, 10**16)} {two} 999.{n}.1.2 {one}"))
    for n in range(25):
        forms = {
            0: f"user.{n} (at) mail.example.com",
            1: f"10[.]{n}[.]0[.]9",
            2: f"{card(rng)}/{card(rng)}".replace("/", " "),
            3: f"(830) 555-{1000 + n}",
        }
        for kind, form in forms.items():
            doc_id = 5000 + 10 * n + kind
            rows.append((doc_id, f"{prose(6)} {form} {prose(6)}"))
            added[doc_id] = (kind, form)
    for n in range(100):
        doc_id = 9000 + n
        clean.append(doc_id)
        rows.append((doc_id, f"{prose(4)} look at home {prose(3)} 2024-01-{n % 28 + 1:02d} 12:30:{n % 60:02d} v1.2.3 {n}.5 {prose(4)} {10**9 + n}"))
    found = {r.doc_id: r for r in personal_data(documents(*rows)).collect()}
    texts = dict(rows)
    for doc_id, text in rows:
        base = written(by_hand(text))
        assert found[doc_id].base_spans == base
        assert set(filter(None, base.split(","))) <= set(found[doc_id].spans.split(","))
    caught = {kind: 0 for kind in range(4)}
    for doc_id, (kind, form) in added.items():
        marks = found[doc_id].spans
        left = redacted(texts[doc_id], marks)
        caught[kind] += KINDS[kind] in marks and form.split()[0] not in left
    assert all(n >= 20 for n in caught.values()), caught
    assert [found[doc_id].spans for doc_id in clean] == [""] * len(clean)


def test_threshold_needs_proof():
    scores, labels = np.linspace(1, 0, 200), np.r_[np.ones(100), np.zeros(100)]
    assert calibrated_threshold(scores, labels, 0.98) == scores[99]
    assert calibrated_threshold(scores[:30], labels[:30], 0.98) is None
    assert calibrated_threshold(scores, 1 - labels, 0.98) is None
    assert calibrated_threshold(np.zeros(0), np.zeros(0), 0.98) is None
    assert calibrated_threshold(np.full(400, 0.5), np.r_[np.ones(399), 0], 0.98) == 0.5


def test_all_labelled_spans_grow_the_trees_and_set_the_thresholds(documents, monkeypatch):
    """Every span counts, however many a kind has: 6,000 emails, all of them used."""
    seen, fit, judge = [], pii.GBTClassifier.fit, pii.calibrated_threshold

    def fitted(self, rows):
        seen.append({(r.kind, r.label): r.n for r in rows.groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()})
        return fit(self, rows)

    judged = []

    def threshold(scores, labels, precision, counts):
        judged.append((int(labels.sum()), int(counts.sum())))
        return judge(scores, labels, precision, counts)

    monkeypatch.setattr(pii.GBTClassifier, "fit", fitted)
    monkeypatch.setattr(pii, "calibrated_threshold", threshold)
    rows = [(n, " ".join(f"see u{n}x{k}@host{k}.example.com now" for k in range(30))) for n in range(200)]
    personal_data(documents(*rows), trees=2).count()
    assert seen[0].keys() == {(0, 0.0), (0, 1.0)} and seen[0][0, 0.0] == seen[0][0, 1.0]
    hits, held_out = judged[0]
    assert hits + seen[0][0, 1.0] == 6000 and held_out + 2 * seen[0][0, 1.0] == 12000


def test_threshold_of_counted_rows():
    scores, labels = np.repeat(np.arange(5.0), 200), np.r_[np.zeros(400), np.ones(600)]
    assert calibrated_threshold(np.arange(5.0), np.array([0, 0, 200, 200, 200]), 0.98, np.full(5, 200)) == 2
    assert calibrated_threshold(scores, labels, 0.98) == 2


def test_stretches_taken():
    taken = Taken([(5, 9), (7, 12)])
    assert not taken.free(11, 13) and taken.free(12, 14) and taken.free(0, 5) and not taken.free(0, 20)
    taken.add(12, 14)
    assert not taken.free(13, 15) and taken.free(14, 15)


def test_redaction():
    assert redacted("mail a@b.cc now 1.2.3.4", "email:5:11,ip:16:23") == "mail [email] now [ip]"
    assert redacted("clean", "") == "clean"
