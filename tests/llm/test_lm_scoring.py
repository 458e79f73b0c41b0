from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pytest

from tallyhour.llm.lm_scoring import lm_scoring
from tallyhour.llm.tables import table

SF = "/root/testdata/sf0.1"


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2


def context_trees(training, texts, depth):
    """Scores by trees in a dictionary, decision by decision."""
    counts: dict = {}
    stream = lambda text: b"\n" * depth + b" ".join(text.encode().lower().split()) + b"\n"

    def decisions(data):
        for at in range(depth, len(data)):
            node = 1
            for k in range(7, -1, -1):
                bit = (data[at] >> k) & 1
                yield [(node, data[at - d : at]) for d in range(depth + 1)], bit
                node = 2 * node + bit

    for text in training:
        for keys, bit in decisions(stream(text)):
            for key in keys:
                counts.setdefault(key, [0, 0])[bit] += 1
    children: dict = {}
    for node, context in counts:
        if context:
            children.setdefault((node, context[1:]), []).append((node, context))

    def estimate(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    known: dict = {}

    def weighted(key):
        if key not in known:
            own = estimate(*counts[key])
            if len(key[1]) < depth:
                below = sum(map(weighted, children.get(key, [])))
                top = max(own, below)
                own = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
            known[key] = own
        return known[key]

    scores = []
    for text in texts:
        total = 0.0
        for keys, bit in decisions(stream(text)):
            p = 0.5
            for key in reversed(keys):
                if key not in counts:
                    p = 0.5
                    continue
                own = (counts[key][bit] + 0.5) / (sum(counts[key]) + 1)
                if len(key[1]) == depth:
                    p = own
                else:
                    odds = sum(map(weighted, children.get(key, []))) - estimate(*counts[key])
                    share = 1 / (1 + math.exp(min(odds, 700)))
                    p = share * own + (1 - share) * p
            total += math.log10(p)
        scores.append(total)
    return scores


@pytest.mark.parametrize("depth, block_rows", [(2, 10**6), (4, 500)])
def test_scores_equal_trees_built_one_by_one(documents, depth, block_rows):
    texts = ["the cat sat", "The CAT\n sat  on", "", None, "a dog é sat", "the the the", "unseen words here", "zz", "cat", "on the mat"]
    rows = list(enumerate(texts * 2)) + [(3, "the cat"), (None, "cat the")]
    found = {(r.doc_id, r.n_tokens): r for r in lm_scoring(documents(*rows), depth=depth, block_rows=block_rows, tree_rows=40).collect()}
    training = [text or "" for doc_id, text in rows if not held(doc_id)]
    words = lambda text: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())] + [None]
    seen = Counter(w for text in training for w in words(text))
    n, v = sum(seen.values()), len(seen)
    for (doc_id, text), score in zip(rows, context_trees(training, [text or "" for _, text in rows], depth)):
        row = found[doc_id, len(words(text))]
        assert row.score == pytest.approx(score, rel=1e-10)
        assert row.base_score == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words(text)), rel=1e-10)
        assert (row.held_out, row.n_known, row.train_tokens) == (held(doc_id), sum(seen[w] > 0 for w in words(text)), n)


def test_held_out_texts_are_told_better_than_by_words_alone(spark):
    found = lm_scoring(table(spark, SF, "documents")).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert found[0] > found[1], found


def test_empty_tables(documents):
    assert lm_scoring(documents("x").limit(0)).count() == 0
    alone = lm_scoring(documents((None, "only held out"))).collect()
    # nothing learned: every decision is even
    assert alone[0].score == pytest.approx(-8 * 14 * math.log10(2)) and alone[0].train_tokens == 0


@pytest.mark.parametrize("block_rows", [10**6, 20])
def test_code_length_per_byte(documents, block_rows):
    even = {r.doc_id: r for r in lm_scoring(documents((None, "a  B\nc")), block_rows=block_rows).collect()}
    # nothing learned: eight bits for each byte of "a b c" and its end
    assert even[None].n_bytes == 6 and even[None].bits_per_byte == pytest.approx(8)
    texts = ["the cat sat", "", "a dog é sat", None, "the cat sat on the mat"]
    for row in lm_scoring(documents(*enumerate(texts)), block_rows=block_rows).collect():
        assert row.n_bytes == len((texts[row.doc_id] or "").encode()) + 1
        assert row.bits_per_byte == pytest.approx(-row.score / math.log10(2) / row.n_bytes)
