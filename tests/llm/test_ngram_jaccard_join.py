from __future__ import annotations

import random
import re
import time
from collections import Counter
from pathlib import Path

import pytest

from tallyhour.llm import ngram_jaccard_join as join
from tallyhour.llm.components import components
from tallyhour.llm.ngram_jaccard_join import ngram_jaccard_join
from tallyhour.session import shared_folder


def brute_force(rows):
    """Sizes and groups by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        sets[doc_id] = set(grams or ([tuple(words)] if words else []))
    parent = {doc_id: doc_id for doc_id in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where: dict = {}
    for doc_id, grams in sets.items():
        for gram in grams:
            where.setdefault(gram, []).append(doc_id)
    for a, grams in sets.items():
        shared = Counter(b for gram in grams for b in where[gram] if b < a)
        for b, n in shared.items():
            if 100 * n >= 75 * (len(grams) + len(sets[b]) - n):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {doc_id: (len(sets[doc_id]), root(doc_id)) for doc_id in sets}


def varied(seed, n=160):
    """Groups of changed copies around texts that share passages, chains of changes, exact copies, short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = words(30)
    texts: list[list[str]] = []
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.3 or not texts:
            texts.append(words(rng.randint(0, 60)))
        elif kind < 0.45:
            own = words(rng.randint(5, 40))
            texts.append(own + passage + words(3))
        else:
            copy = list(rng.choice(texts))
            for _ in range(rng.randint(0, 3)):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy[: rng.randint(max(len(copy) - 4, 0), len(copy))])
    return [(k, rng.choice([" ", "\n", "\t "]).join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(documents, seed):
    rows = varied(seed)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(documents(*rows), sketch=1 << 10).collect()}
    assert found == brute_force(rows)


def crowd(seed, n=400):
    """Copies of one text that is not there itself, each changed elsewhere, so that most lie just outside the threshold."""
    rng = random.Random(seed)
    source = [f"s{k}" for k in range(120)]
    rows = []
    for doc_id in range(n):
        copy = list(source)
        for _ in range(rng.choice([1, 2, 2, 3, 3, 3])):
            copy[rng.randrange(len(copy))] = f"own{doc_id}x{rng.randrange(3)}" if rng.random() < 0.7 else f"some{rng.randrange(9)}"
        start, stop = rng.randint(0, 6), rng.randint(100, 120)
        rows.append((doc_id, " ".join(copy[start:stop])))
    return rows


@pytest.mark.parametrize("seed, crowd_size", [(3, 64), (4, 3)])
def test_a_crowd_around_the_threshold(documents, seed, crowd_size, monkeypatch):
    monkeypatch.setattr(join, "CROWD", crowd_size)
    monkeypatch.setattr(join, "BLOCK", 3000)  # several blocks of askers and members
    rows = crowd(seed)
    expected = brute_force(rows)
    assert 20 < len({component for _, component in expected.values()}) < len(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(documents(*rows)).collect()}
    assert found == expected


@pytest.mark.parametrize("n", [60, 240])
def test_pairs_around_the_threshold_grow_with_the_sets(documents, n, monkeypatch):
    """Below a crowd, too, sets with many possible partners make no rows for all of these."""
    monkeypatch.setattr(join, "CROWD", 10**6)
    made, across = [], join._across
    monkeypatch.setattr(join, "_across", lambda *a: made.append(across(*a)) or made[-1])
    rows = crowd(5, n)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(documents(*rows)).collect()}
    assert found == brute_force(rows)
    assert made[0].count() <= 5 * n


@pytest.mark.parametrize("seed, crowd_size", [(6, 64), (7, 3)])
def test_slices_of_any_number_find_the_same_groups(documents, seed, crowd_size, monkeypatch):
    monkeypatch.setattr(join, "CROWD", crowd_size)
    monkeypatch.setattr(join, "SLICE", 3000)
    monkeypatch.setattr(join, "PART", 500)
    rows = crowd(seed, 120)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(documents(*rows)).collect()}
    assert found == brute_force(rows)


def test_the_disk_is_given_back(spark, documents):
    """No shuffle file outlives the step that made it, and of what is landed only what the result is made of stays."""
    jvm, shared = spark.sparkContext._jvm, Path(shared_folder(spark).removeprefix("file:"))

    def shuffled():
        files = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    before, there = shuffled(), set(shared.glob("tallyhour/*"))
    result = ngram_jaccard_join(documents(*crowd(8, 60)))
    stays = {path.name.rsplit("-", 1)[0] for path in set(shared.glob("tallyhour/*")) - there}
    assert stays == {"llm-summaries", "llm-classes", "llm-linked", "llm-links", "llm-across"}
    deadline = time.time() + 10
    while shuffled() - before and time.time() < deadline:
        time.sleep(0.2)  # files are deleted in the background
    assert not shuffled() - before
    assert result.count() == 60


def test_texts_that_share_an_id_are_told_apart_by_their_sets(documents):
    """A set is cut once into its fragments, whichever rows repeat its id."""
    words = [f"w{k}" for k in range(60)]
    one, two, three = (" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in (10, 11, 40))
    rows = [(5, one), (5, two), (3, two), (5, one), (8, three), (8, three), (9, " ".join(words[:30])), (5, " ".join(words[:30]))]
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(documents(*rows)).collect()}
    assert found == {(5, 56, 3), (3, 56, 3), (8, 56, 8), (9, 26, 5), (5, 26, 5)}


def test_defined_cases(documents):
    text = "One two THREE four five six seven"
    rows = [
        (0, None), (1, ""), (2, " \n"), (3, "a b"), (9, "A\tb"), (4, text), (8, text.lower()), (4, text), (None, text),
        (5, "a b c"), (6, "x " * 30000), (7, "x " * 20000),
    ]
    result = ngram_jaccard_join(documents(*rows)).collect()
    assert len(result) == len(rows)
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in result}
    assert found == {
        (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (9, 1, 3), (4, 3, 4), (8, 3, 4), (None, 3, None), (5, 1, 5), (6, 1, 6), (7, 1, 6),
    }
    assert ngram_jaccard_join(documents("x").limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(0, 40).selectExpr("id as a", "id + 1 as b").union(spark.sql("SELECT 100L, 90L"))
    found = {tuple(r) for r in components(links).collect()}
    assert found == {(k, 0) for k in range(41)} | {(90, 90), (100, 90)}
