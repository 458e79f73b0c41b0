from __future__ import annotations

from collections import Counter
from pathlib import Path

import corpus_pipeline
from test_ngram_jaccard_join import brute_force, crowd
from test_quality_rules import base

import __spark_entry__ as contract
from tallyhour.llm.tables import table
from tallyhour.session import shared_folder

SF = "/root/testdata/sf0.001"


def test_every_number_has_its_query():
    names = contract.queries()
    assert "pipeline" in names
    for number in range(1, 11):
        assert sum(name.startswith(f"op{number}_") for name in names) == 1


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    spoken = stages["language_id"](spark, docs, SF)
    assert spoken.columns == docs.columns
    kept = {r.doc_id for r in spoken.collect()}
    letters = lambda text: sum(c.isalpha() for c in text or "")
    assert {k for k in rows if letters(rows[k]) < 10} == set(rows) - kept

    good = stages["quality_rules"](spark, spoken, SF)
    assert good.columns == docs.columns
    passed = {r.doc_id for r in good.collect()}
    assert passed == {k for k in kept if not base(rows[k])[-1]}

    single = stages["ngram_jaccard_join"](spark, good, SF)
    assert single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == {group for _, group in brute_force([(k, rows[k]) for k in passed]).values()}

    mixed = stages["mix_sources"](spark, single, SF)
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= {r.doc_id for r in single.collect()}

    packed = stages["best_fit_packing"](spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in packed if r.start + r.length > 0 and r.piece == 0) == copies


def test_repeated_rows_nulls_and_empty_tables(spark, documents):
    text = " ".join(f"w{k}" for k in range(80))
    docs = documents((1, text), (1, text), (2, text + " x"), (None, None, None, None), (None, text), (3, ""))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted((str(r.doc_id), len(r.text or "")) for r in kept.collect()) == [("1", len(text)), ("3", 0), ("None", 0)]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        stage(spark, docs, SF).collect()


def test_columns_of_any_name_pass_through(spark, documents):
    text = " ".join(f"w{k}" for k in range(80))
    docs = documents((1, text), (2, text), (3, " ".join(f"v{k} x" for k in range(60)))).selectExpr(
        "doc_id", "text", "lang", "source", "n_chars", "'mine' as _row_name", "7 as copy", "8 as copies", "'k' as order_key"
    )
    for name, stage in corpus_pipeline.STAGES[1:4]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns
        assert {(r._row_name, r["copy"], r.copies, r.order_key) for r in found.collect()} <= {("mine", 7, 8, "k")}, name


def test_near_duplicates_leave_only_names_and_pairs(spark, documents):
    """Sets, prefixes and parts of them are deleted once the groups are landed."""
    shared = Path(shared_folder(spark).removeprefix("file:"))
    landed = lambda: set(shared.glob("tallyhour/*"))
    there = landed()
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(*crowd(9, 40)), SF)
    stays = {path.name.rsplit("-", 1)[0].removeprefix("llm-") for path in landed() - there}
    assert stays <= {"links", "across", "linked", "groups", "named", "dropped", "repeated"}
    assert 0 < kept.count() < 40
