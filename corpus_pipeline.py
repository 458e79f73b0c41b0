"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, judges all that the stage before kept, and returns the
columns of ``docs``; the last returns pieces of sequences. ``run`` writes what each stage returns to the shared
folder, reads it back for the next, and deletes what the stage itself had written there.

Stages name rows by a 64-bit hash of their columns, so rows that repeat an id are told apart; rows that are equal in
all columns share a name and a verdict, and only deduplication makes one of them. Different rows may share a name by
chance, and then a verdict: at 10^9 rows one such pair is to be expected about once in forty runs, at 10^10 two or three in
each. What a stage drops is sent as a list of names to where the texts are, if a count proves it small; else both sides
are shuffled. Null ids, empty tables and columns of any name pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhour.llm.best_fit_packing import best_fit_packing
from tallyhour.llm.language_id import document_evidence, language_id, train
from tallyhour.llm.mix_sources import mix_sources
from tallyhour.llm.ngram_jaccard_join import ngram_jaccard_join
from tallyhour.llm.quality_rules import quality_rules
from tallyhour.llm.registry import ship
from tallyhour.llm.tables import checked, land, passing, small_batches, table

_NAME = "_row_name"
_NAMED_BY = ("doc_id", "text", "lang", "source")
_MIXED = ("copy", "copies", "order_key")


def _free(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until the input has no such column."""
    while name.lower() in (column.lower() for column in docs.columns):
        name += "_"
    return name


def _named(docs: DataFrame) -> DataFrame:
    """The columns that name a row, and its name; none that another column could be mistaken for."""
    return docs.select(*_NAMED_BY).withColumn(_NAME, _name())


def _name():
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in _NAMED_BY])


def _without(docs: DataFrame, names: DataFrame) -> DataFrame:
    """``docs`` but for the rows named."""
    gone = land(names.distinct(), "dropped").withColumnRenamed(names.columns[0], _free(docs, _NAME))
    return _also_named(docs).join(checked(gone), gone.columns[0], "left_anti").select(*_columns(docs))


def _also_named(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, and the name of each row under a free one."""
    return docs.withColumn(_free(docs, _NAME), _name())


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{column}`") for column in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is identified with confidence."""
    ship(spark)
    with small_batches(spark):
        judged = language_id(document_evidence(_named(docs), id_column=_NAME), train(docs))
        return _without(docs, judged.where(~F.col("accepted")).select("id"))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules within a document and are not made of boilerplate lines."""
    ship(spark)
    with small_batches(spark):
        judged = quality_rules(_named(docs), id_column=_NAME)
        return _without(docs, judged.where(~F.col("kept")).select("doc_id"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id."""
    ship(spark)
    named = _named(docs)
    with small_batches(spark), passing(spark):
        joined = ngram_jaccard_join(named, id_column=_NAME)
        groups = land(joined.select(F.col("doc_id").alias(_NAME), F.col("component_id").alias("component")), "groups", stays=True)
    rows = land(groups.groupBy(_NAME, "component").agg(F.count(F.lit(1)).alias("n")), "named")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", _NAME)).alias("least")
    ids = named.select(_NAME, "doc_id").distinct()
    stays = rows.join(ids, _NAME).groupBy("component").agg(least).select(F.col(f"least.{_NAME}").alias(_NAME))
    single = _without(docs, rows.join(stays, _NAME, "left_anti").select(_NAME))
    repeated = land(rows.where("n > 1").join(stays, _NAME, "left_semi").select(_NAME), "repeated")
    if not repeated.limit(1).count():
        return single
    name = _free(docs, _NAME)
    again = checked(repeated.withColumnRenamed(_NAME, name))
    once = _also_named(single).join(again, name, "left_semi").dropDuplicates([name]).select(*_columns(docs))
    return _also_named(single).join(again, name, "left_anti").select(*_columns(docs)).union(once)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for, in random order."""
    ship(spark)
    kept = {column: _free(docs, f"kept_{column}") for column in docs.columns if column.lower() in _MIXED}
    mixed = mix_sources(docs.withColumnsRenamed(kept))
    return mixed.select(*[F.col(f"`{kept.get(column, column)}`").alias(column) for column in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    ship(spark)
    with small_batches(spark):
        return best_fit_packing(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: Packing and near duplicates have no counterpart in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing(spark):
            docs = land(stage(spark, docs, sf_dir), f"stage-{name}", stays=True)
    return STAGES[-1][1](spark, docs, sf_dir)
