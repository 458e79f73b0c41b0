"""Queries of this subpackage over whole tables, and their expected results as SQL."""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from pathlib import Path
from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhour.llm import exact_topk as topk
from tallyhour.llm import fill_in_middle as middle
from tallyhour.llm import mix_sources as mixing
from tallyhour.llm import url_filters as urls
from tallyhour.llm.best_fit_packing import best_fit_packing
from tallyhour.llm.embedding_whitening import embedding_whitening
from tallyhour.llm.html_extraction import html_extraction
from tallyhour.llm.language_id import language_id, page_evidence, train
from tallyhour.llm.lm_scoring import lm_scoring
from tallyhour.llm.ngram_jaccard_join import ngram_jaccard_join
from tallyhour.llm.pii import personal_data
from tallyhour.llm.quality_rules import quality_rules
from tallyhour.llm.tables import table
from tallyhour.llm.token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per session, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_tallyhour_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(mkdtemp(prefix="tallyhour-")) / "tallyhour_code.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for path in sorted(package.rglob("*.py")):
            target.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tallyhour_shipped = True


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filters(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = page_evidence(table(spark, sf_dir, "pages"))
    found = language_id(evidence, train(table(spark, sf_dir, "documents")), as_pages=True)
    return found.drop("row_id").withColumnRenamed("id", "page_id")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction(table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = best_fit_packing(table(spark, sf_dir, "documents"))
    return packed.withColumn("piece", F.col("piece").cast("int"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("row_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings")).drop("query_row")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(middle.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2("base_spans", 256)).drop("row_id", "base_spans")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening(table(spark, sf_dir, "embeddings"))


_QUERIES: list[Query] = [
    op1_url_filters,
    op2_ngram_jaccard_join,
    op3_lm_scoring,
    op4_language_id,
    op5_html_extraction,
    op6_best_fit_packing,
    op7_quality_rules,
    op8_token_counts,
    op9_exact_topk,
    op10_mix_sources,
    op11_fill_in_middle,
    op12_pii,
    op13_embedding_whitening,
]


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {query.__name__: _shipped(query) for query in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": urls.ORACLE_SQL,
        "op9_exact_topk": topk.ORACLE_SQL,
        "op10_mix_sources": mixing.ORACLE_SQL,
        "op11_fill_in_middle": middle.ORACLE_SQL,
    }
