"""Mixing sources to target weights by Poisson replication, in built-in functions only.

Every source gets a mean repetition rate, its target share of all characters over its own. Each document draws
its number of copies by inverting the Poisson distribution with that mean at a number hashed
from its id and the seed, so a run can be repeated and rows can be drawn where they are.
Copies are dealt out over all partitions by another hash and ordered by it there.

A mean above ``_LARGEST_MEAN`` is drawn as a sum of equal Poisson parts, each with a hash of its own.

Defined cases: a null source is a source of its own; a null text counts as empty; a document has its
characters and one more, so a source of empty texts has a size; a null id draws like any other id; rows
that repeat an id draw the same number; an empty table gives no rows; columns of the input pass through,
but ``copy``, ``copies`` and ``order_key`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from tallyhour.llm.tables import checked, land

SEED = "mix-1"
#: Shares of sources follow the power ``TEMPERATURE`` of their sizes: between equal (0) and as they are (1).
TEMPERATURE = 0.5
_LARGEST_MEAN = 500.0
_ADDED = ("copy", "copies", "order_key")


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 from a hash, with 52 bits."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... up to where nothing is left in double precision."""
    last = F.ceil(mean + F.lit(12.0) * F.sqrt(mean) + F.lit(30.0)).cast("int")
    first = F.exp(-mean)
    start = F.struct(F.array(first).alias("cdf"), first.alias("p"), first.alias("total"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        total = state["total"] + p
        return F.struct(F.concat(state["cdf"], F.array(total)).alias("cdf"), p.alias("p"), total.alias("total"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["cdf"])


def source_rates(
    documents: DataFrame,
    weights: DataFrame | None = None,
    temperature: float = TEMPERATURE,
    source_column: str = "source",
    text_column: str = "text",
    size_factor: float = 1.0,
) -> DataFrame:
    """``source_key, rate`` of each source. ``weights`` holds ``source, weight``; sources it lacks get no copies.

    ``size_factor`` is the size of the mixture over that of the input.
    """
    size = F.length(F.coalesce(documents[f"`{text_column}`"], F.lit(""))) + F.lit(1)
    sizes = documents.groupBy(source_key(documents[f"`{source_column}`"]).alias("source_key")).agg(
        F.sum(size).cast("double").alias("size")
    )
    sizes = land(sizes, "sizes")  # a row for each source, worked out in one pass
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("size", F.lit(temperature)))
    else:
        named = weights.select(source_key(F.col("source")).alias("source_key"), F.col("weight").cast("double"))
        weighed = sizes.join(named, "source_key", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    totals = weighed.agg(F.sum("size").alias("all_sizes"), F.sum("weight").alias("all_weights")).first()
    if not totals["all_weights"]:
        return weighed.select("source_key", F.lit(0.0).alias("rate"))
    share = F.col("weight") / F.lit(totals["all_weights"])
    return weighed.select("source_key", (share * F.lit(totals["all_sizes"] * size_factor) / F.col("size")).alias("rate"))


def source_key(source: Column) -> Column:
    """Sources as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def mix_sources(
    documents: DataFrame,
    weights: DataFrame | None = None,
    temperature: float = TEMPERATURE,
    seed: str = SEED,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    size_factor: float = 1.0,
) -> DataFrame:
    """The rows of ``documents``, each as often as drawn, with ``copy`` (from 1), ``copies`` and ``order_key``."""
    rates = source_rates(documents, weights, temperature, source_column, text_column, size_factor)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(_LARGEST_MEAN)).cast("int"))
    drawing = rates.withColumn("parts", parts).select(
        "source_key", "parts", poisson_cdf(F.col("rate") / F.col("parts")).alias("cdf")
    )
    row = F.struct(*[documents[f"`{name}`"] for name in documents.columns if name not in _ADDED]).alias("row")
    doc = F.coalesce(documents[f"`{id_column}`"].cast("string"), F.lit("null"))
    keyed = documents.select(row, doc.alias("doc"), source_key(documents[f"`{source_column}`"]).alias("source_key"))

    def draw(so_far: Column, part: Column) -> Column:
        u = uniform(F.lit(seed), F.col("doc"), part.cast("string"))
        return so_far + F.size(F.filter("cdf", lambda below: below < u))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), draw)
    widest = 8 * int(_LARGEST_MEAN + 12 * _LARGEST_MEAN**0.5 + 32) + 400
    drawn = keyed.join(checked(drawing, row_bytes=widest), "source_key").withColumn("copies", copies).where("copies > 0")
    copied = drawn.select("row", "doc", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col("doc"), F.col("copy").cast("string")))
    shuffled = copied.select("row.*", "copy", "copies", order.alias("order_key"))
    return shuffled.repartition(F.xxhash64("order_key")).sortWithinPartitions("order_key")


ORACLE_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT coalesce('=' || source, 'null') AS s, sum(length(coalesce(text, '')) + 1)::DOUBLE AS n FROM documents GROUP BY 1
), totals AS (SELECT sum(n) AS t, sum(pow(n, {TEMPERATURE})) AS w FROM sized),
rates AS (SELECT s, pow(n, {TEMPERATURE}) / w * t / n AS r FROM sized, totals),
poisson(s, r, k, p, c) AS (
  SELECT s, r, 0, exp(-r), exp(-r) FROM rates
  UNION ALL
  SELECT s, r, k + 1, p * r / (k + 1), c + p * r / (k + 1) FROM poisson WHERE k < ceil(r + 12 * sqrt(r) + 30)
), drawn AS (
  SELECT d.*, (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents d
), counted AS (
  SELECT d.*, (SELECT count(*) FROM poisson p WHERE p.s = coalesce('=' || d.source, 'null') AND p.c < d.u)::INTEGER AS copies FROM drawn d
)
SELECT doc_id, text, lang, source, n_chars, copies, copy::INTEGER AS copy,
  md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR) AS order_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted)
"""
