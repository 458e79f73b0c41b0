"""Exact top-k search by block-at-a-time pruning.

Candidates are sorted into ranges (by an optional cluster column, then id) and cut into parts, each part into blocks.
Of each block the least and greatest value of every component are kept; summed for a query, sign by
sign, they bound every score in the block from above. Within a part a query takes the blocks in
descending order of their bounds, scores each through its rows, and stops when the next bound falls
below its k-th score.

Before, each query is searched in the part it lies in itself, which gives a first k-th score; other
parts whose own bound is below it are never visited. Queries of a part are split into chunks, so a
group holds a bounded number of candidates and of queries.

Scores are integers, exact. Ties go to the smaller id.

Defined cases: a vector that is null, or holds a null or a value that is not finite, takes no part; shorter
vectors, empty ones too, count as filled with zeros; rows that repeat an id are candidates one by one, those of the
query's id but for the query's own row; each repeated query has its own list, numbered by ``query_row``; a row without an
id takes no part; a cluster column of any type serves, by its hash if it is no number; an empty table gives no rows;
columns not named are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhour.llm.tables import checked, land, own

K = 20
QUERY_MODULUS = 20
SCALE = 64
PART = 4096
BLOCK = 128
QUERY_CHUNK = 4096

_HITS = "query_row long, query_id long, vec_id long, score long, part int"


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of doubles, filled with zeros up to ``width``."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = flat
    return out


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of integer rows; by whole numbers where doubles could round."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if most < 2.0**53:
        return (left @ right.T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def _search(
    queries: np.ndarray,
    query_rows: np.ndarray,
    floor: np.ndarray,
    rows: np.ndarray,
    ids: np.ndarray,
    row_ids: np.ndarray,
    k: int,
    block: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``k`` scores and ids of each query among sorted ``rows``, and which places are filled.

    ``floor`` is a score that k rows elsewhere are known to reach: blocks below it are not read.
    """
    n, lowest = len(queries), np.iinfo(np.int64).min
    starts = np.arange(0, len(rows), block)
    high = np.maximum.reduceat(rows, starts, axis=0)
    low = np.minimum.reduceat(rows, starts, axis=0)
    positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
    # a little above the true bound wherever doubles round
    bounds = (positive @ high.T + negative @ low.T) * (1 + 1e-12 * np.sign(positive @ high.T + negative @ low.T))
    order = np.argsort(-bounds, axis=1, kind="stable")
    scores = np.full((n, k), lowest)
    found = np.full((n, k), -1, np.int64)
    has = np.zeros((n, k), bool)
    active = np.arange(n)
    for step in range(len(starts)):
        chosen = order[active, step]
        least = np.maximum(np.where(has[active, k - 1], scores[active, k - 1], lowest), floor[active])
        go = bounds[active, chosen] >= least
        active, chosen = active[go], chosen[go]
        if not len(active):
            break
        for one in np.unique(chosen):
            who = active[chosen == one]
            span = slice(starts[one], starts[one] + block)
            new = _products(queries[who], rows[span])
            new_ids = np.broadcast_to(ids[span], new.shape)
            allowed = row_ids[None, span] != query_rows[who, None]
            all_has = np.concatenate([has[who], allowed], axis=1)
            all_scores = np.concatenate([scores[who], new], axis=1)
            all_ids = np.concatenate([found[who], new_ids], axis=1)
            best = np.lexsort((all_ids, -all_scores, ~all_has), axis=1)[:, :k]
            has[who] = np.take_along_axis(all_has, best, 1)
            scores[who] = np.take_along_axis(all_scores, best, 1)
            found[who] = np.take_along_axis(all_ids, best, 1)
    return scores, np.where(has, found, -1), has


def _hits(part: int, query_rows, query_ids, scores, found, has) -> pa.Table:
    n, k = has.shape
    take = has.reshape(-1)
    return pa.table(
        {
            "query_row": pa.array(np.repeat(query_rows, k)[take]),
            "query_id": pa.array(np.repeat(query_ids, k)[take]),
            "vec_id": pa.array(found.reshape(-1)[take]),
            "score": pa.array(scores.reshape(-1)[take]),
            "part": pa.array(np.full(int(take.sum()), part, np.int32)),
        }
    )


def _sorted_rows(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = pa.compute.sort_indices(rows, [("cluster", "ascending"), ("vec_id", "ascending")])
    rows = rows.take(order)
    return _matrix(rows.column("vector"), width), rows.column("vec_id").to_numpy(), rows.column("row_id").to_numpy()


def exact_topk(
    vectors: DataFrame,
    k: int = K,
    query_modulus: int = QUERY_MODULUS,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    cluster_column: str | None = "label",
    scale: int = SCALE,
    part_rows: int = PART,
    block_rows: int = BLOCK,
    query_chunk: int = QUERY_CHUNK,
) -> DataFrame:
    """``query_row, query_id, rank, vec_id, score``: queries are the rows whose id ``query_modulus`` divides."""
    named = {"vec_id": id_column, "embedding": vector_column}
    if cluster_column in vectors.columns:
        named["cluster"] = cluster_column
    rows = own(vectors, named)
    if "cluster" not in named:
        rows = rows.withColumn("cluster", F.lit(0))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    number = dict(rows.dtypes)["cluster"] in ("tinyint", "smallint", "int", "bigint")
    cluster = F.col("cluster").cast("long") if number else F.xxhash64(F.col("cluster"))
    valid = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~broken).select(
        F.col("vec_id").cast("long").alias("vec_id"), cluster.alias("cluster"), whole.alias("vector")
    )
    totals = valid.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    n, width = totals["n"], totals["width"] or 1
    parts = max(1, math.ceil(n / part_rows))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, part, np.int32)), *batch.columns], names=["part", *batch.schema.names]
            )

    ranged = valid.withColumn("row_id", F.monotonically_increasing_id()).repartitionByRange(
        parts, "cluster", "vec_id", "row_id"
    )
    index = land(
        ranged.mapInArrow(numbered, "part int, vec_id long, cluster long, vector array<double>, row_id long"), "vectors"
    )
    queries = index.where(F.col("vec_id") % query_modulus == 0).select(
        F.col("row_id").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), "part"
    )
    n_queries = queries.count()
    chunks = max(1, math.ceil(n_queries / query_chunk))
    chunk_of = F.pmod(F.xxhash64("query_row"), F.lit(chunks)).cast("int")

    def pair(key, candidates: pa.Table, asked: pa.Table) -> pa.Table:
        if not candidates.num_rows or not asked.num_rows:
            nothing = np.zeros(0, np.int64)
            return _hits(0, nothing, nothing, np.zeros((0, k), np.int64), np.zeros((0, k), np.int64), np.zeros((0, k), bool))
        vectors_, ids, row_ids = _sorted_rows(candidates, width)
        query_rows = asked.column("query_row").to_numpy()
        floor = asked.column("floor").to_numpy()
        scores, found, has = _search(
            _matrix(asked.column("query"), width), query_rows, floor, vectors_, ids, row_ids, k, block_rows
        )
        return _hits(key[0].as_py(), query_rows, asked.column("query_id").to_numpy(), scores, found, has)

    def searched(asked: DataFrame) -> DataFrame:
        """Every query in the part it is dealt to: parts meet chunks of queries."""
        numbers = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
        candidates = index.select("part", "vec_id", "row_id", "cluster", "vector", numbers if chunks > 1 else F.lit(0).alias("chunk"))
        return (
            candidates.groupBy("part", "chunk")
            .cogroup(asked.withColumn("chunk", chunk_of).groupBy("part", "chunk"))
            .applyInArrow(pair, _HITS)
        )

    lowest = F.lit(-(1 << 62)).cast("long")
    at_home = land(searched(queries.withColumn("floor", lowest)), "home")
    kth = at_home.groupBy("query_row").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(lowest).alias("floor")
    )
    outline = (
        index.select("part", F.posexplode("vector").alias("place", "value"))
        .groupBy("part", "place")
        .agg(F.min("value").alias("low"), F.max("value").alias("high"))
        .groupBy("part")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("place", "low"))).alias("lows"),
            F.map_from_entries(F.collect_list(F.struct("place", "high"))).alias("highs"),
        )
    )
    places = F.sequence(F.lit(0), F.lit(width - 1))
    outline = land(
        outline.select(
            F.col("part").alias("other"),
            F.transform(places, lambda i: F.least(F.coalesce(F.element_at("lows", i), F.lit(0.0)), F.lit(0.0))).alias("low"),
            F.transform(places, lambda i: F.greatest(F.coalesce(F.element_at("highs", i), F.lit(0.0)), F.lit(0.0))).alias("high"),
        ),
        "outline",
    )
    # every query meets one narrow row of each other part; only pairs whose bound reaches its floor go on
    others = F.explode(F.sequence(F.lit(0), F.lit(max(parts - 1, 0)))).alias("other")
    asked = land(queries.join(kth, "query_row", "left").withColumn("floor", F.coalesce("floor", lowest)), "asked")
    bound = F.aggregate(
        F.zip_with(
            "query", F.arrays_zip("low", "high"),
            lambda q, edge: F.coalesce(F.when(q >= 0, q * edge["high"]).otherwise(q * edge["low"]), F.lit(0.0)),
        ),
        F.lit(0.0),
        lambda total, x: total + x,
    )
    visits = (
        asked.select("*", others)
        .where(F.col("other") != F.col("part"))
        .join(checked(outline, parts, 16 * width + 64), "other")
        .where(bound + F.abs(bound) * 1e-9 + 1 >= F.col("floor"))
        .select("query_row", "query_id", "query", "floor", F.col("other").alias("part"))
    )
    hits = at_home.union(searched(visits))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "part")
    return (
        hits.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_row", "query_id", "rank", "vec_id", "score")
    )


ORACLE_SQL = f"""
WITH numbered AS (SELECT vec_id, embedding, row_number() OVER () AS row_id FROM embeddings),
valid AS (
  SELECT vec_id, row_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM numbered
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.row_id AS query_row, c.vec_id,
         COALESCE(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM valid q JOIN valid c ON q.row_id <> c.row_id WHERE q.vec_id % {QUERY_MODULUS} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
