"""Best-fit packing of documents into token sequences, with certified bounds.

A document becomes its token ids and one end id. Longer ones are cut into pieces of a whole
sequence, of which the first may be shorter. The rest are packed per partition by best-fit decreasing, and
a lower bound from dual-feasible functions certifies the partition where it needs no more
sequences than the bound. Partitions with a gap keep their full sequences and exchange the pieces of the others, certified ones
those of their emptiest sequence, which the bound of all partitions together may spare. These are
dealt out anew, by another hash, to partitions of at most ``partition`` pieces on average, and packed again.

Where an exchange no longer settles a tenth of what it deals, all open pieces are packed together: there are no more
different lengths than tokens in a sequence, so the driver runs best-fit decreasing over how often each occurs, run by run,
and tells which places of a length go to which sequences. Pieces are counted off within their length, partition by partition,
and take their places. No task and no driver holds more than a partition's pieces, or a number per length and run.

The result tells how many sequences were made and how many any packing needs at least.

Defined cases: a null or empty text is the end id alone; rows that repeat an id are packed one by
one; a null id stays null; an empty table gives no rows; columns not named are left alone.
"""

from __future__ import annotations

import itertools
import logging
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhour.llm import spans
from tallyhour.llm.tables import land, own

_log = logging.getLogger(__name__)

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 0
#: Pieces that one task packs, on average.
PARTITION = 4_000
#: An exchange goes on while it settles this share of its pieces.
SETTLED = 0.1
ROUNDS = 16

_PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"
_COLUMNS = ["row_id", "doc_id", "piece", "start", "length", "ids_crc32"]
_PACKED = _PIECES + ", part long, bin long, offset long, done boolean"


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, each: np.ndarray | None = None) -> int:
    """The best of the dual-feasible functions' bounds on the number of sequences.

    Two families: one counts lengths over ``capacity - k`` as whole, those of ``k`` or more as
    they are and drops the rest; the other rounds ``(n + 1) * length / capacity`` down unless it is whole. ``each``: how often each of the lengths, then all different, occurs.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True) if each is None else (lengths, each)
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in np.unique(np.minimum(sizes, capacity - sizes)):
        if 0 < k <= capacity // 2:
            value = np.where(sizes > capacity - k, capacity, np.where(sizes >= k, sizes, 0))
            best = max(best, -(-int((value * counts).sum()) // capacity))
    for n in range(1, 33):
        scaled = (n + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * n, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (n * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece: longest first, into the fullest sequence with room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    occupied, made = 0, 0  # a bit for each room that some open sequence has
    for at, length in zip(order.tolist(), lengths[order].tolist()):
        above = occupied >> length
        if above:
            room = length + (above & -above).bit_length() - 1
            one = rooms[room].pop()
            if not rooms[room]:
                occupied &= ~(1 << room)
        else:
            room, one, made = capacity, made, made + 1
        bins[at], offsets[at] = one, capacity - room
        left = room - length
        if left:
            rooms[left].append(one)
            occupied |= 1 << left
    return bins, offsets


def runs_of(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over how often each length occurs, and the number of sequences made.

    Rows are runs ``length, rank, bins, each, bin, offset``: from that rank of the length on, so many sequences from
    ``bin`` on take ``each`` pieces, the first at ``offset``. Pieces of one length follow one another into the fullest
    sequence with room until it has none, and sequences of one room are alike, so runs stand for pieces one by one.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    occupied, made = 0, 0
    runs: list[tuple[int, ...]] = []

    def put(room: int, first: int, n: int) -> None:
        nonlocal occupied
        if room and n:
            rooms.setdefault(room, []).append((first, n))
            occupied |= 1 << room

    for at in np.argsort(-lengths, kind="stable").tolist():
        length, left, rank = int(lengths[at]), int(counts[at]), 0
        while left:
            above = occupied >> length
            if not above:
                n = -(-left // (capacity // length))
                put(capacity, made, n)
                made += n
                continue
            room = length + (above & -above).bit_length() - 1
            first, n = rooms[room].pop()
            if not rooms[room]:
                occupied &= ~(1 << room)
            each = min(room // length, left)
            bins = min(n, left // each)
            runs.append((length, rank, bins, each, first, capacity - room))
            put(room - each * length, first, bins)
            put(room, first + bins, n - bins)
            rank += bins * each
            left -= bins * each
    return np.array(runs, np.int64).reshape(-1, 6), made


def _together(waiting: DataFrame, number: int, capacity: int, partition: int) -> DataFrame:
    """All open pieces in one packing, by the histogram of their lengths."""
    histogram = waiting.groupBy("length").count().toPandas()
    runs, _ = runs_of(histogram["length"].to_numpy(), histogram["count"].to_numpy(), capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    buckets = max(1, -(-int(histogram["count"].sum()) // partition))
    dealt = waiting.withColumn("bucket", F.pmod(F.xxhash64("row_id", "piece", F.lit(number)), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row_id", "piece"))
    ranked = dealt.withColumn("within", within).join(before, ["length", "bucket"])
    ranked = ranked.select(*_COLUMNS, (F.col("before") + F.col("within") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.searchsorted(runs[:, 0], np.arange(capacity + 2))
        # one number that rises with length and rank
        most = int(runs[:, 1].max(initial=0)) + int((runs[:, 2] * runs[:, 3]).max(initial=0)) + 1
        keys = runs[:, 0] * most + runs[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.maximum(np.searchsorted(keys, length * most + rank, "right") - 1, starts[length])
            _, first, _, each, start, offset = runs[at].T
            sequence = (number << 58) + start + (rank - first) // each
            columns = [batch.column(name) for name in _COLUMNS]
            columns += [pa.array(offset + (rank - first) % each * length), pa.array(np.ones(len(rank), bool)), pa.array(sequence)]
            yield pa.RecordBatch.from_arrays(columns, names=[*_COLUMNS, "offset", "done", "sequence_id"])

    return land(ranked.mapInArrow(place, f"{_PIECES}, offset long, done boolean, sequence_id long"), "packed")


def pieces(
    documents: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Every text as pieces of at most ``capacity`` ids, with the checksum of each piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallyhour.llm.tokens import tokenize

        path = tokenizer or public_tokenizers.path(TOKENIZER)
        end = np.array([end_id], "<u4")
        for batch in spans.thrifty(batches, "text"):
            _, ids = tokenize(batch.column("text"), path, True)
            columns: list[list] = [[], [], [], [], []]
            for row, own_ids in enumerate(ids):
                whole = np.concatenate([own_ids.astype("<u4"), end])
                first = len(whole) % capacity or capacity
                for number, stop in enumerate(range(first, len(whole) + 1, capacity)):
                    start = max(0, stop - capacity) if number else 0
                    raw = whole[start:stop].tobytes()
                    for column, value in zip(columns, (row, number, start, stop - start, zlib.crc32(raw))):
                        column.append(value)
            row = pa.array(columns[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_id").take(row),
                    batch.column("doc_id").take(row),
                    pa.array(columns[1], pa.int32()),
                    *[pa.array(column, pa.int64()) for column in columns[2:]],
                ],
                names=["row_id", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = own(documents, {"doc_id": id_column, "text": text_column}).select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.mapInArrow(cut, _PIECES)


def _pack(table: pa.Table, capacity: int) -> pa.Table:
    length, row, piece = (table.column(name).to_numpy() for name in ("length", "row_id", "piece"))
    order = np.lexsort((piece, row, -length))
    table, lengths = table.take(pa.array(order)), length[order]
    bins, offsets = best_fit_decreasing(lengths, capacity)
    filled = np.bincount(bins, lengths).astype(np.int64)
    certified = bins.max() < lower_bound(lengths, capacity)
    # where the bound is not met, only full sequences stay; the emptiest one is always worth an exchange
    stays = (filled == capacity) | (certified & (np.arange(len(filled)) != filled.argmin()))
    columns = {name: table.column(name) for name in [*_COLUMNS, "part"]}
    return pa.table({**columns, "bin": pa.array(bins), "offset": pa.array(offsets), "done": pa.array(stays[bins])})


def _round(open_pieces: DataFrame, number: int, parts: int, capacity: int) -> DataFrame:
    dealt = open_pieces.withColumn("part", F.pmod(F.xxhash64("row_id", "piece", F.lit(number)), F.lit(parts)))
    packed = dealt.groupBy("part").applyInArrow(lambda table: _pack(table, capacity), _PACKED)
    sequence = F.lit(number << 58) + F.shiftleft("part", 32) + F.col("bin")
    return land(packed.withColumn("sequence_id", sequence).drop("part", "bin"), "packed")


def best_fit_packing(
    documents: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
    partition: int = PARTITION,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece, ``n_sequences`` and ``least_sequences``."""
    waiting = land(pieces(documents, tokenizer, capacity, end_id, id_column, text_column), "pieces")
    lengths = waiting.groupBy("length").count().toPandas()
    n_waiting, packed, made = int(lengths["count"].sum()), [], 0
    for number in itertools.count():
        parts = max(1, -(-n_waiting // partition))
        dealt = _round(waiting, number, parts, capacity)
        begins = F.col("offset") == 0
        found = dealt.agg(F.count_if(~F.col("done")), F.count_if(begins), F.count_if(begins & F.col("done"))).first()
        if not found[0] or parts == 1:
            packed.append(dealt)
            made += found[1]
            break
        packed.append(dealt.where("done"))
        made += found[2]
        waiting = dealt.where(~F.col("done")).drop("offset", "done", "sequence_id")
        settled, n_waiting = n_waiting - found[0], found[0]
        if number + 1 == ROUNDS or settled < SETTLED * (settled + n_waiting):
            last = _together(waiting, number + 1, capacity, partition)
            packed.append(last)
            made += last.where("offset = 0").count()
            break
    bound = lower_bound(lengths["length"].to_numpy(), capacity, lengths["count"].to_numpy())
    _log.info("%d sequences, %d at least", made, bound)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    result = packed[0].select(*columns)
    for more in packed[1:]:
        result = result.unionByName(more.select(*columns))
    return result.withColumns({"n_sequences": F.lit(made).cast("long"), "least_sequences": F.lit(bound).cast("long")})
