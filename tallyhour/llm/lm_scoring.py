"""Language-model scores by context-tree weighting over bytes.

A text is normalised to its words (A-Z lower-cased), a space after each but the last, and an end
byte. A byte is coded as eight binary decisions. Each decision has a context tree over the ``depth`` bytes
before it; a node's block probability is the Krichevsky-Trofimov estimate of its counts, and
its weighted probability is the mean of that and the product of its children's. The predictive
probability of a decision mixes the estimates at all depths with the weights that follow, so a
byte's probability is a product of eight mixtures, and the score the sum of their logarithms.

Counts are order-free, so training is a grouped aggregation: each task counts its byte strings of length
``depth + 1``, a shuffle adds them up. Strings of texts that only get scored are listed with count zero, so that every
string met later has its probability worked out. Trees are built by the last two context bytes: all nodes from
depth 2 on lie within such a group; the two depths above are one table of at most 65,280 rows and 255 rows.

Scoring looks strings up in tables that the workers hold. The tables are cut into blocks of ``block_rows``
entries, whose size is thus bounded, and the texts are read once for each block; sums are added up per row.

The base score is that of words alone, with one added to each count.

Defined cases: a null text counts as empty and has its end alone; a null id never learns nor is held out of
training by its number (it counts as held out) and keeps its null; rows that repeat an id are scored one
by one; an empty table gives no rows; a text outside training data scores by the estimates of empty counts; columns
not named are left alone.
"""

from __future__ import annotations

import ctypes
import gc
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from tallyhour.llm import spans
from tallyhour.llm.tables import land, own

DEPTH = 6
END = 0x0A
#: Entries of a lookup table sent to the workers at a time: 16 bytes each.
BLOCK_ROWS = 4_000_000
#: Strings that one task builds trees of, on average.
TREE_ROWS = 100_000
#: Sums that a task holds before it merges them, and different keys that it holds before it passes them on.
_PENDING = 400_000
_HOLDS = 800_000
#: Bytes of text that a task works on at a time; the sums take the rest of its memory.
_SLICE = 1 << 19

GRAM, WORD, TOTAL = 0, 1, 2


# -- texts to strings and words


def _stream(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised texts end to end, each with ``depth`` end bytes before it; offsets; words of each."""
    parts, lengths, n_words = [], [], []
    pad = bytes([END]) * depth
    for text in texts:
        words = text.as_buffer().to_pybytes().lower().split()
        joined = b" ".join(words)
        parts += (pad, joined, pad[:1])
        lengths.append(depth + len(joined) + 1)
        n_words.append(len(words))
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets, np.array(n_words, np.int64)


def _strings(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """The string that ends at each scored byte, as one number; texts in order."""
    keys = np.zeros(len(data) - depth, np.uint64)
    for place in range(depth + 1):
        keys = (keys << np.uint64(8)) | data[place : place + len(keys)]
    scored = np.ones(len(data), bool)
    scored[(offsets[:-1, None] + np.arange(depth)).reshape(-1)] = False
    return keys[scored[depth:]]


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    starts, ends, _ = spans.words(data, offsets)
    return spans.span_hash(data, starts, ends)


class _Sums:
    """Counts by key, merged whenever enough are pending, and handed over whenever many keys are held."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.pending = 0

    def add(self, keys: np.ndarray, learns: int) -> bool:
        """Whether to take the sums now."""
        found, counts = np.unique(keys, return_counts=True)
        self.keys.append(found)
        self.counts.append(counts * learns)
        self.pending += len(found)
        return self.pending > _PENDING and self._merge() > _HOLDS

    def _merge(self) -> int:
        if len(self.keys) > 1:
            keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = keys[1:] != keys[:-1]
            starts = np.flatnonzero(fresh)
            self.keys, self.counts = [keys[starts]], [np.add.reduceat(counts, starts) if len(starts) else counts]
        self.pending = 0
        return len(self.keys[0]) if self.keys else 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self._merge():
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = self.keys[0], self.counts[0]
        self.keys, self.counts = [], []
        return keys, counts


def _give_back() -> None:
    """Return freed memory to the system: a worker that waits keeps none for tasks that are over."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library, without this call
        pass


def _gather(rows: DataFrame, depth: int) -> DataFrame:
    """``kind, item, n, unlearned`` per task: counts in training texts, and whether other texts have the item.

    A task holds a bounded number of keys and may pass on a key more than once; the shuffle adds up.
    """

    def taken(kind: int, side: bool, one: _Sums) -> Iterator[pa.RecordBatch]:
        keys, counts = one.take()
        for start in range(0, len(keys), 1 << 18):
            part = slice(start, start + (1 << 18))
            size = len(keys[part])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(size, kind, np.int32)),
                    spans.signed(keys[part]),
                    pa.array(counts[part]),
                    pa.array(np.full(size, side)),
                ],
                names=["kind", "item", "n", "unlearned"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _HELD.clear()  # tables of an earlier run in this worker
        _give_back()
        sums = {(kind, held): _Sums() for kind in (GRAM, WORD) for held in (False, True)}
        tokens = 0
        for batch in spans.slices(batches, "text", _SLICE):
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for side in (False, True):
                texts = batch.column("text").filter(pa.array(held == side))
                if not len(texts):
                    continue
                data, offsets, n_words = _stream(texts, depth)
                for kind, keys in ((GRAM, _strings(data, offsets, depth)), (WORD, _word_hashes(data, offsets))):
                    if sums[kind, side].add(keys, int(not side)):
                        yield from taken(kind, side, sums[kind, side])
                tokens += 0 if side else int(n_words.sum()) + len(n_words)
        for (kind, side), one in sums.items():
            yield from taken(kind, side, one)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TOTAL], pa.int32()), pa.array([0], pa.int64()), pa.array([tokens], pa.int64()), pa.array([False])],
            names=["kind", "item", "n", "unlearned"],
        )
        sums.clear()
        _give_back()

    return rows.mapInArrow(run, "kind int, item long, n long, unlearned boolean")


# -- context trees


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series from 8 on."""
    low = np.maximum(0, np.ceil(8 - x)).astype(np.int64)
    steps = np.zeros_like(x)
    for k in range(8):
        steps += np.where(k < low, np.log(x + np.minimum(k, low)), 0.0)
    z = x + low
    inverse = 1 / (z * z)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - steps


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov block probability."""
    zeros, ones = zeros.astype(np.float64), ones.astype(np.float64)
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - math.log(math.pi)


def _weighted(zeros, ones, children) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log weighted probability, share of the node's own estimate, and its estimate that the bit is one."""
    own_estimate = log_estimate(zeros, ones)
    weighted = np.logaddexp(own_estimate, children) - math.log(2)
    share = 1 / (1 + np.exp(np.clip(children - own_estimate, -700, 700)))
    return weighted, share, (ones + 0.5) / (zeros + ones + 1)


def _decisions(last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node (1 to 255) and bit of the eight decisions of each byte, as columns."""
    shifts = np.arange(8)
    whole = last.astype(np.int64)[:, None] | 256
    return whole >> (8 - shifts), (whole >> (7 - shifts)) & 1


class Trees:
    """All nodes from depth 2 on under some contexts, with predictions for their strings."""

    def __init__(self, strings: np.ndarray, counts: np.ndarray, depth: int):
        self.n = len(strings)
        nodes, bits = _decisions(strings & np.uint64(255))
        self.nodes, self.bits = nodes, bits
        # the context with the latest byte on top, so that a shorter context is a prefix
        context = np.zeros(self.n, np.uint64)
        for place in range(1, depth + 1):
            context = (context << np.uint64(8)) | ((strings >> np.uint64(8 * place)) & np.uint64(255))
        weight = np.repeat(counts.astype(np.float64), 8)
        bit = bits.reshape(-1)
        keys = ((context[:, None] << np.uint64(8)) | nodes.astype(np.uint64)).reshape(-1)
        found, inverse = np.unique(keys, return_inverse=True)
        zeros = np.bincount(inverse, weight * (1 - bit), len(found))
        ones = np.bincount(inverse, weight * bit, len(found))
        self.levels = []
        children = log_estimate(zeros, ones)  # a leaf is weighted by its own estimate alone
        share, estimate = np.ones(len(found)), (ones + 0.5) / (zeros + ones + 1)
        weighted = children
        for level in range(depth, 1, -1):
            if level < depth:
                weighted, share, estimate = _weighted(zeros, ones, children)
            # a node that no training text reached predicts by nothing of its own
            reached = zeros + ones > 0
            self.levels.append((inverse, share, estimate, reached))
            if level == 2:
                break
            parent = ((found >> np.uint64(16)) << np.uint64(8)) | (found & np.uint64(255))
            above, up = np.unique(parent, return_inverse=True)
            zeros, ones = np.bincount(up, zeros, len(above)), np.bincount(up, ones, len(above))
            children = np.bincount(up, weighted, len(above))
            found, inverse = above, up[inverse]
        self.top = found, zeros, ones, weighted

    def log10_probability(self, upper) -> np.ndarray:
        """Of the last byte of each string; ``upper`` has the shares and estimates of depths 1 and 0."""
        one = np.full(self.n * 8, 0.5)
        for inverse, share, estimate, reached in self.levels:
            mixed = share[inverse] * estimate[inverse] + (1 - share[inverse]) * one
            one = np.where(reached[inverse], mixed, 0.5)
        node = self.nodes.reshape(-1)
        # the latest context byte is on top of the key: two context bytes above the node
        latest = np.repeat((self.top_context() & 255), 8)
        for share, estimate, reached in upper:
            at = (latest, node) if share.ndim == 2 else node
            mixed = share[at] * estimate[at] + (1 - share[at]) * one
            one = np.where(reached[at], mixed, 0.5)
        bit = self.bits.reshape(-1)
        chosen = np.where(bit == 1, one, 1 - one)
        return np.log10(chosen).reshape(-1, 8).sum(axis=1)

    def top_context(self) -> np.ndarray:
        return self.latest

    latest: np.ndarray


def _trees(batches: list[pa.RecordBatch], depth: int) -> tuple[np.ndarray, Trees] | None:
    if not sum(batch.num_rows for batch in batches):
        return None
    table = pa.Table.from_batches(batches)
    strings = table.column("item").to_numpy().view(np.uint64)
    trees = Trees(strings, table.column("n").to_numpy(), depth)
    trees.latest = ((strings >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
    return strings, trees


def _upper(tops: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Shares, estimates and reach at depths 1 and 0, from the sums over each latest byte and node."""
    byte, node = tops.column("latest").to_numpy(), tops.column("node").to_numpy()
    grid = np.zeros((3, 256, 256))
    for place, name in enumerate(("zeros", "ones", "weighted")):
        grid[place, byte, node] = tops.column(name).to_numpy()
    zeros, ones, children = grid
    weighted, share, estimate = _weighted(zeros, ones, children)
    met = np.zeros((256, 256), bool)
    met[byte, node] = True
    root = _weighted(zeros.sum(0), ones.sum(0), np.where(met, weighted, 0.0).sum(0))
    return [(share, estimate, zeros + ones > 0), (root[1], root[2], (zeros + ones).sum(0) > 0)]


def string_probabilities(counts: DataFrame, depth: int, tree_rows: int = TREE_ROWS) -> DataFrame:
    """``item, value``: log10 probability of the last byte of each string given those before it."""
    spark = counts.sparkSession
    n = counts.count()
    group = F.shiftright("item", 8).bitwiseAND(F.lit(0xFFFF))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _trees(list(batches), depth)
        if built is None:
            return
        found, zeros, ones, weighted = built[1].top
        # the key of a node of depth 2: latest byte, byte before, node
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(((found >> np.uint64(16)) & np.uint64(255)).astype(np.int32)),
                pa.array((found & np.uint64(255)).astype(np.int32)),
                pa.array(zeros),
                pa.array(ones),
                pa.array(weighted),
            ],
            names=["latest", "node", "zeros", "ones", "weighted"],
        )

    dealt = counts.repartition(max(1, -(-n // tree_rows)), group)
    summed = (
        dealt.mapInArrow(tops, "latest int, node int, zeros double, ones double, weighted double")
        .groupBy("latest", "node")
        .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted"))
    )
    upper = spark.sparkContext.broadcast(_upper(summed.toArrow()))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _trees(list(batches), depth)
        if built is None:
            return
        strings, trees = built
        values = trees.log10_probability(upper.value)
        del built, trees
        yield pa.RecordBatch.from_arrays([spans.signed(strings), pa.array(values)], names=["item", "value"])
        _give_back()

    return dealt.mapInArrow(predict, "item long, value double")


# -- scoring


class _Lookup:
    """Values by 64-bit key: open addressing, whole arrays at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * max(len(keys), 1) - 1).bit_length())
        size = 1 << self.bits
        self.place = np.full(size, -1, np.int32)
        self.keys, self.values = keys, values
        slot = self._slot(keys)
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.place[slot[left]] < 0
            self.place[slot[left[free]]] = left[free]
            lost = self.place[slot[left]] != left
            left = left[lost]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(keys), missing)
        if not len(self.keys):
            return out
        slot = self._slot(keys)
        place = self.place[slot]
        hit = place >= 0
        hit[hit] = self.keys[place[hit]] == keys[hit]
        out[hit] = self.values[place[hit]]
        left = np.flatnonzero(~hit & (place >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.place) - 1)
            place = self.place[slot[left]]
            same = place >= 0
            same[same] = self.keys[place[same]] == keys[left[same]]
            out[left[same]] = self.values[place[same]]
            left = left[~same & (place >= 0)]
        return out


_HELD: dict = {}


def _lookups(broadcast) -> tuple[_Lookup, _Lookup]:
    """The tables of a block, built once in a worker and kept for its later tasks."""
    if broadcast.value[0] not in _HELD:
        _HELD.clear()
        name, strings, values, words, counts = broadcast.value
        _HELD[name] = _Lookup(strings, values), _Lookup(words, counts)
    return _HELD[broadcast.value[0]]


def _sum_by_text(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths), values, len(lengths))
    return sums.astype(np.float64)  # whole numbers where there is nothing to add


def _scored(rows: DataFrame, number: int, blocks: int, tables, depth: int, totals: tuple[int, int, int]) -> DataFrame:
    """Partial sums of each row for one block of the tables; the first block adds what holds for all."""
    n_tokens, n_types, n_texts = totals
    whole = n_tokens + n_types + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, words = _lookups(tables)
        for batch in spans.slices(batches, "text", _SLICE):
            data, offsets, n_words = _stream(batch.column("text"), depth)
            lengths = np.diff(offsets) - depth
            score = _sum_by_text(strings.get(_strings(data, offsets, depth), 0.0), lengths)
            hashes = _word_hashes(data, offsets)
            counts = words.get(hashes, -1.0)
            # the lexicon lacks words that training texts have once and other texts never
            learned = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            once = np.repeat(learned, n_words) & (np.mod(hashes.view(np.int64), blocks) == number)
            counts = np.where(counts < 0, once.astype(np.float64), counts)
            # sums relative to a count of zero, so that blocks add up
            base = _sum_by_text(np.log10(counts + 1), n_words)
            known = _sum_by_text(counts > 0, n_words)
            if number == 0:
                base += np.log10(n_texts + 1) - (n_words + 1) * np.log10(whole)
                known += n_texts > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_id"),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(n_words + 1),
                    pa.array(lengths.astype(np.int64)),
                    pa.array(known.astype(np.int64)),
                    pa.array(base),
                    pa.array(score),
                ],
                names=["row_id", "doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base_score", "score"],
            )
        _give_back()

    return rows.mapInArrow(
        run,
        "row_id long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base_score double, score double",
    )


def held_out(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(True))


def lm_scoring(
    documents: DataFrame,
    depth: int = DEPTH,
    id_column: str = "doc_id",
    text_column: str = "text",
    is_held_out=held_out,
    block_rows: int = BLOCK_ROWS,
    tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_bytes, n_known, train_tokens, base_score, score, bits_per_byte`` of each row.

    ``n_bytes`` are the bytes scored: those of the normalised text and its end.
    """
    spark = documents.sparkSession
    if not 2 <= depth <= 7:
        raise ValueError("depth must be 2 to 7: strings are 64-bit numbers")
    rows = own(documents, {"doc_id": id_column, "text": text_column}).select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        is_held_out(F.col("doc_id")).alias("held_out"),
    )
    gathered = land(
        _gather(rows, depth)
        .groupBy("kind", "item")
        .agg(F.sum("n").alias("n"), F.bool_or("unlearned").alias("unlearned")),
        "counts",
    )
    totals = gathered.agg(
        F.sum(F.when(F.col("kind") == TOTAL, F.col("n"))).alias("tokens"),
        F.count_if((F.col("kind") == WORD) & (F.col("n") > 0)).alias("types"),
    ).first()
    n_tokens, words = totals["tokens"] or 0, totals["types"]
    n_texts = rows.where(~F.col("held_out")).count()
    n_types = words + (1 if n_texts else 0)  # the end is a token like any word
    strings = land(
        string_probabilities(gathered.where(F.col("kind") == GRAM).select("item", "n"), depth, tree_rows), "strings"
    )
    # a word that a single training text has once needs no entry
    lexicon = gathered.where((F.col("kind") == WORD) & ((F.col("n") > 1) | (F.col("n") > 0) & F.col("unlearned")))
    entries = strings.count() + lexicon.count()
    blocks = max(1, -(-entries // block_rows))
    partial = None
    for number in range(blocks):
        some = strings.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).toArrow()
        counted = lexicon.select("item", "n").where(F.pmod("item", F.lit(blocks)) == number).toArrow()
        tables = spark.sparkContext.broadcast(
            (
                uuid.uuid4().hex,
                some.column("item").to_numpy().view(np.uint64),
                some.column("value").to_numpy(),
                counted.column("item").to_numpy().view(np.uint64),
                counted.column("n").to_numpy().astype(np.float64),
            )
        )
        one = land(_scored(rows, number, blocks, tables, depth, (n_tokens, n_types, n_texts)), "scores")
        tables.unpersist()
        partial = one if partial is None else partial.unionByName(one)
    if blocks > 1:
        partial = partial.groupBy("row_id", "doc_id", "held_out", "n_tokens", "n_bytes").agg(
            *[F.sum(name).alias(name) for name in ("n_known", "base_score", "score")]
        )
    return partial.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_bytes",
        "n_known",
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        (F.col("score") * F.lit(-math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
