"""Quality rules: line frequency across documents, and rules within one document.

Lines are normalised (A-Z lower-cased, digits to 0, white space to one space) and hashed. For
each host the documents that hold a line are counted; a line that more than ``max_documents`` of them
hold is boilerplate, wherever it stands. Boilerplate lines are taken away, and a document that
keeps less than ``min_left`` of its words is rejected.

Copies of one text count once, as they are for deduplication to judge: documents of equal lines are one, and so
are near copies, of a similarity of 0.75 or more as everywhere in this package. Two texts of one length reach that
if no more than a seventh of either (``OWN_SHARE``) is its own. A document with less in lines of its own, those that at most
``max_documents`` different texts of the host hold, counts as the text that its main line stands for, the rarest of its
others; with more, it counts for itself, however much it shares. So a block that stands in many documents goes, a
document made of several such blocks is left depleted and goes, and copies of one document stay for deduplication.

Defined cases: a null text counts as empty; an empty text has no words and fails the rule on
length; a null host is a host of its own; rows that repeat an id are judged one by one, and each
counts as a document; an empty table gives no rows; columns not named are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhour.llm import spans
from tallyhour.llm.tables import land, own

MAX_DOCUMENTS = 20
#: Of two texts of one length whose similarity is 0.75, what only one of them has.
OWN_SHARE = 1 - 2 * 0.75 / (1 + 0.75)
MIN_LEFT = 0.1
MIN_WORDS = 50
MAX_REPEATED = 0.5

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_NORMAL = spans.LOWER.copy()
_NORMAL[ord("0") : ord("9") + 1] = ord("0")

_MEASURES = (
    "row_id long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<struct<line: long, line_words: int>>"
)


def _repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, the words inside windows of three words that occur there twice or more."""
    counts = np.diff(first)
    if len(hashes) < 3:
        return np.zeros(len(counts), np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    whole = text[:-2] == text[2:]
    keys = spans.mix(spans.windows(hashes, 3) ^ spans.mix(text[:-2].astype(np.uint64)))
    _, inverse, seen = np.unique(keys[whole], return_inverse=True, return_counts=True)
    at = np.flatnonzero(whole)[seen[inverse] > 1]
    covered = np.zeros(len(hashes), bool)
    for step in range(3):
        covered[at + step] = True
    return np.bincount(text[covered], minlength=len(counts)).astype(np.int64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in spans.thrifty(batches, "text"):
        data, offsets = spans.text_bytes(batch.column("text"))
        starts, ends, first = spans.words(data, offsets)
        chars = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
        in_words = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(chars[ends] - chars[starts], out=in_words[1:])
        line_starts, line_ends = spans.runs(data != 10, offsets)
        line_text = np.searchsorted(offsets, line_starts, "right") - 1
        line_first = np.searchsorted(starts, line_starts)
        line_last = np.searchsorted(starts, line_ends)
        full = line_last > line_first
        line_starts, line_ends, line_text = line_starts[full], line_ends[full], line_text[full]
        line_first, line_last = line_first[full], line_last[full]
        own_key = spans.mix(line_text.astype(np.uint64))
        raw = spans.mix(spans.span_hash(data, line_starts, line_ends) ^ own_key)
        _, kept_raw = np.unique(raw, return_index=True)
        n_lines = np.bincount(line_text, minlength=batch.num_rows)
        n_kept = np.bincount(line_text[kept_raw], minlength=batch.num_rows)

        normal = spans.span_hash(_NORMAL[data], starts, ends)
        place = np.arange(len(normal)) - np.repeat(line_first, line_last - line_first)
        weights = spans.mix(place.astype(np.uint64)) | np.uint64(1)
        sums = np.zeros(len(normal) + 1, np.uint64)
        np.cumsum(normal * weights, out=sums[1:])
        line = spans.mix(sums[line_last] - sums[line_first])

        # a text lists each of its lines once, at its first place and with the words of all places
        _, once, which = np.unique(spans.mix(line ^ own_key), return_index=True, return_inverse=True)
        line_words = np.bincount(which, line_last - line_first, len(once)).astype(np.int64)
        order = np.argsort(once)
        once, line_words = once[order], line_words[order]

        def listed(values, kind):
            return pa.array(values, kind)

        bounds = np.zeros(batch.num_rows + 1, np.int32)
        np.cumsum(np.bincount(line_text[once], minlength=batch.num_rows), out=bounds[1:])
        structs = pa.StructArray.from_arrays(
            [spans.signed(line[once]), listed(line_words, pa.int32())],
            ["line", "line_words"],
        )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row_id"),
                batch.column("doc_id"),
                batch.column("host"),
                listed(np.diff(first), pa.int64()),
                listed(in_words[first[1:]] - in_words[first[:-1]], pa.int64()),
                listed(spans.counts_between(_SYMBOLS[data], offsets), pa.int64()),
                listed(n_lines - n_kept, pa.int64()),
                listed(_repeated_words(spans.span_hash(data, starts, ends), first), pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds), structs),
            ],
            names=[
                "row_id", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines",
            ],
        )


def _frequent(each: DataFrame, document: str, max_documents: int) -> DataFrame:
    """``host, line, n_documents`` of the lines that more than ``max_documents`` documents hold.

    Rows of one document meet first; a line that a third of all documents hold is split over these, and the
    second aggregate is summed in every task before it is sent.
    """
    return (
        each.select("host", "line", document)
        .distinct()
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n_documents"))
        .where(F.col("n_documents") > max_documents)
    )


def boilerplate_lines(
    measured: DataFrame, max_documents: int = MAX_DOCUMENTS, own_share: float = OWN_SHARE
) -> tuple[DataFrame, DataFrame]:
    """``host, line, n_documents`` of the boilerplate lines, and ``row_id, host, line, line_words`` of all frequent lines.

    Lines are counted over different texts first; the rows of those that pass are few, and are counted again
    with near copies as one.
    """
    each = measured.select(
        "row_id", "host", "n_words", F.xxhash64("lines.line").alias("same_text"), F.explode("lines").alias("at")
    ).select("row_id", "host", "n_words", "same_text", "at.line", "at.line_words")
    held = land(each.join(_frequent(each, "same_text", max_documents), ["host", "line"]), "frequent")
    n_own = F.first("n_words") - F.sum("line_words")
    main_line = F.min(F.struct("n_documents", "line"))["line"]
    named = held.groupBy("row_id").agg(
        F.when(n_own >= F.lit(own_share) * F.first("n_words"), F.first("same_text")).otherwise(main_line).alias("counts_as")
    )
    counted = held.select("row_id", "host", "line").join(named, "row_id")
    return _frequent(counted, "counts_as", max_documents), held.select("row_id", "host", "line", "line_words")


def quality_rules(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    max_documents: int = MAX_DOCUMENTS,
    own_share: float = OWN_SHARE,
    min_left: float = MIN_LEFT,
    min_words: int = MIN_WORDS,
    max_repeated: float = MAX_REPEATED,
) -> DataFrame:
    """Measures and verdict of each row: base counts, removed words, ``kept``.

    ``row_id`` numbers the rows of this run; it tells rows apart that repeat an id.
    """
    rows = own(documents, {"doc_id": id_column, "text": text_column, "host": host_column}).select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("host").cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    measured = land(rows.mapInArrow(_measure, _MEASURES), "quality")
    boilerplate, held = boilerplate_lines(measured, max_documents, own_share)
    removed = (
        held.join(boilerplate.select("host", "line"), ["host", "line"], "left_semi")
        .groupBy("row_id")
        .agg(F.sum("line_words").alias("removed_words"))
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.lit(max_repeated) * F.col("n_words"))
    removed_words = F.coalesce("removed_words", F.lit(0)).cast("long")
    return (
        measured.drop("lines", "host")
        .join(removed, "row_id", "left")
        .withColumn("removed_words", removed_words)
        .withColumn("base_failed", failed)
        .withColumn(
            "kept",
            ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= F.lit(min_left) * F.col("n_words")),
        )
    )
