"""N-gram Jaccard join by vertical partitioning, and the groups of its links.

Shingles (five words each, A-Z lower-cased) are put into one global order, rare ones first: by
the power of two of a count sketch over all texts, then by hash. Two sets can only reach the
threshold if they meet within their first shingles in this order (the prefix). The order is cut into fragments of equal
weight, every set into the segments that lie in them; partial overlaps are counted for each fragment by itself and
summed per pair.

Equal sets form a class and take part once. Candidates are tested in two steps, so that a group of n
near copies needs about n tests and not n squared:

1. for each prefix shingle, the members against one of them, the hub;
2. for each prefix shingle, members of different groups of step 1 against each other. Members of one
   group are linked already, whatever a test would say, so no link between groups is lost. Sets are first held
   against whole bands of sizes; those in crowds, or with many possible partners, by all their shingles against all other
   groups at once, so that what is near a crowd but not near enough to any of it makes no pairs.

Both steps test a pair only if it shares as many prefix shingles as sets of their sizes must; step 1, which
does not count shingles with another hub, if a third of them. What step 1 leaves out step 2 meets.

The result has the groups of all links: the connected components.

Disk: shuffles and landed tables go as soon as what they were for is landed, and steps that need not see all sets or
shingles at once run slice by slice, so the disk holds the landed tables and the shuffles of one step.

Hashes have 64 bits. Equal signatures of different sets are found by a second signature
and stop the run. Two shingles with one hash would need to fall into the texts of one candidate pair
to matter.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing;
a null id takes no part and keeps its row with a null group; rows that repeat an id are judged by
their own texts; an empty table gives no rows; columns not named are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhour.llm import spans
from tallyhour.llm.components import components
from tallyhour.llm.tables import checked, in_slices, land, own, passing, shuffles_freed

SHINGLE = 5
PERCENT = 75
#: Counters of the sketch that orders shingles: a fixed size, 4 MB when sent to the workers.
SKETCH = 1 << 22
FRAGMENTS = 16
#: Bands of set sizes for each doubling of the size.
BANDS = 16
#: How often sets without enough in common with a band are taken out before pairs are made.
ROUNDS = 1
#: A shingle that more groups than this have makes no pairs of sets with groups.
CROWD = 64
#: A set with more possible partners than this makes no rows for each of its shingles and each of them.
PARTNERS = 4
#: How often sets whose shared shingles leave no partner possible are taken out.
REACH_ROUNDS = 1
#: Shingles of a block of sets that are held against each other in a task.
BLOCK = 1 << 19
#: Shingles of whole sets that are looked through together in a task.
PART = 1 << 20
#: Shingles, or numbers of as many bytes, that steps which need not see all sets or shingles at once take up at a time.
SLICE = 1 << 27


def _sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    data, offsets = spans.text_bytes(batch.column("text"))
    data = spans.LOWER[data]
    starts, ends, first = spans.words(data, offsets)
    hashes = spans.span_hash(data, starts, ends)
    grams = spans.windows(hashes, size)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            sets.append(np.array([spans.chain(hashes[a:b])], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _signature(hashes: np.ndarray) -> tuple[int, int]:
    one = np.array([hashes.sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64)
    two = np.array([spans.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)], np.uint64)
    return int(spans.mix(one).view(np.int64)[0]), int(two.view(np.int64)[0])


def _summaries(rows: DataFrame, size: int, slots: int) -> DataFrame:
    """One row for each text, and in the end of each task the counters that stand out among its own.

    Counters that chance alone explains would only say how many shingles there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.int64)
        names = ["doc_id", "n_shingles", "set_id", "second", "slot", "n"]
        for batch in spans.thrifty(batches, "text"):
            sets = _sets(batch, size)
            np.add.at(counts, (np.concatenate(sets) & np.uint64(slots - 1)).astype(np.int64), 1)
            signatures = [_signature(hashes) if len(hashes) else (None, None) for hashes in sets]
            nothing = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(hashes) for hashes in sets], pa.int64()),
                    pa.array([one for one, _ in signatures], pa.int64()),
                    pa.array([two for _, two in signatures], pa.int64()),
                    nothing,
                    nothing.cast(pa.int64()),
                ],
                names=names,
            )
        mean = counts.mean()
        slot = np.flatnonzero(counts > mean + 3 * np.sqrt(mean) + 2)
        nothing = pa.nulls(len(slot), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [nothing, nothing, nothing, nothing, pa.array(slot.astype(np.int32)), pa.array(counts[slot])], names=names
        )

    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_id long, second long, slot int, n long")


class GlobalOrder:
    """Places of shingles in the global order, from the summed sketch."""

    def __init__(self, counts: np.ndarray, fragments: int):
        self.level = np.zeros(len(counts), np.uint8)
        full = counts > 0
        self.level[full] = np.log2(counts[full]).astype(np.uint8)
        weight = np.bincount(self.level, np.maximum(counts, 1), 64)
        self.fragments = fragments
        self.share = weight / max(weight.sum(), 1)
        self.below = np.cumsum(self.share) - self.share

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        return self.level[hashes & np.uint64(len(self.level) - 1)]

    def prefix(self, hashes: np.ndarray, percent: int) -> np.ndarray:
        """The first shingles of a set that no linked set can miss altogether."""
        n = len(hashes)
        keep = n - -(-percent * n // 100) + 1
        return hashes[np.lexsort((hashes, self.levels(hashes)))[:keep]]

    def fragment(self, hashes: np.ndarray) -> np.ndarray:
        level = self.levels(hashes)
        place = self.below[level] + self.share[level] * (hashes / 2.0**64)
        return np.minimum((place * self.fragments).astype(np.int64), self.fragments - 1)


def _prefix_rows(rows: DataFrame, order, size: int, percent: int) -> DataFrame:
    """``shingle, set_id`` of the prefix of every set, once for each set and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, done = order.value, set()
        for batch in spans.thrifty(batches, "text"):
            found, owners = [], []
            for hashes in _sets(batch, size):
                if not len(hashes):
                    continue
                set_id, _ = _signature(hashes)
                if set_id not in done:
                    done.add(set_id)
                    found.append(places.prefix(hashes, percent))
                    owners.append(set_id)
            if found:
                lengths = [len(one) for one in found]
                yield pa.RecordBatch.from_arrays(
                    [spans.signed(np.concatenate(found)), pa.array(np.repeat(np.array(owners, np.int64), lengths))],
                    names=["shingle", "set_id"],
                )

    return rows.mapInArrow(run, "shingle long, set_id long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by shingle and set: those of shingles that two sets have, once each."""
    last = None  # the row before, and whether it was passed on
    for batch in batches:
        shingle = batch.column("shingle").to_numpy()
        owner = batch.column("set_id").to_numpy()
        if not len(shingle):
            continue
        if last is not None:
            shingle, owner = np.append(last[0], shingle), np.append(last[1], owner)
        same = shingle[1:] == shingle[:-1]
        fresh = np.ones(len(shingle), bool)
        fresh[1:] = ~(same & (owner[1:] == owner[:-1]))
        shingle, owner = shingle[fresh], owner[fresh]
        same = shingle[1:] == shingle[:-1]
        keep = np.zeros(len(shingle), bool)
        keep[1:] = same
        keep[:-1] |= same
        if last is not None and last[2]:
            keep[0] = False
        passed = bool(keep[-1]) or len(shingle) == 1 and last is not None and last[2]
        last = shingle[-1:], owner[-1:], passed
        if keep.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingle[keep]), pa.array(owner[keep])], names=["shingle", "set_id"]
            )


def _sizes(classes: DataFrame) -> DataFrame:
    """``set_id, n_shingles``, sent to all tasks while it is small."""
    return checked(classes.select("set_id", "n_shingles"), row_bytes=32)


def _spokes(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b, shared`` of each set with the hubs of its prefix shingles.

    Hub of a shingle is the member whose own prefix is the commonest: of copies that were each changed
    elsewhere, the one nearest to what they were copied from.
    """
    n = F.col("n_shingles")
    sizes = members.groupBy("shingle").agg(F.log2(F.count(F.lit(1))).alias("weight"))
    common = (
        members.join(sizes, "shingle")
        .groupBy("set_id")
        .agg(F.sum("weight").alias("weight"))
        .join(_sizes(classes), "set_id")
        .select("set_id", (F.col("weight") / (n - _ceil_div(percent * n, 100) + 1)).alias("common"))
    )
    common = land(common, "common")
    hubs = (
        members.join(checked(common, row_bytes=32), "set_id")
        .groupBy("shingle")
        .agg(F.max(F.struct("common", "set_id"))["set_id"].alias("hub"))
    )
    return (
        members.join(hubs, "shingle")
        .where("set_id != hub")
        .groupBy(F.least("hub", "set_id").alias("a"), F.greatest("hub", "set_id").alias("b"))
        .agg(F.count(F.lit(1)).alias("shared"))
    )


def _segments(rows: DataFrame, order, size: int) -> DataFrame:
    """``doc_id, set_id, fragment, hashes`` of the sets of some rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = order.value
        for batch in spans.thrifty(batches, "text"):
            ids, owners, fragments, parts, lengths = [], [], [], [], []
            for doc_id, hashes in zip(batch.column("doc_id").to_pylist(), _sets(batch, size)):
                if not len(hashes):
                    continue
                set_id, _ = _signature(hashes)
                where = places.fragment(hashes)
                by_fragment = np.argsort(where, kind="stable")
                present, counts = np.unique(where, return_counts=True)
                ids += [doc_id] * len(present)
                owners += [set_id] * len(present)
                fragments += present.tolist()
                lengths += counts.tolist()
                parts.append(hashes[by_fragment])
            if parts:
                bounds = np.zeros(len(lengths) + 1, np.int32)
                np.cumsum(lengths, out=bounds[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(owners, pa.int64()),
                        pa.array(fragments, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(bounds), spans.signed(np.concatenate(parts))),
                    ],
                    names=["doc_id", "set_id", "fragment", "hashes"],
                )

    return rows.mapInArrow(run, "doc_id long, set_id long, fragment int, hashes array<long>")


def _segments_of(sets: DataFrame, rows: DataFrame, classes: DataFrame, order, size: int) -> DataFrame:
    """``set_id, fragment, hashes`` of the sets named, each from one of its texts."""
    named = classes.select("set_id", F.col("doc_id").alias("key"), "copies")
    keys = land(sets.select("set_id").distinct().join(named, "set_id"), "needed")

    def cut(keys: DataFrame) -> DataFrame:
        keys, n = keys.select(F.col("key").alias("doc_id"), "set_id"), keys.count()
        texts = rows.join(checked(keys.select("doc_id").distinct(), n), "doc_id", "left_semi")
        return _segments(texts, order, size).join(checked(keys, n, row_bytes=24), ["doc_id", "set_id"], "left_semi").drop("doc_id")

    segments, repeated = cut(keys.where("copies = 1")), keys.where("copies > 1")
    if repeated.limit(1).count():
        segments = segments.unionByName(cut(repeated).dropDuplicates(["set_id", "fragment"]))
    return land(segments, "segments")


def _ceil_div(value: Column, by: int) -> Column:
    return F.floor((value + F.lit(by - 1)) / by).cast("long")


def _least_overlap(n_a: Column, n_b: Column, percent: int) -> Column:
    """What two sets of these sizes must share to reach the threshold."""
    return _ceil_div(percent * (n_a + n_b), 100 + percent)


def _least_shared(n_a: Column, n_b: Column, percent: int) -> Column:
    """How many shingles linked sets share within their prefixes, at least.

    The prefix that ends first in the order lies within reach of the other; all but ``n - overlap`` of
    its shingles belong to both.
    """
    overlap = _least_overlap(n_a, n_b, percent)
    spare = [overlap - _ceil_div(percent * n, 100) + 1 for n in (n_a, n_b)]
    return F.greatest(F.lit(1), F.least(*spare))


def _promising(pairs: DataFrame, classes: DataFrame, percent: int, seen: int) -> DataFrame:
    """Of pairs ``a, b, shared``, those that sizes and shared prefix shingles leave possible, with sizes.

    ``shared`` counts at least one in ``seen`` of what the pair shares.
    """
    sizes = _sizes(classes)
    possible = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    return (
        pairs.join(sizes.toDF("a", "n_a"), "a")
        .join(sizes.toDF("b", "n_b"), "b")
        .where(possible & (seen * F.col("shared") >= _least_shared(F.col("n_a"), F.col("n_b"), percent)))
        .select("a", "b", "n_a", "n_b")
    )


def _links(
    pairs: DataFrame, rows: DataFrame, classes: DataFrame, order, size: int, percent: int, seen: int = 1
) -> DataFrame:
    """The pairs ``a, b`` that reach the threshold: overlaps per fragment, summed per pair."""
    with passing(rows.sparkSession):
        pairs = land(_promising(pairs, classes, percent, seen), "pairs")
        ends = pairs.select(F.col("a").alias("set_id")).union(pairs.select(F.col("b").alias("set_id")))
        segments = _segments_of(ends, rows, classes, order, size)
        weight = pairs.agg(F.sum(F.col("n_a") + F.col("n_b"))).first()[0] or 0
        sized = checked(pairs, row_bytes=48)

        def overlaps(segments: DataFrame) -> DataFrame:
            left = segments.select(F.col("set_id").alias("a"), "fragment", F.col("hashes").alias("hashes_a"))
            right = segments.select(F.col("set_id").alias("b"), "fragment", F.col("hashes").alias("hashes_b"))
            partial = (
                sized.join(left, "a")
                .join(right, ["b", "fragment"])
                .select("a", "b", "n_a", "n_b", F.size(F.array_intersect("hashes_a", "hashes_b")).alias("overlap"))
            )
            return partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))

        slices = min(order.value.fragments, -(-weight // SLICE))
        partial = in_slices(overlaps, segments, F.col("fragment"), slices, "overlaps")
        total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
        union = F.col("n_a") + F.col("n_b") - F.col("overlap")
        return land(total.where(100 * F.col("overlap") >= percent * union).select("a", "b"), "links", stays=True)


def _band(n: Column) -> Column:
    return F.floor(F.log2(n) * BANDS).cast("int")


def _least_over(n: Column, least: Column, most: Column, percent: int) -> tuple[Column, Column]:
    """Whether a set may link with sets of ``least`` to ``most`` shingles, and what it must share with any of them."""
    low = F.greatest(least, F.floor(percent * n / 100).cast("long"))
    high = F.least(most, _ceil_div(100 * n, percent))
    # one less than the least over the range, as rounding need not be monotone
    needed = F.least(
        _least_overlap(n, low, percent) - _ceil_div(percent * n, 100),
        _least_overlap(n, high, percent) - _ceil_div(percent * high, 100),
    )
    return low <= high, needed


def _open(members: DataFrame, percent: int) -> DataFrame:
    """Members ``shingle, set_id, n, component, band`` with each band of sizes, ``other``, that they may have links in.

    A set must share enough prefix shingles with all sets of other groups in a band taken together. A set that
    fails has no link there, so it does not count for others either, and they are judged anew. Every step
    grows with members and bands, not with pairs.
    """
    ranges = F.broadcast(members.groupBy(F.col("band").alias("other")).agg(F.min("n").alias("least"), F.max("n").alias("most")))
    possible, needed = _least_over(F.col("n"), F.col("least"), F.col("most"), percent)
    reach = math.floor(BANDS * math.log2(100 / percent)) + 1
    kinds = members.groupBy("shingle", F.col("band").alias("other")).agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    )
    met = members.join(kinds, "shingle").where(F.abs(F.col("band") - F.col("other")) <= reach)
    for number in range(ROUNDS):
        if number:
            kinds = members.groupBy("shingle", F.col("band").alias("other"), F.col("other").alias("band")).agg(
                F.min("component").alias("low"), F.max("component").alias("high")
            )
            met = members.join(kinds, ["shingle", "band", "other"])
        kept = (
            met.where((F.col("low") != F.col("component")) | (F.col("high") != F.col("component")))
            .groupBy("set_id", "n", "other")
            .agg(F.count(F.lit(1)).alias("shared"))
            .join(ranges, "other")
            .where(possible & (F.col("shared") >= needed))
            .select("set_id", "other")
        )
        kept = checked(land(kept, "kept"), row_bytes=24)
        members = land(members.join(kept, ["set_id", "other"] if number else "set_id"), "open")
    return members


def _mixed(parts: pa.Table) -> pa.Table:
    """Of ``set_id, fragment, component, hashes`` of a fragment: what sets of several groups have, and how many sets have it."""
    lists = parts.column("hashes").combine_chunks()
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    flat = lists.flatten().to_numpy()
    by_hash = np.argsort(flat, kind="stable")
    flat, owner = flat[by_hash], owner[by_hash]
    component = parts.column("component").to_numpy()[owner]
    fresh = np.ones(len(flat), bool)
    fresh[1:] = flat[1:] != flat[:-1]
    first, run = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    often = np.diff(np.append(first, len(flat)))
    shared = np.minimum.reduceat(component, first) != np.maximum.reduceat(component, first)
    kept = np.flatnonzero(shared[run])
    kept = kept[np.argsort(owner[kept], kind="stable")]
    present, lengths = np.unique(owner[kept], return_counts=True)
    bounds = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
    return pa.table(
        {
            "set_id": parts.column("set_id").to_numpy()[present],
            "fragment": parts.column("fragment").to_numpy()[present],
            "hashes": pa.ListArray.from_arrays(bounds, pa.array(flat[kept])),
            "often": pa.ListArray.from_arrays(bounds, pa.array(often[run[kept]].astype(np.int32))),
        }
    )


def _reaching(members: DataFrame, rows: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the sets of ``members``, those whose whole sets leave a link with another group possible.

    Gives ``set_id, n, component, shared, most, ordered`` of each, ``most`` being the largest partner it may have, and
    ``ordered`` what it shares with sets of other groups, as ``often, hashes``, rarest first; the rest of it no partner has. A
    copy that was changed too much to be near any other shares too little, though it may have much in common with each: it is
    known without being held against them. What fails does not count for others, so the rest is judged anew.

    Whole sets meet in fragments of the hashes alone, so that no row is made for a shingle. Every
    round grows with the shingles of these sets, not with pairs.
    """
    sets = land(members.select("set_id", "n", "component").distinct(), "reaching")
    weight = sets.agg(F.sum("n")).first()[0]
    slices = -(-weight // SLICE)
    evenly = GlobalOrder(np.zeros(1, np.int64), max(FRAGMENTS, -(-weight // PART)))
    parts = _segments_of(sets, rows, classes, rows.sparkSession.sparkContext.broadcast(evenly), size)
    for _ in range(REACH_ROUNDS):
        held = checked(sets.select("set_id", "component"), row_bytes=32)

        def shared(parts: DataFrame, held: DataFrame = held) -> DataFrame:
            schema = "set_id long, fragment int, hashes array<long>, often array<int>"
            named = parts.select("set_id", "fragment", "hashes").join(held, "set_id")
            return named.groupBy("fragment").applyInArrow(_mixed, schema)

        parts = in_slices(shared, parts, F.col("fragment"), slices, "whole")
        counted = parts.groupBy("set_id").agg(F.sum(F.size("hashes")).alias("shared")).join(sets.drop("most", "shared"), "set_id")
        most = F.floor(F.col("shared") * (100 + percent) / percent).cast("long") - F.col("n")
        sets = land(
            counted.select("set_id", "n", "component", "shared", most.alias("most")).where(100 * F.col("most") >= percent * F.col("n")),
            "reach",
        )
        parts = parts.join(checked(sets.select("set_id")), "set_id", "left_semi")

    def ordered(parts: DataFrame) -> DataFrame:
        zipped = F.flatten(F.collect_list(F.arrays_zip("often", "hashes")))
        return parts.groupBy("set_id").agg(F.sort_array(zipped).alias("ordered"))

    return in_slices(ordered, parts, F.xxhash64("set_id"), slices, "ordered").join(checked(sets, row_bytes=48), "set_id")


def _asks(members: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """``set_id, their``: sets with the groups they may have a link in, each pair of groups asked from its smaller side.

    The order is now exact: by how many of the sets of ``members`` have a shingle, and what no other group has comes first. Two sets
    that share enough must meet in the first shingles of both, as many as either may miss, so a set meets
    others by the rarest of what it shares. Sizes are told apart by bands, as the fewer a set may miss the nearer
    its partner's size.
    """
    sets = whole.drop("ordered")
    ranges = sets.groupBy(_band(F.col("n")).alias("other")).agg(F.min("n").alias("least"))
    smallest = F.greatest(F.col("least"), _ceil_div(percent * F.col("n"), 100))
    depth = (F.col("shared") - _least_overlap(F.col("n"), smallest, percent) + 1).cast("int").alias("depth")
    sizes = sets.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    wanted = (
        members.select("set_id", "band", "other").distinct()
        .join(sets, "set_id")
        .join(F.broadcast(ranges), "other")
        .where("least <= most")
        .join(sizes, "component")
        .select("set_id", "n", "component", "size", "most", "band", "other", depth)
        .where("depth > 0")
    )
    wanted = land(wanted, "wanted")
    deepest = wanted.groupBy("set_id").agg(F.max("depth").alias("deepest"))
    placed = whole.join(deepest, "set_id").select("set_id", F.posexplode(F.slice("ordered.hashes", F.lit(1), F.col("deepest"))))
    placed = placed.select("set_id", F.col("pos").alias("place"), F.col("col").alias("shingle"))
    first = land(placed.join(wanted, "set_id").where("place < depth").drop("place", "depth"), "first")
    theirs = first.groupBy(
        "shingle", F.col("component").alias("their"), F.col("size").alias("their_size"),
        F.col("band").alias("other"), F.col("other").alias("band"),
    ).agg(F.min("n").alias("least"), F.max("n").alias("greatest"), F.max("most").alias("reach"))
    smaller = (F.col("size") < F.col("their_size")) | ((F.col("size") == F.col("their_size")) & (F.col("component") < F.col("their")))
    near = (F.col("least") <= F.col("most")) & (F.col("n") <= F.col("reach"))
    near = near & (100 * F.col("greatest") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("least"))
    met = first.join(theirs, ["shingle", "band", "other"]).where(smaller & near)
    return land(met.select("set_id", "their").distinct(), "asks")


def _in_blocks(asks: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """``a, b`` for each set and group asked: the nearest of the group's sets, if it reaches the threshold.

    Askers and members of a group are cut into blocks of a bounded number of shingles, and meet block by block;
    what they share is counted in arrays, so no row is made for a pair that is not linked. Members of a
    group are linked already, so one link with it is as good as all.
    """
    whole = whole.select("set_id", "n", "component", F.col("ordered.hashes").alias("hashes"))
    asking = asks.join(whole.drop("component"), "set_id")
    weight = F.ceil(F.sum(F.size("hashes")) / BLOCK).cast("int")
    askers = asking.groupBy("their").agg(weight.alias("askers"))
    blocks = whole.withColumnRenamed("component", "their").groupBy("their").agg(weight.alias("blocks")).join(askers, "their")

    def dealt(to: str) -> Column:
        return F.pmod(F.xxhash64("set_id"), F.col(to)).cast("int")

    def each(to: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(to) - 1))

    left = asking.join(blocks, "their").select("their", "set_id", "n", "hashes", dealt("askers").alias("asker"), each("blocks").alias("block"))
    right = whole.withColumnRenamed("component", "their").join(blocks, "their").select(
        F.col("their").alias("of"),
        F.col("set_id").alias("member"),
        F.col("n").alias("member_n"),
        F.col("hashes").alias("member_hashes"),
        dealt("blocks").alias("block"),
        each("askers").alias("asker"),
    )

    def nearest(askers: pa.Table, members: pa.Table) -> pa.Table:
        found: tuple[list[int], list[int]] = ([], [])
        if askers.num_rows and members.num_rows:
            lists = members.column("member_hashes").combine_chunks()
            flat = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            by_hash = np.argsort(flat, kind="stable")
            flat, owner = flat[by_hash], owner[by_hash]
            sizes, ids = members.column("member_n").to_numpy(), members.column("member").to_numpy()
            for asker, n, hashes in zip(*[askers.column(name) for name in ("set_id", "n", "hashes")]):
                wanted, n = hashes.values.to_numpy(), n.as_py()
                start, stop = np.searchsorted(flat, wanted), np.searchsorted(flat, wanted, "right")
                lengths = stop - start
                places = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths - start, lengths)
                overlap = np.bincount(owner[places], minlength=len(sizes))
                reached = (100 + percent) * overlap >= percent * (n + sizes)
                if reached.any():
                    best = np.where(reached, overlap / (n + sizes), -1.0).argmax()
                    found[0].append(asker.as_py())
                    found[1].append(int(ids[best]))
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    pairs = left.groupBy("their", "block", "asker").cogroup(right.groupBy("of", "block", "asker")).applyInArrow(nearest, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _crowded(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members in shingles of few groups, and those that may have links by the crowded shingles alone.

    A shingle of more than ``CROWD`` groups is crowded. Of two sets that share enough, one of which has fewer crowded
    shingles in its prefix than they must share, some shared shingle is not crowded: the first frame has these, with
    ``crowded``, how many were taken out of the set. The other pairs lie among the second frame's sets.
    """
    crowds = members.select("shingle", "component").distinct().groupBy("shingle").agg(F.count(F.lit(1)).alias("groups"))
    crowds = checked(land(crowds.where(F.col("groups") > CROWD).select("shingle"), "crowds"))
    ranges = F.broadcast(members.groupBy(F.col("band").alias("other")).agg(F.min("n").alias("least"), F.max("n").alias("most")))
    _, needed = _least_over(F.col("n"), F.col("least"), F.col("most"), percent)
    held = members.join(crowds, "shingle", "left_semi").groupBy("set_id", "n", "other").agg(
        F.count(F.lit(1)).alias("crowded")
    )
    held = land(held.join(ranges, "other").select("set_id", "other", "crowded", (F.col("crowded") >= needed).alias("deep")), "crowded")
    held = checked(held, row_bytes=32)
    calm = members.join(crowds, "shingle", "left_anti").join(held.drop("deep"), ["set_id", "other"], "left")
    deep = members.join(held.where("deep").select("set_id", "other"), ["set_id", "other"], "left_semi")
    return calm.withColumn("crowded", F.coalesce("crowded", F.lit(0))), deep


def _meets(members: DataFrame, percent: int) -> DataFrame:
    """``set_id, n, component, band, their, other, partners``: groups that sets may have links with, by bands of sizes.

    A set must share enough shingles of ``members`` with all members of a group in a band taken together, for the sizes these have.
    ``partners`` counts those members which likewise share enough with the set's own group.
    """
    theirs = [F.col("component").alias("their"), F.col("band").alias("other"), F.col("other").alias("band")]
    ranges = members.groupBy(*theirs[:2]).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    possible, needed = _least_over(F.col("n"), F.col("least"), F.col("most"), percent)
    met, slices = members.select("shingle", *theirs).distinct(), -(-4 * members.count() // SLICE)
    if slices > 1:
        met = land(met, "met")

    def judged(members: DataFrame) -> DataFrame:
        return (
            members.join(met, ["shingle", "band", "other"])
            .where("component != their")
            .groupBy("set_id", "n", "crowded", "component", "band", "their", "other")
            .agg(F.count(F.lit(1)).alias("shared"))
            .join(ranges, ["their", "other"])
            .where(possible & (F.col("shared") + F.col("crowded") >= needed))
            .select("set_id", "n", "component", "band", "their", "other")
        )

    meets = in_slices(judged, members, F.xxhash64("set_id"), slices, "meets")
    back = meets.groupBy(*_turned()).agg(F.count(F.lit(1)).alias("partners"))
    return land(meets.join(back, ["component", "their", "band", "other"]), "mutual")


def _turned() -> list[Column]:
    """The columns of a meeting as the other side has them."""
    pairs = ("their", "component"), ("component", "their"), ("other", "band"), ("band", "other")
    return [F.col(theirs).alias(ours) for theirs, ours in pairs]


def _by_partners(meets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Meetings of sets with few possible partners, and ``set_id, n, component, band, other`` of the other sets and their partners.

    A pair of which one set has more than ``PARTNERS`` has both its sets in the second frame.
    """
    busy = meets.groupBy("set_id").agg(F.sum("partners").alias("partners")).where(F.col("partners") > PARTNERS)
    busy = land(busy.select("set_id"), "busy")
    busy = checked(busy)
    theirs = meets.join(busy, "set_id", "left_semi")
    partners = meets.join(theirs.select(*_turned()).distinct(), ["component", "their", "band", "other"], "left_semi")
    columns = ["set_id", "n", "component", "band", "other"]
    return meets.join(busy, "set_id", "left_anti"), theirs.select(columns).union(partners.select(columns)).distinct()


def _by_groups(members: DataFrame, meets: DataFrame) -> DataFrame:
    """Pairs ``a, b, shared`` of sets in groups that meet, by the shingles of ``members`` that they share."""
    meets = checked(land(meets.select("set_id", "component", "their", "other"), "few"), row_bytes=48)
    each = members.drop("n").join(meets, ["set_id", "component", "other"])
    left = each.where("component < their").select(
        "shingle", "component", "their", "band", "other", F.col("set_id").alias("a"), F.col("crowded").alias("crowded_a")
    )
    right = each.where("component > their").select(
        "shingle",
        F.col("their").alias("component"),
        F.col("component").alias("their"),
        F.col("other").alias("band"),
        F.col("band").alias("other"),
        F.col("set_id").alias("b"),
        F.col("crowded").alias("crowded_b"),
    )
    return (
        left.join(right, ["shingle", "component", "their", "band", "other"])
        .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg((F.count(F.lit(1)) + F.max(F.least("crowded_a", "crowded_b"))).alias("shared"))
    )


def _across(shared: DataFrame, groups: DataFrame, rows: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs ``a, b, shared`` of sets in different groups so far, enough of them to find all groups that are linked.

    First a set meets bands of sizes by its prefix, then groups. What lies in crowds or may have many partners is held against
    all other groups at once by its whole set, then against single groups by the rarest shingles it shares, and against their
    members last.
    """
    with passing(rows.sparkSession):
        members = (
            shared.join(checked(groups, row_bytes=32), "set_id", "left")
            .join(_sizes(classes).withColumnRenamed("n_shingles", "n"), "set_id")
            .select("shingle", "set_id", "n", F.coalesce("component", "set_id").alias("component"), _band(F.col("n")).alias("band"))
        )
        mixed = members.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        mixed = mixed.where("low != high").select("shingle")
        calm, deep = _crowded(_open(land(members.join(mixed, "shingle", "left_semi"), "members"), percent), percent)
        few, many = _by_partners(_meets(calm, percent))
        pairs = _by_groups(calm, few)
        deep = land(deep.select(many.columns).union(many).distinct(), "deep")
        if deep.limit(1).count():
            whole = _reaching(deep, rows, classes, size, percent)
            near = _in_blocks(_asks(deep, whole, percent), whole, percent)
            # the blocks have counted what the pair shares; partial overlaps of fragments settle it
            pairs = pairs.unionByName(near.withColumn("shared", F.lit(1 << 40)))
        return land(pairs, "across", stays=True)


def ngram_jaccard_join(
    documents: DataFrame,
    size: int = SHINGLE,
    percent: int = PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
    sketch: int = SKETCH,
    fragments: int = FRAGMENTS,
) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` of each row.

    ``class_id`` is the least id with the same set, ``component_id`` the least that links reach.
    """
    spark: SparkSession = documents.sparkSession
    rows = own(documents, {"doc_id": id_column, "text": text_column}).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    summaries = land(_summaries(rows, size, sketch), "summaries")
    counts = np.zeros(sketch, np.int64)
    with shuffles_freed(spark):
        slots = summaries.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[slots.column("slot").to_numpy()] = slots.column("n").to_numpy()
    order = spark.sparkContext.broadcast(GlobalOrder(counts, fragments))

    sets = summaries.where("slot is null").drop("slot", "n")
    known = sets.where("set_id is not null and doc_id is not null")
    by_id = known.groupBy("set_id", "doc_id").agg(
        F.min("n_shingles").alias("n_shingles"),
        F.min("second").alias("low"),
        F.max("second").alias("high"),
        F.count(F.lit(1)).alias("copies"),
    )
    classes = by_id.groupBy("set_id").agg(
        F.min(F.struct("doc_id", "copies")).alias("least"),
        F.min("n_shingles").alias("n_shingles"),
        (F.min("low") != F.max("high")).alias("clash"),
    )
    classes = land(classes.select("set_id", "least.doc_id", "least.copies", "n_shingles", "clash"), "classes")
    with passing(spark), shuffles_freed(spark):
        if classes.where("clash").limit(1).count():
            raise RuntimeError("two shingle sets have one signature; change the hash")
        prefixes = _prefix_rows(rows.where("doc_id is not null"), order, size, percent)
        members = land(
            prefixes.repartition(F.col("shingle")).sortWithinPartitions("shingle", "set_id").mapInArrow(
                _shared, "shingle long, set_id long"
            ),
            "shared",
        )
        links = _links(_spokes(members, classes, percent), rows, classes, order, size, percent, seen=3)
        groups = components(links, "set_id")
        more = _links(_across(members, groups, rows, classes, size, percent), rows, classes, order, size, percent)
        if more.limit(1).count():
            groups = components(links.union(more), "set_id")
        groups = land(groups, "linked", stays=True)

    named = classes.join(groups, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("set_id", F.col("doc_id").alias("class_id"), "component_id")
    return (
        sets.select("doc_id", "n_shingles", "set_id")
        .join(named, "set_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
    )
