"""Personal data: plain patterns, and spans beyond them that boosted trees select.

Plain patterns with their checks (``base_spans``) find emails, addresses, cards and phones; those spans always stay. Generators
of high recall then propose more, overlapping each other: written-out and spaced emails, defanged addresses, cards
with other separators or run together with more digits, phones without a plus. Every span, found or proposed, is described by
its format, worked out after separators are taken out, and by its context.

Gradient-boosted trees learn from all labelled spans: spans of the patterns are positive; negative are matches that failed
their check, and a spoilt twin of every span (a wrong check digit, a part beyond 255, no domain). One half of them, by document,
grows the trees; the other half calibrates: scores, in ``GRID`` steps, are turned into precision by isotonic regression, and a kind's
threshold is the least score whose precision reaches ``PRECISION``, one error counted beyond those seen. A kind
with too few spans to show that adds none. Of overlapping proposals the best scored stays.

Texts are read once; what is landed grows with the spans. Spans with equal features are counted together and weighed by their
number, so that each kind and label weighs the same. The values at which trees may part a feature are quantiles of
all that grow them; only those values and the counts of each score step reach the driver.

Defined cases: a null or empty text has no spans; a null id counts as any other; rows that repeat an id are judged one by
one; a table without spans, or an empty one, trains nothing; the time spent on a text grows with its length,
whatever it holds; columns not named are left alone.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhour.llm import spans
from tallyhour.llm.tables import land, own

KINDS = ("email", "ip", "card", "phone")
#: Steps of a score in which spans are counted to find a threshold.
GRID = 1 << 16
#: Values, at most, at which trees may part a feature within a kind.
CUTS = 16
PRECISION = 0.98
TREES = 12
DEPTH = 4
#: Described spans that a task holds at most before it hands them on.
FLUSH = 20_000

# The plain patterns. The part of an email before its @ is looked for backwards.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_MARK = r"[(\[{<][ \t]?%s[ \t]?[)\]}>]"
_LOOSE_AT = re.compile(
    rf"(?:[ \t]?(?:@|{_MARK % 'at'})[ \t]?|[ \t]at[ \t])"
    rf"([a-z0-9-]{{1,63}}(?:(?:[ \t]?\.|[ \t]?{_MARK % 'dot'}[ \t]?|[ \t]dot[ \t])[a-z0-9-]{{1,63}})+)",
    re.IGNORECASE,
)
_LOOSE_DOT = re.compile(rf"[ \t]?\.|[ \t]?{_MARK % 'dot'}[ \t]?|[ \t]dot[ \t]", re.IGNORECASE)
_LOOSE_IP = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:[ \t]?(?:\.|\[\.\]|\(\.\))[ \t]?[0-9]{1,3}){3,}(?![0-9A-Za-z])")
_LOOSE_CARD = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20./_ -]?[0-9]){11,}(?![0-9A-Za-z])")
_LOOSE_PHONE = re.compile(
    r"(?<![0-9A-Za-z.])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,4}\)?){2,5}(?![0-9A-Za-z])"
)
_DIGITS = re.compile(r"[0-9]+")

# Words that announce a kind.
_CUES = {
    "email": ("mail", "contact", "write to", "reach"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "credit", "payment", "cc"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "dial"),
}

_PROPOSAL = "struct<kind: int, start: long, end: long, label: int, features: array<double>>"
_MEASURES = (
    "row_id long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
    f"base array<struct<start: long, kind: int, end: long>>, proposals array<{_PROPOSAL}>"
)


def luhn(digits: str) -> bool:
    doubled = [2 * int(d) - 9 * (d > "4") for d in digits[-2::-2]]
    return (sum(doubled) + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for found in _DOMAIN.finditer(text):
        start = found.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < found.start():
            done = found.end()
            yield start, done


def _octet(part: str) -> int:
    short = part.lstrip("0")
    return int(short or "0") if len(short) <= 3 else 999


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """``(start, kind, end)`` of the plain patterns' matches, in order, and of those that failed their check."""
    good, bad = [], []

    def judge(kind: str, start: int, end: int, passed: bool) -> None:
        (good if passed else bad).append((start, KINDS.index(kind), end))

    if "@" in text:
        for start, end in _emails(text):
            judge("email", start, end, True)
    for found in _IP.finditer(text):
        judge("ip", *found.span(), max(map(_octet, found[0].split("."))) <= 255)
    for found in _CARD.finditer(text):
        length = found.end() - found.start()
        if length >= 12:
            digits = found[0].replace(" ", "").replace("-", "") if length <= 40 else ""
            judge("card", *found.span(), 14 <= len(digits) <= 19 and luhn(digits))
    if "+" in text:
        for found in _PHONE.finditer(text):
            judge("phone", *found.span(), 10 <= sum(map(len, _DIGITS.findall(found[0]))) <= 15)
    return sorted(good), sorted(bad)


def _runs(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Stretches of whole groups, of three digits or more, with 12 to 19 digits inside a longer run."""
    groups = [(start + g.start(), start + g.end()) for g in _DIGITS.finditer(text[start:end])]
    for a, (first, _) in enumerate(groups):
        size = 0
        for left, right in groups[a : a + 6]:
            size += right - left
            if size > 19 or right - left < 3:
                break
            if size >= 12:
                yield first, right


def proposed_spans(text: str) -> set[tuple[int, int, int]]:
    """``(start, kind, end)`` of all that may be personal data; spans may overlap."""
    found: set[tuple[int, int, int]] = set()
    for at in _LOOSE_AT.finditer(text):
        start = at.start()
        while start > max(0, at.start() - 64) and text[start - 1] in _LOCAL:
            start -= 1
        if start < at.start():
            found.add((start, 0, at.end()))
    if not _DIGITS.search(text):
        return found
    for one in _LOOSE_IP.finditer(text):
        parts = list(_DIGITS.finditer(text, *one.span()))
        found |= {(a.start(), 1, b.end()) for a, b in zip(parts, parts[3:])}
    for one in _LOOSE_CARD.finditer(text):
        found |= {(a, 2, b) for a, b in _runs(text, *one.span())}
    found |= {(one.start(), 3, one.end()) for one in _LOOSE_PHONE.finditer(text)}
    return found


def _email_parts(span: str) -> tuple[str, list[str]]:
    local, mark, domain = span.partition("@")
    if not mark:
        at = _LOOSE_AT.search(span)
        local, domain = span[: at.start()], at[1]
    return local.strip(), _LOOSE_DOT.split(domain.strip())


def _place(text: str, at: int) -> float:
    """The class of a neighbouring character."""
    if not 0 <= at < len(text) or text[at] == "\n":
        return 0.0
    char = text[at]
    return 1.0 if char.isspace() else 4.0 if char.isalnum() else 3.0 if char in "\"'=<>" else 2.0


def _format(kind: int, span: str, twin: bool) -> list[float]:
    """Numbers that describe a span without its separators; those of its spoilt ``twin`` if asked for."""
    if KINDS[kind] == "email":
        local, labels = _email_parts(span)
        labels = labels[:1] if twin else labels
        last = labels[-1]
        numbers = [len(local), len(labels), len(last) if len(labels) > 1 else 0, last.isalpha() and len(labels) > 1]
        return [*numbers, max(map(len, labels)), any(c.isdigit() for c in local), local[0].isalnum()]
    groups = _DIGITS.findall(span)
    digits = "".join(groups)
    if KINDS[kind] == "ip":
        octets = [_octet(g) for g in groups]
        octets[-1] += 256 * twin
        padded = any(len(g) > 1 and g[0] == "0" for g in groups)
        return [len(octets), max(octets), padded, len(set(octets)), octets[0], max(octets) > 255, 0]
    if KINDS[kind] == "card":
        checked = luhn(digits) if 12 <= len(digits) <= 19 else False
        sizes = [len(g) for g in groups]
        even = len(sizes) == 1 or max(sizes) <= 6
        return [len(digits), checked and not twin, int(digits[0]), len(set(digits)), even, len(groups) > 6, max(sizes) > 19]
    kept = groups[:-1] + [groups[-1][:1]] if twin and len(groups) > 1 else [digits[:5]] if twin else groups
    before = len(kept[-2]) if len(kept) > 1 else 0
    return [sum(map(len, kept)), len(kept), len(kept[-1]), before, max(map(len, kept)), len(kept[0]) > 4, 0]


def describe(text: str, start: int, kind: int, end: int, twin: bool = False) -> list[float]:
    """Features of a span: its kind, its context and its format."""
    span = text[start:end]
    around = text[max(0, start - 32) : start].lower()
    numbers = [float(kind == k) for k in range(len(KINDS))]
    numbers += [_place(text, start - 1), _place(text, end), float(any(cue in around for cue in _CUES[KINDS[kind]]))]
    # a run too long to be any of the kinds is told by its length alone
    shape = _format(kind, span, twin) if end - start <= 400 else [float(end - start)] * 7
    return numbers + [float(value) for value in shape]


def _measured(text: str, good: list[tuple[int, int, int]], bad: list[tuple[int, int, int]]) -> Iterator[dict]:
    """Described spans: labelled ones, and proposals that meet none of the patterns' spans."""

    def row(start: int, kind: int, end: int, label: int | None, twin: bool = False) -> dict:
        features = describe(text, start, kind, end, twin)
        return {"kind": kind, "start": start, "end": end, "label": label, "features": features}

    for one in good:
        yield row(*one, 1)
        yield row(*one, 0, twin=True)
    for one in bad:
        yield row(*one, 0)
    taken = Taken([(start, end) for start, _, end in good])
    for one in sorted(proposed_spans(text) - set(good) - set(bad)):
        if taken.free(one[0], one[2]):
            yield row(*one, None)


class Taken:
    """Stretches of a text that do not overlap."""

    def __init__(self, stretches: list[tuple[int, int]]):
        self.edges: list[tuple[int, int]] = []
        for start, end in sorted(stretches):
            if self.edges and start < self.edges[-1][1]:
                # base spans of two kinds may overlap; together they are one stretch
                self.edges[-1] = (self.edges[-1][0], max(end, self.edges[-1][1]))
            else:
                self.edges.append((start, end))

    def free(self, start: int, end: int) -> bool:
        at = bisect.bisect_left(self.edges, (start, start))
        after = self.edges[at][0] if at < len(self.edges) else end
        before = self.edges[at - 1][1] if at else start
        return before <= start and end <= after

    def add(self, start: int, end: int) -> None:
        bisect.insort(self.edges, (start, end))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and rows without counts for proposals beyond ``FLUSH``."""
    edge = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    fields = [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("label", pa.int32())]
    proposal = pa.list_(pa.struct([*fields, ("features", pa.list_(pa.float64()))]))
    types = [pa.int64()] * (2 + len(KINDS)) + [edge, proposal]
    names = ["row_id", "doc_id", *[f"n_{kind}" for kind in KINDS], "base", "proposals"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in spans.slices(batches, "text"):
        rows, waiting = [], 0
        for row_id, doc_id, text in zip(batch.column("row_id"), batch.column("doc_id"), batch.column("text")):
            row_id, doc_id, text = row_id.as_py(), doc_id.as_py(), text.as_py()
            good, bad = base_spans(text)
            proposals: list[dict] = []
            for one in _measured(text, good, bad):
                proposals.append(one)
                if len(proposals) + waiting >= FLUSH:
                    yield batch_of([*rows, (row_id, doc_id, *[None] * len(KINDS), None, proposals)])
                    rows, proposals, waiting = [], [], 0
            waiting += len(proposals)
            base = [{"start": s, "kind": k, "end": e} for s, k, e in good]
            rows.append((row_id, doc_id, *[sum(k == kind for _, k, _ in good) for kind in range(len(KINDS))], base, proposals))
        if rows:
            yield batch_of(rows)


def _labelled(proposals: DataFrame) -> DataFrame:
    """``kind, label, held_out, features, n``: all labelled spans, equal ones together; ``held_out`` goes by document."""
    fold = F.pmod(F.hash(F.lit(7), "doc_id"), F.lit(2)) == 1
    keys = ["kind", F.col("label").cast("double").alias("label"), fold.alias("held_out"), "features"]
    return proposals.where(F.col("label").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _cuts(training: DataFrame) -> list[list[float]]:
    """For each feature the values that trees may part it at: quantiles within each kind."""
    places = [k / CUTS for k in range(CUTS)]
    found = (
        training.select("kind", F.posexplode("features").alias("at", "value"))
        .groupBy("kind", "at")
        .agg(F.percentile_approx("value", places).alias("cuts"))
        .select("at", F.explode("cuts").alias("cut"))
        .groupBy("at")
        .agg(F.sort_array(F.collect_set("cut")).alias("cuts"))
    )
    return [row.cuts for row in found.orderBy("at").collect()]


def _parted(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """Features as one binary value for each cut, marked as such: trees then need no sample of rows to find their splits."""

    def above(at: int, values: list[float]) -> Column:
        return F.transform(F.array(*map(F.lit, values)), lambda cut: (F.col("features")[at] > cut).cast("double"))

    width = sum(map(len, cuts))
    marks = {"ml_attr": {"attrs": {"binary": [{"idx": k, "name": f"f{k}"} for k in range(width)]}, "num_attrs": width}}
    return rows.withColumn("features", array_to_vector(F.concat(*map(above, range(len(cuts)), cuts))).alias("features", metadata=marks))


def calibrated_threshold(
    scores: np.ndarray, labels: np.ndarray, precision: float, counts: np.ndarray | None = None
) -> float | None:
    """The least score from which isotonic precision reaches ``precision``, with one error more than was seen.

    With ``counts``, each score stands for so many rows, of which ``labels`` are positive.
    """
    order = np.argsort(-scores, kind="stable")
    counts = np.ones(len(scores)) if counts is None else counts
    scores, labels, counts = scores[order], labels[order], counts[order]
    blocks: list[list[float]] = []  # positives, rows and least score, by falling score
    for score, label, count in zip(scores.tolist(), labels.tolist(), counts.tolist()):
        if blocks and blocks[-1][2] == score:
            blocks[-1][0] += label
            blocks[-1][1] += count
        else:
            blocks.append([label, count, score])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] <= blocks[-1][0] * blocks[-2][1]:
            hits, rows, least = blocks.pop()
            blocks[-1] = [blocks[-1][0] + hits, blocks[-1][1] + rows, least]
    hits = rows = 0.0
    best = None
    for block_hits, block_rows, least in blocks:
        if block_hits < precision * block_rows:
            break
        hits, rows = hits + block_hits, rows + block_rows
        if hits >= precision * (rows + 1):
            best = least
    return best


def _scored(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("step", F.floor(F.col("score") * GRID))


def _fit(
    proposals: DataFrame, precision: float, trees: int, depth: int
) -> tuple[GBTClassificationModel, list[list[float]], dict[int, float]] | None:
    """Boosted trees, the cuts of their features and each kind's threshold; None without rows of both labels to learn from."""
    labelled = land(_labelled(proposals), "pii-labelled")
    training = labelled.where(~F.col("held_out"))
    if training.select("label").distinct().count() < 2:
        return None
    cuts = _cuts(training)
    totals = training.groupBy("kind", "label").agg(F.sum("n").alias("total"))
    mean = F.lit(totals.agg(F.avg("total")).first()[0])
    weighed = training.join(F.broadcast(totals), ["kind", "label"]).withColumn("weight", F.col("n") * mean / F.col("total"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=12, weightCol="weight").fit(_parted(weighed, cuts))
    judged = _scored(model, _parted(labelled.where("held_out"), cuts)).groupBy("kind", "step").agg(
        F.sum(F.col("label") * F.col("n")).alias("hits"), F.sum("n").alias("n")
    )
    judged = judged.toArrow()
    kind, step, hits, n = (judged.column(name).to_numpy() for name in ("kind", "step", "hits", "n"))
    found = {}
    for k in range(len(KINDS)):
        of = kind == k
        found[k] = calibrated_threshold(step[of], hits[of], precision, n[of])
    return model, cuts, {k: threshold for k, threshold in found.items() if threshold is not None}


def _written(edges: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(edges))


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All spans of each row: those of the patterns, then proposals by score wherever nothing is taken."""
    for batch in batches:
        base_text, every = [], []
        for base, accepted in zip(batch.column("base").to_pylist(), batch.column("accepted").to_pylist()):
            edges = [(one["start"], one["kind"], one["end"]) for one in base]
            base_text.append(_written(edges))
            taken = Taken([(start, end) for start, _, end in edges])
            ranked = sorted(accepted or [], key=lambda one: (-one["score"], one["start"] - one["end"], one["start"], one["kind"]))
            for one in ranked:
                if taken.free(one["start"], one["end"]):
                    taken.add(one["start"], one["end"])
                    edges.append((one["start"], one["kind"], one["end"]))
            every.append(_written(edges))
        columns = [batch.column(name) for name in batch.schema.names if name not in ("base", "accepted")]
        names = [name for name in batch.schema.names if name not in ("base", "accepted")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(base_text, pa.string()), pa.array(every, pa.string())], names=[*names, "base_spans", "spans"])


def personal_data(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    precision: float = PRECISION,
    trees: int = TREES,
    depth: int = DEPTH,
) -> DataFrame:
    """``row_id, doc_id``, counts of the patterns' spans, ``base_spans`` and ``spans`` of each row.

    Spans are written ``kind:start:end``, in code points, the end exclusive; ``redacted`` cuts them out of a text.
    """
    rows = own(documents, {"doc_id": id_column, "text": text_column}).select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    measured = land(rows.mapInArrow(_measure, _MEASURES), "pii")
    proposals = measured.select("row_id", "doc_id", F.inline("proposals"))
    texts = measured.where(F.col("base").isNotNull()).drop("proposals")
    fitted = _fit(proposals, precision, trees, depth)
    if fitted:
        model, cuts, thresholds = fitted
        chosen = F.lit(False)
        for kind, threshold in thresholds.items():
            chosen = chosen | ((F.col("kind") == kind) & (F.col("step") >= F.lit(threshold)))
        open_ = _parted(proposals.where(F.col("label").isNull()), cuts)
        accepted = (
            _scored(model, open_)
            .where(chosen)
            .groupBy("row_id")
            .agg(F.collect_list(F.struct("kind", "start", "end", "score")).alias("accepted"))
        )
        joined = texts.join(accepted, "row_id", "left")
    else:
        kind = "array<struct<kind: int, start: long, end: long, score: double>>"
        joined = texts.withColumn("accepted", F.lit(None).cast(kind))
    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    return joined.select("row_id", "doc_id", *[f"n_{kind}" for kind in KINDS], "base", "accepted").mapInArrow(
        _select, f"row_id long, doc_id long, {counts}, base_spans string, spans string"
    )


def redacted(text: str, written: str) -> str:
    """``text`` with every span of ``written`` replaced by its kind in brackets; of overlapping ones, by the first's."""
    out, at = [], 0
    for one in filter(None, written.split(",")):
        kind, start, end = one.split(":")
        if int(start) >= at:
            out += [text[at : int(start)], f"[{kind}]"]
        at = max(at, int(end))
    return "".join([*out, text[at:]])
