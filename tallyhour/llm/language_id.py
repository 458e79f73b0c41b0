"""Language identification by Bayesian evidence fusion.

Text: byte trigrams of lower-cased words, hashed to ``BUCKETS``, under one multinomial for each language of the
labelled rows; their log likelihood is tempered by ``TEXT_POWER``, as trigrams overlap and depend on each other.
Declared language, address suffix (top-level domain and a leading path part of two letters) and host are
further evidence. Their distributions come from grouped aggregates over all rows, by the language the
text alone gives: how often a language declares each value, how often it stands under each suffix, and a
prior of each host that is smoothed by that of its parent domain, and that by the prior of all rows, each weighing
``SMOOTHING`` rows. The posterior is the product, made to sum to one.

A row is accepted if it has ``MIN_LETTERS`` letters, its best language reaches ``MIN_CONFIDENCE``, and its text fits that
language. The posterior only compares trained languages; whether it is any of them is told by the mean log likelihood of its trigrams.
That may lie ``WIDTH`` deviations below the mean of the language's own labelled rows, where rows deviate as the labelled ones do
(with ``SMOOTHING`` rows of deviation 1 added) and by the sampling of their trigrams, but never below that of even chances for all
buckets. A row whose text does not fit has no text language, and is no evidence for others.

Training counts every labelled row, and then measures each against its language; the model has ``BUCKETS`` numbers for each language, and more than
``MAX_LANGUAGES`` languages are an error, which bounds what is sent to the workers.

Defined cases: a null or empty text has no likelihood, and one without letters is not accepted and has language null;
a null declared value, suffix or host gives no evidence of its kind; without labelled rows nothing is
accepted; rows that repeat an id are judged one by one; ties go to the first language in order;
an empty table gives no rows; columns not named are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from tallyhour.llm import spans
from tallyhour.llm.html_extraction import main_text
from tallyhour.llm.tables import checked, land, own
from tallyhour.llm.url_filters import with_parts

BUCKETS = 1 << 14
MAX_LANGUAGES = 256
TEXT_POWER = 0.05
SMOOTHING = 10.0
MIN_LETTERS = 10
MIN_CONFIDENCE = 0.5
WIDTH = 7.0

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(ord("a"), ord("z") + 1), *range(0xC3, 0xF5)]] = True


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each trigram, trigrams of each text, letters of each text."""
    parts, lengths = [], []
    for text in column:
        joined = b" " + b" ".join(text.as_buffer().to_pybytes().lower().split()) + b" "
        parts.append(joined)
        lengths.append(len(joined))
    data = np.frombuffer(b"".join(parts), np.uint8)
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    wide = data.astype(np.uint64)
    keys = (wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:]
    buckets = (spans.mix(keys) & np.uint64(BUCKETS - 1)).astype(np.int64)
    n = np.maximum(np.diff(offsets) - 2, 0)
    inside = np.ones(len(data), bool)
    inside[offsets[1:] - 1] = False
    inside[np.maximum(offsets[1:] - 2, 0)] = False
    return buckets[inside[:-2]], n, spans.counts_between(_LETTERS[data], offsets)


def _pages_as_text(batch: pa.RecordBatch) -> pa.Array:
    return pa.array([main_text(page.as_py()) for page in batch.column("text")], pa.string())


class Model:
    """Languages, the logarithms of their trigram distributions, and how labelled rows lie under them."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))

        shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        self.means = (shares * self.logs).sum(axis=1)
        self.gram_variances = (shares * (self.logs - self.means[:, None]) ** 2).sum(axis=1)
        self.row_variances = np.ones(len(languages))

    def measured(self, label: str, n: int, sum_: float, squares: float) -> None:
        """Take the mean and variance of a language from the mean log likelihoods of its rows."""
        at = self.languages.index(label)
        self.means[at] = sum_ / n
        self.row_variances[at] = (max(0.0, squares - sum_ * sum_ / n) + SMOOTHING) / (n + SMOOTHING)

    def fits(self, likelihoods: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether each text may be of each language, whatever the other languages say."""
        n = np.maximum(n, 1)[:, None]
        least = self.means - WIDTH * np.sqrt(self.row_variances + self.gram_variances / n)
        return likelihoods / n >= np.maximum(least, -np.log(BUCKETS))

    def likelihoods(self, buckets: np.ndarray, n: np.ndarray) -> np.ndarray:
        text = np.repeat(np.arange(len(n)), n)
        columns = [np.bincount(text, logs[buckets], len(n)) for logs in self.logs]
        return np.array(columns, np.float64).T.reshape(len(n), len(self.languages))


def train(labelled: DataFrame, text_column: str = "text", label_column: str = "lang") -> Model:
    """Count the trigrams of every labelled row by language."""
    rows = own(labelled, {"text": text_column, "label": label_column}).where("label is not null").select(
        F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("string").alias("label")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in spans.thrifty(batches, "text"):
            labels = np.array(batch.column("label").to_pylist())
            for label in np.unique(labels).tolist():
                buckets, _, _ = _grams(batch.column("text").filter(pa.array(labels == label)))
                if label not in counts and len(counts) >= MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
                counts[label] = counts.get(label, 0) + np.bincount(buckets, minlength=BUCKETS)
        for label, one in counts.items():
            found = np.flatnonzero(one)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(found)), pa.array(found.astype(np.int32)), pa.array(one[found])],
                names=["label", "bucket", "n"],
            )

    sums = rows.mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    table = land(sums, "trigrams")
    languages = sorted(row["label"] for row in table.select("label").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(languages), BUCKETS))
    found = table.toArrow()
    place = {label: at for at, label in enumerate(languages)}
    rows_ = np.array([place[label] for label in found.column("label").to_pylist()], np.int64)
    counts[rows_, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    model = Model(languages, counts)
    held = labelled.sparkSession.sparkContext.broadcast(model)
    moments = rows.mapInArrow(lambda batches: _moments(batches, held.value), "label string, n long, sum double, squares double")
    for row in moments.groupBy("label").agg(*[F.sum(name).alias(name) for name in ("n", "sum", "squares")]).collect():
        model.measured(*row)
    return model


def _moments(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Number, sum and sum of squares of the mean log likelihoods of rows under their own language."""
    sums: dict[str, np.ndarray] = {}
    for batch in spans.thrifty(batches, "text"):
        labels = np.array(batch.column("label").to_pylist())
        buckets, n, letters = _grams(batch.column("text"))
        own_language = np.searchsorted(model.languages, labels)
        text = np.repeat(np.arange(len(n)), n)
        mean = np.bincount(text, model.logs[own_language[text], buckets], len(n)) / np.maximum(n, 1)
        for label in np.unique(labels[letters >= MIN_LETTERS]).tolist():
            values = mean[(labels == label) & (letters >= MIN_LETTERS)]
            sums[label] = sums.get(label, 0) + np.array([len(values), values.sum(), (values**2).sum()])
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums)), *[pa.array([one[k] for one in sums.values()]).cast(kind) for k, kind in enumerate((pa.int64(), pa.float64(), pa.float64()))]],
            names=["label", "n", "sum", "squares"],
        )


def page_evidence(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Rows of pages as evidence: the page itself as ``text``, declared language, suffix, host."""
    rows = with_parts(own(pages, {"page_id": id_column, "url": url_column, "html": html_column}))
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-zA-Z]+)", 1)
    top = F.substring_index("host", ".", -1)
    section = F.regexp_extract("path", r"^/([A-Za-z]{2})(?:/|$)", 1)
    return rows.select(
        F.col("page_id").cast("long").alias("id"),
        F.coalesce("html", F.lit("")).alias("text"),
        F.when(declared != "", F.lower(declared)).alias("declared"),
        F.when(F.col("host") != "", F.concat_ws("/", top, F.lower(section))).alias("suffix"),
        F.when(F.col("host") != "", F.col("host")).alias("host"),
    )


def document_evidence(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", declared_column: str = "lang", host_column: str = "source"
) -> DataFrame:
    """Rows of documents as evidence; they have no address."""
    rows = own(documents, {"id": id_column, "text": text_column, "declared": declared_column, "host": host_column})
    return rows.select(
        F.col("id").cast("long").alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lower(F.col("declared").cast("string")).alias("declared"),
        F.lit(None).cast("string").alias("suffix"),
        F.col("host").cast("string").alias("host"),
    )


def _text_evidence(rows: DataFrame, model, as_pages: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in spans.thrifty(batches, "text"):
            buckets, n, letters = _grams(_pages_as_text(batch) if as_pages else batch.column("text"))
            likelihoods = known.likelihoods(buckets, n)
            width = likelihoods.shape[1]
            bounds = pa.array(np.arange(0, width * len(n) + 1, width, dtype=np.int32) if width else np.zeros(len(n) + 1, np.int32))
            has = (letters >= MIN_LETTERS) & (width > 0)
            best = likelihoods.argmax(axis=1) if width else np.zeros(len(n), np.int64)
            fits = known.fits(likelihoods, n)
            fitting = has & (fits[np.arange(len(n)), best] if width else False)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_id"),
                    batch.column("id"),
                    batch.column("declared"),
                    batch.column("suffix"),
                    batch.column("host"),
                    pa.array(letters),
                    pa.array(best.astype(np.int32), mask=~fitting),
                    pa.ListArray.from_arrays(bounds, pa.array(likelihoods.reshape(-1))),
                    pa.ListArray.from_arrays(bounds, pa.array(fits.reshape(-1))),
                ],
                names=["row_id", "id", "declared", "suffix", "host", "letters", "best", "likelihoods", "fits"],
            )

    return rows.mapInArrow(
        run,
        "row_id long, id long, declared string, suffix string, host string, letters long, best int, likelihoods array<double>, "
        "fits array<boolean>",
    )


def _counts(rows: DataFrame, key: Column, name: str, n_languages: int) -> DataFrame:
    """Rows of each language by text, for each value of ``key``."""
    each = F.array(*[F.count_if(F.col("best") == at).cast("double") for at in range(n_languages)])
    return rows.where("best is not null").select(key.alias(name), "best").where(F.col(name).isNotNull()).groupBy(name).agg(
        each.alias(f"{name}_counts")
    )


def _logs_given_language(counts: DataFrame, name: str, by_language: list[float]) -> DataFrame:
    """Log probability of each value under each language, with one added to every count."""
    n_values = counts.count() + 1
    totals = F.array(*[F.lit(float(total)) for total in by_language])
    logs = F.zip_with(f"{name}_counts", totals, lambda n, total: F.log((n + 1) / (total + n_values)))
    return counts.select(name, logs.alias(f"{name}_logs"))


def _smoothed(counts: Column, prior: Column, weight: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda sum_, n: sum_ + n)
    return F.zip_with(counts, prior, lambda n, p: (n + F.lit(weight) * p) / (total + F.lit(weight)))


def host_priors(rows: DataFrame, overall: list[float], smoothing: float = SMOOTHING) -> DataFrame:
    """``host, host_logs``: log prior of each host, smoothed by its parent domain's, and that by all rows'."""
    parent = F.when(F.instr("host", ".") > 0, F.substring_index("host", ".", -2)).otherwise(F.lit(""))
    hosts = _counts(rows, F.col("host"), "host", len(overall)).withColumn("parent", parent)
    sums = F.array(*[F.sum(F.col("host_counts")[at]) for at in range(len(overall))])
    parents = hosts.groupBy("parent").agg(sums.alias("parent_counts"))
    base = F.array(*[F.lit(p) for p in overall])
    parents = parents.select("parent", _smoothed(F.col("parent_counts"), base, smoothing).alias("parent_prior"))
    joined = hosts.join(checked(parents, row_bytes=256 + 8 * len(overall)), "parent")
    prior = _smoothed(F.col("host_counts"), F.col("parent_prior"), smoothing)
    return joined.select("host", F.transform(prior, lambda p: F.log(p)).alias("host_logs"))


def language_id(
    rows: DataFrame,
    model: Model,
    as_pages: bool = False,
    text_power: float = TEXT_POWER,
    smoothing: float = SMOOTHING,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """``row_id, id, host, declared, suffix, text_language, language, confidence, accepted`` of each row.

    ``rows`` holds ``id, text, declared, suffix, host``, as the two functions above make them.
    """
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(model)
    numbered = rows.withColumn("row_id", F.monotonically_increasing_id())
    evidence = land(_text_evidence(numbered, held, as_pages), "evidence")
    n_languages = len(model.languages)
    if not n_languages:
        nothing = F.lit(None).cast("string")
        return evidence.select(
            "row_id", "id", "host", "declared", "suffix", nothing.alias("text_language"), nothing.alias("language"),
            F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"),
        )
    found = evidence.agg(*[F.count_if(F.col("best") == at).alias(f"n{at}") for at in range(n_languages)]).first()
    by_language = [float(n or 0) for n in found]
    overall = [(n + 1) / (sum(by_language) + n_languages) for n in by_language]
    joined = evidence
    for name in ("declared", "suffix"):
        logs = land(_logs_given_language(_counts(evidence, F.col(name), name, n_languages), name, by_language), name)
        joined = joined.join(checked(logs, row_bytes=64 + 8 * n_languages), name, "left")
    hosts = land(host_priors(evidence, overall, smoothing), "hosts")
    joined = joined.join(checked(hosts, row_bytes=256 + 8 * n_languages), "host", "left")

    none = F.array(*[F.lit(0.0)] * n_languages)
    prior = F.coalesce("host_logs", F.array(*[F.log(F.lit(p)) for p in overall]))

    def plus(left: Column, right: Column) -> Column:
        return F.zip_with(left, right, lambda a, b: a + b)

    logs = plus(
        plus(F.transform("likelihoods", lambda x: x * F.lit(text_power)), prior),
        plus(F.coalesce("declared_logs", none), F.coalesce("suffix_logs", none)),
    )
    joined = joined.withColumn("logs", logs).withColumn("most", F.array_max("logs"))
    total = F.aggregate("logs", F.lit(0.0), lambda sum_, x: sum_ + F.exp(x - F.col("most")))
    names = F.array(*[F.lit(name) for name in model.languages])
    has = F.col("letters") >= MIN_LETTERS
    first = F.array_position("logs", F.col("most")).cast("int")
    language = F.when(has, F.element_at(names, first))
    confidence = F.when(has, 1 / total).otherwise(F.lit(0.0))
    return joined.select(
        "row_id",
        "id",
        "host",
        "declared",
        "suffix",
        F.get(names, F.col("best")).alias("text_language"),
        language.alias("language"),
        confidence.alias("confidence"),
        (has & (confidence >= min_confidence) & F.element_at("fits", first)).alias("accepted"),
    )
