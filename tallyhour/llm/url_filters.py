"""URL filters: host rules, and a Bloom filter cascade for listed keys, in built-in functions only.

The keys of a page are its host, the parent domains of the host and the host with the path. The universe holds every key
of the corpus. Level 1 of the cascade holds the listed keys; each further level holds the keys of
the universe that the level before passes wrongly, until there are none. A key is listed if an odd number of
levels pass it in a row. That is exact for every key of the universe, and pages need no join.

A level is one array of 64-bit words, read by scalar subquery. Its size follows from the number of
listed keys. Levels of more than ``MAX_BYTES`` together are not sent to the tasks: pages then meet the list
by a join on their keys.

Defined cases: a null url, or one without ``://``, has an empty host and path, no key and no rule, and is
allowed; rows that repeat an id or url are judged one by one; an empty table gives no rows; a list
without keys blocks nothing; columns not named are left alone.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from tallyhour.llm.tables import land, own

#: Rules of the query: host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Terms in the first label of a domain that put it on the query's list.
FLAGGED = ("adult", "ads-track", "bets", "casino", "pills", "spam")
MAX_BYTES = 32 << 20


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path`` to rows with ``url``."""
    at = F.coalesce(F.instr("url", "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(F.col("url"), at + F.lit(3), F.length("url"))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("rest", rest).withColumn("host", host).withColumn("path", path).drop("rest")


def page_keys(host: Column, path: Column) -> Column:
    """The host, its parent domains, and the host with the path; none without a host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(domains, F.array(F.concat(host, path))))
    )


def _bit(key: Column, level: int, number: int, n_bits: int) -> Column:
    """The place of one of a key's bits."""
    one, two = F.xxhash64(key, F.lit(level)), F.xxhash64(key, F.lit(-1 - level))
    # a mask keeps the product's sign and overflow out of the way
    mixed = one.bitwiseAND(F.lit((1 << 40) - 1)) + F.lit(number) * two.bitwiseAND(F.lit((1 << 40) - 1))
    return F.pmod(mixed, F.lit(n_bits))


def _level(keys: DataFrame, n_keys: int, rate: float, level: int) -> tuple[DataFrame, int, int]:
    """A one-row frame with the words of a filter, its bits and its number of hashes."""
    rate = min(0.5, max(rate, 1e-9))
    n_hashes = max(1, round(-math.log2(rate)))
    n_words = max(1, math.ceil(-n_keys * math.log(rate) / math.log(2) ** 2 / 64))
    n_bits = 64 * n_words
    places = F.array(*[_bit(F.col("key"), level, number, n_bits) for number in range(n_hashes)])
    bits = keys.select(F.explode(places).alias("place")).select(
        F.floor(F.col("place") / 64).cast("long").alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int")).alias("bits"),
    )
    empty = keys.sparkSession.range(n_words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = bits.union(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    one_row = words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all")).select(
        F.transform("all", lambda one: one["bits"]).alias("words")
    )
    return land(one_row, f"level{level}"), n_bits, n_hashes


class Cascade:
    """Levels of filters, and the test of a key."""

    def __init__(self):
        self.levels: list[tuple[DataFrame, int, int]] = []

    def passes(self, key: Column, level: int) -> Column:
        words, n_bits, n_hashes = self.levels[level]
        array = words.select("words").scalar()
        found = F.lit(True)
        for number in range(n_hashes):
            place = _bit(key, level, number, n_bits)
            word = F.get(array, F.floor(place / 64).cast("int"))
            found = found & (F.bit_get(word, F.pmod(place, F.lit(64)).cast("int")) == F.lit(1).cast("byte"))
        return found

    def lists(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            verdict = F.when(self.passes(key, level), verdict).otherwise(F.lit(level % 2 == 1))
        return verdict

    @property
    def n_bytes(self) -> int:
        return sum(n_bits // 8 for _, n_bits, _ in self.levels)


def build_cascade(universe: DataFrame, listed: DataFrame, max_bytes: int = MAX_BYTES) -> Cascade | None:
    """A cascade over ``key`` rows, none if a level would pass ``max_bytes``; ``listed`` lies within ``universe``."""
    inside, outside = land(listed, "listed"), land(universe.join(listed, "key", "left_anti"), "unlisted")
    n_inside, n_outside = inside.count(), outside.count()
    cascade = Cascade()
    while n_inside:
        level = len(cascade.levels)
        rate = n_inside * math.sqrt(0.5) / max(n_outside, 1) if level == 0 else 0.5
        if n_inside * -math.log(min(0.5, max(rate, 1e-9))) / math.log(2) ** 2 / 8 > max_bytes - cascade.n_bytes:
            return None
        cascade.levels.append(_level(inside, n_inside, rate, level))
        wrong = land(outside.where(cascade.passes(F.col("key"), level)), f"passed{level}")
        inside, outside = wrong, inside
        n_inside, n_outside = wrong.count(), n_inside
    return cascade


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null if none does."""
    fits = []
    for rule_host, rule_path, verdict in sorted(rules, key=lambda rule: -len(rule[0] + rule[1])):
        inside = (host == rule_host) | host.endswith("." + rule_host)
        found = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(inside & path.startswith(rule_path), found))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule: string, verdict: string>")


def flagged_keys(universe: DataFrame, terms=FLAGGED) -> DataFrame:
    """The domains of the universe whose first label has one of the terms."""
    return universe.where(F.col("key").rlike(rf"^[^./]*({'|'.join(terms)})[^./]*\.[^/]*$"))


def url_filters(
    pages: DataFrame,
    listed=flagged_keys,
    rules=RULES,
    id_column: str = "page_id",
    url_column: str = "url",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` of each row.

    ``listed`` is a frame of ``key``, or a function that picks the listed ones from the universe.
    """
    parts = with_parts(own(pages, {"page_id": id_column, "url": url_column})).withColumn(
        "keys", page_keys(F.col("host"), F.col("path"))
    )
    universe = land(parts.select(F.explode("keys").alias("key")).distinct(), "keys")
    if callable(listed):
        chosen = listed(universe)
    else:
        chosen = universe.join(listed.select("key").distinct(), "key", "left_semi")
    cascade = build_cascade(universe, chosen, max_bytes)
    if cascade is None:
        # too large to send to every task: the list meets the keys by a shuffle
        rows = land(parts.withColumn("row_id", F.monotonically_increasing_id()), "rows")
        hits = rows.select("row_id", F.explode("keys").alias("key")).join(chosen.select("key"), "key", "left_semi")
        hits = hits.select("row_id").distinct().withColumn("listed", F.lit(True))
        judged = rows.join(hits, "row_id", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        # the keys of a row stay in its task, so one row for each page is shuffled
        each = parts.withColumn("row_id", F.monotonically_increasing_id()).select(
            "row_id", "page_id", "host", "path", F.explode_outer("keys").alias("key")
        )
        judged = each.groupBy("row_id").agg(
            F.any_value("page_id").alias("page_id"),
            F.any_value("host").alias("host"),
            F.any_value("path").alias("path"),
            F.coalesce(F.bool_or(cascade.lists(F.col("key"))), F.lit(False)).alias("listed"),
        )
    rule = rule_of(F.col("host"), F.col("path"), rules)
    own_verdict = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumn("fit", rule).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", own_verdict).alias("verdict"), "listed",
    )


_ANY_TERM = "|".join(FLAGGED)
ORACLE_SQL = f"""
WITH rested AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, lower(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rested
), ruled AS (
  SELECT *, regexp_matches(host, '(^|\\.)[^./]*({_ANY_TERM})[^./]*\\.') AS listed, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM ruled
"""
