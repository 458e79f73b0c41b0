"""Fill-in-middle transformation: a text is cut twice, and its middle moved to the end.

The units of a text (its code points, or the matches of a pattern from left to right) are the bottom lane of an
indexable skip list. A node of a lane rises to the lane above with chance one in ``FAN``; every node of
an express lane carries two widths up to the next one: how many units it spans and how many code points. A cut after
``r`` units is found from the top lane down: go along while the units passed stay within ``r``, else go down. The code
points passed on the way are the place of the cut.

Cuts and form follow a hash of the document's id, so they are the same in every run. ``restore`` gives the text back
from output and form alone: a text that holds a sentinel stays plain, and sentinels that could
arise across a seam are refused.

Each text is taken by itself; memory grows with the longest text, lanes adding about one number for each eight
units of it (code points) or three for each unit (a pattern).

Defined cases: a null or empty text is plain, with an empty output and no units; a null id counts as an empty
one; rows that repeat an id are cut alike if their texts are; an empty table gives no rows; columns not
named are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhour.llm import spans
from tallyhour.llm.tables import own

#: One node in so many rises to the next lane.
FAN = 16
#: Of 100 texts, how many are transformed; and of 100 of those, how many have their suffix first.
RATE = 90
SUFFIX_FIRST = 20

_FIELDS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Sentinels:
    """What marks prefix, suffix and middle in an output."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = list(enumerate(self.all()))
        for a, one in marks:
            for b, other in marks:
                lapped = any(one.endswith(other[:n]) for n in range(1, min(len(one), len(other) + 1)))
                if not one or lapped or (a != b and one in other):
                    raise ValueError(f"{one!r} and {other!r} could be mistaken for each other")

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class SkipList:
    """The units of one text, with express lanes. ``widths`` is None if every unit is one code point."""

    def __init__(self, n: int, widths: np.ndarray | None = None, fan: int = FAN):
        self.n, self.widths = n, widths
        #: From the second lane up: units and code points that each node spans, and its place in the lane below.
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        chance = np.random.default_rng(n)
        units, points, size = None, widths, n
        while size > fan:
            risen = self._risen(chance, size, fan)
            above_units = np.diff(risen, append=size) if units is None else np.add.reduceat(units, risen)
            above_points = above_units if points is None else np.add.reduceat(points, risen)
            self.lanes.append((above_units, above_points, risen))
            units, points, size = above_units, above_points, len(risen)

    @staticmethod
    def _risen(chance: np.random.Generator, size: int, fan: int) -> np.ndarray:
        """Places of the nodes that rise, the head among them: gaps of independent chances are geometric."""
        draws = size // fan + 4 * int(np.sqrt(size)) + 8
        places = np.concatenate([[0], np.cumsum(chance.geometric(1 / fan, draws))])
        return places[: max(1, min(int(np.searchsorted(places, size)), size // 2))]

    def seek(self, rank: int) -> int:
        """Code points before the unit of that rank; those of the whole text at the end."""
        node = passed = at = 0
        for units, points, down in reversed(self.lanes):
            last = len(units) - 1
            while node < last and passed + units[node] <= rank:
                passed += int(units[node])
                at += int(points[node])
                node += 1
            node = int(down[node])
        while passed < rank:
            at += 1 if self.widths is None else int(self.widths[node])
            passed += 1
            node += 1
        return at


def unit_widths(text: str, pattern: re.Pattern) -> np.ndarray:
    """Code points of each unit: every match, and every stretch between matches."""
    edges = {0, len(text)}
    for found in pattern.finditer(text):
        edges |= {found.start(), found.end()}
    return np.diff(np.array(sorted(edges), np.int64))


def _draws(doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def _transform(text: str, doc_id: int | None, pattern, marks: Sentinels, rate: int, suffix_first: int):
    widths = unit_widths(text, pattern) if pattern and text else None
    n = len(text) if widths is None else len(widths)
    h1, h2, h3, h4 = _draws(doc_id)
    if not text or h3 % 100 >= rate or any(mark in text for mark in marks.all()):
        return n, "plain", None, None, text
    units = SkipList(n, widths)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = units.seek(low), units.seek(high)
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < suffix_first:
        output = f"{marks.suffix}{suffix}{marks.prefix}{prefix}{marks.middle}{middle}"
        return n, "spm", first, second - first, output
    return n, "psm", first, second - first, f"{marks.prefix}{prefix}{marks.suffix}{suffix}{marks.middle}{middle}"


def fill_in_middle(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    unit: str | None = None,
    sentinels: Sentinels = Sentinels(),
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of each row.

    ``unit`` is a pattern whose matches are not cut, such as ``\\S+\\s*``; without one a unit is a code point.
    ``n`` counts units. ``form`` is plain, psm or spm.
    """
    rows = own(documents, {"doc_id": id_column, "text": text_column}).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit) if unit else None
        for batch in spans.slices(batches, "text"):
            ids = batch.column("doc_id")
            made = [
                _transform(text.as_py(), doc_id.as_py(), pattern, sentinels, rate, suffix_first)
                for doc_id, text in zip(ids, batch.column("text"))
            ]
            n, form, prefix, middle, output = zip(*made) if made else ((),) * 5
            columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64())]
            columns += [pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=names)

    return rows.mapInArrow(run, _FIELDS)


def restore(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text that an output of that form was made from."""

    first = F.when(form == "psm", F.lit(sentinels.prefix)).otherwise(F.lit(sentinels.suffix))
    second = F.when(form == "psm", F.lit(sentinels.suffix)).otherwise(F.lit(sentinels.prefix))
    body = F.substr(output, F.length(first) + 1)
    seam = F.instr(body, second)
    one, rest = F.substr(body, F.lit(1), seam - 1), F.substr(body, seam + F.length(second))
    last = F.instr(rest, F.lit(sentinels.middle))
    two, middle = F.substr(rest, F.lit(1), last - 1), F.substr(rest, last + F.lit(len(sentinels.middle)))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def digests(transformed: DataFrame) -> DataFrame:
    """Hashes in place of the outputs: of each output, and of the text rebuilt from it."""
    back = restore(F.col("output"), F.col("form"))
    return transformed.withColumns(
        {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(back, 256)}
    ).drop("output")


ORACLE_SQL = f"""
WITH cut AS (
  SELECT doc_id, COALESCE(text, '') AS text, length(COALESCE(text, '')) AS n,
         sha256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS c4
  FROM cut
), formed AS (
  SELECT *, least(c1, c2) AS low, greatest(c1, c2) AS high,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c3 >= {RATE}
              THEN 'plain' WHEN c4 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, substr(text, 1, low) AS prefix, substr(text, low + 1, high - low) AS middle, substr(text, high + 1) AS suffix
  FROM formed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(low AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(high - low AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
