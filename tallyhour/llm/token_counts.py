"""Token counts by a compiled finite-state transducer; see ``tokens`` for the method.

Defined cases: a null text counts as empty and has no tokens; rows that repeat an id are counted
one by one; a null id stays null; an empty table gives no rows; columns not named are left alone.
No shuffle: each text is counted where it is read, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhour.llm import spans
from tallyhour.llm.tables import own

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512


def token_counts(
    documents: DataFrame,
    tokenizer: str | None = None,
    limit: int = LIMIT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row; ``tokenizer`` is a file's path on the workers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallyhour.llm.tokens import tokenize

        path = tokenizer or public_tokenizers.path(TOKENIZER)
        for batch in spans.slices(batches, "text"):
            text = batch.column("text")
            n_tokens, _ = tokenize(text, path, False)
            n_bytes = np.diff(spans.text_offsets(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = own(documents, {"doc_id": id_column, "text": text_column}).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
