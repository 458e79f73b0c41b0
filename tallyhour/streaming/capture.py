"""Change capture for raw tables that can be read as a stream."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tallyhour.functions import EPOCH
from tallyhour.operators.envelope import to_envelope
from tallyhour.plans.capture import POLL_SECONDS

# Half a second, as for polls of a table.
POLL_TRIGGER = {"processingTime": f"{int(POLL_SECONDS * 1000)} milliseconds"}


def publish_stream(
    raw: DataFrame,
    options: dict[str, str],
    checkpoint: str,
    format: str = "kafka",
    cursor: str = EPOCH,
    **trigger: Any,
) -> StreamingQuery:
    """Publish each new row as a change; the checkpoint's offsets take the cursor's place.

    ``cursor`` only decides the operation code: the epoch marks a first load.
    """
    rows = raw.where("ts IS NOT NULL")
    writer = to_envelope(rows, cursor).writeStream.format(format).options(**options)
    return writer.trigger(**(trigger or POLL_TRIGGER)).option("checkpointLocation", checkpoint).start()
