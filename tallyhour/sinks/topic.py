"""Publishing of change messages."""

from __future__ import annotations

from pyspark.sql import DataFrame


def publish(messages: DataFrame, options: dict[str, str], format: str = "kafka") -> None:
    """Send the ``value`` of each message, without a key; returns once all are stored.

    For ``kafka`` pass ``kafka.bootstrap.servers`` and ``topic``; other formats append
    files below ``path``. There is no shuffle: each scan task sends its own rows.
    """
    messages.write.format(format).options(**options).mode("append").save()
