"""Column expressions shared by the operators."""

from tallyhour.functions.clock import (
    EPOCH,
    instant,
    iso_text,
    millis,
    op_code,
    parse_iso,
    saturating_instant,
)
from tallyhour.functions.kinds import is_kind

__all__ = [
    "EPOCH",
    "instant",
    "is_kind",
    "iso_text",
    "millis",
    "op_code",
    "parse_iso",
    "saturating_instant",
]
