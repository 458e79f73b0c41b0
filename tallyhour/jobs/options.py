"""``key=value`` options from the command line."""

from __future__ import annotations

import os


def option_map(pairs: list[str]) -> dict[str, str]:
    """Options as a map; a value ``env:NAME`` is read from the environment, for secrets."""
    options = {}
    for pair in pairs:
        key, found, value = pair.partition("=")
        if not found:
            raise ValueError(f"expected key=value, got {pair!r}")
        options[key] = os.environ[value.removeprefix("env:")] if value.startswith("env:") else value
    return options
