from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyhour.schemas import TRACKING, ddl  # noqa: E402
from tallyhour.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    before = {}

    def set_options(**options):
        for key, value in options.items():
            key = key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield set_options
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def tracking(spark):
    """Raw rows from dicts; columns not named are NULL."""

    def make(*rows: dict):
        filled = [tuple({"create_time": f"t{n}", **row}.get(name) for name in TRACKING) for n, row in enumerate(rows)]
        return spark.createDataFrame(filled, ddl(TRACKING))

    return make


@pytest.fixture
def messages(spark):
    def make(*texts: str | bytes | None):
        return spark.createDataFrame(
            [(bytearray(t.encode() if isinstance(t, str) else t) if t is not None else None,) for t in texts],
            "value binary",
        )

    return make
