from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from compare import make_duck, make_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = make_spark(8)
    # Tiny inputs: compiling code costs more than it saves.
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    return make_duck("sf0.001")
