from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import awkward  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    from spanloom.llm.common import small_batches

    small_batches(spark)
    return awkward.documents(spark).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return awkward.documents(spark, [])
