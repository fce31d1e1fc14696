import pytest

from murmurate.llm.queries import importable


@pytest.fixture(autouse=True)
def _package_in_workers(spark):
    importable(spark)
