import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from entityops.session import local_session  # noqa: E402


SESSION = local_session(cores=4)  # columns in module constants need a running session


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture
def one(spark):
    """Evaluate columns over literal inputs: ``one({"a": "x"}, f(F.col("a")))`` -> value."""

    def run(values: dict, *columns):
        schema = ", ".join(f"`{k}` {_ddl(v)}" for k, v in values.items())
        row = spark.createDataFrame([tuple(values.values())], schema).select(*columns).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return run


def _ddl(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "long"
    if isinstance(value, float):
        return "double"
    if isinstance(value, bytes):
        return "binary"
    if isinstance(value, list):
        return "array<string>"
    return "string"
