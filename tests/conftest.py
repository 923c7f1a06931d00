import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tablescope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def strings(spark, **columns):
    """A table of string columns from lists."""
    names = list(columns)
    return spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{n} string" for n in names))


def rows(df):
    return [tuple(r) for r in df.collect()]


def by(df, key="column"):
    return {r[key]: r for r in df.collect()}
