from __future__ import annotations

import pytest

from classatlas.session import configure


@pytest.fixture(scope="session")
def session(spark):
    return configure(spark)


@pytest.fixture()
def table(session, tmp_path):
    """Write rows as one table of a folder; returns the folder's name."""
    def write(name, rows, schema):
        session.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
