import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quillstream.session import local_session

    session = local_session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def rows_of(frame):
    """Rows of a pandas frame as sorted tuples of plain texts, columns by name."""

    def plain(v):
        if v is None or str(v) in ("nan", "NaT", "<NA>"):
            return "NULL"
        if isinstance(v, float) and v == int(v):
            return str(int(v))
        return str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in row) for row in frame[columns].values.tolist())


def same_rows(spark_frame, duck_frame):
    a, b = rows_of(spark_frame), rows_of(duck_frame)
    assert a[0] == b[0]
    assert a[1] == b[1]
