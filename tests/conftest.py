"""One local session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = Path("/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value as both engines would write it."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


@pytest.fixture(scope="session")
def agrees(spark):
    """Assert that a query and its SQL give equal rows and columns over the small tables."""
    import duckdb

    if not SMALL.is_dir():
        pytest.skip("no tables here")
    db = duckdb.connect()
    for name in NAMES:
        db.sql(f"create view {name} as select * from '{SMALL}/{name}.parquet'")

    def check(query, sql: str) -> None:
        df = query(spark, str(SMALL))
        names = sorted(df.columns)
        assert names == sorted(db.sql(sql).columns)
        listed = ", ".join(f'"{n}"' for n in names)
        want = sorted(tuple(map(plain, r)) for r in db.sql(f"select {listed} from ({sql})").fetchall())
        got = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
        assert got == want

    return check
