import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    found = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        found.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found


def plain(rows, columns):
    """Rows as sorted tuples by column name, numbers to six digits."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: v if v is None or isinstance(v, bool) else f"{v + 0.0:.6f}" if isinstance(v, (int, float)) else str(v)
    return sorted((tuple(cell(row[k]) for k in order) for row in rows), key=str)


@pytest.fixture(scope="session")
def agrees(spark, duck):
    def check(query, sql):
        mine = query(spark, SMALL)
        theirs = duck.execute(sql)
        names = [d[0] for d in theirs.description]
        assert sorted(mine.columns) == sorted(names)
        assert plain(mine.collect(), mine.columns) == plain(theirs.fetchall(), names)

    return check
