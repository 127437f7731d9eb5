import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from varcost.session import get_spark  # noqa: E402

TESTDATA = Path(os.environ.get("TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = get_spark("tests", {
        "spark.master": "local[4]",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(folder / "scratch"),
        "spark.sql.warehouse.dir": str(folder / "warehouse"),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="module", autouse=True)
def fresh_catalogue(spark):
    """No module sees the tables and views of another: all share one session."""
    yield
    spark.sql("DROP DATABASE IF EXISTS dw_test CASCADE")
    for table in spark.catalog.listTables():
        if table.isTemporary:
            spark.catalog.dropTempView(table.name)


@pytest.fixture(scope="session")
def small():
    """The smallest given tables."""
    return str(TESTDATA / "sf0.001")


@pytest.fixture(scope="session")
def demo(spark):
    from varcost.sources.demo import demo_frames

    return demo_frames(spark)


def rows(df, *order):
    """Collected rows as tuples."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def plan_of(df):
    """The physical plan before execution."""
    return df._jdf.queryExecution().executedPlan().toString()


def ran_plan(df):
    """The final adaptive plan after execution."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
