import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def tuples(df, *order):
    rows = [tuple(r) for r in df.collect()]
    return sorted(rows) if not order else rows


@pytest.fixture(scope="session")
def events(spark):
    """600 events, a third of them of one user, with time ties."""
    rows = []
    for e in range(600):
        user = 1 if e % 3 == 0 else e % 17 + 2
        rows.append((user, (e * 37) % 211, e, (e * 13) % 50, (e * 7) % 5))
    return spark.createDataFrame(rows, "user long, time long, event long, item long, cat long").cache()
