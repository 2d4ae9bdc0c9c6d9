import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from furlong.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture
def split_everything(spark):
    """Make every key with more than five rows a hot key."""
    spark.conf.set("spark.furlong.hotKeyRows", "5")
    spark.conf.set("spark.furlong.hotKeyCheckBytes", "0")
    yield
    spark.conf.unset("spark.furlong.hotKeyRows")
    spark.conf.unset("spark.furlong.hotKeyCheckBytes")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
