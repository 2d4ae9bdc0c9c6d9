"""A fixture for tables that are read from files."""

import pytest

from furlong.llm.storage import ship


@pytest.fixture
def table(spark, tmp_path):
    """Write rows as a Parquet table of several files and read it."""
    ship(spark)
    made = []

    def make(rows, schema, files=3):
        path = str(tmp_path / f"t{len(made)}")
        made.append(path)
        spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return make
