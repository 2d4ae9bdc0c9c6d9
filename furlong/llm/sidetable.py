"""Small facts about rows, found again by the task that reads the rows.

The facts are written in order of the row number, as files that each cover a range of numbers; only
one entry a file, its range, goes with the task, which opens the files that meet its own rows.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.storage import new_path


class SideTable:
    def __init__(self, key: str, schema: pa.Schema, files: list[tuple[int, int, str]]):
        self.key, self.schema, self.files = key, schema, sorted(files)
        self.highs = [high for _, high, _ in self.files]

    def between(self, low: int, high: int) -> pa.Table:
        """The facts about the numbers low to high, in order."""
        found = []
        for k in range(bisect.bisect_left(self.highs, low), len(self.files)):
            first, _, path = self.files[k]
            if first > high:
                break
            fs, name = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
            found.append(pq.read_table(name, filesystem=fs, filters=[(self.key, ">=", low), (self.key, "<=", high)], partitioning=None))
        return pa.concat_tables(found).sort_by(self.key) if found else self.schema.empty_table()


def side_table(df: DataFrame, key: str, name: str) -> SideTable:
    """Write df, whose key is a long, and keep the range of each file."""
    path = new_path(df.sparkSession, name)
    df.repartitionByRange(key).sortWithinPartitions(key).write.option("compression", "zstd").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    files = written.groupBy(F.input_file_name().alias("f")).agg(F.min(key), F.max(key)).collect()
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    schema = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in df.schema])
    return SideTable(key, schema, [(low, high, file) for file, low, high in files])
