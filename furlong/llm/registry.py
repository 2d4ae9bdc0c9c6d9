"""Registered queries of this subpackage, and their SQL counterparts."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furlong.llm import bottomk, decontamination, htmltext, idfile, jaccard, langid, merkle, oracles, packing, pitmanyor, prefixtrie, repeats, sharding, spotsigs
from furlong.llm.storage import ship

Query = Callable[[SparkSession, str], DataFrame]


def _ready(build: Query) -> Query:
    @functools.wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return build(spark, sf_dir)

    return run


MODULES = [packing, langid, pitmanyor, repeats, sharding, idfile, jaccard, htmltext, decontamination, spotsigs, bottomk, prefixtrie, merkle]
QUERIES = {name: _ready(build) for module in MODULES for name, build in module.QUERIES.items()}
ORACLES = oracles.ORACLES
