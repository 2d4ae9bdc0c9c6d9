"""Set operations, reshaping and paging."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.operators.latest import latest_by

PAGE_SIZE = 100


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by name; a column one side lacks becomes NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def first_source_wins(keys: list[str], *frames: DataFrame, within: list[Column] | None = None) -> DataFrame:
    """Union where an earlier frame's row beats a later frame's row of the same key."""
    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    order = [F.col("_source").asc(), *(within or [])]
    return latest_by(union_all(*tagged), keys, order).drop("_source")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last in ``order`` (give it descending columns)."""
    return latest_by(df, keys, order)


def primary_else_fallback(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """All primary rows, plus fallback rows of keys the primary does not cover at all."""
    covered = primary.select(*keys).distinct()
    return union_all(primary, fallback.join(covered, keys, "left_anti"))


def unpivot_models(df: DataFrame, models: dict[str, str], keep: list[str], name: str = "probability") -> DataFrame:
    """Wide model columns to (model, probability) rows; NULL scores are kept."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(c).alias(name)) for m, c in models.items()]
    )
    return df.select(*keep, F.explode(pairs).alias("_m")).select(*keep, "_m.model", f"_m.{name}")


def models_by_race(df: DataFrame, race: list[str], fields: list[str]) -> DataFrame:
    """One map per race: model -> struct of its fields. A race has one row per model."""
    return df.groupBy(*race).agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("model", F.struct(*fields).alias("value"))))
        ).alias("models")
    )


@dataclass
class Page:
    rows: DataFrame
    page: int
    total: DataFrame  # one row: total, pages

    @classmethod
    def of(cls, df: DataFrame, order: list[Column], page: int = 1, size: int = PAGE_SIZE) -> "Page":
        """Offset/limit page. The total is a separate count, so the page itself stays a
        top-k and never needs the whole result in one place."""
        page = max(1, int(page))
        rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
        total = df.agg(F.count(F.lit(1)).alias("total")).select(
            "total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint").alias("pages")
        )
        return cls(rows, page, total)


def page_by_group(df: DataFrame, group: list[str], order: list[Column], page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """All rows of the groups on the page (a page holds ``size`` groups, not rows)."""
    page = max(1, int(page))
    groups = df.select(*group).distinct().orderBy(*order).offset((page - 1) * size).limit(size)
    return df.join(F.broadcast(groups), group, "left_semi")


def pages_for(total: int, size: int = PAGE_SIZE) -> int:
    return max(1, ceil(total / size))


def ordered_label(column: Column, labels: list[str]) -> Column:
    """Sort key that follows a fixed label order; unknown labels come last."""
    expr = F.lit(len(labels))
    for i, label in reversed(list(enumerate(labels))):
        expr = F.when(column == label, i).otherwise(expr)
    return expr
