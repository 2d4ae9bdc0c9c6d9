"""Splitting hot keys must not change any result."""

from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from furlong.operators import asof, skew, windows
from furlong.plans import metrics

SIZE = 900


def skewed(spark):
    """A third of all rows belong to key 0; values repeat and some are NULL."""
    return spark.range(SIZE).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).cast("int").alias("k"),
        (F.col("id") * 7919 % 300).cast("double").alias("t"), F.col("id"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 31 % 17).cast("double")).alias("v"),
    )


def both_ways(spark, build):
    plain = rows(build())
    spark.conf.set("spark.furlong.hotKeyRows", "5")
    spark.conf.set("spark.furlong.hotKeyCheckBytes", "0")
    try:
        assert rows(build()) == plain
    finally:
        spark.conf.unset("spark.furlong.hotKeyRows")
        spark.conf.unset("spark.furlong.hotKeyCheckBytes")
    return plain


def test_hot_keys_are_found_and_split(spark, split_everything):
    df = skewed(spark)
    assert skew.find_hot(df, ["k"]) is not None
    cut = skew.split(df, ["k"], ["t", "id"])
    assert cut.hot and cut.df.filter("k = 0").select("_slice").distinct().count() > 20
    largest = cut.df.filter("k = 0").groupBy("_slice").count().agg(F.max("count")).first()[0]
    assert largest < SIZE / 3 / 10


def test_running_values(spark):
    df = skewed(spark)
    out = both_ways(
        spark,
        lambda: skew.running(
            df, ["k"], ["t", "id"],
            {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "last": ("last", F.col("v"))},
        ),
    )
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumns(
        {"s": F.coalesce(F.sum("v").over(w), F.lit(0.0)), "n": F.count("v").over(w), "hi": F.max("v").over(w), "lo": F.min("v").over(w),
         "last": F.last("v", ignorenulls=True).over(w)}
    )
    assert out == rows(want)


def test_ranks_and_totals(spark):
    df = skewed(spark)
    out = both_ways(spark, lambda: skew.ranked(df, ["k"], ["-v", "id"], "r"))
    w = Window.partitionBy("k").orderBy(F.col("v").desc(), "id")
    assert out == rows(df.withColumn("r", F.row_number().over(w)))
    both_ways(spark, lambda: skew.group_totals(df, ["k"], {"n": F.count("v"), "m": F.max("v")}))
    both_ways(spark, lambda: skew.ranked(df, [], ["t", "id"], "r"))


def test_bounded_windows(spark):
    df = skewed(spark)
    sizes = {3: "m3", 10: "m10"}
    out = both_ways(spark, lambda: windows.rolling_prior_mean(df, ["k"], ["t", "id"], "v", sizes))
    w = Window.partitionBy("k").orderBy("t", "id")
    assert out == rows(df.withColumns({name: F.avg("v").over(w.rowsBetween(-n, -1)) for n, name in sizes.items()}))
    both_ways(spark, lambda: windows.rolling_prior_mean(df, ["k"], ["t", "id"], "v", sizes, skip_nulls=True))
    both_ways(spark, lambda: windows.lag_columns(df, ["k"], ["t", "id"], {"v": "p"}))


def test_scans_over_one_group(spark):
    df = skewed(spark).withColumn("profit", F.col("v") - 8).fillna(0.0)
    both_ways(spark, lambda: windows.drawdown(df, [], ["t", "id"], "profit"))
    both_ways(spark, lambda: windows.longest_streaks(df.withColumn("m", F.lit("a")), ["m"], ["t", "id"], F.col("profit") > 0))


def test_asof_join(spark):
    df = skewed(spark)
    left, right = df.filter("id % 2 = 0"), df.filter("id % 2 = 1").select("k", F.col("t").alias("rt"), "v", F.col("id").alias("rid"))
    for exact in (False, True):
        out = both_ways(
            spark, lambda e=exact: asof.asof_join(left, right, ["k"], "t", "rt", {"rid": "seen"}, allow_exact=e, tie_break=["rid"])
        )
        pdf_r = right.toPandas()
        for row in left.collect():
            ok = pdf_r[(pdf_r.k == row.k) & ((pdf_r.rt <= row.t) if exact else (pdf_r.rt < row.t))].sort_values(["rt", "rid"])
            seen = int(ok.rid.iloc[-1]) if len(ok) else None
            assert (*row, seen) in out


def test_metrics_over_skewed_scores(spark):
    df = skewed(spark).select("k", F.col("id").alias("horse_id"), (F.col("t") / 300).alias("p"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    rounded = lambda d: d.select("k", *[F.round(c, 9).alias(c) for c in d.columns if c != "k"])
    both_ways(spark, lambda: rounded(metrics.auc(df, ["k"], "p", "y")))
    both_ways(spark, lambda: rounded(metrics.exact_median(df, ["k"], "p")))
