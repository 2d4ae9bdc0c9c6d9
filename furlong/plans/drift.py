"""Distribution drift between a current day and the days before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions import text
from furlong.operators.filters import completed_races
from furlong.plans.metrics import exact_median

# Alarm limits.
THRESHOLDS = {
    "psi": 0.25,
    "js": 0.20,
    "kl": 0.50,
    "confidence_shift": 0.15,
    "ece": 0.15,
    "missing_rate_delta": 0.20,
    "unseen_category_rate": 0.10,
    "target_rate_shift": 0.10,
}
MIN_CURRENT_ROWS = 30
MIN_REFERENCE_ROWS = 100
SMOOTH = 1e-9
INTERSECT_ONLY = ("track", "race_class")


def split_window(df: DataFrame, day: str, reference_days: int = 30) -> DataFrame:
    """Add ``window``: current = last day, reference = the days before it; older rows drop."""
    last = df.agg(F.max(day)).scalar()
    recent = df.filter(F.col(day).between(F.date_sub(last, reference_days), last))
    return recent.withColumns(
        {
            "window": F.when(F.col(day) == last, "current").otherwise("reference"),
            "as_of_date": last,
        }
    )


def _distances(cells: DataFrame, by: list[str]) -> DataFrame:
    """PSI, Jensen-Shannon and Kullback-Leibler from per-cell counts ``_ref`` and ``_cur``.

    Cells are bins or categories. Both sides are smoothed and normalised over the cells.
    """
    smoothed = cells.withColumns({"_r": F.col("_ref") + F.lit(SMOOTH), "_c": F.col("_cur") + F.lit(SMOOTH)})
    totals = smoothed.groupBy(*by).agg(F.sum("_r").alias("_rs"), F.sum("_c").alias("_cs"))
    shares = smoothed.join(totals, by).withColumns(
        {"_r": F.col("_r") / F.col("_rs"), "_c": F.col("_c") / F.col("_cs")}
    )
    r, c = F.col("_r"), F.col("_c")
    m = (r + c) / 2
    return shares.groupBy(*by).agg(
        F.sum((c - r) * F.ln(c / r)).alias("psi"),
        (0.5 * F.sum(r * F.ln(r / m)) + 0.5 * F.sum(c * F.ln(c / m))).alias("js_distance"),
        F.sum(c * F.ln(c / r)).alias("kl_divergence"),
    )


def numeric(
    df: DataFrame, by: list[str], value: str, window: str = "window", bins: int = 10,
    fixed: tuple[float, float] | None = None,
) -> DataFrame:
    """Distances over equal-width bins of the combined range (or a fixed one).

    The last bin includes its upper edge; values outside a fixed range are left out; a
    constant feature has distance 0; a side without values gives NULL.
    """
    keys = by or ["_k"]
    base = df if by else df.withColumn("_k", F.lit(1))
    known = base.filter(F.col(value).isNotNull() & ~F.isnan(value))
    ref, cur = F.col(window) == "reference", F.col(window) == "current"
    # one pass: counts per distinct bin need the range first, so the range is its own aggregate
    ranges = known.groupBy(*keys).agg(
        F.min(value).alias("_low"), F.max(value).alias("_high"),
        F.count_if(ref).alias("_nr"), F.count_if(cur).alias("_nc"),
    )
    if fixed:
        ranges = ranges.withColumns({"_low": F.lit(fixed[0]), "_high": F.lit(fixed[1])})
    v, low, high = F.col(value), F.col("_low"), F.col("_high")
    # edges built like a linear grid, compared as numbers, so that edge values land right
    edges = F.transform(
        F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: low + (high - low) / bins * i
    )
    bin_no = F.size(F.filter(edges, lambda e: e <= v))
    # groups are report dimensions (features, models): a short fixed list, safe to broadcast
    placed = known.join(F.broadcast(ranges), keys).filter((v >= low) & (v <= high))
    counts = placed.groupBy(*keys, bin_no.alias("_bin")).agg(
        F.count_if(ref).cast("double").alias("_ref"), F.count_if(cur).cast("double").alias("_cur")
    )
    grid = ranges.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_bin"))
    cells = grid.join(counts, [*keys, "_bin"], "left").fillna(0.0, ["_ref", "_cur"])
    out = ranges.join(_distances(cells, keys), keys)
    usable = (F.col("_nr") > 0) & (F.col("_nc") > 0)
    constant = (F.col("_low") == F.col("_high")) if not fixed else F.lit(False)
    out = out.select(
        *keys,
        *[
            F.when(usable, F.when(constant, 0.0).otherwise(F.col(n))).alias(n)
            for n in ("psi", "js_distance", "kl_divergence")
        ],
    )
    return out if by else out.drop("_k")


def categorical(df: DataFrame, by: list[str], category: Column, window: str = "window", intersect: Column | None = None) -> DataFrame:
    """Distances over category shares, and the share of current rows in unseen categories.

    Where ``intersect`` holds, only categories of both sides count (high-cardinality
    features), else the union. The unseen rate always uses all current rows.
    """
    keys = by or ["_k"]
    base = df if by else df.withColumn("_k", F.lit(1))
    only_shared = intersect if intersect is not None else F.lit(False)
    counts = base.withColumns({"_cat": category, "_shared": only_shared}).groupBy(*keys, "_shared", "_cat").agg(
        F.count_if(F.col(window) == "reference").cast("double").alias("_ref"),
        F.count_if(F.col(window) == "current").cast("double").alias("_cur"),
    )
    sums = counts.groupBy(*keys).agg(
        F.sum("_ref").alias("_nr"), F.sum("_cur").alias("_nc"),
        F.sum(F.when(F.col("_ref") == 0, F.col("_cur")).otherwise(0.0)).alias("_new"),
    )
    # shares are taken over all rows before the smoothing, as counts would be after a reindex
    cells = counts.join(sums, keys).filter(
        ~F.col("_shared") | ((F.col("_ref") > 0) & (F.col("_cur") > 0))
    ).withColumns(
        {
            "_ref": F.coalesce(F.try_divide(F.col("_ref"), F.col("_nr")), F.lit(0.0)),
            "_cur": F.coalesce(F.try_divide(F.col("_cur"), F.col("_nc")), F.lit(0.0)),
        }
    ).select(*keys, "_ref", "_cur")
    out = sums.join(_distances(cells, keys), keys, "left")
    usable = (F.col("_nr") > 0) & (F.col("_nc") > 0)
    out = out.select(
        *keys,
        *[F.when(usable, F.col(n)).alias(n) for n in ("psi", "js_distance", "kl_divergence")],
        F.try_divide(F.col("_new"), F.col("_nc")).alias("unseen_category_rate"),
    )
    return out if by else out.drop("_k")


def _over(value: Column, limit: str) -> Column:
    """value >= limit, where an unknown value is not over it."""
    return F.coalesce(value >= THRESHOLDS[limit], F.lit(False))


def _enough() -> Column:
    return (F.col("current_rows") >= MIN_CURRENT_ROWS) & (F.col("reference_rows") >= MIN_REFERENCE_ROWS)


def _status(critical: Column, enough: Column) -> Column:
    return F.when(enough & critical, "CRITICAL").when(enough, "PASS").otherwise("INSUFFICIENT_DATA")


def feature_report(df: DataFrame, day: str, numbers: list[str], categories: list[str]) -> DataFrame:
    """One row per feature: moments of both windows, missing rates, distances, status.

    Features become rows once, so one scan and one shuffle serve all of them.
    """
    windowed = split_window(df, day)
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.lit("numeric").alias("feature_type"),
                F.col(c).cast("double").alias("number"), F.lit(None).cast("string").alias("label"),
                F.col(c).isNull().alias("missing"),
            )
            for c in numbers
        ],
        *[
            F.struct(
                F.lit(c).alias("feature"), F.lit("categorical").alias("feature_type"),
                F.lit(None).cast("double").alias("number"),
                text.normalise_category(F.col(c).cast("string"), c).alias("label"),
                F.col(c).isNull().alias("missing"),
            )
            for c in categories
        ],
    )
    long = windowed.select("as_of_date", "window", F.explode(entries).alias("e")).select("as_of_date", "window", "e.*")
    cur, ref = F.col("window") == "current", F.col("window") == "reference"
    moments = []
    for side, cond in (("current", cur), ("reference", ref)):
        n = F.when(cond, F.col("number"))
        moments += [
            F.count_if(cond).alias(f"{side}_rows"), F.avg(n).alias(f"{side}_mean"),
            F.stddev_samp(n).alias(f"{side}_std"),
            F.min(n).alias(f"{side}_min"), F.max(n).alias(f"{side}_max"),
            F.avg(F.when(cond, F.col("missing").cast("double"))).alias(f"{side}_missing_rate"),
        ]
    base = long.groupBy("as_of_date", "feature", "feature_type").agg(*moments)
    medians = exact_median(long, ["feature", "window"], "number").groupBy("feature").agg(
        F.max(F.when(cur, F.col("median"))).alias("current_median"),
        F.max(F.when(ref, F.col("median"))).alias("reference_median"),
    )
    base = base.join(medians, "feature", "left")
    by = ["feature"]
    shared = F.col("feature").isin(*INTERSECT_ONLY)
    num = numeric(long.filter("feature_type = 'numeric'"), by, "number").withColumn(
        "unseen_category_rate", F.lit(None).cast("double")
    )
    cat = categorical(long.filter("feature_type = 'categorical'"), by, F.col("label"), intersect=shared)
    out = base.join(num.unionByName(cat), by, "left").withColumn(
        "missing_rate_delta", F.abs(F.col("current_missing_rate") - F.col("reference_missing_rate"))
    )
    improving = F.coalesce(
        (F.col("reference_missing_rate") >= 0.95)
        & (F.col("current_missing_rate") < F.col("reference_missing_rate")),
        F.lit(False),
    )
    critical = (
        _over(F.col("psi"), "psi") | _over(F.col("js_distance"), "js") | _over(F.col("kl_divergence"), "kl")
        | (~improving & _over(F.col("missing_rate_delta"), "missing_rate_delta"))
        | _over(F.col("unseen_category_rate"), "unseen_category_rate")
    )
    return out.withColumn("status", _status(critical, _enough()))


def prediction_report(df: DataFrame, day: str, score: str = "probability", winner: str = "winner") -> DataFrame:
    """Per model: score distances, shift of the winners' mean score and of the confidence."""
    windowed = split_window(df, day)
    by = ["as_of_date", "model"]
    cur, ref = F.col("window") == "current", F.col("window") == "reference"
    won = F.col(winner) == 1
    counts = windowed.groupBy(*by).agg(
        F.count_if(cur).alias("current_rows"), F.count_if(ref).alias("reference_rows"),
        F.abs(
            F.avg(F.when(cur & won, F.col(score))) - F.avg(F.when(ref & won, F.col(score)))
        ).alias("winner_probability_shift"),
    )
    tops = windowed.groupBy(*by, "window", "race_id").agg(F.max(score).alias("_top"))
    shift = tops.groupBy(*by).agg(
        F.abs(F.avg(F.when(cur, F.col("_top"))) - F.avg(F.when(ref, F.col("_top")))).alias("confidence_shift")
    )
    distances = numeric(windowed, by, score, fixed=(0.0, 1.0))
    out = counts.join(shift, by).join(distances, by, "left")
    critical = (
        _over(F.col("psi"), "psi") | _over(F.col("js_distance"), "js") | _over(F.col("kl_divergence"), "kl")
        | _over(F.col("confidence_shift"), "confidence_shift")
    )
    return out.withColumns({"drift_type": F.lit("prediction"), "status": _status(critical, _enough())})


def target_report(df: DataFrame, day: str, winner: str = "winner", race_class: str = "race_class", status: str = "result_status") -> DataFrame:
    """Winner-rate, class-mix and scratch-rate shift between the windows."""
    windowed = split_window(df, day)
    cur, ref = F.col("window") == "current", F.col("window") == "reference"
    done = completed_races(windowed, ["window", "race_id"], winner)
    rates = done.groupBy("as_of_date").agg(
        F.count_if(cur).alias("current_rows"), F.count_if(ref).alias("reference_rows"),
        F.abs(
            F.avg(F.when(cur, F.col(winner).cast("double"))) - F.avg(F.when(ref, F.col(winner).cast("double")))
        ).alias("winner_rate_shift"),
    )
    classes = categorical(
        windowed, ["as_of_date"], text.normalise_category(race_class, "race_class"), intersect=F.lit(True)
    ).select("as_of_date", F.col("js_distance").alias("class_js_distance"))
    scratched = F.coalesce(F.col(status) == "scratched", F.lit(False)).cast("double")
    scratches = windowed.groupBy("as_of_date").agg(
        F.abs(F.avg(F.when(cur, scratched)) - F.avg(F.when(ref, scratched))).alias("scratch_rate_shift")
    )
    out = rates.join(classes, "as_of_date", "left").join(scratches, "as_of_date", "left")
    critical = (
        _over(F.col("winner_rate_shift"), "target_rate_shift") | _over(F.col("class_js_distance"), "js")
        | _over(F.col("scratch_rate_shift"), "target_rate_shift")
    )
    return out.withColumns({"drift_type": F.lit("target"), "model": F.lit("all"), "status": _status(critical, _enough())})


def overall_status(report: DataFrame) -> DataFrame:
    """CRITICAL when any row is, INSUFFICIENT_DATA when rows are too few, else PASS."""
    return report.agg(
        F.when(F.count_if(F.col("status") == "CRITICAL") > 0, "CRITICAL")
        .when((F.count(F.lit(1)) == 0) | (F.count_if(F.col("status") == "INSUFFICIENT_DATA") > 0), "INSUFFICIENT_DATA")
        .otherwise("PASS")
        .alias("status")
    )
