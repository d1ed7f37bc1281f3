"""Capacity forecasts, one per series, many series in one job.

A series is (key, date, bytes). Its rows are bounded by the calendar, so one
window per key is safe. After the window every model is an aggregate of the
same grouping, so all three cost one shuffle together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from stowage import fixed_values as V
from stowage.functions.scoring import trend_of

RESULT_FIELDS = [
    "model_type", "daily_growth_bytes", "weekly_growth_bytes", "predicted_total_30d",
    "predicted_total_90d", "exhaustion_date", "days_until_full", "confidence", "trend",
    "r_squared", "data_points_used",
]


def series_points(
    snapshots: DataFrame, key: str = "volume_id", value: str = "used_size_bytes"
) -> DataFrame:
    """(key, day_index, bytes) with days counted from the first snapshot."""
    all_dates = W.partitionBy(key)
    return snapshots.select(
        F.col(key).alias("series"),
        F.datediff("snapshot_date", F.min("snapshot_date").over(all_dates)).alias("day_index"),
        F.col(value).alias("bytes"),
    )


def growth_deltas(points: DataFrame) -> DataFrame:
    """Bytes per day between neighbouring points of each series."""
    by_day = W.partitionBy("series").orderBy("day_index")
    days = F.col("day_index") - F.lag("day_index").over(by_day)
    grown = F.col("bytes") - F.lag("bytes").over(by_day)
    return points.select(
        "series", "day_index", "bytes", F.when(days > 0, grown / days).alias("delta")
    )


def rolling_growth(points: DataFrame, window: int = V.MOVING_WINDOW) -> DataFrame:
    """Mean of the last ``window`` deltas at each day."""
    by_day = W.partitionBy("series").orderBy("day_index")
    last = by_day.rowsBetween(-(window - 1), W.currentRow)
    return (
        growth_deltas(points)
        .where(F.col("delta").isNotNull())
        .select("series", "day_index", F.avg("delta").over(last).alias("rolling_growth_bytes"))
    )


def _fit(points: DataFrame, window: int, alpha: float) -> DataFrame:
    """All sums that any of the models needs, one row per series.

    Sums for the line are whole numbers of 38 digits, hence exact.
    """
    by_day = W.partitionBy("series").orderBy("day_index")
    whole = W.partitionBy("series")
    rows = (
        growth_deltas(points)
        .withColumn("_i", F.count("delta").over(
            by_day.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("_m", F.count("delta").over(whole))
    )
    big = lambda c: c.cast("decimal(38,0)")
    x, y, d = F.col("day_index"), F.col("bytes"), F.col("delta")
    age = F.col("_m") - F.col("_i")
    weight = F.when(F.col("_i") == 1, F.pow(F.lit(1 - alpha), (F.col("_m") - 1).cast("double")))
    weight = weight.otherwise(F.lit(alpha) * F.pow(F.lit(1 - alpha), age.cast("double")))
    in_window = d.isNotNull() & (age < window)
    return rows.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(x.cast("bigint")).alias("sx"),
        F.sum(big(y)).alias("sy"),
        F.sum(x.cast("decimal(10,0)") * y.cast("decimal(19,0)")).alias("sxy"),
        F.sum(x.cast("bigint") * x).alias("sxx"),
        F.var_pop(y.cast("double")).alias("var_y"),
        F.min(y).alias("min_y"),
        F.max(y).alias("max_y"),
        F.max(x).alias("last_day"),
        F.max_by(y, x).alias("current_bytes"),
        F.count(d).alias("m"),
        F.sum(F.when(in_window, d)).alias("window_sum"),
        F.count_if(in_window).alias("window_n"),
        F.sum(F.when(d.isNotNull(), weight * d)).alias("smoothed"),
        F.avg(d).alias("delta_mean"),
        F.stddev_pop(d).alias("delta_dev"),
    )


def _result(
    model: str | Column,
    growth: Column,
    p30: Column,
    p90: Column,
    confidence: Column,
    r2: Column,
    as_of: str,
) -> Column:
    """The common result fields from the signed growth of a model."""
    current, capacity = F.col("current_bytes"), F.col("capacity_bytes")
    left = F.when(
        (growth > 0) & (capacity > current),
        F.least(((capacity - current) / growth), F.lit(float(V.MAX_DAYS_UNTIL_FULL))).cast("bigint"),
    )
    date = F.when(left > 0, F.date_add(F.lit(as_of).cast("date"), left.cast("int")))
    daily = F.greatest(F.lit(0.0), growth)
    return F.struct(
        (F.lit(model) if isinstance(model, str) else model).alias("model_type"),
        daily.alias("daily_growth_bytes"),
        (daily * 7).alias("weekly_growth_bytes"),
        F.greatest(p30.cast("bigint"), current).alias("predicted_total_30d"),
        F.greatest(p90.cast("bigint"), current).alias("predicted_total_90d"),
        date.alias("exhaustion_date"),
        left.alias("days_until_full"),
        confidence.alias("confidence"),
        trend_of(daily, current).alias("trend"),
        r2.alias("r_squared"),
        F.col("n").alias("data_points_used"),
    )


def _empty(model: str) -> Column:
    return F.struct(
        F.lit(model).alias("model_type"),
        F.lit(0.0).alias("daily_growth_bytes"),
        F.lit(0.0).alias("weekly_growth_bytes"),
        F.lit(0).cast("bigint").alias("predicted_total_30d"),
        F.lit(0).cast("bigint").alias("predicted_total_90d"),
        F.lit(None).cast("date").alias("exhaustion_date"),
        F.lit(None).cast("bigint").alias("days_until_full"),
        F.lit(0.0).alias("confidence"),
        F.lit("stable").alias("trend"),
        F.lit(0.0).alias("r_squared"),
        F.col("n").alias("data_points_used"),
    )


def line_confidence(r2: Column, n: Column) -> Column:
    bonus = F.least(F.lit(0.25), F.lit(0.01) * n)
    return F.round(F.least(F.lit(0.95), r2 * 0.7 + bonus), 3)


def forecasts(
    points: DataFrame,
    as_of: str,
    capacity: DataFrame | None = None,
    window: int = V.MOVING_WINDOW,
    alpha: float = V.SMOOTHING_ALPHA,
) -> DataFrame:
    """All models and the automatic choice for each series, as structs.

    ``capacity`` has (series, capacity_bytes); where it says nothing, twice the
    last value is taken.
    """
    fit = _fit(points, window, alpha)
    if capacity is not None:
        fit = fit.join(capacity.select("series", "capacity_bytes"), "series", "left")
    else:
        fit = fit.withColumn("capacity_bytes", F.lit(None).cast("bigint"))
    n = F.col("n")
    nd = n.cast("decimal(10,0)")
    # Whole-number differences are exact; only then do they become floating.
    top = (nd * F.col("sxy") - F.col("sx").cast("decimal(18,0)") * F.col("sy")).cast("double")
    bottom = (n * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double")
    fit = fit.withColumn(
        "capacity_bytes", F.coalesce("capacity_bytes", F.col("current_bytes") * 2)
    ).withColumn("slope", top / F.nullif(bottom, F.lit(0.0)))
    slope = F.col("slope")
    fit = fit.withColumn(
        "intercept",
        (F.col("sy").cast("double") - slope * F.col("sx").cast("double")) / n,
    ).withColumn("_bottom", bottom)
    flat = F.col("min_y") == F.col("max_y")
    r2 = F.when(flat | slope.isNull(), 0.0).otherwise(
        F.least(
            F.lit(1.0),
            slope * slope * F.col("_bottom") / (n * n) / F.nullif(F.col("var_y"), F.lit(0.0)),
        )
    )
    fit = fit.withColumn("r2", r2)
    last, current = F.col("last_day"), F.col("current_bytes")
    line = _result(
        "linear_regression", slope,
        slope * (last + 30) + F.col("intercept"), slope * (last + 90) + F.col("intercept"),
        line_confidence(F.col("r2"), n), F.col("r2"), as_of,
    )
    mean = F.col("window_sum") / F.nullif(F.col("window_n"), F.lit(0))
    moving = _result(
        "moving_average", mean, current + mean * 30, current + mean * 90,
        F.least(F.lit(0.75), F.lit(0.5) + F.lit(0.03) * F.col("window_n")), F.lit(0.0), as_of,
    )
    ema = F.col("smoothed")
    smooth = _result(
        "exponential_smoothing", ema, current + ema * 30, current + ema * 90,
        F.least(F.lit(0.80), F.lit(0.45) + F.lit(0.04) * n), F.lit(0.0), as_of,
    )
    no_deltas = (n < 3) | (F.col("m") == 0)
    fit = (
        fit.withColumn(
            "linear",
            F.when((n < 2) | slope.isNull(), _empty("linear_regression")).otherwise(line),
        )
        .withColumn("moving", F.when(no_deltas, _empty("moving_average")).otherwise(moving))
        .withColumn(
            "smoothing", F.when(no_deltas, _empty("exponential_smoothing")).otherwise(smooth)
        )
    )
    variation = F.when(F.coalesce("delta_mean", F.lit(0.0)) == 0, 0.0).otherwise(
        F.col("delta_dev") / F.abs("delta_mean")
    )
    chosen = (
        F.when(n < 3, _empty("auto"))
        .when(n < 5, F.col("moving"))
        .when(F.col("linear.r_squared") >= V.LINEAR_R2, F.col("linear"))
        .when(variation > V.HIGH_VARIATION, F.col("smoothing"))
        .otherwise(F.col("linear"))
    )
    return fit.select(
        "series", F.col("n").alias("point_count"), "current_bytes", "capacity_bytes",
        "linear", "moving", "smoothing",
        chosen.alias("auto"),
    )


def one_model(all_models: DataFrame, model: str = "auto") -> DataFrame:
    """The result of one model as flat columns."""
    return all_models.select("series", f"{model}.*")


def latest_forecast(stored: DataFrame) -> DataFrame:
    """The newest stored forecast of each series."""
    rest = [c for c in stored.columns if c not in ("series", "created_at")]
    return (
        stored.groupBy("series")
        .agg(F.max_by(F.struct("created_at", *rest), F.col("created_at")).alias("_row"))
        .select("series", "_row.*")
    )


def exhaustion_report(latest: DataFrame, all_series: DataFrame) -> DataFrame:
    """Exhaustion per series; zeros where there is no forecast."""
    return all_series.select("series").distinct().join(latest, "series", "left").select(
        "series",
        "exhaustion_date",
        "days_until_full",
        F.coalesce("daily_growth_bytes", F.lit(0.0)).alias("daily_growth_bytes"),
        F.coalesce("weekly_growth_bytes", F.lit(0.0)).alias("weekly_growth_bytes"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "model_type",
    )


def growth_rate_report(latest: DataFrame, all_series: DataFrame) -> DataFrame:
    """Daily, weekly and monthly growth with the trend; ``stable`` without a forecast."""
    daily = F.coalesce("daily_growth_bytes", F.lit(0.0))
    return all_series.select("series").distinct().join(latest, "series", "left").select(
        "series",
        daily.alias("daily_growth_bytes"),
        (daily * 7).alias("weekly_growth_bytes"),
        (daily * 30).alias("monthly_growth_bytes"),
        F.coalesce("trend", F.lit("stable")).alias("trend"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )
