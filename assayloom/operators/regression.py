"""Regression evaluation: residuals, error aggregates, worst rows, residual diagnostics, model comparison."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.numeric import finite
from assayloom.operators.order_statistics import quantiles
from assayloom.staging import stage


def with_residuals(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    residual = F.col(y_true) - F.col(y_pred)
    return df.withColumns({"residual": residual, "absolute_error": F.abs(residual)})


def rmse(y_true: Column, y_pred: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y_true - y_pred, F.lit(2))))


def r2(y_true: Column, y_pred: Column) -> Column:
    """One minus residual over total sum of squares; a constant target scores 1 when hit exactly, else 0."""
    squares = F.sum(F.pow(y_true - y_pred, F.lit(2)))
    total = F.var_pop(y_true) * F.count(y_true)
    return F.when(total == 0, F.when(squares == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(squares, total))


def squared_correlation(y_true: Column, y_pred: Column) -> Column:
    """Squared Pearson correlation, null if a side is constant. Unlike R², it does not see a bias or a scale error."""
    together = F.covar_pop(y_true, y_pred)
    return F.try_divide(together * together, F.var_pop(y_true) * F.var_pop(y_pred))


def valid_pair(y_true: str, y_pred: str) -> tuple[Column, Column]:
    """Both sides, null unless both are finite numbers."""
    t, p = finite(F.col(y_true)), finite(F.col(y_pred))
    return F.when(p.isNotNull(), t), F.when(t.isNotNull(), p)


def regression_metrics(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: Sequence[str] = ()
) -> DataFrame:
    """``n, skipped, rmse, r2, pearson_r2`` in one pass: one row, or one per group of ``by``.

    A pair counts if both sides are finite numbers; ``skipped`` is the number of the others.
    """
    t, p = valid_pair(y_true, y_pred)
    return df.groupBy(*by).agg(
        F.count(t).alias("n"),
        F.count_if(t.isNull()).alias("skipped"),
        rmse(t, p).alias("rmse"),
        r2(t, p).alias("r2"),
        squared_correlation(t, p).alias("pearson_r2"),
    )


def compare_models(df: DataFrame, y_true: str, predictions: dict[str, str], baseline: str) -> DataFrame:
    """``model, rmse, r2, rmse_gain`` for several prediction columns, worst first, all from one pass over ``df``.

    ``rmse_gain`` is the relative improvement over the baseline model's RMSE.
    """
    sides = {name: valid_pair(y_true, c) for name, c in predictions.items()}
    records = [
        F.struct(F.lit(name).alias("model"), rmse(t, p).alias("rmse"), r2(t, p).alias("r2")) for name, (t, p) in sides.items()
    ]
    base = rmse(*sides[baseline]).alias("_base")
    rows = df.agg(F.array(*records).alias("_records"), base).select(F.explode("_records").alias("_r"), "_base")
    gain = F.try_divide(F.col("_base") - F.col("_r.rmse"), F.col("_base"))
    return rows.select("_r.model", "_r.rmse", "_r.r2", gain.alias("rmse_gain")).orderBy(F.desc("rmse"), "model")


def worst_predictions(df: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` rows with the largest absolute error; the keys break ties."""
    return with_residuals(df).orderBy(F.desc("absolute_error"), *keys).limit(n)


def report_lines(df: DataFrame) -> DataFrame:
    """A two-decimal text line per prediction."""
    line = F.format_string(
        "True: %.2f | Predicted: %.2f | Residual: %.2f", F.col("y_true"), F.col("y_pred"), F.col("residual")
    )
    return df.withColumn("line", line)


# Histogram ----------------------------------------------------------------------------------------------------------


def quartiles(df: DataFrame, column: str, rows: int) -> tuple[float, float]:
    """Exact linearly interpolated first and third quartile of ``rows`` present values, by two scans."""
    found, quarters, _ = quantiles(df, column, (0.25, 0.75))
    if found != rows:
        raise ValueError(f"{found} values, not {rows}")
    return quarters[0], quarters[1]


def bin_count(n: int, low: float, high: float, q1: float, q3: float) -> int:
    """The larger of Sturges' and the Freedman-Diaconis bin count."""
    if n == 0 or high == low:
        return 1
    sturges = math.ceil(math.log2(n) + 1)
    spread = 2 * (q3 - q1) / n ** (1 / 3)
    return max(sturges, math.ceil((high - low) / spread) if spread > 0 else 0)


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Equal-width histogram ``bin, bins, low, high, count`` of the filled bins among ``bins``, the last one closed.

    Values that are not finite have no bin. The result follows the data, however far an outlier lies. The table is read three times,
    with exact quartiles from two of them: stage it first if it is dear to compute.
    """
    spark, df = df.sparkSession, df.select(finite(F.col(column)).alias(column))
    ends = [F.min(column).alias("low"), F.max(column).alias("high")]
    n, quarters, (low, high) = quantiles(df, column, [0.25, 0.75] if bins is None else [], ends)
    if n == 0:
        return spark.createDataFrame([], "bin long, bins long, low double, high double, count long")
    if bins is None:
        bins = bin_count(n, low, high, *quarters)
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    counts = df.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(
        "bin",
        F.lit(bins).cast("long").alias("bins"),
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        "count",
    )


def density(df: DataFrame, column: str, bin_width: float, points: int = 200, cells_per_bandwidth: int = 64) -> DataFrame:
    """Gaussian density on ``points`` grid points over [min, max], scaled to counts per histogram bin.

    The bandwidth is Scott's rule, ``stddev * n ** -0.2``. Rows are first reduced to cells of 1/64 bandwidth, each
    standing at the mean of its rows, so the work per grid point depends on the number of cells and not of rows; the
    relative error is about (1/64)² / 24.
    """
    spark, df = df.sparkSession, stage(df.select(finite(F.col(column)).alias(column)), "values")
    n, low, high, deviation = df.agg(F.count(column), F.min(column), F.max(column), F.stddev_samp(column)).first()
    if n < 2 or not deviation:
        return spark.createDataFrame([], "point long, x double, density double")
    bandwidth = deviation * n ** -0.2
    count = math.ceil((high - low) * cells_per_bandwidth / bandwidth)
    place = F.floor((F.col(column) - F.lit(low)) / F.lit((high - low) / count))
    cells = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.least(place, F.lit(count - 1)).alias("_cell"))
        .agg(F.count(F.lit(1)).alias("_weight"), F.avg(column).alias("_center"))
    )
    step = (high - low) / (points - 1)
    scale = bin_width / (bandwidth * math.sqrt(2 * math.pi))
    x = F.lit(low) + F.col("point") * F.lit(step)
    z = (x - F.col("_center")) / F.lit(bandwidth)
    # Beyond 39 bandwidths the kernel is zero in a double, so a cell only meets the points around it.
    reach = F.lit(39 * bandwidth)
    first = F.greatest(F.lit(0), F.ceil((F.col("_center") - reach - F.lit(low)) / F.lit(step))).cast("long")
    last = F.least(F.lit(points - 1), F.floor((F.col("_center") + reach - F.lit(low)) / F.lit(step))).cast("long")
    met = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    grid = spark.range(points).select(F.col("id").alias("point"), F.lit(0).cast("long").alias("_weight"), F.lit(low).alias("_center"))
    return (
        cells.select(F.explode(met).alias("point"), "_weight", "_center")
        .unionByName(grid)
        .groupBy("point")
        .agg((F.sum(F.col("_weight") * F.exp(-z * z / 2)) * F.lit(scale)).alias("density"))
        .select("point", x.alias("x"), "density")
    )


def residual_profile(df: DataFrame, buckets: int = 20) -> DataFrame:
    """Residuals by equal-width bucket of the prediction: count, mean and spread per bucket."""
    t, p = valid_pair("y_true", "y_pred")
    df = df.select(t.alias("y_true"), p.alias("y_pred")).where(F.col("y_pred").isNotNull())
    low, high = df.agg(F.min("y_pred"), F.max("y_pred")).first()
    if low is None:
        low = high = 0.0
    width = (high - low) / buckets or 1.0
    place = F.least(F.floor((F.col("y_pred") - F.lit(low)) / F.lit(width)), F.lit(buckets - 1))
    residual = F.col("y_true") - F.col("y_pred")
    return df.groupBy(place.alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("y_pred").alias("mean_prediction"),
        F.avg(residual).alias("mean_residual"),
        F.stddev_samp(residual).alias("residual_stddev"),
    )


def residual_bias(df: DataFrame) -> DataFrame:
    """One row: slope of the residual over the true value (1 = predictions do not follow the target, 0 = no bias)."""
    t, p = valid_pair("y_true", "y_pred")
    df = df.select(t.alias("y_true"), p.alias("y_pred"))
    residual = F.col("y_true") - F.col("y_pred")
    slope = F.try_divide(F.covar_pop(residual, F.col("y_true")), F.var_pop(F.when(residual.isNotNull(), F.col("y_true"))))
    return df.agg(slope.alias("residual_slope"), F.avg(residual).alias("mean_residual"))
