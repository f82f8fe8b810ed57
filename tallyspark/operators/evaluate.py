"""Accuracy of forecasts: rows(hour, zone_id, borough, actual, baseline, forecast), with a column period where named."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.time import date_hour

SUSPICIOUS_WAPE, SUSPICIOUS_GAIN, LEAST_VOLUME = 0.10, 60.0, 5.0


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def _err(c: str) -> Column:
    return _d(c) - _d("actual")


def mae(c: str) -> Column:
    return F.avg(F.abs(_err(c)))


def rmse(c: str) -> Column:
    return F.sqrt(F.avg(_err(c) * _err(c)))


def wape(c: str) -> Column:
    return F.try_divide(F.sum(F.abs(_err(c))), F.sum(_d("actual")))


def clip(rows: DataFrame, column: str) -> DataFrame:
    """Forecasts below 0 become 0."""
    return rows.withColumn(column, F.greatest(F.col(column), F.lit(0.0)))


def scored(rows: DataFrame, actual: str, baseline: str, forecast: str) -> DataFrame:
    """The scored table: narrow types, as it is stored."""
    return rows.select("hour", F.col("zone_id").cast("short").alias("zone_id"), "borough", *(F.col(c).cast("float").alias(n) for c, n in ((actual, "actual"), (baseline, "baseline"), (forecast, "forecast"))))


def error_metrics(rows: DataFrame, column: str, by: tuple = ()) -> DataFrame:
    return rows.groupBy(*by).agg(mae(column).alias("mae"), rmse(column).alias("rmse"), wape(column).alias("wape"))


def evaluate_periods(rows: DataFrame) -> DataFrame:
    """Metrics of both forecasts per period, improvement in %, and whether the result is too good to be believed unchecked."""
    out = rows.groupBy("period").agg(
        F.count("*").alias("n_rows"), F.countDistinct("zone_id").alias("n_zones"), F.avg(_d("actual")).alias("mean_actual"),
        *(f(c).alias(f"{name}_{c}") for c in ("baseline", "forecast") for name, f in (("mae", mae), ("rmse", rmse), ("wape", wape))),
    )
    out = out.withColumn("improvement_pct", 100 * (1 - F.try_divide("mae_forecast", "mae_baseline")))
    return out.withColumn("leakage_check_required", F.coalesce((F.col("wape_forecast") < SUSPICIOUS_WAPE) | (F.col("improvement_pct") > SUSPICIOUS_GAIN), F.lit(False)))


def borough_metrics(rows: DataFrame) -> DataFrame:
    """Per period and borough, rounded half to even; errors are null where there were no trips."""
    some = F.sum(_d("actual")) > 0
    return rows.groupBy("period", "borough").agg(
        F.countDistinct("zone_id").alias("n_zones"), F.count("*").alias("n_rows"), F.bround(F.avg(_d("actual")), 3).alias("mean_actual"),
        *(F.bround(F.when(some, f(c)), 4).alias(f"{name}_{c}") for name, f in (("mae", mae), ("wape", wape)) for c in ("baseline", "forecast")),
    )


def day_bootstrap(rows: DataFrame, seed: int = 42, n_boot: int = 1000) -> DataFrame:
    """95 % interval of MAE(forecast) - MAE(baseline) per period, whole days resampled with replacement.

    The draw of resample b at place i is a digest of seed, b and i, the same on every engine and partitioning. What is
    resampled is one row a day.
    """
    days = rows.groupBy("period", date_hour(F.col("hour")).alias("day")).agg(F.sum(F.abs(_err("forecast")) - F.abs(_err("baseline"))).alias("diff"), F.count("*").alias("n"))
    listed = days.groupBy("period").agg(F.sort_array(F.collect_list(F.struct("day", "diff", "n"))).alias("days"), F.sum("diff").alias("d"), F.sum("n").alias("n"))
    draws = listed.select("period", F.size("days").alias("of")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("i").cast("string"))
    pick = (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % F.col("of")).cast("int")
    numbered = listed.select("period", F.posexplode("days").alias("k", "x"))
    one = draws.select("period", "b", pick.alias("k")).join(numbered, ["period", "k"])
    sums = one.groupBy("period", "b").agg((F.sum("x.diff") / F.sum("x.n")).alias("v"))
    ends = sums.groupBy("period").agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("e"))
    return listed.join(ends, "period").select("period", (F.col("d") / F.col("n")).alias("mae_diff"), F.col("e")[0].alias("ci95_low"), F.col("e")[1].alias("ci95_high"), F.lit(n_boot).alias("n_bootstrap"), F.size("days").alias("n_days"))


def accuracy_report(periods: DataFrame, boot: DataFrame) -> DataFrame:
    """Period rows for reading: MAE, WAPE in %, and the difference with its interval as text."""
    text = F.format_string("%.2f [%.2f, %.2f]", F.bround("mae_diff", 2), F.bround("ci95_low", 2), F.bround("ci95_high", 2))
    return periods.join(boot, "period").select("period", "mae_baseline", "mae_forecast", (100 * F.col("wape_baseline")).alias("wape_baseline_pct"), (100 * F.col("wape_forecast")).alias("wape_forecast_pct"), text.alias("difference"))


def series(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    return rows.where((F.col("hour") >= start) & (F.col("hour") < end)).groupBy("hour").agg(*(F.sum(_d(c)).alias(c) for c in ("actual", "baseline", "forecast")))


def snapshot(rows: DataFrame, hour: Column) -> DataFrame:
    return rows.where(F.col("hour") == hour).select("zone_id", "actual", "baseline", "forecast", (_d("forecast") - _d("actual")).alias("error")).orderBy("zone_id")


def snapshot_kpis(shot: DataFrame) -> DataFrame:
    return shot.agg(F.sum(_d("forecast")).alias("total_forecast"), F.sum(_d("actual")).alias("total_actual"), mae("forecast").alias("mae_forecast"), mae("baseline").alias("mae_baseline"), F.max(_d("forecast")).alias("max_forecast"))


def mae_by_hour(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.hour("hour").alias("hour_of_day")).agg(mae("baseline").alias("mae_baseline"), mae("forecast").alias("mae_forecast"))


def zone_errors(rows: DataFrame, least: float = LEAST_VOLUME) -> DataFrame:
    """Per zone; WAPE in % only for zones with a mean of at least `least` (stable), highest first."""
    out = rows.groupBy("zone_id").agg(F.avg(_d("actual")).alias("mean_actual"), mae("baseline").alias("mae_baseline"), mae("forecast").alias("mae_forecast"), (100 * wape("forecast")).alias("w"))
    out = out.withColumn("stable", F.col("mean_actual") >= least).withColumn("wape_forecast", F.when(F.col("stable"), F.col("w"))).drop("w")
    return out.orderBy(F.desc_nulls_last("wape_forecast"), "zone_id")


def largest_misses(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n rows furthest from the actual value; ties by month, zone, hour."""
    out = rows.select("hour", "zone_id", "actual", "baseline", "forecast", (_d("forecast") - _d("actual")).alias("error"))
    return out.orderBy(F.desc(F.abs("error")), F.date_format("hour", "yyyy-MM"), "zone_id", "hour").limit(n)


def month_slice(rows: DataFrame, start: Column, end: Column, borough: str | None = None, zone: int | None = None) -> DataFrame:
    out = rows.where((F.col("hour") >= start) & (F.col("hour") < end))
    out = out if borough is None else out.where(F.col("borough") == borough)
    return out if zone is None else out.where(F.col("zone_id") == zone)
