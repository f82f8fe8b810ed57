"""Wall-clock time: hours, months, calendars. Every timestamp is without a zone (TIMESTAMP_NTZ).

date_trunc, F.window and unix_timestamp are avoided: they go through the session's zone.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def hour_floor(at: Column) -> Column:
    """The hour that holds a wall-clock time."""
    return F.to_date(at).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(at))


def month_label(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def date_hour(at: Column) -> Column:
    """The midnight that begins a day, as a timestamp."""
    return F.to_date(at).cast("timestamp_ntz")


def month_range(start: str, end: str) -> list[str]:
    """Labels of the months from start to end, both included."""
    (y, m), (y1, m1) = (map(int, x.split("-")) for x in (start, end))
    return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(y * 12 + m - 1, y1 * 12 + m1)]


def parse_months(text: str) -> list[str]:
    """"A:B" as the months from A to B, "A" as that month alone."""
    start, _, end = text.partition(":")
    months = month_range(start, end or start)
    if not months:
        raise ValueError(f"{text!r} holds no month")
    return months


def month_bounds(months: DataFrame, column: str = "month") -> DataFrame:
    """Adds start and end (exclusive) of each month label."""
    start = F.concat(F.col(column), F.lit("-01")).cast("timestamp_ntz")
    return months.withColumn("start", start).withColumn("end", F.add_months(F.to_date(start), 1).cast("timestamp_ntz"))


def month_weeks(months: DataFrame, column: str = "month") -> DataFrame:
    """(month, start, end): windows of seven days from each month's first day; the last may be shorter."""
    bounds = month_bounds(months, column)
    starts = bounds.select(column, "end", F.explode(F.expr("sequence(start, end - interval 1 day, interval 7 day)")).alias("start"))
    return starts.select(column, "start", F.least(F.expr("start + interval 7 day"), "end").alias("end"))


def hours_between(bounds: DataFrame) -> DataFrame:
    """(hour): every wall-clock hour of bounds(start, end), end exclusive; 24 a day, whatever the zone does."""
    return bounds.where("start < end").select(F.explode(F.expr("sequence(start, end - interval 1 hour, interval 1 hour)")).alias("hour"))


def days_between(bounds: DataFrame) -> DataFrame:
    """(date): every day from bounds.first to bounds.last."""
    return bounds.where("first <= last").select(F.explode(F.expr("sequence(first, last, interval 1 day)")).alias("date"))


def _nth(weekday: int, n: int, first: Column) -> Column:
    """The n-th given weekday (Monday 0) of the month that begins at `first`."""
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)).cast("int") + 7 * (n - 1))


def holidays(years: DataFrame) -> DataFrame:
    """(date): observed federal holidays of the United States in years(year)."""
    day = lambda m, d: F.make_date(F.col("year"), F.lit(m), F.lit(d))
    seen = lambda x: F.when(F.weekday(x) == 5, F.date_sub(x, 1)).when(F.weekday(x) == 6, F.date_add(x, 1)).otherwise(x)
    last_monday_of_may = F.date_sub(day(5, 31), F.weekday(day(5, 31)))
    every = [
        seen(day(1, 1)), seen(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1))), _nth(0, 3, day(1, 1)), _nth(0, 3, day(2, 1)), last_monday_of_may,
        F.when(F.col("year") >= 2021, seen(day(6, 19))), seen(day(7, 4)), _nth(0, 1, day(9, 1)), _nth(0, 2, day(10, 1)), seen(day(11, 11)),
        _nth(3, 4, day(11, 1)), seen(day(12, 25)),
    ]
    return years.select(F.explode(F.array(*every)).alias("date")).where("date IS NOT NULL").distinct()


def dst_transition(hour: Column, zone: str) -> Column:
    """Whether a wall-clock hour doesn't exist or exists twice in a zone."""
    z = F.lit(zone)
    utc = F.convert_timezone(z, F.lit("UTC"), hour)
    back = lambda u: F.convert_timezone(F.lit("UTC"), z, u)
    hour_long = F.expr("interval 1 hour")
    return (back(utc) != hour) | (back(utc + hour_long) == hour) | (back(utc - hour_long) == hour)


def calendar(hours: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """hours(hour) with date, hour_of_day, day_of_week (Monday 0), is_holiday, is_dst_transition."""
    years = hours.select(F.year("hour").alias("year")).distinct()
    free = holidays(years).withColumn("is_holiday", F.lit(True))  # a dozen rows a year
    out = hours.select("hour", F.to_date("hour").alias("date"), F.hour("hour").cast("byte").alias("hour_of_day"), F.weekday("hour").cast("byte").alias("day_of_week"))
    out = out.join(F.broadcast(free), "date", "left")
    return out.select("hour", "date", "hour_of_day", "day_of_week", F.coalesce("is_holiday", F.lit(False)).alias("is_holiday"), dst_transition(F.col("hour"), zone).alias("is_dst_transition"))


def hours_of_months(spark: SparkSession, months: list[str]) -> DataFrame:
    return hours_between(month_bounds(spark.createDataFrame([(m,) for m in months], "month string")))
