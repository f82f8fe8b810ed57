"""Matching of two event tables by keys and by closeness in time."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Right rows of a cell that left rows may be held against one by one.
FEW = 64
#: A cell is hot that holds more than one in HOT_PART of all left rows. Its left rows, and the right rows of every cell, are dealt out to SALTS parts.
HOT_PART, SALTS = 1000, 32


def _close(seconds: int) -> Column:
    gap = lambda c: F.abs(F.col(f"l.{c}") - F.col(f"r.{c}"))
    limit = F.make_dt_interval(secs=F.lit(float(seconds)).cast("decimal(18,6)"))
    return (gap("pickup") <= limit) & (gap("dropoff") <= limit)


def matched_plain(left: DataFrame, right: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """(id) of left rows with a right row of equal keys whose pickup and drop-off both lie within `seconds`."""
    same = _close(seconds)
    for k in keys:
        same = same & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return left.alias("l").join(right.alias("r"), same, "left_semi").select("id")


def _micros(column: Column) -> Column:
    """Microseconds since 1970 on the wall clock."""
    day = F.date_diff(F.to_date(column), F.lit("1970-01-01").cast("date")).cast("long")
    minutes = F.hour(column).cast("long") * 60 + F.minute(column)
    return day * 86_400_000_000 + minutes * 60_000_000 + (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("long")


def _cell(x: str, side: int) -> Column:
    """The number of the cell of a coordinate, rounded down; whole numbers only."""
    return F.call_function("div", F.col(x) - F.pmod(F.col(x), F.lit(side)), F.lit(side))


def _fronts(right: DataFrame, by: list[str]) -> DataFrame:
    """Rows (x, y) of each group that no other row of it beats in one of the four directions; rows beaten in all four go.

    A row beats another towards (low, low) if neither of its coordinates is larger, and so on. Columns ll, lh, hl and hh tell the directions in which a row counts.
    """
    all_before = (Window.unboundedPreceding, -1)
    before, after = Window.partitionBy(*by).orderBy("x", "y").rowsBetween(*all_before), Window.partitionBy(*by).orderBy(F.desc("x"), F.desc("y")).rowsBetween(*all_before)
    open_ = lambda best, beats: best.isNull() | beats
    y = F.col("y")
    told = right.withColumns({
        "ll": open_(F.min("y").over(before), y < F.min("y").over(before)), "lh": open_(F.max("y").over(before), y > F.max("y").over(before)),
        "hl": open_(F.min("y").over(after), y < F.min("y").over(after)), "hh": open_(F.max("y").over(after), y > F.max("y").over(after)),
    })
    return told.where("ll OR lh OR hl OR hh")


def _cells(right: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key and cell: its lowest and highest x and y, and the rows on its four fronts.

    Rows of a cell are thinned out in SALTS parts first, then together, so that a cell with very many rows is sorted by many tasks; what is left
    of a part are its fronts, mostly a handful of rows, and never more than it has different x.
    """
    by = [*keys, "cx", "cy"]
    rows = right.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(SALTS)))
    rows = _fronts(_fronts(rows, [*by, "part"]).drop("ll", "lh", "hl", "hh"), by)
    corner = lambda c: F.collect_list(F.when(F.col(c), F.struct("x", "y"))).alias(c)
    return rows.groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))), *(corner(c) for c in ("ll", "lh", "hl", "hh")))


def _around(cells: DataFrame, keys: list[str]) -> DataFrame:
    """What each cell can be matched with: rows (keys, cx, cy, sides), sides the summaries of the cells around it and of itself, with their places.

    A summary holds, of its cell, what the nearest rows in the direction of the other one are.
    """
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    none = F.array().cast("array<struct<x: long, y: long>>")
    # seen from the cell at (cx - i, cy - j), this one lies i to the right and j above: what counts of it are its low or high ends
    ends = {(1, 1): "ll", (1, -1): "lh", (-1, 1): "hl", (-1, -1): "hh"}
    each = F.array(*(F.struct(
        (F.col("cx") - i).alias("cx"), (F.col("cy") - j).alias("cy"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("low_x" if i > 0 else "high_x").alias("x"), F.col("low_y" if j > 0 else "high_y").alias("y"),
        (F.col(ends[i, j]) if (i, j) in ends else none).alias("front")) for i, j in steps))
    moved = cells.select(*keys, F.explode(each).alias("s"))
    return moved.groupBy(*keys, F.col("s.cx").alias("cx"), F.col("s.cy").alias("cy")).agg(F.collect_list(F.struct("s.i", "s.j", "s.x", "s.y", "s.front")).alias("sides"))


def _reached(limit: int) -> Column:
    """Whether a row (x, y) has a match in one of its cell's sides."""

    def near(at: Column, other: Column, way: Column) -> Column:
        return F.when(way > 0, other - at <= limit).when(way < 0, at - other <= limit).otherwise(F.lit(True))

    def side(s: Column) -> Column:
        corner = F.exists(s["front"], lambda r: near(F.col("x"), r["x"], s["i"]) & near(F.col("y"), r["y"], s["j"]))
        return F.when((s["i"] != 0) & (s["j"] != 0), corner).otherwise(near(F.col("x"), s["x"], s["i"]) & near(F.col("y"), s["y"], s["j"]))

    return F.exists("sides", side)


def matched(left: DataFrame, right: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """The same by cells of pickup and drop-off, `seconds` wide both ways; ids are unique.

    Right rows of cells with FEW of them at most go to the nine cells around, where each left row is held against them: 9 * FEW tests at most. Cells with more
    are summarised, so that no rows are paired however many share a key and a moment: rows of one key and cell match outright; of the cells at its sides, the
    end that is nearest tells whether a row has a match there; of those at its corners, the rows on the front towards it. Left rows of very full
    cells are dealt out. A null key, pickup or drop-off matches nothing.
    """
    limit = round(seconds * 1_000_000)
    side = max(1, limit)
    by = [*keys, "cx", "cy"]
    known = lambda df: df.where(F.col("pickup").isNotNull() & F.col("dropoff").isNotNull()).dropna(subset=keys)
    placed = lambda df, *more: known(df).select(*more, *keys, _micros(F.col("pickup")).alias("x"), _micros(F.col("dropoff")).alias("y")).withColumns({"cx": _cell("x", side), "cy": _cell("y", side)})
    rows = placed(left, "id")
    others = placed(right).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    around = [F.explode(F.array(*(F.col(c) + k for k in (-1, 0, 1)))).alias(c) for c in ("cx", "cy")]
    few = others.where(F.col("n") <= FEW).select(*keys, "cy", "x", "y", around[0]).select(*keys, "cx", "x", "y", around[1])
    a, b = rows.alias("a"), few.alias("b")
    same = (F.abs(F.col("a.x") - F.col("b.x")) <= limit) & (F.abs(F.col("a.y") - F.col("b.y")) <= limit)
    for c in by:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    found = a.join(b, same, "left_semi").select("id")
    return found.unionByName(_matched_in_full_cells(rows, others.where(F.col("n") > FEW).drop("n"), keys, limit)).distinct()


def _matched_in_full_cells(rows: DataFrame, others: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(id) of placed left rows with a match among placed right rows, by summaries of cells."""
    by = [*keys, "cx", "cy"]
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    full = F.broadcast(counts.crossJoin(F.broadcast(total)).where(F.col("n") > F.greatest(F.col("total") / HOT_PART, F.lit(SALTS))).select(*by, F.lit(True).alias("full")))  # fewer than HOT_PART rows
    salt = F.when(F.col("full"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = rows.join(full, by, "left").withColumn("salt", salt)
    parts = F.explode(F.when(F.col("full"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    around = _around(_cells(others, keys), keys).join(full, by, "left").withColumn("salt", parts).drop("full")
    return dealt.join(around, [*by, "salt"]).where(_reached(limit)).select("id")


def within(events: DataFrame, start: Column, end: Column, column: str = "pickup", seconds: int = 0) -> DataFrame:
    """Rows of [start, end), widened by `seconds` on both sides."""
    edge = F.make_dt_interval(secs=F.lit(float(seconds)).cast("decimal(18,6)"))
    return events.where((F.col(column) >= start - edge) & (F.col(column) < end + edge))


def match_rate(left: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """(group, trips, matched, rate) by rate, highest first; a null group shows as 'null'."""
    rows = left.select("id", F.coalesce(F.col(group).cast("string"), F.lit("null")).alias("group")).join(found.select("id", F.lit(1).alias("m")).distinct(), "id", "left")
    out = rows.groupBy("group").agg(F.count("*").alias("trips"), F.count("m").alias("matched"))
    return out.withColumn("rate", F.col("matched") / F.col("trips")).orderBy(F.desc("rate"), "group")


def _outcomes(rates: DataFrame) -> DataFrame:
    """(group, v, k): numbers k of matches that resampling a group's rows can give, v the chance of k or fewer.

    Numbers more than 12 standard deviations and 40 away from the seen one are left out: all of them together come with a chance
    of less than 1e-30. So a group has about as many rows as the root of its trips.
    """
    of, seen, k = F.col("trips"), F.col("matched"), F.col("k")
    far = F.when((seen > 0) & (seen < of), F.ceil(12 * F.sqrt(seen * (1 - seen / of)) + 40)).otherwise(0)
    numbers = rates.withColumn("lo", F.greatest(F.lit(0), seen - far)).withColumn("k", F.explode(F.sequence("lo", F.least(of, seen + far))))
    whole = Window.partitionBy("group")
    up_to = whole.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the chance of k against that of k - 1
    step = F.when(k > F.col("lo"), F.log((of - k + 1) / k * seen / F.nullif(of - seen, F.lit(0)))).otherwise(0.0)
    logs = numbers.withColumn("log", F.sum(step).over(up_to))
    weights = logs.withColumn("w", F.exp(F.col("log") - F.max("log").over(whole)))
    return weights.select("group", (F.sum("w").over(up_to) / F.sum("w").over(whole)).alias("v"), "k")


def match_rate_ci(rates: DataFrame, pair: tuple[str, str], seed: int = 42, n: int = 1000) -> DataFrame:
    """(group, rate, low, high): 95 % bootstrap intervals of match rates, and of the difference of two groups.

    Resampling the rows of a group and counting matches is a binomial draw, so no rows are resampled: resample b takes the
    first number of matches whose chance, with all lower numbers, is above a digest of seed, group and b between 0 and 1. Draws are the
    same on every engine and partitioning.
    """
    text = F.concat_ws(":", F.lit(str(seed)), "group", F.col("b").cast("string"))
    level = (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") + 0.5) / 2.0**48
    tries = rates.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("group", level.alias("v"), "trips", "b")
    # from the top, the number drawn is the last one before its level
    above = Window.partitionBy("group").orderBy(F.desc("v"), F.col("b").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = tries.unionByName(_outcomes(rates), allowMissingColumns=True).withColumn("k", F.min("k").over(above))
    draws = lined.where("b IS NOT NULL").select("group", "b", (F.col("k") / F.col("trips")).alias("rate"))
    ends = F.percentile("rate", F.array(F.lit(0.025), F.lit(0.975)))
    single = draws.groupBy("group").agg(ends.alias("e")).join(rates.select("group", "rate"), "group")
    first, second = (F.max(F.when(F.col("group") == g, F.col("rate"))) for g in pair)
    point = rates.agg((first - second).alias("rate"))
    gap = draws.groupBy("b").agg((first - second).alias("rate"))
    gap = gap.agg(ends.alias("e")).crossJoin(point).select(F.lit(f"{pair[0]} - {pair[1]}").alias("group"), "e", "rate")
    return single.select("group", "e", "rate").unionByName(gap).select("group", "rate", F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))
