"""Windows over forecast hours, steps of a path and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from cumula.functions.wind import haversine

MM_PER_INCH, KT_PER_MS = 25.4, 1.9438445
# Spans of the snapshot and fixed wind products in forecast hours.
SPANS = {"0_24h": (1, 24), "24_48h": (25, 48), "0_48h": (1, 48)}


def window_reduce(values: DataFrame, keys: list[str], hours: list[int]) -> DataFrame:
    """Sum, greatest, least, range and contributing hours over the named hours.

    The sum is null unless every hour is there with a value; the others take
    what there is. (NaN never occurs: missing values are null.)
    """
    got = values.where(F.col("fhr").isin(hours)).groupBy(*keys).agg(F.sum("value").alias("_s"), F.count("value").alias("hours"), F.max("value").alias("max"), F.min("value").alias("min"))
    return got.select(*keys, F.when(F.col("hours") == len(set(hours)), F.col("_s")).alias("sum"), "max", "min", (F.col("max") - F.col("min")).alias("range"), "hours")


def trailing(values: DataFrame, keys: list[str], n: int, agg: str = "sum") -> DataFrame:
    """``values`` with ``trail``: the aggregate over the last n hours, null where one is missing."""
    w = Win.partitionBy(*keys).orderBy("fhr").rangeBetween(-(n - 1), 0)
    got = {"sum": F.sum, "max": F.max, "min": F.min}[agg]("value").over(w)
    return values.withColumn("trail", F.when(F.count("value").over(w) == n, got))


def run_total(values: DataFrame, keys: list[str], agg: str = "sum") -> DataFrame:
    """``values`` with ``total``: the aggregate from hour 1 to each hour, null where one is missing."""
    w = Win.partitionBy(*keys).orderBy("fhr").rowsBetween(Win.unboundedPreceding, 0)
    own = values.where("fhr >= 1")
    got = {"sum": F.sum, "max": F.max}[agg]("value").over(w)
    return own.withColumn("total", F.when(F.count("value").over(w) == F.col("fhr"), got))


def qpf(hourly: DataFrame, direct: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, fhr, qpf_in, strategy, hours) of the last n hours, in inches.

    A direct n-hour amount (keys, fhr, mm) is preferred; else all n hourly
    amounts (keys, fhr, value) are needed; else the strategy is ``blocked``.
    """
    t = trailing(hourly, keys, n)
    w = Win.partitionBy(*keys).orderBy("fhr").rangeBetween(-(n - 1), 0)
    t = t.withColumn("_hours", F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.col("fhr"))).over(w)))
    both = t.join(direct.select(*keys, "fhr", F.col("mm").alias("_mm")), [*keys, "fhr"], "left")
    has = F.col("_mm").isNotNull()
    strategy = F.when(has, "direct").when(F.col("trail").isNotNull(), "hourly_sum").otherwise("blocked")
    return both.select(*keys, "fhr", (F.coalesce("_mm", "trail") / MM_PER_INCH).alias("qpf_in"), strategy.alias("strategy"), F.when(has, F.array("fhr")).when(F.col("trail").isNotNull(), F.col("_hours")).alias("hours"))


def wind_max(values: DataFrame, keys: list[str], span: str) -> DataFrame:
    """Greatest wind of a span in knots; null unless every hour is there."""
    first, last = SPANS[span]
    got = values.where(F.col("fhr").between(first, last)).groupBy(*keys).agg(F.max("value").alias("m"), F.count("value").alias("n"))
    return got.select(*keys, F.lit(span).alias("span"), F.when(F.col("n") == last - first + 1, F.col("m") * KT_PER_MS).alias("max_kt"))


def snapshot_windows(values: DataFrame, keys: list[str], spans: dict[str, tuple[int, int]]) -> DataFrame:
    """(keys, span, op, value): max, min and range over each span, null unless every hour is there.

    Every row goes to the spans that hold its hour, so one shuffle serves all.
    """
    spans_col = F.array(*(F.struct(F.lit(n).alias("span"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in spans.items()))
    rows = values.select(*keys, "fhr", "value", F.inline(spans_col)).where("fhr between a and b")
    got = rows.groupBy(*keys, "span", (F.col("b") - F.col("a") + 1).alias("need")).agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.count("value").alias("n"))
    full = F.col("n") == F.col("need")
    ops = F.array(*(F.struct(F.lit(o).alias("op"), F.when(full, v).alias("value")) for o, v in (("max", F.col("hi")), ("min", F.col("lo")), ("range", F.col("hi") - F.col("lo")))))
    return got.select(*keys, "span", F.inline(ops))


def eligible(products: DataFrame, runs: DataFrame) -> DataFrame:
    """Products (slug, min_fhr, needs_00z) a run (run, cycle_hour, fhr) may make, and why not.

    ``products`` is the fixed catalogue and is broadcast.
    """
    reason = F.when(F.col("fhr") < F.col("min_fhr"), "forecast hour too early").when(F.col("needs_00z") & (F.col("cycle_hour") != 0), "needs a 00Z cycle")
    return runs.withColumn("_", F.lit(1)).join(F.broadcast(products.dropDuplicates(["slug"]).withColumn("_", F.lit(1))), "_").drop("_").withColumn("blocker", reason)


def window_status(values: DataFrame, keys: list[str], hours: list[int]) -> DataFrame:
    """Hours of a window that are missing, and whether the product can be made."""
    need = F.array(*(F.lit(h).cast("long") for h in hours))
    got = values.groupBy(*keys).agg(F.collect_set(F.when(F.col("value").isNotNull(), F.col("fhr"))).alias("have"))
    miss = F.array_sort(F.array_except(need, "have"))
    return got.select(*keys, miss.alias("missing"), F.when(F.size(miss) == 0, "ok").otherwise("missing_hours").alias("status"))


def hourly_precip(accum: DataFrame, keys: list[str]) -> DataFrame:
    """``accum`` with ``hourly``: the rise since the hour before, 0 or more; hour 0 is its own first amount."""
    w = Win.partitionBy(*keys).orderBy("fhr")
    rise = F.when(F.lag("fhr").over(w) == F.col("fhr") - 1, F.col("value") - F.lag("value").over(w)).when(F.col("fhr") == 0, F.col("value"))
    return accum.withColumn("hourly", F.when(rise.isNotNull(), F.greatest(rise, F.lit(0.0))))


def monotone_height(levels: DataFrame, keys: list[str], least_step: float = 1.0) -> DataFrame:
    """``levels`` with heights that rise by ``least_step`` or more from level to level."""
    w = Win.partitionBy(*keys).orderBy("k").rowsBetween(Win.unboundedPreceding, 0)
    return levels.withColumn("z_m", F.max(F.col("z_m") - F.col("k") * least_step).over(w) + F.col("k") * least_step)


def path_distance(path: DataFrame, key: str) -> DataFrame:
    """``path`` with the distance from its first point along its points."""
    w = Win.partitionBy(key).orderBy("seq")
    step = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    stepped = path.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return stepped.withColumn("distance_km", F.sum("_step").over(w.rowsBetween(Win.unboundedPreceding, 0))).drop("_step")


def coalesce_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges (start, end) that touch or overlap, merged."""
    w = Win.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Win.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    marked = ranges.withColumn("_new", fresh).withColumn("_g", F.sum("_new").over(w.rowsBetween(Win.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("parts")).drop("_g")


def lowest_sweep(gates: DataFrame, keys: list[str], has: Column) -> DataFrame:
    """Gates of the lowest sweep of each volume that has the moment at all."""
    low = gates.where(has).groupBy(*keys).agg(F.min("elev").alias("_low"))
    return gates.join(low, keys).where(F.col("elev") == F.col("_low")).drop("_low")


def distinct_elevations(sweeps: Column, least: float = 0.3) -> Column:
    """Elevations of a sorted array, each ``least`` or more above the last one kept."""
    keep = lambda acc, e: F.when((F.size(acc) == 0) | (e - F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(-99.0)) >= least - 1e-9), F.concat(acc, F.array(e))).otherwise(acc)
    return F.aggregate(sweeps, F.array().cast("array<double>"), keep)


def latest_run(available: DataFrame, products: list[str], fhr: int, sources: list[str]) -> DataFrame:
    """Newest (date, cycle) of each model whose first source in order has all products at the hour."""
    need = len(set(products))
    ok = available.where((F.col("fhr") == fhr) & F.col("product").isin(products)).groupBy("model", "date", "cycle", "source").agg(F.countDistinct("product").alias("n")).where(F.col("n") == need)
    order = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    w = Win.partitionBy("model").orderBy(F.desc("date"), F.desc("cycle"), order)
    return ok.where(order > 0).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "n")
