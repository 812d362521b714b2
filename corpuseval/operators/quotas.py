"""Quotas by venue and year, computed on tables of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuseval.operators.reshape import number_rows
from corpuseval.sources.shared import stored

STEPS = 50


def venue_quota(counts: DataFrame, target: int, venue: str = "journal", n: str = "n", power: float = 0.9, slack: int = 3) -> DataFrame:
    """F7. ``quota`` of each venue: target shared by (n/N)^power, rounded half to even, within 0 and n.

    If the sum is short, venues below n get one more, largest raw share first; if it is over target + slack, venues above 0 get one
    less, largest excess first; one pass each. ``counts`` has a row for each venue. Sums are scalars and ranks come from ranges, so no
    task sees all venues.
    """
    rows = stored(counts.select(F.col(venue), F.col(n).alias("n")), "venues")
    all_n = rows.agg(F.sum("n")).first()[0] or 1
    rows = rows.withColumn("_w", F.pow(F.col("n") / F.lit(float(all_n)), F.lit(power)))
    rows = rows.withColumn("_raw", target * F.col("_w") / F.lit(rows.agg(F.sum("_w")).first()[0] or 1.0))
    rows = rows.withColumn("quota", F.least(F.greatest(F.bround("_raw").cast("long"), F.lit(0)), F.col("n")))
    excess = (rows.agg(F.sum("quota")).first()[0] or 0) - target
    if 0 <= excess <= slack:
        return rows.select(venue, "n", "quota")
    step = 1 if excess < 0 else -1
    fit = F.col("quota") < F.col("n") if step > 0 else F.col("quota") > 0
    first = F.col("_raw") if step > 0 else F.col("quota") - F.col("_raw")
    chosen = number_rows(rows.where(fit).select(F.col(venue).alias("_venue"), (-first).alias("_first")), "_first", "_venue").where(F.col("row_no") <= abs(excess))
    joined = rows.join(chosen.select("_venue", F.lit(step).alias("_step")), F.col(venue).eqNullSafe(F.col("_venue")), "left")
    return joined.select(venue, "n", (F.col("quota") + F.coalesce("_step", F.lit(0))).alias("quota"))


def _bisect(low: float, high: float, excess, tolerance: float) -> Column:
    """Bisection in a fold: ``excess(x)`` falls towards 0 as x falls; the last x tried within tolerance, or the last of all."""
    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"), F.lit(high).alias("best"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        e = excess(mid)
        found = F.abs(e) <= tolerance
        return F.when(s["done"], s).otherwise(F.struct(F.when(e < 0, mid).otherwise(s["lo"]).alias("lo"), F.when(e < 0, s["hi"]).otherwise(mid).alias("hi"), mid.alias("best"), found.alias("done")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["best"]


def year_quota_decay(counts: DataFrame, target: int, current: int, venue: str = "journal", year: str = "year", n: str = "n") -> DataFrame:
    """F8. Quota of each (venue, year): the current year in full up to the target, year i before it min(int(current x d^i), n).

    d is 1 if that is still short of the target, else found by bisection in [0.5, 1] to a tolerance of 1. A null year is the current one;
    without rows of the current year all quotas are 0.
    """
    table = counts.groupBy(venue, F.coalesce(year, F.lit(current)).alias("year")).agg(F.sum(n).alias("n"))
    lists = table.groupBy(venue).agg(F.array_sort(F.collect_list(F.struct((-F.col("year")).alias("back"), "n"))).alias("years"), F.coalesce(F.sum(F.when(F.col("year") == current, F.col("n"))), F.lit(0)).alias("cur"))
    first = F.least(F.col("cur"), F.lit(target))
    others = F.filter("years", lambda y: y["back"] != -current)
    part = lambda d, y, i: F.least(F.floor(first * F.pow(d, i + 1)).cast("long"), y["n"])
    total = lambda d: F.aggregate(F.transform(others, lambda y, i: part(d, y, i)), F.lit(0).cast("long"), lambda a, x: a + x) + first
    d = F.when(total(F.lit(1.0)) <= target, F.lit(1.0)).otherwise(_bisect(0.5, 1.0, lambda x: total(x) - target, 1))
    rows = lists.withColumn("_d", d).withColumn("_y", F.concat(F.array(F.struct(F.lit(current).cast("long").alias("year"), first.cast("long").alias("quota"))), F.transform(others, lambda y, i: F.struct((-y["back"]).cast("long").alias("year"), part(F.col("_d"), y, i).alias("quota")))))
    return rows.select(venue, F.inline("_y")).where((F.col("year") != current) | (F.col("quota") > 0))


def year_quota_weight(counts: DataFrame, target: int, current: int, decay: float, venue: str = "journal", year: str = "year", n: str = "n") -> DataFrame:
    """F9. Quota min(int(target x w / W), n) with w = decay^(current - year); what is left fills the newest years first."""
    table = counts.groupBy(venue, F.coalesce(year, F.lit(current)).alias("year")).agg(F.sum(n).alias("n"))
    w = F.pow(F.lit(decay), F.lit(current) - F.col("year"))
    rows = table.withColumn("_w", w).withColumn("quota", F.least(F.floor(target * F.col("_w") / F.sum("_w").over(Window.partitionBy(venue))).cast("long"), F.col("n")))
    rest = F.greatest(target - F.sum("quota").over(Window.partitionBy(venue)), F.lit(0))
    room = F.col("n") - F.col("quota")
    before = F.coalesce(F.sum(room).over(Window.partitionBy(venue).orderBy(F.desc("year")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_more", F.least(room, F.greatest(F.lit(0), rest - before))).select(venue, "year", "n", (F.col("quota") + F.col("_more")).alias("quota"))


def size_factor(counts: DataFrame, target: int, tolerance: int, n: str = "n") -> DataFrame:
    """F10. Exponent f for which the sum of min(n, max(1, int(target (n/N)^f))) is within the tolerance of the target; larger f gives less."""
    # Groups of equal count are one entry: n rows hold at most sqrt(2n) different counts.
    sizes = counts.groupBy(F.col(n).cast("long").alias("n")).agg(F.count("*").alias("groups"))
    rows = sizes.agg(F.array_sort(F.collect_list(F.struct("n", "groups"))).alias("sizes"), F.sum(F.col("n") * F.col("groups")).alias("total"))
    part = lambda x, f: F.least(x["n"], F.greatest(F.lit(1).cast("long"), F.floor(target * F.pow(x["n"] / F.col("total"), f)).cast("long")))
    total = lambda f: F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x["groups"] * part(x, f))
    factor = _bisect(0.0, 4.0, lambda f: -(total(f) - target), tolerance)
    return rows.withColumn("factor", factor).select("factor", total(F.col("factor")).alias("total"))
