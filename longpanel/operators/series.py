"""Ordered series, history features and targets.

A series is the non-null values of one entity in order.  Every feature of a row sees strictly earlier
rows alone.  All windows share one partitioning and order, so a panel of features needs one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clip, days_between


def series(df: DataFrame, entity: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Complete rows with y, rn (1-based rank of the report) and n (reports of the entity)."""
    w = Window.partitionBy(*entity).orderBy(*order)
    y = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    df = df.withColumn("y", y).where("y IS NOT NULL")
    return df.withColumn("rn", F.row_number().over(w).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy(*entity)))


def unpivoted(df: DataFrame, ids: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """Wide outcomes as long rows: outcome, value; missing values are left out."""
    return df.unpivot(list(ids), list(outcomes), "outcome", "value").where("value IS NOT NULL")


class History:
    """Expressions of strictly earlier rows over frames of one ordered window."""

    def __init__(self, entity: Sequence[str], y: str = "y", rn: str = "rn"):
        self.whole = Window.partitionBy(*entity)
        self.order = self.whole.orderBy(rn)
        self.before = self.order.rowsBetween(Window.unboundedPreceding, -1)
        self.y, self.rn = F.col(y), F.col(rn)

    def last(self, k: int):
        return self.order.rowsBetween(-k, -1)

    def frozen_mean(self, k: int) -> Column:
        """Mean of the first k reports."""
        return F.avg(F.when(self.rn <= k, self.y)).over(self.whole)

    def frozen_last(self, k: int) -> Column:
        return F.max(F.when(self.rn == k, self.y)).over(self.whole)

    def rolling_mean(self, k: int) -> Column:
        return F.avg(self.y).over(self.last(k))

    def previous(self) -> Column:
        return F.lag(self.y, 1).over(self.order)

    def running_mean(self) -> Column:
        return F.avg(self.y).over(self.before)

    def oracle_mean(self) -> Column:
        """Mean of the whole series; sees the future, so only a bound."""
        return F.avg(self.y).over(self.whole)

    def rolling_median(self, k: int) -> Column:
        return F.percentile(self.y, 0.5).over(self.last(k))

    def recent_mode(self, k: int) -> Column:
        """Commonest of the last k; of equally common ones the most recent."""
        last = F.collect_list(self.y).over(self.last(k))
        best = F.array_max(F.transform(last, lambda x, i: F.struct(F.size(F.filter(last, lambda z: z == x)).alias("c"), i.alias("i"))))
        return F.get(last, best["i"])

    def ewm(self, k: int = 8, alpha: float = 2 / 9) -> Column:
        """Mean of the first k reports, then moved by alpha towards each later one.

        The frame ends where a report's weight falls below 1e-18, so the work a row is the same in any series.
        """
        reach = math.ceil(math.log(1e-18) / math.log(1 - alpha))
        later = F.collect_list(F.when(self.rn > k, self.y)).over(self.last(reach))
        return F.aggregate(later, self.frozen_mean(k), lambda m, x: m * (1 - alpha) + x * alpha)

    def online_ar1(self, shrink: float = 10.0, bound: float = 0.95) -> Column:
        """mean + phi (last - mean), phi a shrunk lag-1 ratio of the earlier rows, from running sums."""
        b = self.before
        n, s = F.count(self.y).over(b), F.sum(self.y).over(b)
        ss = F.sum(self.y * self.y).over(b)
        cross = F.sum(self.y * F.col("_lag")).over(b)
        first, last = F.first(self.y).over(b), F.last(self.y).over(b)
        constant = F.min(self.y).over(b) == F.max(self.y).over(b)
        m = s / n
        num = cross - m * ((s - last) + (s - first)) + (n - 1) * m * m
        den = (ss - last * last) - 2 * m * (s - last) + (n - 1) * m * m
        w = (n - 1) / (n - 1 + shrink)
        phi = F.when(constant | (den <= 0), 0.0).otherwise(clip(w * F.try_divide(num, den), -bound, bound))
        return m + phi * (last - m)


def with_lag(df: DataFrame, entity: Sequence[str]) -> DataFrame:
    """df with _lag, the previous value, which online_ar1 needs."""
    return df.withColumn("_lag", F.lag("y").over(Window.partitionBy(*entity).orderBy("rn")))


def steps_back(rows: DataFrame, entity: Sequence[str], time: str) -> DataFrame:
    """Rows that are earlier in time than the row before them."""
    w = Window.partitionBy(*entity).orderBy("rn")
    return rows.withColumn("_before", F.lag(time).over(w)).where(F.col(time) < F.col("_before")).drop("_before")


def targets(rows: DataFrame, entity: Sequence[str], order_col: str, k: int = 8) -> DataFrame:
    """Rows after the k-th with bk, lk, age (elapsed days, or distance of an integer order), benefit."""
    h = History(entity)
    start = F.max(F.when(F.col("rn") == k, F.col(order_col))).over(h.whole)
    kind = dict(rows.dtypes)[order_col]
    age = days_between(F.col(order_col), start) if kind.startswith(("timestamp", "date")) else (F.col(order_col) - start).cast("double")
    out = rows.withColumn("bk", h.frozen_mean(k)).withColumn("lk", h.rolling_mean(k)).withColumn("age", age).where(F.col("rn") > k)
    return out.withColumn("ae_b", F.abs(F.col("y") - F.col("bk"))).withColumn("ae_l", F.abs(F.col("y") - F.col("lk"))).withColumn("benefit", F.col("ae_b") - F.col("ae_l"))


def scaled_age(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """x = log1p(age) / stddev_pop(log1p(age)), over all rows or within groups."""
    rows = rows.withColumn("log_age", F.log1p("age"))
    if by:
        return rows.withColumn("x", F.try_divide("log_age", F.stddev_pop("log_age").over(Window.partitionBy(*by))))
    scale = rows.agg(F.stddev_pop("log_age").alias("_sd"))  # one row
    return rows.crossJoin(F.broadcast(scale)).withColumn("x", F.try_divide("log_age", F.col("_sd"))).drop("_sd")


def missing_streak(done: Column, counter: Column, before) -> Column:
    """Missed opportunities directly before this one."""
    return counter - 1 - F.coalesce(F.max(F.when(done, counter)).over(before), F.lit(0))


def opportunities(df: DataFrame, entity: Sequence[str], counter: str, done: Column, least: int = 8) -> DataFrame:
    """All scheduled prompts with `least` earlier completed ones: n_prior, completion_rate, streak."""
    w = Window.partitionBy(*entity).orderBy(counter)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col(counter)
    out = df.withColumn("n_prior", F.coalesce(F.sum(F.when(done, 1).otherwise(0)).over(before), F.lit(0)))
    out = out.withColumn("completion_rate", F.try_divide("n_prior", c - 1)).withColumn("streak", missing_streak(done, c, before))
    return out.where(F.col("n_prior") >= least)


def sessions(df: DataFrame, entity: Sequence[str], time: str, gap_days: float = 30.0, tie: Sequence[str] = ()) -> DataFrame:
    """segment (0-based): a new one begins after a gap of more than gap_days."""
    w = Window.partitionBy(*entity).orderBy(time, *tie)
    gap = days_between(F.col(time), F.lag(time).over(w))
    return df.withColumn("_opens", F.when(gap > gap_days, 1).otherwise(0)).withColumn("segment", F.sum("_opens").over(w)).drop("_opens")


def pseudo_origins(rows: DataFrame, entity: Sequence[str], k: int = 8) -> DataFrame:
    """Early, middle and late starts: origin, base (first k from the start), recent (last k), targets from start + 2k."""
    rows = rows.where(F.col("n") >= 2 * k + 5)
    starts = F.array(
        F.struct(F.lit("early").alias("origin"), F.lit(0).cast("long").alias("start")),
        F.struct(F.lit("middle").alias("origin"), F.floor((F.col("n") - (2 * k + 5)) / 2).cast("long").alias("start")),
        F.struct(F.lit("late").alias("origin"), (F.col("n") - (2 * k + 5)).cast("long").alias("start")),
    )
    rows = rows.withColumn("_o", F.explode(starts)).select("*", "_o.origin", "_o.start").drop("_o")
    w = Window.partitionBy(*entity, "origin")
    base = F.avg(F.when((F.col("rn") > F.col("start")) & (F.col("rn") <= F.col("start") + k), F.col("y"))).over(w)
    recent = F.avg("y").over(w.orderBy("rn").rowsBetween(-k, -1))
    return rows.withColumn("base", base).withColumn("recent", recent).where(F.col("rn") > F.col("start") + 2 * k)


def first_features(rows: DataFrame, entity: Sequence[str], k: int = 8) -> DataFrame:
    """Mean, SD, mean absolute successive difference and trend of the first k reports."""
    w = Window.partitionBy(*entity).orderBy("rn")
    first = rows.withColumn("_step", F.abs(F.col("y") - F.lag("y").over(w))).where(F.col("rn") <= k)
    return first.groupBy(*entity).agg(F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"), F.avg("_step").alias("step"), F.regr_slope("y", "rn").alias("trend"))
