"""Entity-balanced aggregates, slopes, correlations and diagnostics.

Every summary is two-level: within entities, then over entities with equal weight.  Both levels are
ordinary aggregates, so they are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clip, correlation


def person_errors(rows: DataFrame, by: Sequence[str], predictions: dict[str, str], actual: str = "y") -> DataFrame:
    """Per group mae_<name>, mse_<name> and targets, for predictions {name: column}."""
    aggs = [F.count("*").alias("targets")]
    for name, column in predictions.items():
        e = F.col(actual) - F.col(column)
        aggs += [F.avg(F.abs(e)).alias(f"mae_{name}"), F.avg(e * e).alias(f"mse_{name}")]
    return rows.groupBy(*by).agg(*aggs)


def balanced(people: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """mae_<name>: mean over people; rmse_<name>: root of the mean over people of their MSE."""
    aggs = [F.count("*").alias("people"), F.sum("targets").alias("targets")]
    for name in names:
        aggs += [F.avg(f"mae_{name}").alias(f"mae_{name}"), F.sqrt(F.avg(f"mse_{name}")).alias(f"rmse_{name}")]
    return people.groupBy(*by).agg(*aggs) if by else people.agg(*aggs)


def long_errors(rows: DataFrame, keep: Sequence[str], methods: dict[str, str], actual: str = "y") -> DataFrame:
    """A row for each row and method: method, prediction, ae, se."""
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).cast("double").alias("prediction")) for m, c in methods.items()])
    out = rows.select(*keep, F.col(actual).alias("actual"), F.explode(pairs).alias("p")).select(*keep, "actual", "p.method", "p.prediction")
    e = F.col("actual") - F.col("prediction")
    return out.withColumn("ae", F.abs(e)).withColumn("se", e * e)


def participant_weights(rows: DataFrame, entity: Sequence[str]) -> DataFrame:
    """weight: 1 / rows of the entity, scaled to mean 1 over all rows."""
    rows = rows.withColumn("_w", 1.0 / F.count("*").over(Window.partitionBy(*entity)))
    mean = rows.agg(F.avg("_w").alias("_m"))  # one row
    return rows.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("_w") / F.col("_m")).drop("_w", "_m")


def slopes(rows: DataFrame, entity: Sequence[str], y: str, x: str, least: int = 5, standardised: bool = False) -> DataFrame:
    """slope of y on x within entities of at least `least` rows and two different x.

    standardised: per standard deviation of the entity's own x.
    """
    g = rows.groupBy(*entity).agg(F.count("*").alias("rows"), F.count_distinct(x).alias("_d"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.stddev_pop(x).alias("_s"))
    g = g.where((F.col("rows") >= least) & (F.col("_d") >= 2))
    if standardised:
        g = g.withColumn("slope", F.col("slope") * F.col("_s"))
    return g.drop("_d", "_s")


def weighted_slopes(rows: DataFrame, entity: Sequence[str], y: str, x: str, w: str, least: int = 5) -> DataFrame:
    """Weighted least-squares slopes from weighted moments, centred by entity for accuracy."""
    part = Window.partitionBy(*entity)
    sw = F.sum(w).over(part)
    c = rows.withColumn("_x", F.col(x) - F.sum(F.col(w) * F.col(x)).over(part) / sw).withColumn("_y", F.col(y) - F.sum(F.col(w) * F.col(y)).over(part) / sw)
    g = c.groupBy(*entity).agg(F.count("*").alias("rows"), F.count_distinct(x).alias("_d"), F.try_divide(F.sum(F.col(w) * F.col("_x") * F.col("_y")), F.sum(F.col(w) * F.col("_x") * F.col("_x"))).alias("slope"))
    return g.where((F.col("rows") >= least) & (F.col("_d") >= 2)).drop("_d")


def cumulative(steps: DataFrame, order: str, value: str, by: Sequence[str] = (), parts: int = 256) -> DataFrame:
    """_upto and _all: the sum of value up to and with each row in order of a number, and over the group.

    The order is dealt out in ranges between quantiles; sums run inside a range and take over those of the
    ranges before it, so no group is ordered in one task.  Rows with equal order share a range.
    """
    cuts = F.percentile_approx(F.col(order), [i / parts for i in range(1, parts)]).alias("_cuts")
    bounds = steps.groupBy(*by).agg(cuts)  # parts - 1 numbers a group
    at = steps.join(F.broadcast(bounds), list(by)) if by else steps.crossJoin(F.broadcast(bounds))
    halves = F.array(*[F.lit(1 << i) for i in reversed(range((parts - 1).bit_length()))])
    below = F.aggregate(halves, F.lit(0), lambda n, h: n + F.when(F.get("_cuts", n + h - 1) < F.col(order), h).otherwise(0))  # cuts below the row, found by halving
    at = at.withColumn("_part", below).drop("_cuts")
    sums = at.groupBy(*by, "_part").agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(*by)
    ranges = sums.select(*by, "_part", F.coalesce(F.sum("_s").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"), F.sum("_s").over(w).alias("_all"))
    inside = Window.partitionBy(*by, "_part").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    out = at.withColumn("_in", F.sum(value).over(inside)).join(F.broadcast(ranges), [*by, "_part"])
    return out.withColumn("_upto", F.col("_before") + F.col("_in")).drop("_part", "_before", "_in")


def average_rank(df: DataFrame, column: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Ranks with ties averaged."""
    counts = df.groupBy(*by, column).agg(F.count("*").cast("double").alias("_c"))
    ranks = cumulative(counts, column, "_c", by).select(*by, column, (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name))
    return df.join(ranks, [*by, column])


def variance_decomposition(rows: DataFrame, entity: Sequence[str]) -> DataFrame:
    """between (variance of entity means), within (mean of entity variances), share between."""
    p = rows.groupBy(*entity).agg(F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    out = p.agg(F.var_pop("m").alias("between"), F.avg("v").alias("within"))
    return out.withColumn("share_between", F.try_divide("between", F.col("between") + F.col("within")))


def centred(rows: DataFrame, entity: Sequence[str]) -> DataFrame:
    """c (value less entity mean) and its previous value."""
    c = rows.withColumn("c", F.col("y") - F.avg("y").over(Window.partitionBy(*entity)))
    return c.withColumn("c_lag", F.lag("c").over(Window.partitionBy(*entity).orderBy("rn")))


def phi_ratio(c: Column, lag: Column) -> Column:
    """Sum of lagged products over the sum of squares, bounded; 0 for constant series."""
    return F.when(F.sum(c * c) > 0, clip(F.try_divide(F.sum(c * lag), F.sum(c * c)), -0.95, 0.95)).otherwise(0.0)


def lag1(rows: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Per-entity correlation of successive values, where three pairs exist and neither side is constant."""
    w = Window.partitionBy(*entity).orderBy("rn")
    pairs = rows.withColumn("prev", F.lag("y").over(w)).where("prev IS NOT NULL")
    return pairs.groupBy(*entity).agg(F.count("*").alias("pairs"), correlation(F.col("y"), F.col("prev")).alias("r")).where("pairs >= 3 AND r IS NOT NULL")


def weighted_quantile(rows: DataFrame, value: str, weight: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """Smallest value whose cumulative share of weight reaches q.

    Values are summed first, so equal values are one step and the ordered part is small.
    """
    steps = cumulative(rows.groupBy(*by, value).agg(F.sum(weight).alias("_w")), value, "_w", by)
    hit = steps.where(F.col("_upto") / F.col("_all") >= q - 1e-12)
    return hit.groupBy(*by).agg(F.min(value).alias("threshold")) if by else hit.agg(F.min(value).alias("threshold"))


def weighted_quantiles(rows: DataFrame, value: str, weights: Sequence[str], q: float, by: Sequence[str], width: float, digits: int) -> DataFrame:
    """weighted_quantile of the value, rounded to digits, for each group and each column of weights, whose place is `at`.

    A histogram in steps of width finds the step in which a share reaches q; the rows of that step alone are then
    ordered.  So no shuffle carries a row for each row and column, and what a task orders is either the steps of a group
    or the values of digits within one step.
    """
    key = [*by, "at"]
    order = lambda c: F.sum("_w").over(Window.partitionBy(*key).orderBy(c))
    binned = rows.withColumn("_bin", F.rint(F.col(value) / width))
    cells = F.array(*[F.struct(F.lit(i).alias("at"), F.col(w).alias("_w")) for i, w in enumerate(weights)])
    bins = binned.groupBy(*by, "_bin").agg(*[F.sum(w).alias(w) for w in weights])
    steps = bins.select(*by, "_bin", F.explode(cells).alias("_c")).select(*by, "_bin", "_c.*").where("_w IS NOT NULL")
    steps = steps.withColumn("_upto", order("_bin")).withColumn("_all", F.sum("_w").over(Window.partitionBy(*key)))
    reach = steps.where(F.col("_upto") / F.col("_all") >= q - 1e-12).groupBy(*key).agg(F.min(F.struct("_bin", (F.col("_upto") - F.col("_w")).alias("_below"), "_all")).alias("_s"))
    inside = binned.join(F.broadcast(reach.select(*key, "_s.*")), [*by, "_bin"])  # a row for each of the key
    inside = inside.withColumn("_w", F.get(F.array(*weights), F.col("at"))).where("_w IS NOT NULL").withColumn("_v", F.round(value, digits))
    last = inside.groupBy(*key, "_below", "_all", "_v").agg(F.sum("_w").alias("_w")).withColumn("_upto", F.col("_below") + order("_v"))
    # the step's last value reaches q by its sum, whatever the order of additions did to it
    hit = F.when(F.col("_upto") / F.col("_all") >= q - 1e-12, F.col("_v"))
    return last.groupBy(*key).agg(F.coalesce(F.min(hit), F.max("_v")).alias("threshold"))


def score_distribution(rows: DataFrame, by: Sequence[str], low: float, high: float) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"), F.min("y").alias("min"), F.max("y").alias("max"),
        F.avg(F.when(F.col("y") <= low, 1.0).otherwise(0.0)).alias("floor"), F.avg(F.when(F.col("y") >= high, 1.0).otherwise(0.0)).alias("ceiling"),
    )


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """Counts and percents; missing values are a class of their own."""
    g = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("Missing")).alias("level")).agg(F.count("*").alias("n"))
    return g.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def marginals(rows: DataFrame, entity: Sequence[str], low: float, high: float) -> DataFrame:
    """Per entity mean, sd, floor, ceiling, lag1, outside (share out of the scale) and grid (share of whole numbers)."""
    share = lambda c: F.avg(c.cast("double"))
    y = F.col("y")
    pairs = rows.withColumn("_p", F.lag("y").over(Window.partitionBy(*entity).orderBy("rn")))
    return pairs.groupBy(*entity).agg(
        F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"), share(y == low).alias("floor"), share(y == high).alias("ceiling"), correlation(y, F.col("_p")).alias("lag1"),
        share((y < low) | (y > high)).alias("outside"), share(F.abs(y - F.rint(y)) <= 1e-10).alias("grid"),
    )


def correlation_phi(rows: DataFrame, entity: Sequence[str], least: int = 9, shrink: float = 10.0) -> DataFrame:
    """phi of entities with enough reports: the correlation of successive values, drawn to that of all pairs by max(n - 3, 0)."""
    w = Window.partitionBy(*entity).orderBy("rn")
    pairs = rows.where(F.col("n") >= least).withColumn("_p", F.lag("y").over(w))
    pooled = pairs.agg(correlation(F.col("_p"), F.col("y")).alias("phi_pooled"))
    sd = F.sqrt(F.greatest(F.var_samp("y"), F.lit(1e-8)))
    own = pairs.groupBy(*entity).agg(F.first("n").alias("n"), F.avg("y").alias("mean"), sd.alias("sd"), F.coalesce(correlation(F.col("_p"), F.col("y")), F.lit(0.0)).alias("phi_raw"))
    more = F.greatest(F.col("n") - 3, F.lit(0))
    share = more / (more + shrink)
    return own.crossJoin(F.broadcast(pooled)).withColumn("phi", clip(share * F.col("phi_raw") + (1 - share) * F.col("phi_pooled"), -0.95, 0.95))
