"""Semi-synthetic change: a ramp to a plateau is added to a series of targets, and baselines are judged by what they keep.

Rows hold pos (0-based place among the entity's targets), m (targets of the entity), y, bk and lk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .balance import weighted_quantile, weighted_quantiles

SCENARIO = ["fraction", "ramp", "magnitude"]
#: How much of the last-k baseline each method holds; the rest is the frozen one.
METHODS = {"B8": 0.0, "A50": 0.5, "L8": 1.0}


def onset_at(fraction: Column, k: int = 8) -> Column:
    """0-based place of the first changed target."""
    return F.greatest(F.lit(2 * k), F.floor(F.col("m") * fraction)).cast("long")


def scenarios(rows: DataFrame, fractions: Sequence[float], ramps: Sequence[int], magnitudes: Sequence[float], k: int = 8) -> DataFrame:
    """Each row in each scenario in which its series is long enough: fraction, ramp, magnitude (in SD), onset (0-based)."""
    grid = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.lit(int(r)).alias("ramp"), F.lit(float(m)).alias("magnitude")) for f in fractions for r in ramps for m in magnitudes])
    out = rows.withColumn("_g", F.explode(grid)).select("*", "_g.*").drop("_g")
    out = out.withColumn("onset", onset_at(F.col("fraction"), k))
    return out.where(F.col("onset") + F.col("ramp") + k <= F.col("m"))


def offset(position: Column, onset: Column, ramp: Column, magnitude: Column) -> Column:
    """Added change at a 0-based position: 0 before the onset, then rising to the magnitude over the ramp."""
    step = (position - onset + 1) / ramp
    return F.when(position < onset, 0.0).otherwise(magnitude * F.least(step, F.lit(1.0)))


def adaptation(position: Column, onset: Column, ramp: Column, magnitude: Column, k: int = 8) -> Column:
    """Mean of the change added at the k positions before this one (none before the first): a difference of the ramp's prefix sums."""

    def total(t: Column) -> Column:  # of min((i + 1) / ramp, 1) over i < t
        return F.when(t <= 0, 0.0).when(t <= ramp, t * (t + 1) / (2 * ramp)).otherwise((ramp + 1) / 2 + (t - ramp))

    return magnitude * (total(position - onset) - total(position - k - onset)) / k


def injected(rows: DataFrame, entity: Sequence[str], k: int = 8) -> DataFrame:
    """off (added change), adapt (how much of it the last-k baseline took in) and phase, in SD."""
    pos, onset, ramp, magnitude = F.col("pos"), F.col("onset"), F.col("ramp"), F.col("magnitude")
    out = rows.withColumn("off", offset(pos, onset, ramp, magnitude)).withColumn("adapt", adaptation(pos, onset, ramp, magnitude, k))
    phase = F.when(pos < onset, "pre").when(pos < onset + ramp, "ramp").when(pos < onset + ramp + k, "plateau").otherwise("after")
    return out.withColumn("phase", phase)


def scored(rows: DataFrame, direction: Column, sd: Column) -> DataFrame:
    """A row for each method: score (signed error in SD) and injected_score, both to six digits."""
    out = rows.withColumn("_m", F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.lit(s).alias("share")) for n, s in METHODS.items()])))
    share = F.col("_m.share")
    score = direction * (F.col("y") - ((1 - share) * F.col("bk") + share * F.col("lk"))) / sd
    # the change is added in the direction that counts, so it comes into the signed score as it is
    gained = F.col("off") - share * F.col("adapt")
    return out.select("*", F.col("_m.method").alias("method"), F.round(score, 6).alias("score"), F.round(score + gained, 6).alias("injected_score"), gained.alias("increment")).drop("_m")


def thresholds(rows: DataFrame, entity: str, q: float = 0.95) -> DataFrame:
    """threshold of each scenario and method: the q-quantile of the scores before the onset, each entity with the same weight."""
    pre = rows.where("phase = 'pre'")
    own = pre.groupBy(*SCENARIO, "method", entity, "score").agg(F.count("*").alias("c"))
    weight = F.col("c") / F.sum("c").over(Window.partitionBy(*SCENARIO, "method", entity))
    return weighted_quantile(own.withColumn("weight", weight), "score", "weight", q, [*SCENARIO, "method"])


def _measured(met: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: retention on the plateau, and alarms of original and injected scores in the rows, which run from the onset to its end."""
    before, after = F.col("score") > F.col("threshold"), F.col("injected_score") > F.col("threshold")
    g = met.groupBy(*by).agg(
        F.count("*").alias("targets"), (F.avg(F.when(F.col("phase") == "plateau", F.col("increment"))) / F.first("magnitude")).alias("retention"),
        F.avg(before.cast("double")).alias("false_alarm"), F.avg(after.cast("double")).alias("detection"), F.min(F.when(after, F.col("pos") - F.col("onset"))).alias("first"),
    )
    return _delayed(g)


def _delayed(g: DataFrame) -> DataFrame:
    return g.select("*", (F.col("detection") - F.col("false_alarm")).alias("excess"), F.col("first").isNotNull().cast("double").alias("detected"), F.coalesce("first", "targets").cast("double").alias("delay"))


def responses(rows: DataFrame, entity: str) -> DataFrame:
    """Per entity, scenario and method: retention on the plateau, and alarms of original and injected scores from the onset to its end.

    The delay is the place of the first alarm of the injected scores in that window, censored at its length.
    """
    met = rows.where("phase IN ('ramp', 'plateau')").join(F.broadcast(thresholds(rows, entity)), [*SCENARIO, "method"])  # a row for each scenario and method
    return _measured(met, [entity, *SCENARIO, "method"])


#: The grid of changes: where they begin, over how many targets they rise, and how far, in SD.
FRACTIONS, RAMPS, MAGNITUDES = (0.4, 0.5, 0.6), (4, 8, 16), (0.5, 1.0)


#: Steps of the histogram of scores, in SD.
WIDTH = 1 / 256


def _held(rows: DataFrame, fractions: Sequence[float], ramps: Sequence[int], k: int) -> DataFrame:
    """A row for each onset and ramp for which it lies between the onset and the end of the plateau, in series that are long enough."""
    pairs = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.lit(int(r)).alias("ramp")) for f in fractions for r in ramps])
    out = rows.where(F.col("pos") >= 2 * k).withColumn("_g", F.explode(pairs)).select("*", "_g.*").drop("_g").withColumn("onset", onset_at(F.col("fraction"), k))
    end = F.col("onset") + F.col("ramp") + k
    return out.where((F.col("pos") >= F.col("onset")) & (F.col("pos") < end) & (end <= F.col("m")))


def _left(share: Column | float, magnitude: float = 1.0, k: int = 8) -> Column:
    """The added change less what the baseline took in of it."""
    change = (F.col("pos"), F.col("onset"), F.col("ramp"), F.lit(float(magnitude)))
    return offset(*change) - share * adaptation(*change, k)


def _kept(share: Column | float, k: int) -> Column:
    """Retention: a plateau's share that is left, on average of its targets; the same for all magnitudes, as both parts are in proportion to it."""
    return F.avg(F.when(F.col("pos") >= F.col("onset") + F.col("ramp"), _left(share, k=k)))


def grid_retention(rows: DataFrame, entity: str, directions: Sequence[float] = (1.0, -1.0), fractions: Sequence[float] = FRACTIONS, ramps: Sequence[int] = RAMPS, magnitudes: Sequence[float] = MAGNITUDES, k: int = 8) -> DataFrame:
    """retention alone of grid_responses: it knows neither scores nor thresholds, so it needs places in series and no values."""
    g = _held(rows.select(entity, "pos", "m"), fractions, ramps, k).groupBy(entity, "fraction", "ramp").agg(*[_kept(s, k).alias(n) for n, s in METHODS.items()])
    cells = [F.struct(F.lit(float(d)).alias("direction"), F.lit(float(x)).alias("magnitude"), F.lit(n).alias("method"), F.col(n).alias("retention")) for d in directions for x in magnitudes for n in METHODS]
    return g.select(entity, "fraction", "ramp", F.explode(F.array(*cells)).alias("_c")).select(entity, "fraction", "ramp", "_c.*")


def grid_responses(rows: DataFrame, entity: str, sd: Column, directions: Sequence[float] = (1.0, -1.0), fractions: Sequence[float] = FRACTIONS, ramps: Sequence[int] = RAMPS, magnitudes: Sequence[float] = MAGNITUDES, k: int = 8, q: float = 0.95) -> DataFrame:
    """responses of all scenarios and directions (1: higher is worse), without a copy of the rows for each scenario.

    An original score knows no scenario.  So thresholds come from one histogram of the scores, with a column of weights
    for each onset and ramp; they are the same for all magnitudes.  Changes are added in closed form to the rows between
    onset and end of the plateau, the only ones that are copied: for each onset, ramp, direction and method, with columns
    for the magnitudes.
    """
    kinds = F.array(*[F.struct(F.lit(float(d)).alias("direction"), F.lit(n).alias("method"), F.lit(s).alias("share")) for d in directions for n, s in METHODS.items()])

    def with_scores(df):
        df = df.withColumn("_m", F.explode(kinds)).select("*", "_m.*").drop("_m")
        return df.withColumn("_raw", F.col("direction") * (F.col("y") - ((1 - F.col("share")) * F.col("bk") + F.col("share") * F.col("lk"))) / sd)

    pairs = [(f, r) for f in fractions for r in ramps]
    names = [f"_w{i}" for i in range(len(pairs))]
    # an entity has as many rows before the onset as the onset says
    weight = lambda f, r: F.when((F.col("pos") < onset_at(F.lit(float(f)), k)) & (onset_at(F.lit(float(f)), k) + r + k <= F.col("m")), 1.0 / onset_at(F.lit(float(f)), k))
    weighed = rows.select("*", *[weight(f, r).alias(n) for n, (f, r) in zip(names, pairs, strict=True)]).where(F.coalesce(*names).isNotNull())
    places = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.lit(int(r)).alias("ramp")) for f, r in pairs])
    limits = weighted_quantiles(with_scores(weighed), "_raw", names, q, ["direction", "method"], WIDTH, 6)
    limits = limits.withColumn("_p", F.get(places, F.col("at"))).select("direction", "method", "_p.*", "threshold")

    def above(x: Column) -> Column:  # of the score to six digits, which matter next to the threshold alone
        return F.when(F.abs(x - F.col("threshold")) > 1e-6, x > F.col("threshold")).otherwise(F.round(x, 6) > F.col("threshold"))

    key = ["direction", "method", "fraction", "ramp"]
    met = with_scores(_held(rows, fractions, ramps, k)).join(F.broadcast(limits), key)  # a row for each of the key
    aggs = [F.count("*").alias("targets"), _kept(F.col("share"), k).alias("retention"), F.count_if(above(F.col("_raw"))).alias("_false")]
    for i, x in enumerate(magnitudes):
        after = above(F.col("_raw") + _left(F.col("share"), x, k))
        aggs += [F.count_if(after).alias(f"_met{i}"), F.min(F.when(after, F.col("pos") - F.col("onset"))).alias(f"_first{i}")]
    cells = [F.struct(F.lit(float(x)).alias("magnitude"), (F.col(f"_met{i}") / F.col("targets")).alias("detection"), F.col(f"_first{i}").alias("first")) for i, x in enumerate(magnitudes)]
    g = met.groupBy(entity, *key).agg(*aggs)
    return _delayed(g.select(entity, *key, "targets", "retention", (F.col("_false") / F.col("targets")).alias("false_alarm"), F.explode(F.array(*cells)).alias("_c")).select("*", "_c.*").drop("_c"))
