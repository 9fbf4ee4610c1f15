"""Whole studies: stress tests, cross-fitted budgets, bootstraps, extensions and audits, with the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clip, correlation, days_between, relative_change, spearman_brown, weighted_mean
from ..operators import balance, models, quality, redraw, resample, stress, verdicts
from ..operators import series as ops
from ..sources import cohorts
from .base import ENTITY, S, T, out, r, reports, rows_after_eight, table
from .queries import _ALPHAS, _DRAWS, _EL, _FEATURES, _FM, _FO, _NULL, _PEOPLE, _REARRANGED, _W, _X, _balanced, _bootstrap, _early_late, _first_features_and_gain, _folded, _folds, _lcg_sql, _null, _people, _prompts, _scaled, _shrunk, query

# -- semi-synthetic change -------------------------------------------------------------------------

_SCENARIO = "direction, fraction, ramp, magnitude"
_CHANGED = f"""{T}, k AS (SELECT user_id, rn - 9 AS pos, n - 8 AS m, y, bk, lk FROM t), sd AS (SELECT sqrt(avg(v)) AS sd FROM (SELECT var_samp(y) AS v FROM k GROUP BY user_id)),
c AS (SELECT k.*, direction, fraction, ramp, magnitude, greatest(16, CAST(floor(m * fraction) AS BIGINT)) AS onset FROM k, (SELECT unnest([4, 8, 16]) AS ramp), (SELECT unnest([0.5e0, 1e0]) AS magnitude), (SELECT unnest([0.4e0, 0.5e0, 0.6e0]) AS fraction), (SELECT unnest([1e0, -1e0]) AS direction)),
e AS (SELECT *, CASE WHEN pos < onset THEN 0e0 ELSE magnitude * least((pos - onset + 1) / CAST(ramp AS DOUBLE), 1e0) END AS off FROM c WHERE onset + ramp + 8 <= m),
i AS (SELECT *, coalesce(sum(off) OVER (PARTITION BY user_id, {_SCENARIO} ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0) / 8 AS adapt FROM e),
z AS (SELECT i.*, method, off - share * adapt AS increment, round(direction * (y - ((1 - share) * bk + share * lk)) / sd, 6) AS score, round(direction * (y - ((1 - share) * bk + share * lk)) / sd + (off - share * adapt), 6) AS injected FROM i, sd, (VALUES ('B8', 0e0), ('A50', 0.5e0), ('L8', 1e0)) v(method, share)),
w AS (SELECT {_SCENARIO}, method, score, sum(w) AS w FROM (SELECT *, 1e0 / count(*) OVER (PARTITION BY {_SCENARIO}, method, user_id) AS w FROM z WHERE pos < onset) GROUP BY ALL),
q AS (SELECT *, sum(w) OVER (PARTITION BY {_SCENARIO}, method ORDER BY score) / sum(w) OVER (PARTITION BY {_SCENARIO}, method) AS c FROM w),
h AS (SELECT {_SCENARIO}, method, min(score) AS threshold FROM q WHERE c >= 0.95 - 1e-12 GROUP BY ALL),
u AS (SELECT user_id, {_SCENARIO}, method, count(*) AS targets, avg(increment) FILTER (pos >= onset + ramp) / any_value(magnitude) AS retention, avg(CAST(score > threshold AS DOUBLE)) AS fa, avg(CAST(injected > threshold AS DOUBLE)) AS de, min(pos - onset) FILTER (injected > threshold) AS first
  FROM z JOIN h USING ({_SCENARIO}, method) WHERE pos >= onset AND pos < onset + ramp + 8 GROUP BY ALL)"""


_CHANGE = ["direction", *stress.SCENARIO, "method"]


def _panel(spark, d):
    return rows_after_eight(spark, d).select("user_id", (F.col("rn") - 9).alias("pos"), (F.col("n") - 8).alias("m"), "y", "bk", "lk")


@query(f"WITH {_CHANGED} SELECT {_SCENARIO}, method, count(*) AS people, {r('avg(retention)')} AS retention FROM u GROUP BY ALL")
def deterioration_retention(spark, d):
    """18 scenarios in both directions."""
    g = stress.grid_retention(_panel(spark, d), "user_id").groupBy(*_CHANGE).agg(F.count("*").alias("people"), F.avg("retention").alias("r"))
    return out(g, *_CHANGE, "people", retention="r")


@query(f"WITH {_CHANGED} SELECT {_SCENARIO}, method, CAST(sum(targets) AS BIGINT) AS targets, {r('avg(fa)')} AS false_alarm, {r('avg(de)')} AS detection, {r('avg(de - fa)')} AS excess, {r('avg(CASE WHEN first IS NULL THEN 0e0 ELSE 1e0 END)')} AS detected, {r('avg(coalesce(first, targets))')} AS delay FROM u GROUP BY ALL")
def alarm_metrics(spark, d):
    """18 scenarios in both directions."""
    names = ("false_alarm", "detection", "excess", "detected", "delay")
    t = _panel(spark, d)
    sd = t.groupBy("user_id").agg(F.var_samp("y").alias("v")).agg(F.sqrt(F.avg("v")).alias("sd"))
    g = stress.grid_responses(t.crossJoin(F.broadcast(sd)), "user_id", F.col("sd")).groupBy(*_CHANGE).agg(F.sum("targets").alias("targets"), *[F.avg(c).alias(c) for c in names])
    return out(g, *_CHANGE, "targets", **{c: c for c in names})


# -- cross-fitted budgets, nine rules ----------------------------------------------------------------

_BUDGETS = (2, 4, 6, 8)
_BUDGET_SQL = f"""{S}, {_FM}, h AS (SELECT s.*, fold, {', '.join(f'avg(CASE WHEN rn <= {k} THEN y END) OVER (PARTITION BY user_id) AS m{k}, max(CASE WHEN rn = {k} THEN y END) OVER (PARTITION BY user_id) AS l{k}' for k in _BUDGETS)},
  avg(y) OVER ({_W} UNBOUNDED PRECEDING AND 1 PRECEDING) AS m0, lag(y) OVER (PARTITION BY user_id ORDER BY rn) AS l0 FROM s JOIN fm USING (user_id)),
x AS (SELECT user_id, fold, rn, y, budget, m, l FROM h, LATERAL (VALUES (0, m0, l0), {', '.join(f'({k}, m{k}, l{k})' for k in _BUDGETS)}) v(budget, m, l) WHERE rn > 8),
g AS (SELECT unnest(range(0, 41)) / 40e0 AS w), p AS (SELECT budget, fold, user_id, w, avg(abs(y - m - w * (l - m))) AS loss FROM x, g GROUP BY ALL),
q AS (SELECT budget, tf, w, round(avg(loss), 12) AS loss FROM p, (SELECT unnest(range(1, 6)) AS tf) WHERE fold <> tf GROUP BY budget, tf, w QUALIFY row_number() OVER (PARTITION BY budget, tf ORDER BY round(avg(loss), 12), w) = 1),
e AS (SELECT budget, user_id, avg(abs(y - (m + w * (l - m)))) AS mae FROM x JOIN q ON q.budget = x.budget AND fold = tf GROUP BY ALL)""".replace("SELECT budget, user_id, avg", "SELECT x.budget, user_id, avg")


def _budget_people(spark, d):
    """budget (0: online), user_id, mae: weights tuned a budget and fold on the other folds' people."""
    h = ops.History(ENTITY)
    rows = reports(spark, d).join(_folds(spark, d), "user_id")
    pairs = [F.struct(F.lit(0).alias("budget"), h.running_mean().alias("m"), h.previous().alias("l")), *[F.struct(F.lit(k).alias("budget"), h.frozen_mean(k).alias("m"), h.frozen_last(k).alias("l")) for k in _BUDGETS]]
    x = rows.withColumn("_b", F.array(*pairs)).where("rn > 8").select("user_id", "fold", "y", F.explode("_b").alias("_b")).select("user_id", "fold", "y", "_b.*")
    return models.budget_errors(x, "user_id", "m", "l", 5)


@query(f"WITH {_BUDGET_SQL} SELECT CAST(budget AS INTEGER) AS budget, count(*) AS people, {r('avg(mae)')} AS mae, {r('100 * (max(CASE WHEN budget = 0 THEN avg(mae) END) OVER () / avg(mae) - 1)')} AS online_percent FROM e GROUP BY budget")
def budget_curve(spark, d):
    g = _budget_people(spark, d).groupBy("budget").agg(F.count("*").alias("people"), F.avg("mae").alias("mae"))
    online = F.max(F.when(F.col("budget") == 0, F.col("mae"))).over(Window.partitionBy())  # a row a budget
    return out(g.withColumn("c", relative_change(online, F.col("mae"))), "budget", "people", mae="mae", online_percent="c")


_NINE = """nine AS (
  SELECT s.user_id, s.rn, s.y, avg(CASE WHEN rn <= 8 THEN y END) OVER w AS B8, avg(y) OVER (w ORDER BY rn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS L8, lag(y) OVER (w ORDER BY rn) AS Last, avg(y) OVER (w ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS Cumulative,
    median(y) OVER (w ORDER BY rn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS Median8, avg(y) OVER w AS OracleMean, stddev_pop(y) OVER w AS sd,
    list(y) OVER (w ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM s WINDOW w AS (PARTITION BY user_id)),
a AS (SELECT *, list_reduce(list_prepend(B8, past[9:]), lambda m, x: m * (7 / 9e0) + x * (2 / 9e0)) AS EWM8, len(past) AS k, list_avg(past) AS mu, list_transform(past, lambda x: x - list_avg(past)) AS dev, past[len(past)-7:] AS eight FROM nine WHERE rn > 8),
b AS (SELECT *, CASE WHEN list_min(past) = list_max(past) OR list_sum(list_transform(range(1, k), lambda i: dev[i] * dev[i])) <= 0 THEN 0e0 ELSE greatest(least((k - 1) / (k - 1 + 10e0) * list_sum(list_transform(range(1, k), lambda i: dev[i] * dev[i + 1])) / list_sum(list_transform(range(1, k), lambda i: dev[i] * dev[i])), 0.95e0), -0.95e0) END AS phi,
  list_max(list_transform(range(1, 9), lambda i: 10 * len(list_filter(eight, lambda z: z = eight[i])) + i)) % 10 AS best FROM a),
c AS (SELECT *, mu + phi * (past[k] - mu) AS OnlineAR1, eight[best] AS Mode8 FROM b),
l AS (SELECT user_id, y, sd, method, p FROM c, LATERAL (VALUES ('B8', B8), ('L8', L8), ('Last', Last), ('Cumulative', Cumulative), ('EWM8', EWM8), ('Median8', Median8), ('Mode8', Mode8), ('OnlineAR1', OnlineAR1), ('OracleMean', OracleMean)) v(method, p)),
u AS (SELECT user_id, method, count(*) AS targets, avg(abs(y - p)) AS mae, avg(abs(y - p)) / nullif(any_value(sd), 0) AS smae FROM l GROUP BY ALL),
o AS (SELECT method, count(*) AS people, CAST(sum(targets) AS BIGINT) AS targets, avg(mae) AS mae, avg(smae) AS smae FROM u GROUP BY method)"""


@query(f"WITH {S}, {_NINE} SELECT method, people, targets, method = 'OracleMean' AS oracle, {r('mae')} AS mae, {r('smae')} AS standardised_mae, {r('''mae - max(CASE WHEN method = 'B8' THEN mae END) OVER ()''')} AS difference, {r('''100 * (mae / max(CASE WHEN method = 'B8' THEN mae END) OVER () - 1)''')} AS percent FROM o")
def comparator_panel_nine(spark, d):
    h = ops.History(ENTITY)
    rules = {"B8": h.frozen_mean(8), "L8": h.rolling_mean(8), "Last": h.previous(), "Cumulative": h.running_mean(), "EWM8": h.ewm(), "Median8": h.rolling_median(8), "Mode8": h.recent_mode(8), "OnlineAR1": h.online_ar1(), "OracleMean": h.oracle_mean()}
    rows = ops.with_lag(reports(spark, d), ENTITY)
    rows = rows.select("user_id", "rn", "y", F.stddev_pop("y").over(h.whole).alias("sd"), *[v.alias(k) for k, v in rules.items()]).where("rn > 8")
    p = balance.long_errors(rows, ["user_id", "sd"], {k: k for k in rules}).groupBy("user_id", "method").agg(F.count("*").alias("targets"), F.avg("ae").alias("mae"), F.try_divide(F.avg("ae"), F.first("sd")).alias("smae"))
    g = p.groupBy("method").agg(F.count("*").alias("people"), F.sum("targets").alias("targets"), F.avg("mae").alias("mae"), F.avg("smae").alias("smae"))
    base = F.max(F.when(F.col("method") == "B8", F.col("mae"))).over(Window.partitionBy())  # nine rows
    g = g.withColumn("difference", F.col("mae") - base).withColumn("percent", relative_change(F.col("mae"), base)).withColumn("oracle", F.col("method") == "OracleMean")
    return out(g, "method", "people", "targets", "oracle", mae="mae", standardised_mae="smae", difference="difference", percent="percent")


# -- the bootstrap family ----------------------------------------------------------------------------


def _drawn(people: str, statistics: str) -> str:
    """A statistic of every draw of the people in CTE b."""
    return f"{people}, ix AS (SELECT *, row_number() OVER (ORDER BY {_lcg_sql('user_id')}, user_id) - 1 AS idx FROM b), ds AS (SELECT draw, {_lcg_sql('31415926', 'draw', 'slot')} % (SELECT count(*) FROM b) AS idx FROM (SELECT unnest(range(0, {_DRAWS})) AS draw), (SELECT unnest(range(0, (SELECT count(*) FROM b))) AS slot)), q AS (SELECT draw, {statistics} FROM ds JOIN ix USING (idx) GROUP BY draw)"


def _interval_sql(column: str, name: str) -> str:
    return f"{r(f'quantile_cont({column}, 0.025)')} AS {name}_low, {r(f'quantile_cont({column}, 0.975)')} AS {name}_high"


def _intervals(draws, *names):
    g = draws.agg(F.count("*").alias("draws"), *[F.percentile(c, q).alias(f"{c}_{e}") for c in names for e, q in (("low", 0.025), ("high", 0.975))], *[F.count(c).alias(f"{c}_valid") for c in names])
    return out(g, "draws", *[f"{c}_valid" for c in names], **{f"{c}_{e}": f"{c}_{e}" for c in names for e in ("low", "high")})


def _bootstrap_means(people, **statistics):
    """Statistics of the means of each bootstrap's persons, which _mean names."""
    used = [c for c in people.columns if c != "user_id"]
    return resample.bootstrap_means(people, "user_id", _DRAWS, used).select("draw", *[v.alias(k) for k, v in statistics.items()])


def _mean(c):
    return F.col(c)


_SLOPES = f"{_X}, b AS (SELECT user_id, regr_slope(benefit, x) AS slope FROM x GROUP BY user_id HAVING count(*) >= 5 AND count(DISTINCT x) >= 2)"


@query(f"WITH {_drawn(_SLOPES, 'avg(slope) AS slope, avg(CASE WHEN slope > 0 THEN 1e0 ELSE 0 END) AS positive')} SELECT count(*) AS draws, count(slope) AS slope_valid, count(positive) AS positive_valid, {_interval_sql('slope', 'slope')}, {_interval_sql('positive', 'positive')} FROM q")
def slope_bootstrap(spark, d):
    people = balance.slopes(_scaled(spark, d), ENTITY, "benefit", "x").withColumn("up", (F.col("slope") > 0).cast("double"))
    return _intervals(_bootstrap_means(people, slope=_mean("slope"), positive=_mean("up")), "slope", "positive")


@query(f"WITH {_drawn(_PEOPLE.replace(', p AS (', ', b AS ('), 'sqrt(avg(mse_l)) - sqrt(avg(mse_b)) AS delta')} SELECT count(*) AS draws, count(delta) AS delta_valid, {_interval_sql('delta', 'delta')} FROM q")
def paired_rmse_bootstrap(spark, d):
    delta = F.sqrt(_mean("mse_l")) - F.sqrt(_mean("mse_b"))
    return _intervals(_bootstrap_means(_people(spark, d), delta=delta), "delta")


_HALF = f"{_EL}, b AS (SELECT * FROM sa)"


@query(f"WITH {_drawn(_HALF, 'corr(a, b) AS r').replace('corr(a, b)', 'corr(ix.a, ix.b)')} SELECT count(*) AS draws, count(r) AS r_valid, {_interval_sql('r', 'r')}, count(r) >= 1900 AS enough FROM q")
def correlation_bootstrap(spark, d):
    """Draws without spread are left out; at least 1,900 of 2,000 must be left."""
    g = _intervals(resample.bootstrap(_early_late(spark, d), "user_id", _DRAWS, r=resample.weighted_correlation("a", "b")), "r")
    return g.withColumn("enough", F.col("r_valid") >= 1900)


@query(f"WITH {_drawn(_HALF, '2 * corr(ix.a, ix.b) / (1 + corr(ix.a, ix.b)) AS sb')} SELECT count(*) AS draws, count(sb) AS sb_valid, {_interval_sql('sb', 'sb')} FROM q")
def spearman_brown_bootstrap(spark, d):
    return _intervals(resample.bootstrap(_early_late(spark, d), "user_id", _DRAWS, sb=spearman_brown(resample.weighted_correlation("a", "b"))), "sb")


_SPARSE = f"{_PEOPLE}, b AS (SELECT user_id, CASE WHEN mae_l < mae_b THEN mae_l END AS v FROM p)"


@query(f"WITH {_drawn(_SPARSE, 'avg(v) AS v')} SELECT count(*) AS draws, count(v) AS v_valid, {_interval_sql('v', 'v')} FROM q")
def skip_missing_bootstrap(spark, d):
    """Missing values are skipped in each draw, and draws without values in the interval."""
    people = _people(spark, d).select("user_id", F.when(F.col("mae_l") < F.col("mae_b"), F.col("mae_l")).alias("v"))
    return _intervals(_bootstrap_means(people, v=_mean("v")), "v")


_OOF = f"""{_FM}, pg AS (SELECT user_id, avg(benefit) AS gain, any_value(fold) AS fold FROM t JOIN fm USING (user_id) GROUP BY user_id),
pf AS (SELECT user_id, avg(y) AS m FROM s WHERE rn <= 8 GROUP BY user_id), pj AS (SELECT * FROM pg JOIN pf USING (user_id)),
co AS (SELECT tf, regr_slope(gain, m) AS slope, regr_intercept(gain, m) AS cut, avg(gain) AS mean FROM pj, (SELECT unnest(range(1, 6)) AS tf) WHERE fold <> tf GROUP BY tf),
b AS (SELECT user_id, fold, gain, cut + slope * m AS prediction, mean AS dummy FROM pj JOIN co ON fold = tf)"""


def _oof(spark, d):
    """gain of each person, predicted from the first mean by a line, and by the mean, that other folds gave."""
    gain = rows_after_eight(spark, d).groupBy("user_id").agg(F.avg("benefit").alias("gain"))
    first = reports(spark, d).where("rn <= 8").groupBy("user_id").agg(F.avg("y").alias("m"))
    p = gain.join(first, "user_id").join(_folds(spark, d), "user_id")
    line = models.held_out_folds(p, 5).groupBy("test_fold").agg(F.regr_slope("gain", "m").alias("slope"), F.regr_intercept("gain", "m").alias("cut"), F.avg("gain").alias("dummy"))
    met = p.join(F.broadcast(line.withColumnRenamed("test_fold", "fold")), "fold")
    return met.select("user_id", "fold", "gain", (F.col("cut") + F.col("slope") * F.col("m")).alias("prediction"), "dummy")


@query(f"WITH {_drawn(f'{T}, {_OOF}', 'sqrt(avg((gain - prediction) ** 2)) - sqrt(avg((gain - dummy) ** 2)) AS delta')} SELECT count(*) AS draws, count(delta) AS delta_valid, {_interval_sql('delta', 'delta')} FROM q")
def model_rmse_bootstrap(spark, d):
    people = _oof(spark, d).select("user_id", F.pow(F.col("gain") - F.col("prediction"), 2).alias("e"), F.pow(F.col("gain") - F.col("dummy"), 2).alias("z"))
    return _intervals(_bootstrap_means(people, delta=F.sqrt(_mean("e")) - F.sqrt(_mean("z"))), "delta")


@query(f"WITH {T}, {_OOF} SELECT count(*) AS rows, {r('sqrt(avg((gain - prediction) ** 2))')} AS rmse, {r('avg(abs(gain - prediction))')} AS mae, {r('1 - avg((gain - prediction) ** 2) / var_pop(gain)')} AS r2, {r('corr(prediction, gain)')} AS r, {r('sqrt(avg((gain - dummy) ** 2))')} AS dummy_rmse FROM b")
def oof_metrics(spark, d):
    o = _oof(spark, d)
    dummy = models.pooled_metrics(o, "dummy", "gain").select(F.col("rmse").alias("dummy_rmse"))
    return out(models.pooled_metrics(o, "prediction", "gain").crossJoin(dummy), "rows", rmse="rmse", mae="mae", r2="r2", r="r", dummy_rmse="dummy_rmse")


_MB = f"{_X}, z AS (SELECT *, CASE WHEN rn - 8 <= (n - 8) // 2 THEN 0 ELSE 1 END AS half FROM x), sd AS (SELECT user_id, stddev_pop(y) AS sd FROM s GROUP BY user_id), mb AS (SELECT user_id, avg(benefit) FILTER (half = 0) AS ea, avg(benefit) FILTER (half = 1) AS la, regr_slope(benefit, x) FILTER (half = 0) AS es, regr_slope(benefit, x) FILTER (half = 1) AS ls FROM z GROUP BY user_id HAVING count(*) >= 10), b AS (SELECT * FROM mb JOIN sd USING (user_id) WHERE sd > 0)"


@query(f"WITH {_MB} SELECT count(*) AS people, {r('corr(ea, la)')} AS raw_mean_benefit, {r('corr(ea / sd, la / sd)')} AS standardised_mean_benefit, {r('corr(es, ls)')} AS age_gradient FROM b")
def standardised_reliability(spark, d):
    half = F.when(F.col("rn") - 8 <= F.floor((F.col("n") - 8) / 2), 0).otherwise(1)
    rows = _scaled(spark, d).withColumn("half", half)
    part = lambda i, c: F.when(F.col("half") == i, F.col(c))
    g = rows.groupBy("user_id").agg(F.count("*").alias("c"), *[F.avg(part(i, "benefit")).alias(f"m{i}") for i in (0, 1)], *[F.regr_slope(part(i, "benefit"), F.col("x")).alias(f"s{i}") for i in (0, 1)]).where("c >= 10")
    g = g.join(reports(spark, d).groupBy("user_id").agg(F.stddev_pop("y").alias("sd")), "user_id").where("sd > 0")
    g = g.agg(F.count("*").alias("people"), correlation(F.col("m0"), F.col("m1")).alias("a"), correlation(F.col("m0") / F.col("sd"), F.col("m1") / F.col("sd")).alias("b"), correlation(F.col("s0"), F.col("s1")).alias("c"))
    return out(g, "people", raw_mean_benefit="a", standardised_mean_benefit="b", age_gradient="c")


# -- nulls with everything refitted ------------------------------------------------------------------

_REFITS = 500
_REFIT_SQL = f"""{S}, e AS (SELECT s.*, draw FROM s, (SELECT unnest(range(0, {_REFITS})) AS draw)), v AS (SELECT draw, user_id, y, row_number() OVER (PARTITION BY draw, user_id ORDER BY {_lcg_sql('31415926', 'draw', 'user_id', 'rn')}, rn) AS rn FROM e),
f AS (SELECT draw, user_id, rn, y, avg(CASE WHEN rn <= 8 THEN y END) OVER (PARTITION BY draw, user_id) AS b, avg(y) OVER (PARTITION BY draw, user_id ORDER BY rn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS l FROM v),
k AS (SELECT draw, user_id, {_lcg_sql('31415926', 'draw', 'user_id')} % 5 + 1 AS fold, y, b, l FROM f WHERE rn > 8),
p AS (SELECT draw, fold, user_id, avg((l - b) * (y - b)) AS num, avg((l - b) * (l - b)) AS den FROM k GROUP BY ALL),
w AS (SELECT draw, tf, greatest(least(coalesce(avg(num) / nullif(avg(den), 0), 0), 1), 0) AS w FROM p, (SELECT unnest(range(1, 6)) AS tf) WHERE fold <> tf GROUP BY ALL),
u AS (SELECT k.draw, user_id, avg(abs(y - b)) AS mb, avg(abs(y - (b + w * (l - b)))) AS ml FROM k JOIN w ON w.draw = k.draw AND fold = tf GROUP BY ALL)"""


@query(f"WITH {_REFIT_SQL} SELECT CAST(draw AS INTEGER) AS draw, {r('100 * (avg(ml) / avg(mb) - 1)')} AS percent FROM u GROUP BY draw")
def permutation_null_refit(spark, d):
    """Values permuted within persons; folds are dealt and weights fitted anew in every draw."""
    g = redraw.null_refit(reports(spark, d), ENTITY, "user_id", _REFITS)
    return out(g, "draw", percent=relative_change(F.col("mae_l"), F.col("mae_b")))


@query()
def label_permutation_null(spark, d):
    """Out-of-fold correlation of the nested ridge for 500 permutations of the gains over persons; draw -1 is the real order."""
    return models.label_permutation(_first_features_and_gain(spark, d), "user_id", _FEATURES, "gain", _ALPHAS, 5, _REFITS)


# -- marginal distributions --------------------------------------------------------------------------

_MARGIN = f"{S}, l AS (SELECT *, lag(y) OVER (PARTITION BY user_id ORDER BY rn) AS p FROM s), g AS (SELECT user_id, avg(y) AS mean, stddev_pop(y) AS sd, avg(CASE WHEN y = 5 THEN 1e0 ELSE 0 END) AS floor, avg(CASE WHEN y = 200 THEN 1e0 ELSE 0 END) AS ceiling, CASE WHEN stddev_pop(y) FILTER (p IS NOT NULL) > 0 AND stddev_pop(p) > 0 THEN corr(y, p) END AS lag1, avg(CASE WHEN y < 5 OR y > 200 THEN 1e0 ELSE 0 END) AS outside, avg(CASE WHEN abs(y - round_even(y, 0)) <= 1e-10 THEN 1e0 ELSE 0 END) AS grid FROM l GROUP BY user_id)"


@query(f"WITH {_MARGIN} SELECT count(*) AS people, {', '.join(f'{r(f"avg({c})")} AS {c}' for c in ('mean', 'sd', 'floor', 'ceiling', 'lag1', 'outside', 'grid'))} FROM g")
def marginal_diagnostics(spark, d):
    g = balance.marginals(reports(spark, d), ENTITY, 5.0, 200.0)
    names = ("mean", "sd", "floor", "ceiling", "lag1", "outside", "grid")
    return out(g.agg(F.count("*").alias("people"), *[F.avg(c).alias(c) for c in names]), "people", **{c: c for c in names})


@query()
def ar1_marginals(spark, d):
    """The same diagnostics of 200 autoregressive series a person, within the scale and free."""
    rows = reports(spark, d).join(_shrunk(spark, d), "user_id")
    free = redraw.simulated_marginals(rows, "user_id", 200, 5.0, 200.0)
    bound = redraw.simulated_marginals(rows, "user_id", 200, 5.0, 200.0, bounds=(5.0, 200.0))
    return free.withColumn("generator", F.lit("free")).unionByName(bound.withColumn("generator", F.lit("bounded")))


# -- the extension to another cohort -----------------------------------------------------------------

_ITEMS = """it AS (SELECT l_orderkey, l_shipdate, CAST(floor(l_discount * 100) % 5 AS BIGINT) AS i1, CAST(floor(l_tax * 100) % 5 AS BIGINT) AS i2, CAST(floor(l_quantity) % 6 AS BIGINT) AS i3 FROM lineitem),
va AS (SELECT * FROM it WHERE i1 BETWEEN 0 AND 3 AND i2 BETWEEN 0 AND 3 AND i3 BETWEEN 0 AND 3),
no AS (SELECT l_orderkey, l_shipdate FROM va GROUP BY ALL HAVING count(DISTINCT i1) > 1 OR count(DISTINCT i2) > 1 OR count(DISTINCT i3) > 1)"""


@query(f"WITH {_ITEMS} SELECT DISTINCT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS day, i1 + i2 + i3 AS score, i1 + i2 + 3 - i3 AS reversed FROM va ANTI JOIN no USING (l_orderkey, l_shipdate)")
def scale_totals(spark, d):
    """Totals of items that all lie in 0..3; days whose rows disagree are left out, equal rows count once."""
    i = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", *[(F.floor(x) % m).alias(n) for n, x, m in (("i1", F.col("l_discount") * 100, 5), ("i2", F.col("l_tax") * 100, 5), ("i3", F.col("l_quantity"), 6))])
    t = quality.scale_total(i, ["l_orderkey", "l_shipdate"], ["i1", "i2", "i3"], 0, 3, 9)
    reverse = F.col("i1") + F.col("i2") + quality.reverse_scored(F.col("i3"), 0, 3)
    return t.select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "score", reverse.alias("reversed"))


_EXT = f"{S}, e9 AS (SELECT *, lag(y) OVER (PARTITION BY user_id ORDER BY rn) AS p FROM s WHERE n >= 9), gl AS (SELECT corr(p, y) AS phi FROM e9 WHERE p IS NOT NULL), ow AS (SELECT user_id, any_value(n) AS n, avg(y) AS mean, sqrt(greatest(var_samp(y), 1e-8)) AS sd, CASE WHEN stddev_pop(y) FILTER (p IS NOT NULL) > 0 AND stddev_pop(p) > 0 THEN corr(p, y) ELSE 0e0 END AS raw FROM e9 GROUP BY user_id)"


@query(f"WITH {_EXT} SELECT user_id, n, {r('mean')} AS mean, {r('sd')} AS sd, {r('raw')} AS phi_raw, {r('phi')} AS phi_pooled, {r('greatest(least(greatest(n - 3, 0) / (greatest(n - 3, 0) + 10e0) * raw + (1 - greatest(n - 3, 0) / (greatest(n - 3, 0) + 10e0)) * phi, 0.95), -0.95)')} AS phi FROM ow, gl")
def extension_phi(spark, d):
    return out(balance.correlation_phi(reports(spark, d), ENTITY), "user_id", "n", mean="mean", sd="sd", phi_raw="phi_raw", phi_pooled="phi_pooled", phi="phi")


@query()
def extension_null(spark, d):
    """Unbounded autoregressive series with the extension's phi and sample SD, age in reports."""
    rows = reports(spark, d).join(balance.correlation_phi(reports(spark, d), ENTITY).select("user_id", "phi", "sd"), "user_id")
    return redraw.simulated_null(rows, "user_id", 5000, own_sd=True)


_GAP = 300.0
_SEG = f"g AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, CASE WHEN date_diff('microsecond', lag(o_orderdate) OVER w, o_orderdate) / 86400000000e0 > {_GAP} THEN 1 ELSE 0 END AS opens FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), s AS (SELECT *, o_custkey || '::' || CAST(sum(opens) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS id FROM g), rk AS (SELECT id, o_orderdate, o_totalprice AS y, row_number() OVER (PARTITION BY id ORDER BY o_orderdate, o_orderkey) AS rn FROM s), f AS (SELECT *, avg(CASE WHEN rn <= 8 THEN y END) OVER (PARTITION BY id) AS b, avg(y) OVER (PARTITION BY id ORDER BY rn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS l FROM rk), p AS (SELECT id, count(*) AS targets, avg(abs(y - b)) AS b, avg(abs(y - l)) AS l FROM f WHERE rn > 8 GROUP BY id)"


@query(f"WITH {_SEG} SELECT id, targets, {r('b')} AS mae_b8, {r('l')} AS mae_l8 FROM p")
def segment_histories(spark, d):
    """A gap ends a series: each segment's history begins anew."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    seg = ops.sessions(o, ["o_custkey"], "o_orderdate", _GAP, ["o_orderkey"]).withColumn("id", F.concat_ws("::", "o_custkey", "segment"))
    t = ops.targets(ops.series(seg, ["id"], ["o_orderdate", "o_orderkey"], "o_totalprice"), ["id"], "o_orderdate")
    return out(balance.person_errors(t, ["id"], {"b": "bk", "l": "lk"}), "id", "targets", mae_b8="mae_b", mae_l8="mae_l")


@query(f"WITH {T}, z AS (SELECT *, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY rn), ts) / 86400000000e0 AS gap FROM f), p AS (SELECT CASE WHEN gap >= 14 THEN '>=14 days' ELSE '<14 days' END AS gap_group, user_id, avg(abs(y - bk)) AS b, avg(abs(y - lk)) AS l FROM z WHERE rn > 8 GROUP BY ALL) SELECT gap_group, count(*) AS people, {r('avg(b)')} AS mae_b8, {r('avg(l)')} AS mae_l8, {r('100 * (avg(l) / avg(b) - 1)')} AS percent FROM p GROUP BY gap_group")
def gap_split(spark, d):
    w = Window.partitionBy("user_id").orderBy("rn")
    rows = reports(spark, d).withColumn("gap", days_between(F.col("ts"), F.lag("ts").over(w)))
    t = ops.targets(rows, ENTITY, "ts").withColumn("gap_group", F.when(F.col("gap") >= 14, ">=14 days").otherwise("<14 days"))
    b = balance.balanced(balance.person_errors(t, ["gap_group", "user_id"], {"b": "bk", "l": "lk"}), ["b", "l"], ["gap_group"])
    return out(b, "gap_group", "people", mae_b8="mae_b", mae_l8="mae_l", percent=relative_change(F.col("mae_l"), F.col("mae_b")))


# -- response process, weighted ------------------------------------------------------------------------

_RP = """g AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS counter, event_type <> 'error' AS done FROM events),
h AS (SELECT *, sum(CAST(done AS BIGINT)) OVER (PARTITION BY user_id ORDER BY counter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_prior FROM g),
o AS (SELECT user_id, CAST(done AS DOUBLE) AS y, round(n_prior / (counter - 1e0), 9) AS score, 1e0 / count(*) OVER (PARTITION BY user_id) AS w FROM h WHERE n_prior >= 8),
st AS (SELECT score, sum(w * y) AS p, sum(w * (1 - y)) AS n FROM o GROUP BY score),
cu AS (SELECT *, sum(n) OVER (ORDER BY score) - n AS below, sum(p) OVER (ORDER BY score DESC) AS ap, sum(n) OVER (ORDER BY score DESC) AS an FROM st)"""


@query(f"WITH {_RP} SELECT (SELECT count(*) FROM o) AS opportunities, {r('(SELECT sum(w * y) / sum(w) FROM o)')} AS observed, {r('sum(p * (below + n / 2)) / (sum(p) * sum(n))')} AS roc_auc, {r('sum(p * ap / (ap + an)) / sum(p)')} AS pr_auc, {r('(SELECT sum(w * (score - y) ** 2) / sum(w) FROM o)')} AS brier, {', '.join(f'{r(f"(SELECT quantile_cont(score, {q}) FROM o)")} AS {n}' for n, q in (('p01', 0.01), ('median', 0.5), ('p99', 0.99)))} FROM cu")
def response_metrics(spark, d):
    o = ops.opportunities(_prompts(spark, d), ENTITY, "counter", F.col("done")).select("user_id", F.col("done").cast("double").alias("y"), F.round("completion_rate", 9).alias("score"))
    o = o.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("user_id")))
    g = o.agg(F.count("*").alias("opportunities"), weighted_mean(F.col("y"), F.col("w")).alias("observed"), *[F.percentile("score", q).alias(n) for n, q in (("p01", 0.01), ("median", 0.5), ("p99", 0.99))])
    for one in (models.auc, models.pr_auc, models.brier):
        g = g.crossJoin(one(o, "score", "y", "w"))  # single rows
    return out(g, "opportunities", observed="observed", roc_auc="auc", pr_auc="pr_auc", brier="brier", p01="p01", median="median", p99="p99")


def _response_rows(spark, d):
    o = ops.opportunities(_prompts(spark, d), ENTITY, "counter", F.col("done"))
    o = o.select("user_id", "counter", "ts", "value", "done", F.col("done").cast("double").alias("y"), "completion_rate", F.log1p("streak").alias("streak"))
    return o.join(_folds(spark, d), "user_id").withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("user_id")))


def _response_folds(spark, d):
    return models.crossfit_logistic(_response_rows(spark, d), ["completion_rate", "streak"], "y", 5, cs=(0.01, 0.1, 1.0, 10.0), weight="w")


@query()
def response_model(spark, d):
    """Out-of-fold probabilities of a response, C chosen by inner folds (the smaller on ties), and how well they are calibrated."""
    o = _response_folds(spark, d)
    intercept, slope = models.calibration(o, "probability", "y", "w")
    g = o.agg(F.count("*").alias("opportunities"), F.min("probability").alias("least"), F.max("probability").alias("most"))
    for one in (models.auc, models.pr_auc, models.brier):
        g = g.crossJoin(one(o, "probability", "y", "w"))  # single rows
    return g.withColumn("calibration_intercept", F.lit(float(intercept))).withColumn("calibration_slope", F.lit(float(slope)))


@query()
def ipw_confirmation(spark, d):
    """Errors weighted by the inverse of out-of-fold, bounded response probabilities, with bootstrap interval and verdict."""
    o = _response_folds(spark, d).where("done").select("user_id", "counter", clip(F.col("probability"), 0.10, 0.99).alias("p"))
    done = _prompts(spark, d).where("done").select("user_id", "counter", "value")
    t = ops.targets(ops.series(done, ENTITY, ["counter"], "value"), ENTITY, "counter").join(o, ["user_id", "counter"])
    w = 1 / F.col("p")
    people = t.groupBy("user_id").agg(weighted_mean(F.col("ae_b"), w).alias("b"), weighted_mean(F.col("ae_l"), w).alias("l"))
    change = relative_change(_mean("l"), _mean("b"))
    ci = _bootstrap_means(people, percent=change).agg(F.percentile("percent", 0.025).alias("low"), F.percentile("percent", 0.975).alias("high"))
    g = people.agg(F.count("*").alias("people"), F.avg("b").alias("ipw_b8"), F.avg("l").alias("ipw_l8")).crossJoin(ci)
    g = g.withColumn("percent", relative_change(F.col("ipw_l8"), F.col("ipw_b8")))
    return g.withColumn("verdict", verdicts.improvement(F.col("percent"), F.col("high")))


# -- model benchmark -----------------------------------------------------------------------------------


_SETS = {"intercept": [], "time": ["gap"], "history": ["last", "mean"], "recent": ["last", "mean", "recent"], "history_time": ["last", "mean", "gap"], "identity": ["last", "mean", "gap", "event_type"]}


def _benchmark(spark, d):
    """Predictions of the next value: persons held out (balanced by their reports), and reports held out at random."""
    h = ops.History(ENTITY)
    gap = days_between(F.col("ts"), F.lag("ts").over(h.order))
    rows = reports(spark, d).select("user_id", "event_type", "ts", "rn", "n", "y", h.previous().alias("last"), h.running_mean().alias("mean"), h.rolling_mean(8).alias("recent"), F.when(gap < 14, gap).alias("gap")).where("rn > 8")
    rows = rows.join(resample.group_folds(rows, "user_id").withColumnRenamed("fold", "person_fold"), "user_id").withColumn("row_fold", resample.row_folds(rows, ["user_id", "rn"]))
    return models.benchmark_predictions(rows, "y", _SETS, {"people": "person_fold", "reports": "row_fold"}, 5, alpha=1.0, keep=["user_id"])


@query()
def model_benchmark(spark, d):
    """Six ridge models of the next value under two validations, out-of-fold: validation, model, rows, rmse, mae, r2, r."""
    return models.benchmark_metrics(_benchmark(spark, d))


@query()
def benchmark_bootstrap(spark, d):
    """What the models with recent values, gaps and kinds of report differ by in RMSE from the history model, with intervals over persons."""
    return models.benchmark_differences(_benchmark(spark, d), "user_id", "history", ["recent", "history_time", "identity"], _DRAWS)


@query(f"WITH {S}, w AS (SELECT event_type, user_id, avg(y) AS a, stddev_pop(y) AS b, max(y) AS c FROM s GROUP BY ALL) SELECT event_type, count(*) AS people, {r('corr(a, b)')} AS r_ab, {r('corr(a, c)')} AS r_ac, {r('corr(b, c)')} AS r_bc FROM w GROUP BY event_type HAVING count(*) >= 5")
def loading_inputs(spark, d):
    w = reports(spark, d).groupBy("event_type", "user_id").agg(F.avg("y").alias("a"), F.stddev_pop("y").alias("b"), F.max("y").alias("c"))
    g = w.groupBy("event_type").agg(F.count("*").alias("people"), *[correlation(F.col(x), F.col(y)).alias(f"r_{x}{y}") for x, y in ("ab", "ac", "bc")]).where("people >= 5")
    return out(g, "event_type", "people", r_ab="r_ab", r_ac="r_ac", r_bc="r_bc")


@query()
def loading_stability(spark, d):
    """Loadings of the first component by year and by return flag, in groups of at least 200 rows, and their congruence with those of all."""
    w = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("flag"), *[F.col(f"l_{c}").cast("double").alias(c) for c in ("quantity", "extendedprice", "discount")])
    return models.loading_table(w, ["year", "flag"], ["quantity", "extendedprice", "discount"], 200)


@query()
def component_scores(spark, d):
    """Each person's score on the first component of their first reports."""
    return models.component_scores(_first_features_and_gain(spark, d), ["mean", "sd", "step"]).select("user_id", "score")


# -- joins, sets and guards ----------------------------------------------------------------------------


@query(f"WITH {T}, {_FM}, a AS (SELECT user_id, rn, fold, y, bk FROM t JOIN fm USING (user_id)), b AS (SELECT user_id, rn, fold, lk FROM t JOIN fm USING (user_id)), p AS (SELECT user_id, avg((y - bk) ** 2) AS r, avg((y - lk) ** 2) AS c FROM a JOIN b USING (user_id, rn, fold) GROUP BY user_id) SELECT count(*) AS people, {r('sqrt(avg(c)) - sqrt(avg(r))')} AS delta_rmse FROM p")
def paired_predictions(spark, d):
    t = _folded(spark, d)
    key = ["user_id", "rn", "fold"]
    met = quality.require_unique(t.select(*key, "y", "bk"), key).join(quality.require_unique(t.select(*key, "lk"), key), key)
    p = met.groupBy("user_id").agg(F.avg(F.pow(F.col("y") - F.col("bk"), 2)).alias("r"), F.avg(F.pow(F.col("y") - F.col("lk"), 2)).alias("c"))
    return out(p.agg(F.count("*").alias("people"), (F.sqrt(F.avg("c")) - F.sqrt(F.avg("r"))).alias("x")), "people", delta_rmse="x")


@query("WITH a AS (SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, max(o_totalprice) AS top FROM orders WHERE o_totalprice > 100000 GROUP BY ALL) SELECT o_orderstatus, o_orderpriority, CAST(y AS INTEGER) AS year, n, top FROM a JOIN b USING (o_orderstatus, o_orderpriority, y)")
def natural_keys_join(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year"), "o_totalprice")
    key = ["o_orderstatus", "o_orderpriority", "year"]
    return o.groupBy(*key).agg(F.count("*").alias("n")).join(o.where("o_totalprice > 100000").groupBy(*key).agg(F.max("o_totalprice").alias("top")), key)


@query("SELECT c_custkey, c_acctbal AS balance_left, CAST(x.balance AS DOUBLE) AS balance_right FROM customer LEFT JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS balance FROM orders GROUP BY o_custkey) x ON o_custkey = c_custkey")
def index_join(spark, d):
    """Left join by index, with suffixes for the columns that both sides have."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.max("o_totalprice"), 2).alias("balance"))
    return quality.suffixed_join(c, o, ["c_custkey"])


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 WHEN 'O' THEN 0 END AS rank, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'late' WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 'early' END AS mark FROM orders WHERE o_orderstatus IN ('F', 'O')")
def tuple_lookup(spark, d):
    """Rows of listed states, with the rank of an explicit order and a lookup by pairs of keys."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").where(F.col("o_orderstatus").isin("F", "O"))
    marks = spark.createDataFrame([("F", "1-URGENT", "late"), ("O", "5-LOW", "early")], "o_orderstatus string, o_orderpriority string, mark string")
    met = o.join(F.broadcast(marks), ["o_orderstatus", "o_orderpriority"], "left")  # two rows
    return met.select("o_orderkey", quality.domain_rank(F.col("o_orderstatus"), ["O", "P", "F"]).alias("rank"), "mark")


@query("SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT o_custkey, o_orderstatus FROM orders GROUP BY ALL HAVING count(*) >= 5) USING (o_custkey, o_orderstatus)")
def tuple_filter(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    many = o.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n")).where("n >= 5").select("o_custkey", "o_orderstatus")
    return o.join(many, ["o_custkey", "o_orderstatus"], "left_semi").select("o_orderkey", "o_custkey")


@query("WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT (SELECT count(*) FROM a SEMI JOIN b USING (k)) AS shared, (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS left_only, (SELECT count(*) FROM b ANTI JOIN a USING (k)) AS right_only")
def set_relations(spark, d):
    """Sizes of the intersection and of both differences: disjoint, subset and equal sets follow from zeros."""
    return quality.set_relations(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("WITH a AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY ALL) SELECT 'left' AS side, s, n FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'right', s, n FROM (FROM b EXCEPT ALL FROM a)")
def frame_difference(spark, d):
    """Rows, counted with repeats, that one frame has and the other lacks; none if they are equal."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("s"), "o_totalprice")
    return quality.frame_difference(o.groupBy("s").agg(F.count("*").alias("n")), o.where("o_totalprice > 1000").groupBy("s").agg(F.count("*").alias("n")))


@query("WITH g AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS counter FROM events), c AS (SELECT user_id, count(*) AS rows, count(DISTINCT counter) AS different, CAST(min(counter) AS BIGINT) AS low, CAST(max(counter) AS BIGINT) AS high FROM g GROUP BY user_id) SELECT * FROM c WHERE rows <> 60 OR different <> 60 OR low <> 1 OR high <> 60")
def grid_completeness(spark, d):
    return quality.grid_report(_prompts(spark, d).select("user_id", "counter"), ENTITY, "counter", 60)


@query(f"WITH {T} SELECT user_id, count(DISTINCT bk) AS bk, count(DISTINCT n) AS n, count(DISTINCT lk) AS lk FROM t GROUP BY user_id HAVING count(DISTINCT bk) > 1 OR count(DISTINCT n) > 1 OR count(DISTINCT lk) > 1")
def frozen_invariance(spark, d):
    """Persons in whom a feature takes several values; the frozen ones never do, the recent one does."""
    return quality.varying_features(rows_after_eight(spark, d), ENTITY, ["bk", "n", "lk"])


@query(f"WITH {T}, e AS (SELECT count(DISTINCT user_id) AS people, count(*) AS targets, count(DISTINCT CASE WHEN age <= 0 THEN user_id END) AS without_age FROM t), b AS (SELECT count(*) AS backwards FROM (SELECT ts < lag(ts) OVER (PARTITION BY user_id ORDER BY rn) AS d FROM s) WHERE d), i AS (SELECT count(*) AS unequal FROM (SELECT bk, lk, avg(y) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c, rn FROM f) WHERE rn = 9 AND (abs(c - bk) > 1e-10 OR abs(lk - bk) > 1e-10)) SELECT people, targets, without_age, backwards, unequal FROM e, b, i")
def panel_guards(spark, d):
    """Counts that a study checks: people, targets, persons without positive age, steps back in time, and first targets whose rules differ."""
    h = ops.History(ENTITY)
    rows = reports(spark, d)
    t = rows_after_eight(spark, d).agg(F.count_distinct("user_id").alias("people"), F.count("*").alias("targets"), F.count_distinct(F.when(F.col("age") <= 0, F.col("user_id"))).alias("without_age"))
    back = ops.steps_back(rows, ENTITY, "ts").agg(F.count("*").alias("backwards"))
    first = rows.select("rn", h.frozen_mean(8).alias("b"), h.rolling_mean(8).alias("l"), h.running_mean().alias("c")).where("rn = 9")
    unequal = first.where((F.abs(F.col("c") - F.col("b")) > 1e-10) | (F.abs(F.col("l") - F.col("b")) > 1e-10)).agg(F.count("*").alias("unequal"))
    return t.crossJoin(back).crossJoin(unequal)  # single rows


@query(f"WITH {_X} SELECT user_id, count(*) AS rows, count(DISTINCT x) AS different, count(*) >= 5 AND count(DISTINCT x) >= 2 AS eligible FROM x GROUP BY user_id")
def slope_eligibility(spark, d):
    """Who has a slope, reconciled with the slopes that are made."""
    x = _scaled(spark, d)
    g = x.groupBy("user_id").agg(F.count("*").alias("rows"), F.count_distinct("x").alias("different"))
    made = balance.slopes(x, ENTITY, "benefit", "x").select("user_id", F.lit(True).alias("made"))
    return g.join(made, "user_id", "left").select("user_id", "rows", "different", F.coalesce("made", F.lit(False)).alias("eligible"))


@query(f"WITH {S} SELECT user_id, {r("date_diff('microsecond', min(ts) FILTER (rn = 1), min(ts) FILTER (rn = 8)) / 86400000000e0 + 1")} AS span_days, min(event_type) FILTER (rn = 1) AS first_type, {r('min(y) FILTER (rn = 1)')} AS first_value FROM s GROUP BY user_id HAVING count(*) >= 8")
def first_eight_span(spark, d):
    at = lambda k, c: F.min(F.when(F.col("rn") == k, F.col(c)))
    g = reports(spark, d).groupBy("user_id").agg(F.count("*").alias("c"), at(1, "ts").alias("a"), at(8, "ts").alias("b"), F.min_by("event_type", "rn").alias("first_type"), F.min_by("y", "rn").alias("y1")).where("c >= 8")
    return out(g.withColumn("span", days_between(F.col("b"), F.col("a")) + 1), "user_id", "first_type", span_days="span", first_value="y1")


@query(f"WITH {S}, c AS (SELECT *, floor(n * 0.7) AS cut FROM s), q AS (SELECT *, min(CASE WHEN rn > cut THEN ts END) OVER (PARTITION BY user_id) AS first FROM c WHERE n - cut >= 2), k AS (SELECT user_id, ts, CASE WHEN rn > cut THEN 'test' ELSE 'train' END AS part FROM q WHERE rn > cut OR ts <= first - INTERVAL 14 DAY) SELECT part, count(*) AS rows, count(DISTINCT user_id) AS people, {r("coalesce(min(date_diff('microsecond', last, first) / 86400000000e0), 0)")} AS least_gap FROM (SELECT *, max(CASE WHEN part = 'train' THEN ts END) OVER (PARTITION BY user_id) AS last, min(CASE WHEN part = 'test' THEN ts END) OVER (PARTITION BY user_id) AS first FROM k) GROUP BY part")
def blocked_split_audit(spark, d):
    """Rows and persons of both parts of the blocked split, and the least distance that the purge leaves."""
    w = Window.partitionBy("user_id")
    at = models.blocked_split(reports(spark, d), ENTITY, "ts").withColumn("last", F.max(F.when(F.col("part") == "train", F.col("ts"))).over(w)).withColumn("first", F.min(F.when(F.col("part") == "test", F.col("ts"))).over(w))
    g = at.groupBy("part").agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("people"), F.coalesce(F.min(days_between(F.col("first"), F.col("last"))), F.lit(0.0)).alias("gap"))
    return out(g, "part", "rows", "people", least_gap="gap")


@query(f"WITH {S}, v AS (SELECT user_id, y, n, (rn - 1 + 1 + {_lcg_sql('31415926', '0', 'user_id')} % (n - 1)) % n + 1 AS rn FROM s WHERE n > 1), a AS (SELECT user_id, coalesce(lead(y) OVER w, first_value(y) OVER w) AS z, y FROM s WHERE n > 1 WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), b AS (SELECT user_id, coalesce(lead(y) OVER w, first_value(y) OVER w) AS z, y FROM v WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT (SELECT count(*) FROM a) AS pairs, (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) AS lost")
def shift_keeps_neighbours(spark, d):
    """The multiset of cyclic neighbours of a shifted series, against that of the series."""
    rows = reports(spark, d).where("n > 1")
    new = resample.shifted(rows, ENTITY, "user_id", 1).select("user_id", "rn", F.col("y_new").alias("y"))
    a, b = resample.cyclic_pairs(rows, ENTITY), resample.cyclic_pairs(new, ENTITY)
    return a.agg(F.count("*").alias("pairs")).crossJoin(a.exceptAll(b).agg(F.count("*").alias("lost")))


@query(f"WITH {_FM}, k AS (SELECT user_id, event_id, fold FROM events JOIN fm USING (user_id)) SELECT a.fold, count(DISTINCT a.user_id) AS test_people, count(*) AS test_rows, (SELECT count(DISTINCT b.user_id) FROM k b WHERE b.fold <> a.fold) AS train_people, CAST(0 AS BIGINT) AS shared_people FROM k a GROUP BY a.fold")
def fold_leakage_guard(spark, d):
    """Persons and rows of each fold, and persons on both of its sides."""
    k = table(spark, d, "events").select("user_id").join(_folds(spark, d), "user_id")
    return models.fold_audit(k, "user_id", 5)


_FLOW = "e AS (SELECT user_id, value, count(value) OVER (PARTITION BY user_id) AS n, CASE WHEN value IS NOT NULL THEN count(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS rn FROM events), st AS (SELECT step, name, user_id FROM e, LATERAL (VALUES (0, 'events', true), (1, 'with value', value IS NOT NULL), (2, 'enough reports', value IS NOT NULL AND n > 8), (3, 'targets', value IS NOT NULL AND n > 8 AND rn > 8), (4, 'high targets', value IS NOT NULL AND n > 8 AND rn > 8 AND value > 300)) v(step, name, ok) WHERE ok)"


@query(f"WITH {_FLOW}, g AS (SELECT step, name, count(*) AS rows, count(DISTINCT user_id) AS people FROM st GROUP BY ALL) SELECT step, name, rows, people, coalesce(lag(rows) OVER (ORDER BY step) - rows, 0) AS lost_rows, coalesce(lag(people) OVER (ORDER BY step) - people, 0) AS lost_people FROM g")
def sample_flow(spark, d):
    """Rows and persons that each filter of the main analysis leaves, and that the targets are those that it works on."""
    w = Window.partitionBy("user_id")
    e = table(spark, d, "events").select("user_id", "value", F.count("value").over(w).alias("n"), F.when(F.col("value").isNotNull(), F.count("value").over(w.orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))).alias("rn"))
    steps = {"events": F.lit(True), "with value": F.col("value").isNotNull(), "enough reports": F.col("n") > 8, "targets": F.col("rn") > 8, "high targets": F.col("value") > 300}
    ledger = quality.flow(e, "user_id", steps)
    seen = rows_after_eight(spark, d).agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("people"))
    return quality.require_flow(ledger, seen.select(F.lit("targets").alias("name"), "rows", "people"))


# -- registered panels ---------------------------------------------------------------------------------

_COHORTS = "co AS (SELECT 'events' AS dataset, event_type AS outcome, CAST(user_id AS VARCHAR) AS participant, ts AS moment, event_id AS tie, value AS y FROM events WHERE value IS NOT NULL UNION ALL SELECT 'orders', 'price', CAST(o_custkey AS VARCHAR), o_orderdate, o_orderkey, o_totalprice FROM orders UNION ALL SELECT 'orders', 'items', CAST(o_custkey AS VARCHAR), o_orderdate, o_orderkey, CAST(c AS DOUBLE) FROM orders JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey), sr AS (SELECT *, row_number() OVER (PARTITION BY dataset, outcome, participant ORDER BY moment, tie) AS rn, count(*) OVER (PARTITION BY dataset, outcome, participant) AS n FROM co)"


def _orders_with_items(spark, d):
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("double").alias("items"))
    return table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice").join(items, "o_orderkey", "left")


_EVENT_SCALE = cohorts.Scale(0.0, 500.0)
cohorts.register("events", cohorts.Cohort("events", "user_id", ["ts", "event_id"], {o: _EVENT_SCALE for o in ("click", "error", "purchase", "signup", "view")} | {"purchase": cohorts.Scale(0.0, 500.0, -1.0)}, kind="event_type", value="value"))
cohorts.register("orders", cohorts.Cohort("orders", "o_custkey", ["o_orderdate", "o_orderkey"], {"items": cohorts.Scale(0.0, 20.0), "price": cohorts.Scale(0.0, 600_000.0)}, values={"items": "items", "price": "o_totalprice"}, load=_orders_with_items))
_COHORT_KEY = ["dataset", "outcome", "participant"]


@query(f"WITH {_COHORTS}, f AS (SELECT *, avg(CASE WHEN rn <= 8 THEN y END) OVER (PARTITION BY dataset, outcome, participant) AS b, avg(y) OVER (PARTITION BY dataset, outcome, participant ORDER BY rn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS l FROM sr), p AS (SELECT dataset, outcome, participant, avg(abs(y - b)) AS b, avg(abs(y - l)) AS l, count(*) AS t FROM f WHERE rn > 8 GROUP BY ALL) SELECT dataset, outcome, count(*) AS people, CAST(sum(t) AS BIGINT) AS targets, min(t) AS least, {r('median(t)')} AS median, max(t) AS most, {r('avg(b)')} AS mae_b8, {r('avg(l)')} AS mae_l8 FROM p GROUP BY ALL")
def cohort_summary(spark, d):
    p = balance.person_errors(ops.targets(cohorts.panel(spark, d), _COHORT_KEY, "rn"), _COHORT_KEY, {"b": "bk", "l": "lk"})
    g = p.groupBy("dataset", "outcome").agg(F.count("*").alias("people"), F.sum("targets").alias("t"), F.min("targets").alias("least"), F.percentile("targets", 0.5).alias("median"), F.max("targets").alias("most"), F.avg("mae_b").alias("b"), F.avg("mae_l").alias("l"))
    return out(g.withColumn("targets", F.col("t")), "dataset", "outcome", "people", "targets", "least", "most", median="median", mae_b8="b", mae_l8="l")


_COHORT_NULL = f"""{_COHORTS}, lo AS (SELECT *, CAST(participant AS BIGINT) AS id FROM sr WHERE n > 8), dr AS (SELECT unnest(range(0, {_REARRANGED})) AS draw),
v AS (SELECT draw, dataset, outcome, id, y, (rn - 1 + 1 + {_lcg_sql('31415926', 'draw', 'id')} % (n - 1)) % n + 1 AS rn FROM lo, dr UNION ALL SELECT -1, dataset, outcome, id, y, rn FROM lo),
f AS (SELECT draw, dataset, outcome, id, rn, y, avg(CASE WHEN rn <= 8 THEN y END) OVER w AS b, avg(y) OVER (w ORDER BY rn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS l FROM v WINDOW w AS (PARTITION BY draw, dataset, outcome, id)),
u AS (SELECT draw, dataset, outcome, id, avg(abs(y - b) - abs(y - l)) AS g FROM f WHERE rn > 8 GROUP BY ALL), q AS (SELECT draw, dataset, outcome, avg(g) AS benefit FROM u GROUP BY ALL),
o AS (SELECT dataset, outcome, benefit AS observed FROM q WHERE draw = -1)"""


@query(f"WITH {_COHORT_NULL} SELECT dataset, outcome, count(*) AS draws, {r('any_value(observed)')} AS observed, {r('avg(benefit)')} AS null_mean, {r('stddev_samp(benefit)')} AS null_sd, {r('(1 + count(*) FILTER (round(benefit, 9) >= round(observed, 9))) / (count(*) + 1e0)')} AS p FROM q JOIN o USING (dataset, outcome) WHERE draw >= 0 GROUP BY ALL")
def cohort_null(spark, d):
    """The shift null of every registered outcome, from one pass over all their series."""
    rows = cohorts.panel(spark, d)
    null = redraw.null_benefit(rows, _COHORT_KEY, "id", _REARRANGED, "shifted", cell="cell")
    gain = ops.targets(rows, _COHORT_KEY, "rn").groupBy(*_COHORT_KEY, "cell").agg(F.avg("benefit").alias("g")).groupBy("dataset", "outcome", "cell").agg(F.avg("g").alias("observed"))
    met = null.join(F.broadcast(gain), "cell")  # a row an outcome
    above = F.count_if(F.round("benefit", 9) >= F.round("observed", 9))
    g = met.groupBy("dataset", "outcome").agg(F.count("*").alias("draws"), F.first("observed").alias("o"), F.avg("benefit").alias("m"), F.stddev_samp("benefit").alias("s"), ((1 + above) / (F.count("*") + 1)).alias("p"))
    return out(g, "dataset", "outcome", "draws", observed="o", null_mean="m", null_sd="s", p="p")


@query("WITH w AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) FILTER (event_type = 'click') AS v_click, avg(value) FILTER (event_type = 'view') AS v_view, avg(value) FILTER (event_type = 'purchase') AS v_purchase FROM events GROUP BY ALL), z AS (SELECT *, lag(v_view) OVER (PARTITION BY user_id ORDER BY day) AS view_lag, date_diff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day) AS gap FROM w) SELECT user_id, strftime(day, '%Y-%m-%d') AS day, " + ", ".join(f"{r(c)} AS {c}" for c in ("v_click", "v_view", "v_purchase", "view_lag")) + " FROM z WHERE gap BETWEEN 1 AND 14")
def wide_panel(spark, d):
    """A day's means side by side, with the value and the distance of the last day; rows whose last day is within 14 days."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "value")
    w = e.groupBy("user_id", "day").pivot("event_type", ["click", "view", "purchase"]).agg(F.avg("value"))
    w = w.withColumnsRenamed({c: f"v_{c}" for c in ("click", "view", "purchase")})
    order = Window.partitionBy("user_id").orderBy("day")
    z = w.withColumn("view_lag", F.lag("v_view").over(order)).withColumn("gap", F.date_diff("day", F.lag("day").over(order))).where(F.col("gap").between(1, 14))
    values = [c for c in z.columns if c.startswith("v_")]  # by name pattern
    return out(z.withColumn("day", F.date_format("day", "yyyy-MM-dd")), "user_id", "day", **{c: c for c in [*values, "view_lag"]})


# -- verdicts ----------------------------------------------------------------------------------------


_VERDICTS = f"""{_drawn(_PEOPLE.replace(', p AS (', ', b AS ('), '100 * (avg(mae_l) / avg(mae_b) - 1) AS percent')}, ci AS (SELECT quantile_cont(percent, 0.975) AS high FROM q), re AS (SELECT 100 * (avg(mae_l) / avg(mae_b) - 1) AS rel FROM b)"""


@query(f"WITH {_VERDICTS} SELECT {r('rel')} AS percent, {r('high')} AS high, CASE WHEN rel < 0 AND high < 0 THEN 'supported' WHEN rel < 0 THEN 'direction only' ELSE 'not supported' END AS improvement FROM re, ci")
def improvement_verdict(spark, d):
    ci = _bootstrap(spark, d).agg(F.percentile("percent", 0.975).alias("high"))
    g = _balanced(spark, d).select(relative_change(F.col("mae_l"), F.col("mae_b")).alias("rel")).crossJoin(ci)
    return out(g.withColumn("improvement", verdicts.improvement(F.col("rel"), F.col("high"))), "improvement", percent="rel", high="high")


@query(f"WITH {_NULL} SELECT {r('(1 + count(*) FILTER (benefit >= observed)) / (count(*) + 1e0)')} AS p, CASE WHEN (1 + count(*) FILTER (benefit >= observed)) / (count(*) + 1e0) <= 0.0125 THEN 'beyond the null' ELSE 'within the null' END AS verdict FROM q, o")
def null_verdict(spark, d):
    return out(_null(spark, d).withColumn("verdict", verdicts.against_null(F.col("p"))), "verdict", p="p")


@query(f"WITH {_drawn(_HALF, '2 * corr(ix.a, ix.b) / (1 + corr(ix.a, ix.b)) AS sb')}, whole AS (SELECT 2 * corr(a, b) / (1 + corr(a, b)) AS sb FROM b), lower_end AS (SELECT quantile_cont(sb, 0.025) AS low FROM q) SELECT {r('whole.sb')} AS spearman_brown, {r('low')} AS low, CASE WHEN whole.sb >= 0.5 AND low > 0.2 THEN 'reliable' WHEN whole.sb >= 0.5 THEN 'uncertain' ELSE 'unreliable' END AS verdict FROM whole, lower_end".replace("corr(a, b)", "corr(b.a, b.b)"))
def reliability_verdict(spark, d):
    people = _early_late(spark, d)
    low = resample.bootstrap(people, "user_id", _DRAWS, sb=spearman_brown(resample.weighted_correlation("a", "b"))).agg(F.percentile("sb", 0.025).alias("low"))
    g = people.agg(spearman_brown(correlation(F.col("a"), F.col("b"))).alias("sb")).crossJoin(low)
    return out(g.withColumn("verdict", verdicts.reliability(F.col("sb"), F.col("low"))), "verdict", spearman_brown="sb", low="low")


def _nested_oof(spark, d, people=None):
    """gain of each person, predicted by the nested ridge and by the mean that the other folds gave."""
    p = (_first_features_and_gain(spark, d) if people is None else people).dropna(subset=[*_FEATURES, "gain"])
    fitted = models.nested_ridge(p, "user_id", _FEATURES, "gain", _ALPHAS, 5)
    means = models.held_out_folds(p, 5).groupBy("test_fold").agg(F.avg("gain").alias("dummy"))
    met = p.join(F.broadcast(fitted.join(means, "test_fold").withColumnRenamed("test_fold", "fold")), "fold")  # a row a fold
    prediction = sum((F.col("coefficients")[i + 1] * F.col(c) for i, c in enumerate(_FEATURES)), F.col("coefficients")[0])
    return met.select("user_id", "fold", "gain", prediction.alias("prediction"), "dummy")


@query()
def future_gain_verdict(spark, d):
    """Whether the nested ridge predicts who gains: by its error against the mean's, its correlation and the permutation's p."""
    people = _first_features_and_gain(spark, d).persist(StorageLevel.DISK_ONLY)  # a row a person, for the null and the predictions
    null = models.label_permutation(people, "user_id", _FEATURES, "gain", _ALPHAS, 5, _REFITS)
    real = F.col("draw") < 0
    g = null.agg(F.max(F.when(real, F.col("r"))).alias("r"), F.max(F.when(real, F.col("rmse_percent"))).alias("rmse_percent"), F.collect_list(F.when(~real, F.col("r"))).alias("_all"), F.count_if(~real).alias("_n"))  # a number a draw
    g = g.select("r", "rmse_percent", ((1 + F.size(F.filter("_all", lambda x: x >= F.col("r")))) / (F.col("_n") + 1)).alias("p"))
    o = _nested_oof(spark, d, people).select("user_id", F.pow(F.col("gain") - F.col("prediction"), 2).alias("e"), F.pow(F.col("gain") - F.col("dummy"), 2).alias("z"))
    high = _bootstrap_means(o, delta=F.sqrt(_mean("e")) - F.sqrt(_mean("z"))).agg(F.percentile("delta", 0.975).alias("high"))
    g = g.crossJoin(high)
    return g.withColumn("verdict", verdicts.future_gain(-F.col("rmse_percent"), F.col("high"), F.col("r"), F.col("p")))


_AUDITED = {"events": ["event_type", "props"], "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"], "conversations": ["role", "text"]}
_PATHS = [f"SELECT '{t}' AS tab, '{c}' AS col, 'private path' AS finding, count(*) AS n FROM {t} WHERE regexp_matches({c}, '{quality.PRIVATE_PATH.replace(chr(39), 2 * chr(39))}') HAVING count(*) > 0" for t, columns in _AUDITED.items() for c in columns]


@query("SELECT 'events' AS tab, 'user_id' AS col, 'private column' AS finding, count(user_id) AS n FROM events UNION ALL " + " UNION ALL ".join(_PATHS))
def release_audit(spark, d):
    """What a release of the tables would give away: private columns and texts with private paths, over whole columns."""
    found = [quality.audit_table(table(spark, d, name), name) for name in _AUDITED]
    rows = reduce(DataFrame.unionByName, found)
    return rows.withColumnsRenamed({"table": "tab", "column": "col"})


@query()
def release_files(spark, d):
    """The same for the files of the folder: endings that no release may have, private paths and columns in text files."""
    return quality.audit_files(spark, d)
