"""Every registered query of the panel operators, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clip, correlation, relative_change, spearman_brown, weighted_mean
from ..operators import balance, models, quality, redraw, resample
from ..operators import series as ops
from .base import ENTITY, S, T, out, r, reports, rows_after_eight, table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- targets and balanced errors -------------------------------------------------------------------


@query(f"WITH {T} SELECT user_id, rn, {r('bk')} AS b8, {r('lk')} AS l8, {r('age')} AS age, {r('benefit')} AS benefit FROM t")
def b8_l8_targets(spark, d):
    return out(rows_after_eight(spark, d), "user_id", "rn", b8="bk", l8="lk", age="age", benefit="benefit")


_PEOPLE = T + ", p AS (SELECT user_id, count(*) AS targets, avg(ae_b) AS mae_b, avg(ae_b * ae_b) AS mse_b, avg(ae_l) AS mae_l, avg(ae_l * ae_l) AS mse_l FROM t GROUP BY user_id)"


def _people(spark, d):
    return balance.person_errors(rows_after_eight(spark, d), ENTITY, {"b": "bk", "l": "lk"})


def _balanced(spark, d):
    return balance.balanced(_people(spark, d), ["b", "l"])


@query(f"WITH {_PEOPLE} SELECT count(*) AS people, CAST(sum(targets) AS BIGINT) AS targets, {r('avg(mae_b)')} AS mae_b8, {r('sqrt(avg(mse_b))')} AS rmse_b8, {r('avg(mae_l)')} AS mae_l8, {r('sqrt(avg(mse_l))')} AS rmse_l8 FROM p")
def balanced_mae_rmse(spark, d):
    return out(_balanced(spark, d), "people", "targets", mae_b8="mae_b", rmse_b8="rmse_b", mae_l8="mae_l", rmse_l8="rmse_l")


@query(f"WITH {_PEOPLE} SELECT {r('100 * (avg(mae_l) / avg(mae_b) - 1)')} AS mae_percent, {r('100 * (sqrt(avg(mse_l)) / sqrt(avg(mse_b)) - 1)')} AS rmse_percent, {r('avg(mae_b) - avg(mae_l)')} AS mae_difference FROM p")
def relative_change_l8(spark, d):
    b = _balanced(spark, d)
    return out(b, mae_percent=relative_change(F.col("mae_l"), F.col("mae_b")), rmse_percent=relative_change(F.col("rmse_l"), F.col("rmse_b")), mae_difference=F.col("mae_b") - F.col("mae_l"))


@query(f"WITH {_PEOPLE} SELECT {r('avg(CASE WHEN mae_l < mae_b THEN 1e0 ELSE 0e0 END)')} AS fraction FROM p")
def fraction_recent_better(spark, d):
    return out(_people(spark, d).agg(F.avg((F.col("mae_l") < F.col("mae_b")).cast("double")).alias("fraction")), fraction="fraction")


# -- history features ------------------------------------------------------------------------------

_W = "PARTITION BY user_id ORDER BY rn ROWS BETWEEN"


@query(
    f"WITH {S}, h AS (SELECT user_id, rn, max(CASE WHEN rn = 8 THEN y END) OVER (PARTITION BY user_id) AS first8_last, lag(y) OVER (PARTITION BY user_id ORDER BY rn) AS last, avg(y) OVER ({_W} UNBOUNDED PRECEDING AND 1 PRECEDING) AS online, avg(y) OVER (PARTITION BY user_id) AS oracle FROM s) SELECT user_id, rn, {r('first8_last')} AS first8_last, {r('last')} AS last, {r('online')} AS online, {r('oracle')} AS oracle FROM h WHERE rn > 8"
)
def history_panel(spark, d):
    h = ops.History(ENTITY)
    rows = reports(spark, d).select("user_id", "rn", h.frozen_last(8).alias("a"), h.previous().alias("b"), h.running_mean().alias("c"), h.oracle_mean().alias("e")).where("rn > 8")
    return out(rows, "user_id", "rn", first8_last="a", last="b", online="c", oracle="e")


@query(
    f"WITH {S}, h AS (SELECT user_id, rn, avg(CASE WHEN rn <= 8 THEN y END) OVER (PARTITION BY user_id) AS b, coalesce(list(y) FILTER (rn > 8) OVER ({_W} UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS l FROM s) SELECT user_id, rn, {r('list_reduce(list_prepend(b, l), lambda m, x: m * (7 / 9e0) + x * (2 / 9e0))')} AS ewm8 FROM h WHERE rn > 8"
)
def ewm8(spark, d):
    return out(reports(spark, d).select("user_id", "rn", ops.History(ENTITY).ewm().alias("x")).where("rn > 8"), "user_id", "rn", ewm8="x")


@query(f"WITH {S}, h AS (SELECT user_id, rn, median(y) OVER ({_W} 8 PRECEDING AND 1 PRECEDING) AS m FROM s) SELECT user_id, rn, {r('m')} AS median8 FROM h WHERE rn > 8")
def median8(spark, d):
    return out(reports(spark, d).select("user_id", "rn", ops.History(ENTITY).rolling_median(8).alias("x")).where("rn > 8"), "user_id", "rn", median8="x")


_WHOLE = S.replace("CAST(value AS DOUBLE)", "CAST(floor(value) % 7 AS DOUBLE)")


@query(
    f"""WITH {_WHOLE}, w AS (SELECT a.user_id, a.rn, b.y, count(*) AS c, max(b.rn) AS last FROM s a JOIN s b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn - 8 AND a.rn - 1 WHERE a.rn > 8 GROUP BY ALL)
SELECT user_id, rn, y AS mode8 FROM w QUALIFY row_number() OVER (PARTITION BY user_id, rn ORDER BY c DESC, last DESC) = 1"""
)
def mode8_recent(spark, d):
    rows = reports(spark, d).withColumn("y", F.floor("y") % 7).withColumn("y", F.col("y").cast("double"))
    return rows.select("user_id", "rn", ops.History(ENTITY).recent_mode(8).alias("mode8")).where("rn > 8")


_AR1 = f"""WITH {S}, q AS (SELECT a.user_id, a.rn, list(b.y ORDER BY b.rn) AS l FROM s a JOIN s b ON a.user_id = b.user_id AND b.rn < a.rn WHERE a.rn > 8 GROUP BY ALL),
m AS (SELECT *, list_avg(l) AS m, len(l) AS k FROM q),
c AS (SELECT *, list_transform(l, lambda x: x - m) AS c FROM m),
v AS (SELECT *, list_sum(list_transform(range(1, k), lambda i: c[i] * c[i + 1])) AS num, list_sum(list_transform(range(1, k), lambda i: c[i] * c[i])) AS den FROM c),
p AS (SELECT user_id, rn, m, l[k] AS last, CASE WHEN list_min(l) = list_max(l) OR den <= 0 THEN 0e0 ELSE greatest(least((k - 1) / (k - 1 + 10e0) * num / den, 0.95e0), -0.95e0) END AS phi FROM v)
SELECT user_id, rn, {r("m + phi * (last - m)")} AS prediction FROM p"""


@query(_AR1)
def online_ar1(spark, d):
    rows = ops.with_lag(reports(spark, d), ENTITY)
    return out(rows.select("user_id", "rn", ops.History(ENTITY).online_ar1().alias("x")).where("rn > 8"), "user_id", "rn", prediction="x")


@query(f"WITH {S}, h AS (SELECT user_id, rn, avg(CASE WHEN rn <= 2 THEN y END) OVER (PARTITION BY user_id) AS f, avg(y) OVER ({_W} UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, lag(y) OVER (PARTITION BY user_id ORDER BY rn) AS l FROM s) SELECT user_id, rn - 2 AS future_rank, {r('f')} AS first_two, {r('m')} AS running_mean, {r('l')} AS last FROM h WHERE rn > 2")
def running_first_two(spark, d):
    h = ops.History(ENTITY)
    rows = reports(spark, d).where("n > 2").select("user_id", "rn", h.frozen_mean(2).alias("f"), h.running_mean().alias("m"), h.previous().alias("l")).where("rn > 2")
    return out(rows.withColumn("future_rank", F.col("rn") - 2), "user_id", "future_rank", first_two="f", running_mean="m", last="l")


_KS = (4, 6, 8, 12)


@query(
    " UNION ALL ".join(
        f"(WITH {S}, h AS (SELECT *, avg(CASE WHEN rn <= {k} THEN y END) OVER (PARTITION BY user_id) AS b, avg(y) OVER ({_W} {k} PRECEDING AND 1 PRECEDING) AS l FROM s), p AS (SELECT user_id, avg(abs(y - b)) AS b, avg(abs(y - l)) AS l FROM h WHERE rn > 12 GROUP BY user_id) SELECT CAST({k} AS INTEGER) AS k, {r('avg(b)')} AS mae_b, {r('avg(l)')} AS mae_l FROM p)"
        for k in _KS
    )
)
def window_length(spark, d):
    h = ops.History(ENTITY)
    rows = reports(spark, d).where("n > 12").select("user_id", "rn", "y", *[x.alias(f"{c}{k}") for k in _KS for c, x in (("b", h.frozen_mean(k)), ("l", h.rolling_mean(k)))]).where("rn > 12")
    people = balance.person_errors(rows, ENTITY, {f"{c}{k}": f"{c}{k}" for k in _KS for c in "bl"})
    one = balance.balanced(people, [f"{c}{k}" for k in _KS for c in "bl"])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"mae_b{k}").alias("b"), F.col(f"mae_l{k}").alias("l")) for k in _KS])).alias("x")).select("x.*")
    return out(long, "k", mae_b="b", mae_l="l")


@query(f"WITH {S}, g AS (SELECT user_id, rn, y - lag(y) OVER w AS difference, date_diff('microsecond', lag(ts) OVER w, ts) / 86400000000e0 AS gap FROM s WINDOW w AS (PARTITION BY user_id ORDER BY rn)) SELECT user_id, rn, {r('difference')} AS difference, {r('gap')} AS gap_days FROM g WHERE rn > 1")
def gap_days(spark, d):
    from ..functions.stats import days_between

    w = Window.partitionBy("user_id").orderBy("rn")
    rows = reports(spark, d).withColumn("a", F.col("y") - F.lag("y").over(w)).withColumn("b", days_between(F.col("ts"), F.lag("ts").over(w)))
    return out(rows.where("rn > 1"), "user_id", "rn", difference="a", gap_days="b")


# -- comparators, distributions --------------------------------------------------------------------

_METHODS = f"""{T}, g AS (SELECT t.*, avg(y) OVER (PARTITION BY user_id) AS x FROM t),
o AS (SELECT user_id, rn, avg(y) OVER ({_W} UNBOUNDED PRECEDING AND 1 PRECEDING) AS online, lag(y) OVER (PARTITION BY user_id ORDER BY rn) AS last, median(y) OVER ({_W} 8 PRECEDING AND 1 PRECEDING) AS med, avg(y) OVER (PARTITION BY user_id) AS oracle FROM s),
e AS (SELECT t.user_id, t.rn, t.y, m.method, m.p FROM t JOIN o USING (user_id, rn), LATERAL (VALUES ('B8', bk), ('L8', lk), ('Cumulative', online), ('Last', last), ('Median8', med), ('OracleMean', oracle)) m(method, p)),
pm AS (SELECT user_id, method, avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse, count(*) AS targets FROM e GROUP BY ALL),
b AS (SELECT method, avg(mae) AS mae, sqrt(avg(mse)) AS rmse, count(*) AS people, CAST(sum(targets) AS BIGINT) AS targets FROM pm GROUP BY method)"""


def _methods(spark, d):
    h = ops.History(ENTITY)
    rows = reports(spark, d).select("user_id", "rn", "y", h.frozen_mean(8).alias("b8"), h.rolling_mean(8).alias("l8"), h.running_mean().alias("cum"), h.previous().alias("last"), h.rolling_median(8).alias("med"), h.oracle_mean().alias("oracle"))
    return balance.long_errors(rows.where("rn > 8"), ["user_id", "rn"], {"B8": "b8", "L8": "l8", "Cumulative": "cum", "Last": "last", "Median8": "med", "OracleMean": "oracle"})


def _method_people(spark, d):
    return _methods(spark, d).groupBy("user_id", "method").agg(F.avg("ae").alias("mae"), F.avg("se").alias("mse"), F.count("*").alias("targets"))


@query(f"WITH {_METHODS} SELECT method, people, targets, {r('mae')} AS mae, {r('rmse')} AS rmse, {r('''100 * (mae / max(CASE WHEN method = 'B8' THEN mae END) OVER () - 1)''')} AS mae_percent FROM b")
def comparator_panel(spark, d):
    b = _method_people(spark, d).groupBy("method").agg(F.avg("mae").alias("mae"), F.sqrt(F.avg("mse")).alias("rmse"), F.count("*").alias("people"), F.sum("targets").alias("targets"))
    base = F.max(F.when(F.col("method") == "B8", F.col("mae"))).over(Window.partitionBy())  # one row a method
    return out(b.withColumn("c", relative_change(F.col("mae"), base)), "method", "people", "targets", mae="mae", rmse="rmse", mae_percent="c")


@query(f"WITH {_METHODS} SELECT user_id, {r('''max(CASE WHEN method = 'B8' THEN mae END)''')} AS b8, {r('''max(CASE WHEN method = 'L8' THEN mae END)''')} AS l8, {r('''max(CASE WHEN method = 'Last' THEN mae END)''')} AS last FROM pm GROUP BY user_id")
def pivot_methods(spark, d):
    wide = _method_people(spark, d).groupBy("user_id").pivot("method", ["B8", "L8", "Last"]).agg(F.first("mae"))
    return out(wide, "user_id", b8="B8", l8="L8", last="Last")


@query(f"WITH {_PEOPLE}, z AS (SELECT user_id, stddev_pop(y) AS sd FROM s GROUP BY user_id) SELECT {r('avg(mae_b) / 500')} AS nmae_b8, {r('avg(mae_l) / 500')} AS nmae_l8, {r('avg(mae_b / nullif(sd, 0))')} AS standard_b8, {r('avg(mae_l / nullif(sd, 0))')} AS standard_l8 FROM p JOIN z USING (user_id)")
def normalised_mae(spark, d):
    sd = reports(spark, d).groupBy("user_id").agg(F.stddev_pop("y").alias("sd"))
    p = _people(spark, d).join(sd, "user_id")
    g = p.agg(F.avg("mae_b").alias("b"), F.avg("mae_l").alias("l"), F.avg(F.try_divide("mae_b", "sd")).alias("sb"), F.avg(F.try_divide("mae_l", "sd")).alias("sl"))
    return out(g, nmae_b8=F.col("b") / 500, nmae_l8=F.col("l") / 500, standard_b8="sb", standard_l8="sl")


@query(
    f"WITH {_METHODS}, i AS (SELECT method, user_id, abs(round_even(round(greatest(least(p, 500), 0), 9), 0) - round_even(y, 0)) AS e FROM e), u AS (SELECT method, user_id, avg(CASE WHEN e = 0 THEN 1e0 ELSE 0 END) AS a, avg(CASE WHEN e <= 1 THEN 1e0 ELSE 0 END) AS b, avg(CASE WHEN e <= 2 THEN 1e0 ELSE 0 END) AS c, avg(e) AS m FROM i GROUP BY ALL) SELECT method, {r('avg(a)')} AS exact, {r('avg(b)')} AS within1, {r('avg(c)')} AS within2, {r('avg(m)')} AS ordinal_mae FROM u GROUP BY method"
)
def ordinal_accuracy(spark, d):
    # a mean that is a half but for its last digits is a half
    e = F.abs(F.rint(F.round(clip(F.col("prediction"), 0.0, 500.0), 9)) - F.rint("actual"))
    p = _methods(spark, d).withColumn("e", e).groupBy("method", "user_id").agg(*[F.avg((F.col("e") <= k).cast("double")).alias(f"w{k}") for k in (0, 1, 2)], F.avg("e").alias("m"))
    g = p.groupBy("method").agg(F.avg("w0").alias("w0"), F.avg("w1").alias("w1"), F.avg("w2").alias("w2"), F.avg("m").alias("m"))
    return out(g, "method", exact="w0", within1="w1", within2="w2", ordinal_mae="m")


@query(f"WITH {S} SELECT event_type, count(*) AS n, {r('avg(y)')} AS mean, {r('stddev_samp(y)')} AS sd, {r('min(y)')} AS min, {r('max(y)')} AS max, {r('avg(CASE WHEN y <= 5 THEN 1e0 ELSE 0 END)')} AS floor, {r('avg(CASE WHEN y >= 200 THEN 1e0 ELSE 0 END)')} AS ceiling FROM s GROUP BY event_type")
def score_distribution(spark, d):
    g = balance.score_distribution(reports(spark, d), ["event_type"], 5.0, 200.0)
    return out(g, "event_type", "n", mean="mean", sd="sd", min="min", max="max", floor="floor", ceiling="ceiling")


@query(f"SELECT coalesce(CASE WHEN event_type <> 'error' THEN event_type END, 'Missing') AS level, count(*) AS n, {r('100e0 * count(*) / sum(count(*)) OVER ()')} AS percent FROM events GROUP BY 1")
def frequency_table(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("level"))
    return out(balance.frequency_table(e, "level"), "level", "n", percent="percent")


_QS = {"p01": 0.01, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


@query(f"WITH {S} SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS people, {', '.join(f'{r(f"quantile_cont(y, {q})")} AS {k}' for k, q in _QS.items())} FROM s GROUP BY event_type")
def quantile_summary(spark, d):
    g = reports(spark, d).groupBy("event_type").agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("people"), *[F.percentile("y", q).alias(k) for k, q in _QS.items()])
    return out(g, "event_type", "rows", "people", **{k: k for k in _QS})


# -- age, strata, slopes ---------------------------------------------------------------------------

_X = T + ", x AS (SELECT t.*, ln(1 + age) / (SELECT stddev_pop(ln(1 + age)) FROM t) AS x FROM t)"


def _scaled(spark, d):
    return ops.scaled_age(rows_after_eight(spark, d))


@query(f"WITH {_X} SELECT user_id, rn, {r('age')} AS age, {r('x')} AS log_age_scaled FROM x")
def baseline_age_scaled(spark, d):
    return out(_scaled(spark, d), "user_id", "rn", age="age", log_age_scaled="x")


_CUTS = (1.0, 5.0, 10.0)


def _stratum(age, cuts, right: bool):
    below = (lambda c: age <= c) if right else (lambda c: age < c)
    label = F.when(below(cuts[0]), "1")
    for i, c in enumerate(cuts[1:], 2):
        label = label.when(below(c), str(i))
    return label.otherwise(str(len(cuts) + 1))


_sql_stratum = lambda op: f"CASE WHEN age {op} 1 THEN '1' WHEN age {op} 5 THEN '2' WHEN age {op} 10 THEN '3' ELSE '4' END"


@query(f"WITH {T}, p AS (SELECT {_sql_stratum('<=')} AS stratum, user_id, count(*) AS targets, avg(ae_b) AS b, avg(ae_l) AS l FROM t GROUP BY ALL) SELECT stratum, count(*) AS people, CAST(sum(targets) AS BIGINT) AS targets, {r('avg(b)')} AS mae_b8, {r('avg(l)')} AS mae_l8, {r('100 * (avg(l) / avg(b) - 1)')} AS percent FROM p GROUP BY stratum")
def age_strata_right_closed(spark, d):
    t = rows_after_eight(spark, d).withColumn("stratum", _stratum(F.col("age"), _CUTS, True))
    b = balance.balanced(balance.person_errors(t, ["stratum", "user_id"], {"b": "bk", "l": "lk"}), ["b", "l"], ["stratum"])
    return out(b, "stratum", "people", "targets", mae_b8="mae_b", mae_l8="mae_l", percent=relative_change(F.col("mae_l"), F.col("mae_b")))


@query(f"WITH {T}, p AS (SELECT {_sql_stratum('<')} AS stratum, user_id, avg(ae_b * ae_b) AS b, avg(ae_l * ae_l) AS l FROM t GROUP BY ALL) SELECT stratum, count(*) AS people, {r('sqrt(avg(b))')} AS rmse_b8, {r('sqrt(avg(l))')} AS rmse_l8, count(*) >= 10 AS enough FROM p GROUP BY stratum")
def age_strata_left_closed(spark, d):
    t = rows_after_eight(spark, d).withColumn("stratum", _stratum(F.col("age"), _CUTS, False))
    b = balance.balanced(balance.person_errors(t, ["stratum", "user_id"], {"b": "bk", "l": "lk"}), ["b", "l"], ["stratum"])
    return out(b.withColumn("enough", F.col("people") >= 10), "stratum", "people", "enough", rmse_b8="rmse_b", rmse_l8="rmse_l")


@query(f"WITH {T}, z AS (SELECT *, {_sql_stratum('<=')} AS stratum FROM t), k AS (SELECT user_id FROM z GROUP BY user_id HAVING count(DISTINCT stratum) = (SELECT count(DISTINCT stratum) FROM z)), p AS (SELECT stratum, user_id, avg(ae_b) AS b, avg(ae_l) AS l FROM z SEMI JOIN k USING (user_id) GROUP BY ALL) SELECT stratum, count(*) AS people, {r('avg(b)')} AS mae_b8, {r('avg(l)')} AS mae_l8 FROM p GROUP BY stratum")
def common_strata_population(spark, d):
    t = rows_after_eight(spark, d).withColumn("stratum", _stratum(F.col("age"), _CUTS, True))
    p = balance.person_errors(t, ["stratum", "user_id"], {"b": "bk", "l": "lk"})
    every = p.agg(F.count_distinct("stratum").alias("_all"))
    keys = p.groupBy("user_id").agg(F.count_distinct("stratum").alias("_n")).join(F.broadcast(every), F.col("_n") == F.col("_all")).select("user_id")
    return out(balance.balanced(p.join(keys, "user_id", "left_semi"), ["b", "l"], ["stratum"]), "stratum", "people", mae_b8="mae_b", mae_l8="mae_l")


@query(f"WITH {_X}, g AS (SELECT user_id, count(*) AS rows, regr_slope(benefit, x) AS slope FROM x GROUP BY user_id HAVING count(*) >= 5 AND count(DISTINCT x) >= 2) SELECT user_id, rows, {r('slope')} AS slope FROM g")
def person_slopes(spark, d):
    return out(balance.slopes(_scaled(spark, d), ENTITY, "benefit", "x"), "user_id", "rows", slope="slope")


@query(f"WITH {_X}, g AS (SELECT user_id, regr_slope(benefit, x) AS slope FROM x GROUP BY user_id HAVING count(*) >= 5 AND count(DISTINCT x) >= 2) SELECT count(*) AS people, {r('avg(slope)')} AS mean_slope, {r('avg(CASE WHEN slope > 0 THEN 1e0 ELSE 0 END)')} AS positive FROM g")
def slope_summary(spark, d):
    g = balance.slopes(_scaled(spark, d), ENTITY, "benefit", "x").agg(F.count("*").alias("people"), F.avg("slope").alias("m"), F.avg((F.col("slope") > 0).cast("double")).alias("p"))
    return out(g, "people", mean_slope="m", positive="p")


@query(f"WITH {T}, g AS (SELECT user_id, regr_slope(benefit, ln(1 + age)) * stddev_pop(ln(1 + age)) AS slope FROM t GROUP BY user_id HAVING count(*) >= 5 AND count(DISTINCT age) >= 2) SELECT user_id, {r('slope')} AS slope FROM g")
def person_slopes_z(spark, d):
    t = rows_after_eight(spark, d).withColumn("x", F.log1p("age"))
    return out(balance.slopes(t, ENTITY, "benefit", "x", standardised=True), "user_id", slope="slope")


@query(
    f"WITH {_X}, w AS (SELECT *, 1 / (1e0 + rn % 3) AS w FROM x), m AS (SELECT user_id, sum(w * x) / sum(w) AS mx, sum(w * benefit) / sum(w) AS my FROM w GROUP BY user_id), g AS (SELECT user_id, sum(w * (x - mx) * (benefit - my)) / sum(w * (x - mx) * (x - mx)) AS slope FROM w JOIN m USING (user_id) GROUP BY user_id HAVING count(*) >= 5 AND count(DISTINCT x) >= 2) SELECT user_id, {r('slope')} AS slope FROM g"
)
def weighted_slopes(spark, d):
    t = _scaled(spark, d).withColumn("w", 1 / (1.0 + F.col("rn") % 3))
    return out(balance.weighted_slopes(t, ENTITY, "benefit", "x", "w"), "user_id", slope="slope")


@query(f"WITH {T}, q AS (SELECT *, least(4, CAST(floor((rn - 9) * 4 / (n - 8e0)) AS BIGINT) + 1) AS quartile FROM t), p AS (SELECT quartile, user_id, avg(benefit) AS b FROM q GROUP BY ALL) SELECT quartile, count(*) AS people, {r('avg(b)')} AS benefit FROM p GROUP BY quartile")
def relative_quartile_benefit(spark, d):
    q = F.least(F.lit(4), F.floor((F.col("rn") - 9) * 4 / (F.col("n") - 8)) + 1).cast("long")
    p = rows_after_eight(spark, d).withColumn("quartile", q).groupBy("quartile", "user_id").agg(F.avg("benefit").alias("b"))
    return out(p.groupBy("quartile").agg(F.count("*").alias("people"), F.avg("b").alias("b")), "quartile", "people", benefit="b")


@query(f"WITH {T}, p AS (SELECT CASE WHEN rn = 9 THEN 'first' ELSE 'later' END AS horizon, user_id, avg(ae_b) AS b, avg(ae_l) AS l FROM t GROUP BY ALL) SELECT horizon, count(*) AS people, {r('avg(b)')} AS mae_b8, {r('avg(l)')} AS mae_l8 FROM p GROUP BY horizon")
def horizon_metrics(spark, d):
    t = rows_after_eight(spark, d).withColumn("horizon", F.when(F.col("rn") == 9, "first").otherwise("later"))
    return out(balance.balanced(balance.person_errors(t, ["horizon", "user_id"], {"b": "bk", "l": "lk"}), ["b", "l"], ["horizon"]), "horizon", "people", mae_b8="mae_b", mae_l8="mae_l")


# -- response process ------------------------------------------------------------------------------

_G = """g AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS counter, event_type <> 'error' AS done FROM events)"""
_O = (
    _G
    + f""", h AS (SELECT *, coalesce(sum(CAST(done AS BIGINT)) OVER ({_W.replace('rn', 'counter')} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_prior,
  counter - 1 - coalesce(max(CASE WHEN done THEN counter END) OVER ({_W.replace('rn', 'counter')} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS streak FROM g)"""
)


def _prompts(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.withColumn("counter", F.row_number().over(w).cast("long")).withColumn("done", F.col("event_type") != "error")


@query(f"WITH {_O} SELECT user_id, counter, CAST(n_prior AS BIGINT) AS n_prior, {r('n_prior / (counter - 1e0)')} AS completion_rate, CAST(streak AS BIGINT) AS streak, done FROM h WHERE n_prior >= 8")
def opportunity_features(spark, d):
    o = ops.opportunities(_prompts(spark, d), ENTITY, "counter", F.col("done"))
    return out(o.withColumn("n_prior", F.col("n_prior").cast("long")).withColumn("streak", F.col("streak").cast("long")), "user_id", "counter", "n_prior", "streak", "done", completion_rate="completion_rate")


_P = "greatest(least(0.4 + 0.1 * (rn % 7), 0.99), 0.10)"


@query(f"WITH {T}, w AS (SELECT *, 1e0 / {_P} AS w FROM t), p AS (SELECT user_id, sum(w * ae_b) / sum(w) AS b, sum(w * ae_l) / sum(w) AS l, sqrt(sum(w * ae_l * ae_l) / sum(w)) AS q FROM w GROUP BY user_id) SELECT count(*) AS people, {r('avg(b)')} AS ipw_b8, {r('avg(l)')} AS ipw_l8, {r('sqrt(avg(q * q))')} AS ipw_rmse_l8 FROM p")
def ipw_mae(spark, d):
    # the response probability is a table of its own, joined one to one by key
    t = rows_after_eight(spark, d)
    prob = reports(spark, d).select("user_id", "rn", clip(0.4 + 0.1 * (F.col("rn") % 7), 0.10, 0.99).alias("p"))
    t = quality.require_no_missing(t.join(prob, ["user_id", "rn"], "left"), ["p"]).withColumn("w", 1 / F.col("p"))
    p = t.groupBy("user_id").agg(weighted_mean(F.col("ae_b"), F.col("w")).alias("b"), weighted_mean(F.col("ae_l"), F.col("w")).alias("l"), weighted_mean(F.col("ae_l") * F.col("ae_l"), F.col("w")).alias("q"))
    return out(p.agg(F.count("*").alias("people"), F.avg("b").alias("b"), F.avg("l").alias("l"), F.sqrt(F.avg("q")).alias("q")), "people", ipw_b8="b", ipw_l8="l", ipw_rmse_l8="q")


@query(
    f"WITH {_G}, z AS (SELECT user_id, counter, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY counter) AS rn FROM g WHERE counter > 7 AND done), f AS (SELECT *, avg(CASE WHEN rn <= 8 THEN y END) OVER (PARTITION BY user_id) AS b, avg(y) OVER ({_W} 8 PRECEDING AND 1 PRECEDING) AS l FROM z), p AS (SELECT user_id, avg(abs(y - b)) AS b, avg(abs(y - l)) AS l FROM f WHERE rn > 8 GROUP BY user_id) SELECT count(*) AS people, {r('avg(b)')} AS mae_b8, {r('avg(l)')} AS mae_l8 FROM p"
)
def day1_reanchor(spark, d):
    later = _prompts(spark, d).where("counter > 7 AND done").select("user_id", "counter", "value")
    t = ops.targets(ops.series(later, ENTITY, ["counter"], "value"), ENTITY, "counter")
    p = balance.person_errors(t, ENTITY, {"b": "bk", "l": "lk"})
    return out(balance.balanced(p, ["b", "l"]), "people", mae_b8="mae_b", mae_l8="mae_l")


@query(
    f"WITH {_G}, a AS (SELECT user_id, counter, (counter - 1) % 7 + 1 AS beep, value FROM g WHERE done), e AS (SELECT beep, avg(value) - (SELECT avg(value) FROM a) AS effect FROM a GROUP BY beep), z AS (SELECT user_id, value - effect AS y, row_number() OVER (PARTITION BY user_id ORDER BY counter) AS rn FROM a JOIN e USING (beep)), f AS (SELECT *, avg(CASE WHEN rn <= 8 THEN y END) OVER (PARTITION BY user_id) AS b, avg(y) OVER ({_W} 8 PRECEDING AND 1 PRECEDING) AS l FROM z), p AS (SELECT user_id, avg(abs(y - b)) AS b, avg(abs(y - l)) AS l FROM f WHERE rn > 8 GROUP BY user_id) SELECT count(*) AS people, {r('avg(b)')} AS mae_b8, {r('avg(l)')} AS mae_l8 FROM p"
)
def prompt_adjusted(spark, d):
    a = _prompts(spark, d).where("done").select("user_id", "counter", ((F.col("counter") - 1) % 7 + 1).alias("beep"), "value")
    grand = a.agg(F.avg("value").alias("grand"))
    effect = a.groupBy("beep").agg(F.avg("value").alias("m")).crossJoin(F.broadcast(grand)).select("beep", (F.col("m") - F.col("grand")).alias("effect"))  # 7 rows
    adjusted = a.join(F.broadcast(effect), "beep").select("user_id", "counter", (F.col("value") - F.col("effect")).alias("value"))
    t = ops.targets(ops.series(adjusted, ENTITY, ["counter"], "value"), ENTITY, "counter")
    return out(balance.balanced(balance.person_errors(t, ENTITY, {"b": "bk", "l": "lk"}), ["b", "l"]), "people", mae_b8="mae_b", mae_l8="mae_l")


@query(f"WITH {T}, w AS (SELECT user_id, rn, ae_l, 1e0 / count(*) OVER (PARTITION BY user_id) AS v FROM t), z AS (SELECT *, v / avg(v) OVER () AS w FROM w) SELECT user_id, count(*) AS targets, {r('sum(w)')} AS total, {r('sum(w * ae_l) / sum(w)')} AS mae FROM z GROUP BY user_id")
def participant_weights(spark, d):
    w = balance.participant_weights(rows_after_eight(spark, d), ENTITY)
    g = w.groupBy("user_id").agg(F.count("*").alias("targets"), F.sum("weight").alias("t"), weighted_mean(F.col("ae_l"), F.col("weight")).alias("m"))
    return out(g, "user_id", "targets", total="t", mae="m")


# -- segments, conflicts, splits -------------------------------------------------------------------

_CUST = "o_custkey, o_orderdate, o_orderkey"


@query(
    "WITH g AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, CASE WHEN date_diff('microsecond', lag(o_orderdate) OVER w, o_orderdate) / 86400000000e0 > 30 THEN 1 ELSE 0 END AS opens FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), s AS (SELECT *, sum(opens) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seg FROM g) SELECT o_custkey || '::' || CAST(seg AS BIGINT) AS segment_key, count(*) AS rows, "
    + r("avg(o_totalprice)")
    + " AS mean FROM s GROUP BY 1"
)
def session_gap_segments(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    s = ops.sessions(o, ["o_custkey"], "o_orderdate", 30.0, ["o_orderkey"])
    g = s.groupBy(F.concat_ws("::", "o_custkey", "segment").alias("segment_key")).agg(F.count("*").alias("rows"), F.avg("o_totalprice").alias("m"))
    return out(g, "segment_key", "rows", mean="m")


@query("SELECT o_custkey, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY o_custkey, o_orderdate HAVING count(DISTINCT o_orderstatus) = 1".replace("CAST(o_orderdate AS TIMESTAMP) AS o_orderdate", "strftime(o_orderdate, '%Y-%m-%d') AS day"))
def dedup_conflicts(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderstatus")
    return quality.without_conflicts(o, ["o_custkey", "o_orderdate"], ["o_orderstatus"]).select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus")


@query(
    f"WITH {S}, o AS (SELECT s.*, origin, start FROM s, LATERAL (VALUES ('early', 0), ('middle', (n - 21) // 2), ('late', n - 21)) v(origin, start) WHERE n >= 21), f AS (SELECT *, avg(CASE WHEN rn > start AND rn <= start + 8 THEN y END) OVER (PARTITION BY user_id, origin) AS b, avg(y) OVER (PARTITION BY user_id, origin ORDER BY rn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS l FROM o), p AS (SELECT origin, user_id, avg(abs(y - b)) AS b, avg(abs(y - l)) AS l FROM f WHERE rn > start + 16 GROUP BY ALL) SELECT origin, count(*) AS people, {r('avg(b)')} AS mae_base, {r('avg(l)')} AS mae_recent FROM p GROUP BY origin"
)
def pseudo_origins(spark, d):
    t = ops.pseudo_origins(reports(spark, d), ENTITY)
    p = balance.person_errors(t, ["origin", "user_id"], {"b": "base", "l": "recent"})
    return out(balance.balanced(p, ["b", "l"], ["origin"]), "origin", "people", mae_base="mae_b", mae_recent="mae_l")


_HALVES = "sa AS (SELECT user_id, regr_slope(benefit, x) FILTER ({a}) AS a, regr_slope(benefit, x) FILTER ({b}) AS b FROM z GROUP BY user_id HAVING count(*) >= 10 AND count(*) FILTER ({a}) >= 5 AND count(*) FILTER ({b}) >= 5 AND count(DISTINCT x) FILTER ({a}) >= 2 AND count(DISTINCT x) FILTER ({b}) >= 2)"


def _halves(rows, half):
    g = rows.withColumn("half", half).groupBy("user_id").agg(*[f.alias(f"{n}{i}") for i in (0, 1) for n, f in (("c", F.count_if(F.col("half") == i)), ("d", F.count_distinct(F.when(F.col("half") == i, F.col("x")))), ("s", F.regr_slope(F.when(F.col("half") == i, F.col("benefit")), F.col("x"))))])
    return g.where("c0 + c1 >= 10 AND c0 >= 5 AND c1 >= 5 AND d0 >= 2 AND d1 >= 2").select("user_id", F.col("s0").alias("a"), F.col("s1").alias("b"))


@query(f"WITH {_X}, z AS (SELECT *, (rn - 9) % 2 AS half FROM x), {_HALVES.format(a='half = 0', b='half = 1')} SELECT count(*) AS people, {r('corr(a, b)')} AS r, {r('2 * corr(a, b) / (1 + corr(a, b))')} AS spearman_brown, {r('avg(CASE WHEN sign(a) = sign(b) THEN 1e0 ELSE 0 END)')} AS same_direction FROM sa")
def split_half_reliability(spark, d):
    h = _halves(_scaled(spark, d), F.pmod(F.col("rn") - 9, F.lit(2)))
    g = h.agg(F.count("*").alias("people"), correlation(F.col("a"), F.col("b")).alias("r"), F.avg((F.signum("a") == F.signum("b")).cast("double")).alias("same"))
    return out(g, "people", r="r", spearman_brown=spearman_brown(F.col("r")), same_direction="same")


_EL = f"{_X}, z AS (SELECT *, CASE WHEN rn - 8 <= (n - 8) // 2 THEN 0 ELSE 1 END AS half FROM x), {_HALVES.format(a='half = 0', b='half = 1')}"


def _early_late(spark, d):
    return _halves(_scaled(spark, d), F.when(F.col("rn") - 8 <= F.floor((F.col("n") - 8) / 2), 0).otherwise(1))


@query(f"WITH {_EL} SELECT user_id, {r('a')} AS early, {r('b')} AS late FROM sa")
def early_late_blocks(spark, d):
    return out(_early_late(spark, d), "user_id", early="a", late="b")


@query(f"WITH {_EL}, k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2e0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2e0 AS rb FROM sa) SELECT count(*) AS people, {r('corr(ra, rb)')} AS spearman FROM k")
def spearman_blocks(spark, d):
    # one row a person here; ranks need one order over them
    k = balance.average_rank(balance.average_rank(_early_late(spark, d), "a", "ra"), "b", "rb")
    return out(k.agg(F.count("*").alias("people"), correlation(F.col("ra"), F.col("rb")).alias("r")), "people", spearman="r")


# -- diagnostics -----------------------------------------------------------------------------------


@query(f"WITH {S}, p AS (SELECT user_id, avg(y) AS m, var_pop(y) AS v FROM s GROUP BY user_id) SELECT {r('var_pop(m)')} AS between, {r('avg(v)')} AS within, {r('var_pop(m) / (var_pop(m) + avg(v))')} AS share_between FROM p".replace("AS between", 'AS "between"'))
def variance_decomposition(spark, d):
    return out(balance.variance_decomposition(reports(spark, d), ENTITY), between="between", within="within", share_between="share_between")


@query(f"WITH {S}, l AS (SELECT user_id, y, lag(y) OVER (PARTITION BY user_id ORDER BY rn) AS p FROM s), c AS (SELECT user_id, corr(y, p) AS r FROM l WHERE p IS NOT NULL GROUP BY user_id HAVING count(*) >= 3 AND stddev_pop(y) > 0 AND stddev_pop(p) > 0) SELECT count(*) AS people, {r('avg(r)')} AS mean_lag1 FROM c")
def lag1_autocorr(spark, d):
    return out(balance.lag1(reports(spark, d), ENTITY).agg(F.count("*").alias("people"), F.avg("r").alias("m")), "people", mean_lag1="m")


_C = S + ", m AS (SELECT *, y - avg(y) OVER (PARTITION BY user_id) AS c FROM s), l AS (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY rn) AS p FROM m)"


@query(f"WITH {_C} SELECT {r('greatest(least(sum(c * p) / sum(c * c), 0.95), -0.95)')} AS phi FROM l")
def pooled_phi(spark, d):
    c = balance.centred(reports(spark, d), ENTITY)
    return out(c.agg(balance.phi_ratio(F.col("c"), F.col("c_lag")).alias("phi")), phi="phi")


def _shrunk(spark, d):
    c = balance.centred(reports(spark, d), ENTITY)
    pooled = c.agg(balance.phi_ratio(F.col("c"), F.col("c_lag")).alias("pooled"))
    own = c.groupBy("user_id").agg(F.count("*").alias("k"), balance.phi_ratio(F.col("c"), F.col("c_lag")).alias("own"))
    w = (F.col("k") - 1) / (F.col("k") - 1 + 10.0)
    return own.crossJoin(F.broadcast(pooled)).select("user_id", clip(w * F.col("own") + (1 - w) * F.col("pooled"), -0.95, 0.95).alias("phi"))


@query(f"WITH {_C}, g AS (SELECT greatest(least(sum(c * p) / sum(c * c), 0.95), -0.95) AS pooled FROM l), o AS (SELECT user_id, count(*) AS k, greatest(least(sum(c * p) / sum(c * c), 0.95), -0.95) AS own FROM l GROUP BY user_id) SELECT user_id, {r('greatest(least((k - 1) / (k - 1 + 10e0) * own + (1 - (k - 1) / (k - 1 + 10e0)) * pooled, 0.95), -0.95)')} AS phi FROM o, g")
def shrunk_phi(spark, d):
    return out(_shrunk(spark, d), "user_id", phi="phi")


@query(f"WITH {S} SELECT user_id, {r('regr_slope(y, rn) * stddev_pop(rn)')} AS trend FROM s GROUP BY user_id")
def linear_trend(spark, d):
    g = reports(spark, d).groupBy("user_id").agg((F.regr_slope("y", "rn") * F.stddev_pop("rn")).alias("t"))
    return out(g, "user_id", trend="t")


@query(f"WITH {S}, l AS (SELECT *, abs(y - lag(y) OVER (PARTITION BY user_id ORDER BY rn)) AS step FROM s) SELECT user_id, {r('avg(y)')} AS mean, {r('stddev_samp(y)')} AS sd, {r('avg(step)')} AS step, {r('regr_slope(y, rn)')} AS trend FROM l WHERE rn <= 8 GROUP BY user_id")
def first8_features(spark, d):
    return out(ops.first_features(reports(spark, d), ENTITY), "user_id", mean="mean", sd="sd", step="step", trend="trend")


@query(f"WITH {S}, p AS (SELECT event_type, user_id, var_samp(y) AS v FROM s GROUP BY ALL) SELECT event_type, {r('sqrt(avg(v))')} AS within_sd FROM p GROUP BY event_type")
def within_sd(spark, d):
    p = reports(spark, d).groupBy("event_type", "user_id").agg(F.var_samp("y").alias("v"))
    return out(p.groupBy("event_type").agg(F.sqrt(F.avg("v")).alias("s")), "event_type", within_sd="s")


@query(f"WITH {T}, w AS (SELECT event_type, round(ae_l, 6) AS v, sum(1e0 / n) AS w FROM t GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY event_type ORDER BY v) / sum(w) OVER (PARTITION BY event_type) AS c FROM w) SELECT event_type, {r('min(v)')} AS threshold FROM c WHERE c >= 0.9 - 1e-12 GROUP BY event_type")
def weighted_quantile_threshold(spark, d):
    t = rows_after_eight(spark, d).select("event_type", F.round("ae_l", 6).alias("v"), (1.0 / F.col("n")).alias("w"))
    return out(balance.weighted_quantile(t, "v", "w", 0.9, ["event_type"]), "event_type", threshold="threshold")


@query(f"WITH {_PEOPLE}, a AS (SELECT user_id, avg(abs(y - (bk + lk) / 2)) AS mae FROM t GROUP BY user_id), m AS (SELECT 'B8' AS method, avg(mae_b) AS mae FROM p UNION ALL SELECT 'L8', avg(mae_l) FROM p UNION ALL SELECT 'A50', avg(mae) FROM a) SELECT method, {r('mae')} AS mae, {r('''-100 * (mae / (SELECT mae FROM m WHERE method = 'B8') - 1)''')} AS improvement_percent FROM m")
def accuracy_retention_tradeoff(spark, d):
    t = rows_after_eight(spark, d).withColumn("a50", (F.col("bk") + F.col("lk")) / 2)
    p = balance.long_errors(t, ENTITY, {"B8": "bk", "L8": "lk", "A50": "a50"}).groupBy("user_id", "method").agg(F.avg("ae").alias("mae"))
    m = p.groupBy("method").agg(F.avg("mae").alias("mae"))
    base = m.where("method = 'B8'").select(F.col("mae").alias("b8"))
    return out(m.crossJoin(F.broadcast(base)).withColumn("i", -relative_change(F.col("mae"), F.col("b8"))), "method", mae="mae", improvement_percent="i")


# -- cross-fitting ---------------------------------------------------------------------------------

def _lcg_sql(*parts: str) -> str:
    h = "17"
    for p in parts:
        h = f"list_transform([({h} * 1103515 + CAST({p} AS BIGINT) % 2147483647 * 12345 + 1013904) % 2147483647], lambda v: (v * v + 12345) % 2147483647)[1]"
    return f"(({h} * 48271) % 2147483647)"


_FM = f"fm AS (SELECT user_id, CAST((row_number() OVER (ORDER BY {_lcg_sql('31415926', 'user_id')}, user_id) - 1) % 5 + 1 AS INTEGER) AS fold FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL))"
_FO = f"{T}, {_FM}, k AS (SELECT t.*, fold FROM t JOIN fm USING (user_id)), f5 AS (SELECT unnest(range(1, 6)) AS tf)"


def _folds(spark, d):
    return resample.folds(table(spark, d, "events").select("user_id"), "user_id")


def _folded(spark, d):
    return rows_after_eight(spark, d).join(_folds(spark, d), "user_id")


@query(f"WITH {_FO}, z AS (SELECT tf, avg(bk) AS m, stddev_pop(bk) AS s FROM k, f5 WHERE fold <> tf GROUP BY tf) SELECT user_id, rn, {r('(bk - m) / CASE WHEN s > 0 THEN s ELSE 1 END')} AS z_b8 FROM k JOIN z ON fold = tf")
def fold_standardised_scores(spark, d):
    return out(models.standardised(_folded(spark, d), ["bk"], 5), "user_id", "rn", z_b8="z_bk")


_RW = "p AS (SELECT fold, user_id, avg((lk - bk) * (y - bk)) AS num, avg((lk - bk) * (lk - bk)) AS den FROM k GROUP BY ALL), w AS (SELECT tf, greatest(least(avg(num) / avg(den), 1), 0) AS w FROM p, f5 WHERE fold <> tf GROUP BY tf)"


@query(f"WITH {_FO}, {_RW} SELECT CAST(tf AS INTEGER) AS test_fold, {r('w')} AS weight FROM w")
def recency_weight_closed_form(spark, d):
    return out(models.recency_weight(_folded(spark, d), "user_id", "bk", "lk", 5), "test_fold", weight="weight")


@query(f"WITH {_FO}, g AS (SELECT unnest(range(0, 41)) / 40e0 AS w), p AS (SELECT fold, user_id, w, avg(abs(y - bk - w * (lk - bk))) AS loss FROM k, g GROUP BY ALL), q AS (SELECT tf, w, round(avg(loss), 12) AS loss FROM p, f5 WHERE fold <> tf GROUP BY ALL) SELECT CAST(tf AS INTEGER) AS test_fold, {r('w')} AS weight, {r('loss')} AS loss FROM q QUALIFY row_number() OVER (PARTITION BY tf ORDER BY loss, w) = 1")
def recency_weight_grid(spark, d):
    return out(models.recency_weight_grid(_folded(spark, d), "user_id", "bk", "lk", 5), "test_fold", weight="weight", loss="loss")


@query(f"WITH {_FO}, {_RW} SELECT user_id, rn, {r('bk + w * (lk - bk)')} AS prediction FROM k JOIN w ON fold = tf")
def crossfit_predictions(spark, d):
    t = _folded(spark, d)
    return out(models.crossfit(t, models.recency_weight(t, "user_id", "bk", "lk", 5), "bk", "lk"), "user_id", "rn", prediction="prediction")


# -- resampling ------------------------------------------------------------------------------------


# the reference's numbers of draws
_DRAWS = 2000
_REARRANGED = 500  # permutations and shifts
_AR1_DRAWS = 5000
_SCALE = (0.0, 500.0)
_BLOCK_DRAWS = 1000
_BLOCKS = (8, 16, 32)


def _bootstrap(spark, d, draws=_DRAWS):
    means = resample.bootstrap_means(_people(spark, d), "user_id", draws, ["mae_b", "mae_l"])
    return means.select("draw", relative_change(F.col("mae_l"), F.col("mae_b")).alias("percent"))


@query(
    f"WITH {_PEOPLE}, i AS (SELECT *, row_number() OVER (ORDER BY {_lcg_sql('user_id')}, user_id) - 1 AS idx FROM p), g AS (SELECT draw, {_lcg_sql('31415926', 'draw', 'slot')} % (SELECT count(*) FROM p) AS idx FROM (SELECT unnest(range(0, {_DRAWS})) AS draw), (SELECT unnest(range(0, (SELECT count(*) FROM p))) AS slot)), q AS (SELECT draw, 100 * (avg(mae_l) / avg(mae_b) - 1) AS percent FROM g JOIN i USING (idx) GROUP BY draw) SELECT count(*) AS draws, {r('avg(percent)')} AS mean, {r('quantile_cont(percent, 0.025)')} AS low, {r('quantile_cont(percent, 0.975)')} AS high FROM q"
)
def bootstrap_ci_portable(spark, d):
    return out(resample.percentile_interval(_bootstrap(spark, d), "percent"), "draws", mean="mean", low="low", high="high")


def _null_sql(rearranged: str, draws: int) -> str:
    return f"{S}, e AS (SELECT s.*, draw FROM s, (SELECT unnest(range(0, {draws})) AS draw)), {rearranged}, f AS (SELECT draw, user_id, rn, y, avg(CASE WHEN rn <= 8 THEN y END) OVER (PARTITION BY draw, user_id) AS b, avg(y) OVER (PARTITION BY draw, user_id ORDER BY rn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS l FROM v), u AS (SELECT draw, user_id, avg(abs(y - b) - abs(y - l)) AS g FROM f WHERE rn > 8 GROUP BY ALL), q AS (SELECT draw, avg(g) AS benefit FROM u GROUP BY draw)"


def _null_benefit(spark, d, kind):
    return redraw.null_benefit(reports(spark, d), ENTITY, "user_id", _REARRANGED, kind)


_PERM = _null_sql(f"v AS (SELECT draw, user_id, y, row_number() OVER (PARTITION BY draw, user_id ORDER BY {_lcg_sql('31415926', 'draw', 'user_id', 'rn')}, rn) AS rn FROM e)", _REARRANGED)
_SHIFT = _null_sql(f"v AS (SELECT draw, user_id, y, (rn - 1 + 1 + {_lcg_sql('31415926', 'draw', 'user_id')} % (n - 1)) % n + 1 AS rn FROM e WHERE n > 1)", _REARRANGED)


@query(f"WITH {_PERM} SELECT CAST(draw AS INTEGER) AS draw, {r('benefit')} AS benefit FROM q")
def permutation_null_portable(spark, d):
    return out(_null_benefit(spark, d, "permuted"), "draw", benefit="benefit")


@query(f"WITH {_SHIFT} SELECT CAST(draw AS INTEGER) AS draw, {r('benefit')} AS benefit FROM q")
def circular_shift_portable(spark, d):
    return out(_null_benefit(spark, d, "shifted"), "draw", benefit="benefit")


_NULL = f"{_SHIFT}, o AS (SELECT avg(g) AS observed FROM (SELECT avg(g) AS g FROM (SELECT user_id, abs(y - b) - abs(y - l) AS g FROM (SELECT *, avg(CASE WHEN rn <= 8 THEN y END) OVER (PARTITION BY user_id) AS b, avg(y) OVER ({_W} 8 PRECEDING AND 1 PRECEDING) AS l FROM s) WHERE rn > 8) GROUP BY user_id))"


def _null(spark, d):
    null = _null_benefit(spark, d, "shifted")
    seen = rows_after_eight(spark, d).groupBy("user_id").agg(F.avg("benefit").alias("g")).agg(F.avg("g").alias("observed"))
    return resample.null_summary(null.crossJoin(F.broadcast(seen)), "benefit", F.col("observed"))


@query(f"WITH {_NULL} SELECT {r('avg(benefit)')} AS null_mean, {r('stddev_samp(benefit)')} AS null_sd, {r('(max(observed) - avg(benefit)) / stddev_samp(benefit)')} AS z, {r('(1 + count(*) FILTER (benefit >= observed)) / (count(*) + 1e0)')} AS p FROM q, o")
def null_summary(spark, d):
    return out(_null(spark, d), null_mean="null_mean", null_sd="null_sd", z="z", p="p")


@query()
def ar1_null(spark, d):
    rows = reports(spark, d).join(_shrunk(spark, d), "user_id")
    return redraw.simulated_null(rows, "user_id", _AR1_DRAWS, bounds=_SCALE)


@query()
def block_null(spark, d):
    null = [redraw.simulated_null(reports(spark, d), "user_id", _BLOCK_DRAWS, kind="block", mean_length=k).select(F.lit(k).alias("block"), "*") for k in _BLOCKS]
    return reduce(DataFrame.unionByName, null)


@query(f"WITH {_FM} SELECT user_id, fold FROM fm")
def fold_map(spark, d):
    return _folds(spark, d)


# -- models ----------------------------------------------------------------------------------------


#: Penalties of the nested ridge.
_ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)
_FEATURES = ["mean", "sd", "step", "trend"]


def _first_features_and_gain(spark, d):
    f = ops.first_features(reports(spark, d), ENTITY)
    gain = rows_after_eight(spark, d).groupBy("user_id").agg(F.avg("benefit").alias("gain"))
    return f.join(gain, "user_id").join(_folds(spark, d), "user_id")


@query()
def nested_ridge(spark, d):
    return models.nested_ridge(_first_features_and_gain(spark, d), "user_id", _FEATURES, "gain", _ALPHAS, 5)


@query()
def first_component(spark, d):
    v = models.first_component(_first_features_and_gain(spark, d), ["mean", "sd", "step"])
    return spark.createDataFrame([(n, float(x)) for n, x in zip(("mean", "sd", "step"), v, strict=True)], "feature string, loading double")


# -- keys and verdicts -----------------------------------------------------------------------------


@query("SELECT 'events' AS dataset, CAST(user_id AS VARCHAR) AS participant, count(*) AS rows FROM events GROUP BY user_id UNION ALL SELECT 'orders', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY o_custkey")
def union_sources(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("participant")).agg(F.count("*").alias("rows"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("participant")).agg(F.count("*").alias("rows"))
    return e.select(F.lit("events").alias("dataset"), "participant", "rows").unionByName(o.select(F.lit("orders").alias("dataset"), "participant", "rows"))


_A = "a AS (SELECT o_custkey, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), b AS (SELECT o_custkey, count(*) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)"


def _two(spark, d):
    """Orders a customer, two states of theirs."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    return tuple(o.where(F.col("o_orderstatus") == x).groupBy("o_custkey").agg(F.count("*").alias("v")) for x in "FP")


@query(f"WITH {_A} SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.v AS v_left, b.v AS v_right, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN 'both' WHEN a.v IS NOT NULL THEN 'left' ELSE 'right' END AS presence, coalesce(a.v = b.v, false) AS agree FROM a FULL JOIN b ON a.o_custkey = b.o_custkey")
def full_outer_reconcile(spark, d):
    return quality.reconcile(*_two(spark, d), ["o_custkey"], ["v"]).select("o_custkey", "v_left", "v_right", "presence", "agree")


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'ordered' ELSE 'never' END AS kind FROM customer")
def semi_anti_keys(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey")
    on = c["c_custkey"] == o["o_custkey"]
    return c.join(o, on, "left_semi").withColumn("kind", F.lit("ordered")).unionByName(c.join(o, on, "left_anti").withColumn("kind", F.lit("never")))


@query("SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return quality.duplicate_keys(o, ["o_custkey", "day"])


@query(f"WITH {_A} SELECT o_custkey, 'left' AS side FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b) UNION ALL SELECT o_custkey, 'right' FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)")
def key_set_equality(spark, d):
    return quality.key_difference(*_two(spark, d), ["o_custkey"])


from . import studies  # noqa: E402,F401  registers its queries here
