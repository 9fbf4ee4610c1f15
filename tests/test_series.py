"""History features on small series worked out by hand, and that they never see the present or the future."""

import datetime
import statistics

import pytest
from pyspark.sql import functions as F

from longpanel.operators import quality, resample
from longpanel.operators import series as ops


def make(spark, values, entity="a"):
    rows = [(entity, i, None if v is None else float(v)) for i, v in enumerate(values, 1)]
    return spark.createDataFrame(rows, "who string, ord long, value double")


def panel(spark, values):
    h = ops.History(["who"])
    rows = ops.with_lag(ops.series(make(spark, values), ["who"], ["ord"], "value"), ["who"])
    found = rows.select(
        "rn", h.frozen_mean(8).alias("b8"), h.rolling_mean(8).alias("l8"), h.previous().alias("last"), h.running_mean().alias("online"),
        h.rolling_median(8).alias("median"), h.recent_mode(8).alias("mode"), h.ewm().alias("ewm"), h.online_ar1().alias("ar1"),
    )
    return {r["rn"]: r.asDict() for r in found.collect()}


VALUES = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8]


def test_features_by_hand(spark):
    rows = panel(spark, VALUES)
    for t in range(9, len(VALUES) + 1):
        before = VALUES[: t - 1]
        assert rows[t]["b8"] == pytest.approx(statistics.mean(VALUES[:8]))
        assert rows[t]["l8"] == pytest.approx(statistics.mean(before[-8:]))
        assert rows[t]["last"] == before[-1]
        assert rows[t]["online"] == pytest.approx(statistics.mean(before))
        assert rows[t]["median"] == pytest.approx(statistics.median(before[-8:]))
        m = statistics.mean(VALUES[:8])
        for y in before[8:]:
            m = 7 / 9 * m + 2 / 9 * y
        assert rows[t]["ewm"] == pytest.approx(m)
        m, k = statistics.mean(before), len(before)
        num = sum((x - m) * (y - m) for x, y in zip(before, before[1:], strict=False))
        den = sum((x - m) ** 2 for x in before[:-1])
        phi = min(max((k - 1) / (k - 1 + 10) * num / den, -0.95), 0.95)
        assert rows[t]["ar1"] == pytest.approx(m + phi * (before[-1] - m))


def test_mode_prefers_the_most_recent_on_ties(spark):
    # 1 and 5 both come twice in the last eight; 5 is later
    assert panel(spark, [1, 1, 2, 3, 4, 5, 6, 5, 0])[9]["mode"] == 5.0
    assert panel(spark, [5, 5, 2, 3, 4, 1, 6, 1, 0])[9]["mode"] == 1.0


@pytest.mark.parametrize("changed", [9, 11, 12])
def test_no_leakage(spark, changed):
    """A change of report t moves no feature of reports up to t."""
    other = [v + 50 * (i == changed) for i, v in enumerate(VALUES, 1)]
    a, b = panel(spark, VALUES), panel(spark, other)
    for t in range(9, changed + 1):
        assert a[t] == b[t]


def test_missing_values_take_no_rank(spark):
    rows = ops.series(make(spark, [1, None, float("nan"), 2]), ["who"], ["ord"], "value").collect()
    assert sorted((r["ord"], r["rn"], r["n"]) for r in rows) == [(1, 1, 2), (4, 2, 2)]


def test_empty_input(spark):
    empty = make(spark, [])
    assert ops.targets(ops.series(empty, ["who"], ["ord"], "value"), ["who"], "ord").count() == 0
    assert ops.opportunities(empty.withColumnRenamed("ord", "counter"), ["who"], "counter", F.lit(True)).count() == 0


def test_gap_of_exactly_thirty_days_stays(spark):
    day = datetime.datetime(2024, 1, 1)
    times = [day, day + datetime.timedelta(days=30), day + datetime.timedelta(days=60, seconds=1)]
    rows = ops.sessions(spark.createDataFrame([("a", t) for t in times], "who string, at timestamp"), ["who"], "at").orderBy("at").collect()
    assert [r["segment"] for r in rows] == [0, 0, 1]


def test_streak_and_completion(spark):
    done = [True] * 8 + [False, False, True, False]
    df = spark.createDataFrame([("a", i, d) for i, d in enumerate(done, 1)], "who string, counter long, done boolean")
    rows = {r["counter"]: (r["n_prior"], r["streak"]) for r in ops.opportunities(df, ["who"], "counter", F.col("done")).collect()}
    assert rows == {9: (8, 0), 10: (8, 1), 11: (8, 2), 12: (9, 0)}


def test_permutation_and_shift_keep_values(spark):
    rows = ops.series(make(spark, VALUES).withColumn("who", F.lit(7).cast("long")), ["who"], ["ord"], "value")
    for moved in (resample.permuted(rows, ["who"], "who", 3), resample.shifted(rows, ["who"], "who", 3)):
        for r in moved.groupBy("draw").agg(F.sort_array(F.collect_list("y_new")).alias("v")).collect():
            assert r["v"] == sorted(map(float, VALUES))
    shifted = resample.shifted(rows, ["who"], "who", 3).where("draw = 1").orderBy("rn").collect()
    new = [r["y_new"] for r in shifted]
    assert new != list(map(float, VALUES)) and any(new == list(map(float, VALUES[s:] + VALUES[:s])) for s in range(1, len(VALUES)))


def test_conflicts_and_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, "y"), (3, None), (3, None)], "k int, v string")
    assert sorted(r["k"] for r in quality.without_conflicts(df.where("v IS NOT NULL"), ["k"], ["v"]).collect()) == [1]
    assert sorted((r["k"], r["n"]) for r in quality.duplicate_keys(df, ["k"]).collect()) == [(1, 2), (2, 2), (3, 2)]
    with pytest.raises(Exception, match="repeat"):
        quality.require_unique(df, ["k"]).collect()
    with pytest.raises(Exception, match="missing"):
        quality.require_no_missing(df, ["v"]).collect()


def test_private_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Participant int, x_email int, score int")
    assert quality.private_columns(df) == ["Participant", "x_email"]
    assert quality.private_paths("see /home/someone/x.csv and C:\\data") == ["/home/someone/x.csv", "C:\\data"]
