"""Shared parts of the queries: the test tables in the roles of a panel, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import rounded
from ..operators.series import series, targets

ENTITY = ["user_id"]
NUDGE = 1.7e-8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as one series of reports a user."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return series(events, ENTITY, ["ts", "event_id"], "value")


def rows_after_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets(reports(spark, sf_dir), ENTITY, "ts")


def out(df: DataFrame, *plain: str, **values) -> DataFrame:
    """Named columns as they are, and doubles rounded to six digits.

    Means of 32 or 64 values with two decimals end in an exact half at the seventh; NUDGE moves them off it.
    """
    return df.select(*plain, *[rounded((v if not isinstance(v, str) else F.col(v)) + NUDGE).alias(k) for k, v in values.items()])


S = """s AS (SELECT user_id, event_id, ts, event_type, CAST(value AS DOUBLE) AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
  count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)"""
T = (
    S
    + """, f AS (SELECT *, avg(CASE WHEN rn <= 8 THEN y END) OVER (PARTITION BY user_id) AS bk, avg(y) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS lk,
  max(CASE WHEN rn = 8 THEN ts END) OVER (PARTITION BY user_id) AS t8 FROM s),
t AS (SELECT *, date_diff('microsecond', t8, ts) / 86400000000e0 AS age, abs(y - bk) AS ae_b, abs(y - lk) AS ae_l, abs(y - bk) - abs(y - lk) AS benefit FROM f WHERE rn > 8)"""
)


def r(expr: str) -> str:
    return f"round(({expr}) + {NUDGE}, 6) + 0e0"
