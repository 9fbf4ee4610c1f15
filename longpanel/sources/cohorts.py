"""Cohorts by specification: where a panel's outcomes are, who reports them, in which order, on which scale.

A specification holds all that the analyses ask of a source, so they run over every registered outcome alike.  Each
source is scanned once, with the columns that its specification names.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import series
from . import tables


@dataclass(frozen=True)
class Scale:
    """Least and greatest value, and whether higher is worse (1) or better (-1)."""

    low: float
    high: float
    direction: float = 1.0


@dataclass(frozen=True)
class Cohort:
    """A source of reports.

    outcomes: a scale for each outcome.  values: an expression for each outcome of a wide source; without it the source is
    long, with the outcome's name in ``kind`` and its value in ``value``.  where: a condition on rows.  load: how the table
    is read, if not as a Parquet table of that name.
    """

    table: str
    participant: str
    order: Sequence[str]
    outcomes: Mapping[str, Scale]
    values: Mapping[str, str] = field(default_factory=dict)
    kind: str = ""
    value: str = ""
    where: str = ""
    load: Callable[[SparkSession, str], DataFrame] | None = None


#: Registered cohorts by name.
SPECS: dict[str, Cohort] = {}


def register(name: str, spec: Cohort) -> None:
    if not spec.values and not (spec.kind and spec.value):
        raise ValueError("a cohort has values, or kind and value")
    if spec.values and set(spec.values) != set(spec.outcomes):
        raise ValueError("every outcome has a value and a scale")
    if any(s.low >= s.high or s.direction not in (1.0, -1.0) for s in spec.outcomes.values()):
        raise ValueError("a scale goes up, and its direction is 1 or -1")
    SPECS[name] = spec
    tables.register(name)(lambda spark, folder: reports(spark, folder, name))


def reports(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """dataset, outcome, participant, id (the participant as it is), place (the order columns, as a struct), y of one cohort: one scan of its source."""
    if name not in SPECS:
        raise KeyError(f"no cohort {name}; there are {sorted(SPECS)}")
    s = SPECS[name]
    rows = s.load(spark, folder) if s.load else spark.read.parquet(f"{folder}/{s.table}.parquet")
    rows = rows.where(s.where) if s.where else rows
    who = [F.lit(name).alias("dataset"), F.col(s.participant).cast("string").alias("participant"), F.col(s.participant).alias("id"), F.struct(*s.order).alias("place")]
    if s.values:
        cells = F.array(*[F.struct(F.lit(o).alias("outcome"), F.expr(v).cast("double").alias("y")) for o, v in s.values.items()])
        return rows.select(*who, F.explode(cells).alias("c")).select("dataset", "c.outcome", "participant", "id", "place", "c.y")
    return rows.where(F.col(s.kind).isin(*s.outcomes)).select("*", *who).select("dataset", F.col(s.kind).alias("outcome"), "participant", "id", "place", F.col(s.value).cast("double").alias("y"))


def scales(spark: SparkSession) -> DataFrame:
    """dataset, outcome, cell (a number for each), low, high, direction of all registered outcomes: a row each."""
    rows = [(d, o, float(x.low), float(x.high), float(x.direction)) for d, s in sorted(SPECS.items()) for o, x in sorted(s.outcomes.items())]
    return spark.createDataFrame([(d, o, i, *x) for i, (d, o, *x) in enumerate(rows)], "dataset string, outcome string, cell int, low double, high double, direction double")


def panel(spark: SparkSession, folder: str, names: Sequence[str] | None = None) -> DataFrame:
    """All registered cohorts (or some) as one long table of series: dataset, outcome, participant, id, y, rn, n, low, high, direction, cell."""
    key, parts = ["dataset", "outcome", "participant"], []
    for name in names or sorted(SPECS):
        made = series(reports(spark, folder, name), key, ["place"], "y")
        parts.append(made.select(*key, F.col("id").cast("long").alias("id") if dict(made.dtypes)["id"] != "string" else F.xxhash64("id").alias("id"), "y", "rn", "n"))
    if not parts:
        raise ValueError("no cohort is registered")
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(scales(spark)), ["dataset", "outcome"])  # a row an outcome
