"""Nulls from series rearranged or simulated within entities, with all draws of an entity made where its series is.

A series is shuffled once.  Its draws are rows of an array in the task that holds it, and what leaves the task are
sums for each draw, not rows.  A series too long for one array takes its draws in several blocks, each with a copy of the
series; one of more than ``SERIES_MOST`` reports is rearranged by joins and windows instead (``resample.permuted``,
``resample.shifted``), so no task holds it.  Both ways use the same portable draws and give the same numbers.
Simulated series come from a generator of their entity and block, and blocks follow from a series' length alone, so results do not
depend on how the work is dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import lcg_array
from . import resample
from .resample import PATH_VALUES, SEED, number, whole_runs
from .series import History

#: Reports of a series that one task may hold.
SERIES_MOST = 1 << 22
KINDS = ("permuted", "shifted")


def rearranged(y: np.ndarray, key: int, draws: np.ndarray, kind: str, seed: int = SEED) -> np.ndarray:
    """draws x time: the series in the order of each draw, as resample.permuted and resample.shifted have it."""
    n, d = len(y), draws[:, None]
    if kind == "permuted":
        return y[np.argsort(lcg_array(seed, d, key, np.arange(1, n + 1)), axis=1, kind="stable")]
    return turned(y)[_turns(n, key, draws, seed)]


def turned(y: np.ndarray) -> np.ndarray:
    """The series turned by 1..n-1 places, a row each, without a copy."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([y, y]), len(y))[len(y) - 1 : 0 : -1]


def _turns(n: int, key: int, draws: np.ndarray, seed: int) -> np.ndarray:
    """Row of turned in each draw."""
    return lcg_array(seed, draws, key) % (n - 1)


def baselines(paths: np.ndarray, k: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reports after the first k of each path, the mean of those k, and the mean of the k before each report."""
    c = np.cumsum(np.pad(paths, ((0, 0), (1, 0))), axis=1)
    return paths[:, k:], c[:, k : k + 1] / k, (c[:, k:-1] - c[:, : -1 - k]) / k


def _step(n: int, draws: int) -> int:
    """Draws of a series of n reports that one array holds."""
    return max(1, min(draws, PATH_VALUES // max(n, 1)))


def _dealt(rows: DataFrame, entity: Sequence[str], key: str, draws: int, extra: Sequence[str]) -> DataFrame:
    """The series in order, a copy for each block of draws: _key, _id, _block, rn, y and the extra columns."""
    step = F.greatest(F.lit(1), F.least(F.lit(draws), F.floor(F.lit(PATH_VALUES) / F.greatest("n", F.lit(1)))))
    blocks = F.ceil(F.lit(draws) / step).cast("int")
    ids = number(F.col(key), dict(rows.dtypes)[key])
    spread = rows.select(*entity, ids.alias("_key"), F.concat_ws("\x1f", *entity).alias("_id"), "rn", F.col("y").cast("double").alias("y"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(extra)])
    # a number of its own, for Spark joins small partitions by their bytes, and few bytes of reports are much work
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return spread.repartition(tasks, *entity, "_block").sortWithinPartitions(*entity, "_block", "rn").select("rn", "y", "_key", "_id", "_block", *[f"_x{i}" for i in range(len(extra))])


def _blocks(batches: Iterator[pa.RecordBatch], draws: int, extra: Sequence[str]) -> Iterator[tuple]:
    """For each block of draws of each series: y, number of the entity, its name, block, draws, extra values by name."""
    for table in whole_runs(batches, lambda t: np.flatnonzero(t.column("rn").to_numpy() == 1)):
        rn, y, key, block, *more = (table.column(c).to_numpy() for c in ("rn", "y", "_key", "_block", *(f"_x{i}" for i in range(len(extra)))))
        starts = np.flatnonzero(rn == 1)
        for a, b in zip(starts, [*starts[1:], len(rn)], strict=True):
            step = _step(b - a, draws)
            some = np.arange(block[a] * step, min((block[a] + 1) * step, draws))
            yield y[a:b], int(key[a]), table.column("_id")[int(a)].as_py(), int(block[a]), some, {c: float(x[a]) for c, x in zip(extra, more, strict=True)}


def draw_sums(rows: DataFrame, entity: Sequence[str], key: str, draws: int, paths: Callable, statistic: Callable, names: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """draw, cell, people and the sums over entities of a statistic of each draw's series.

    rows: entity, rn (1..n), n, y and columns that are constant in an entity (extra).  paths(y, key, id, block, draws, extra) gives the
    series of a block of draws, statistic(paths, key, draws, extra) a cell (int), or one for each, and the values of ``names`` for each.
    """
    width = len(names)

    def run(batches):
        sums: dict[int, np.ndarray] = {}  # cell -> draws x (people, values)
        for y, number_, name, block, some, values_of in _blocks(batches, draws, extra):
            cells, values = statistic(paths(y, number_, name, block, some, values_of), number_, some, values_of)
            if isinstance(cells, int):
                if cells not in sums:
                    sums[cells] = np.zeros((draws, 1 + width))
                total = sums[cells][some[0] : some[-1] + 1]
                total[:, 0] += 1
                total[:, 1:] += values
                continue
            for cell in np.unique(cells):
                at = cells == cell
                total = sums.setdefault(int(cell), np.zeros((draws, 1 + width)))
                total[some[at], 0] += 1
                total[some[at], 1:] += values[at]
        for cell, total in sums.items():
            at = np.flatnonzero(total[:, 0])
            columns = [pa.array(at.astype(np.int32)), pa.array(np.full(len(at), cell, np.int32)), pa.array(total[at, 0].astype(np.int64)), *[pa.array(total[at, 1 + i]) for i in range(width)]]
            yield pa.RecordBatch.from_arrays(columns, names=["draw", "cell", "people", *names])

    return _dealt(rows, entity, key, draws, extra).mapInArrow(run, f"draw int, cell int, people bigint, {', '.join(f'{n} double' for n in names)}")


def _moved(kind: str, seed: int) -> Callable:
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    return lambda y, key, name, block, some, extra: rearranged(y, key, some, kind, seed)


def _by_windows(rows: DataFrame, entity: Sequence[str], key: str, draws: int, kind: str, seed: int, k: int) -> DataFrame:
    """draw, entity, y, b, l of the rearranged reports after the first k of series of more than SERIES_MOST reports."""
    h = History(["draw", *entity], y="y_new")
    moved = getattr(resample, kind)(rows.where(F.col("n") > SERIES_MOST), entity, key, draws, seed)
    return moved.select("draw", *entity, "rn", F.col("y_new").alias("y"), h.frozen_mean(k).alias("b"), h.rolling_mean(k).alias("l")).where(F.col("rn") > k)


def _held(rows: DataFrame, k: int) -> DataFrame:
    return rows.where((F.col("n") > k) & (F.col("n") <= SERIES_MOST))


def null_benefit(rows: DataFrame, entity: Sequence[str], key: str, draws: int, kind: str, seed: int = SEED, k: int = 8, cell: str | None = None) -> DataFrame:
    """draw, benefit: the mean over entities of the recent mean's gain on the frozen one, in series rearranged within entities.

    With cell, an int column that is constant in an entity, there is a row for each draw and cell.
    """

    def gains(paths):
        y, b, last = baselines(paths, k)
        return (np.abs(y - b) - np.abs(y - last)).mean(axis=1, keepdims=True)

    def statistic(paths, key, draws, extra):
        return int(extra.get("cell", 0)), gains(paths)

    def of_turns(y, key, draws, extra):
        """A series has n - 1 turns, however many draws there are."""
        at = _turns(len(y), key, draws, seed)
        return int(extra.get("cell", 0)), gains(turned(y))[at] if len(y) <= len(draws) else gains(turned(y)[at])

    moved = _moved(kind, seed)
    way = (lambda y, *_: y, of_turns) if kind == "shifted" else (moved, statistic)
    if cell is not None:
        rows = rows.withColumn("cell", F.col(cell).cast("int"))
    by = ["cell"] if cell is not None else []
    short = draw_sums(_held(rows, k), entity, key, draws, *way, ["benefit"], by)
    far = _by_windows(rows, entity, key, draws, kind, seed, k)
    if cell is not None:
        far = far.join(rows.where(F.col("n") > SERIES_MOST).select(*entity, "cell").distinct(), list(entity))
    per = far.groupBy("draw", *by, *entity).agg(F.avg(F.abs(F.col("y") - F.col("b")) - F.abs(F.col("y") - F.col("l"))).alias("g"))
    long = per.groupBy("draw", *by).agg(F.count("*").alias("people"), F.sum("g").alias("benefit"))
    both = short.select("draw", *by, "people", "benefit").unionByName(long)
    return both.groupBy("draw", *by).agg((F.sum("benefit") / F.sum("people")).alias("benefit"))


def drawn_folds(draws: np.ndarray, key: int, k: int, seed: int = SEED) -> np.ndarray:
    """fold 1..k of an entity in each draw, as resample.drawn_fold deals them."""
    return lcg_array(seed, draws, key) % k + 1


def null_refit(rows: DataFrame, entity: Sequence[str], key: str, draws: int, kind: str = "permuted", folds: int = 5, seed: int = SEED, k: int = 8) -> DataFrame:
    """draw, mae_b, mae_l: errors of the frozen mean and of the blend whose weight the draw's other folds give, rearranged anew in each draw.

    The series are taken twice: for the sums of each draw's folds, from which its weights follow (draws x folds numbers), and for
    the errors under those weights.
    """
    spark, held = rows.sparkSession, _held(rows, k)

    def fitted(paths, key, draws, extra):
        y, b, last = baselines(paths, k)
        d = last - b
        return drawn_folds(draws, key, folds, seed), np.stack([(d * (y - b)).mean(axis=1), (d * d).mean(axis=1)], axis=1)

    far = _by_windows(rows, entity, key, draws, kind, seed, k)
    far = far.withColumn("cell", resample.drawn_fold(F.col("draw"), number(F.col(key), dict(rows.dtypes)[key]), folds, seed))
    d = F.col("l") - F.col("b")
    long = far.groupBy("draw", "cell", *entity).agg(F.avg(d * (F.col("y") - F.col("b"))).alias("num"), F.avg(d * d).alias("den")).groupBy("draw", "cell").agg(F.count("*").alias("people"), F.sum("num").alias("num"), F.sum("den").alias("den"))
    sums = draw_sums(held, entity, key, draws, _moved(kind, seed), fitted, ["num", "den"]).unionByName(long).groupBy("draw", "cell").agg(F.sum("num").alias("num"), F.sum("den").alias("den")).collect()  # draws x folds rows
    part = np.zeros((draws, folds + 1, 2))
    for row in sums:
        part[row["draw"], row["cell"]] = row["num"], row["den"]
    others = part.sum(axis=1, keepdims=True) - part
    with np.errstate(invalid="ignore", divide="ignore"):
        weight = np.where(others[..., 1] > 0, np.clip(others[..., 0] / others[..., 1], 0, 1), 0.0)

    def errors(paths, key, draws, extra):
        y, b, last = baselines(paths, k)
        w = weight[draws, drawn_folds(draws, key, folds, seed)][:, None]
        return 0, np.stack([np.abs(y - b).mean(axis=1), np.abs(y - b - w * (last - b)).mean(axis=1)], axis=1)

    table = spark.createDataFrame([(i, f, float(weight[i, f])) for i in range(draws) for f in range(1, folds + 1)], "draw int, cell int, weight double")
    met = far.join(F.broadcast(table), ["draw", "cell"])  # draws x folds rows
    error = met.groupBy("draw", *entity).agg(F.avg(F.abs(F.col("y") - F.col("b"))).alias("mae_b"), F.avg(F.abs(F.col("y") - F.col("b") - F.col("weight") * d)).alias("mae_l"))
    long = error.groupBy("draw").agg(F.count("*").alias("people"), F.sum("mae_b").alias("mae_b"), F.sum("mae_l").alias("mae_l"))
    both = draw_sums(held, entity, key, draws, _moved(kind, seed), errors, ["mae_b", "mae_l"]).drop("cell").unionByName(long)
    return both.groupBy("draw").agg(*[(F.sum(c) / F.sum("people")).alias(c) for c in ("mae_b", "mae_l")])


# -- simulated series ------------------------------------------------------------------------------


def _generator(seed: int, name: str, block: int) -> np.random.Generator:
    return np.random.default_rng([seed, block, *hashlib.md5(name.encode()).digest()])


def simulated(kind: str, bounds: tuple[float, float] | None = None, mean_length: float = 16.0, own_sd: bool = False, seed: int = SEED) -> Callable:
    """paths of draw_sums: AR(1) series with the entity's phi (and sd, if own_sd), held within bounds, or blocks of the series itself."""
    if kind not in ("ar1", "block"):
        raise ValueError("kind is ar1 or block")

    def paths(y, key, name, block, some, extra):
        rng = _generator(seed, name, block)
        if kind == "ar1":
            return resample.ar1_paths(y, extra["phi"], len(some), rng, bounds, extra["sd"] if own_sd else None)
        return resample.block_paths(y, mean_length, len(some), rng)

    return paths


def simulated_null(rows: DataFrame, entity: str, draws: int, kind: str = "ar1", seed: int = SEED, mean_length: float = 16.0, bounds: tuple[float, float] | None = None, own_sd: bool = False, k: int = 8) -> DataFrame:
    """Per draw: mean over entities of benefit and slope on log age.  rows has y, rn, n, for ar1 phi, and sd if own_sd; phi counts for bounded series as for free ones."""

    def statistic(paths, key, draws, extra):
        return 0, np.stack(resample.benefit_slope(paths, k), axis=1)

    extra = ["phi"] * (kind == "ar1") + ["sd"] * own_sd
    sums = draw_sums(rows.where(F.col("n") >= k + 5), [entity], entity, draws, simulated(kind, bounds, mean_length, own_sd, seed), statistic, ["benefit", "slope"], extra)
    g = sums.groupBy("draw").agg(*[(F.sum(c) / F.sum("people")).alias(c) for c in ("benefit", "slope")])
    return g.select(F.col("draw").cast("long").alias("draw"), "benefit", "slope")


def simulated_marginals(rows: DataFrame, entity: str, draws: int, low: float, high: float, bounds: tuple[float, float] | None = None, seed: int = SEED) -> DataFrame:
    """Means over entities of the diagnostics' means over each entity's simulated series.  rows has y, rn, n, phi."""
    names = resample.MARGINALS
    paths = simulated("ar1", bounds, seed=seed)

    def run(batches):
        for y, key, name, block, some, extra in _blocks(batches, draws, ["phi"]):
            m = resample.path_marginals(paths(y, key, name, block, some, extra), low, high)
            known = ~np.isnan(m)
            values = [*np.where(known, m, 0).sum(axis=0), *known.sum(axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array([name]), *[pa.array([float(v)]) for v in values]], names=["id", *names, *(f"n_{n}" for n in names)])

    each = _dealt(rows.where("n >= 2"), [entity], entity, draws, ["phi"]).mapInArrow(run, "id string, " + ", ".join(f"{n} double" for n in [*names, *(f"n_{n}" for n in names)]))
    per = each.groupBy("id").agg(*[F.try_divide(F.sum(n), F.sum(f"n_{n}")).alias(n) for n in names])
    return per.agg(F.count("*").alias("people"), *[F.avg(n).alias(n) for n in names])
