"""Folds, bootstrap, permutation and shift nulls, by draws that any SQL engine can repeat.

Draw tables are small: draws times entities, on per-entity aggregates.  Sequential simulations
(autoregressive and block nulls) run per entity in grouped functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.stats import lcg, lcg_array

SEED = 31415926
#: Values of simulated series held at once.
PATH_VALUES = 4_000_000
#: Simulated series whose gains are found at once.
PATHS_HELD = 512
#: Persons of a bootstrap whose weights are made at once, and tasks that a few blocks' draws are shared out to.
BLOCK_PEOPLE = 1 << 16
DRAW_PARTS = 16


def number(key: Column, kind: str) -> Column:
    """A key of any type as an integer, by its hash if it is none."""
    return key.cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.pmod(F.xxhash64(key), F.lit(1 << 31))


def indexed(people: DataFrame, key: str, index: str = "idx", by: Sequence[str] = (), order: Column | None = None) -> DataFrame:
    """people with a dense 0-based index (in groups ``by``, which are few), in an order of hashes of key that ranges of the hash share out."""
    h = lcg(number(F.col(key), dict(people.dtypes)[key])) if order is None else order
    at = people.withColumn("_h", h).withColumn("_p", F.shiftright("_h", 21))
    sizes = at.groupBy(*by, "_p").agg(F.count("*").alias("_c"))  # 1024 rows a group at most
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = at.join(F.broadcast(sizes.select(*by, "_p", before.alias("_before"))), [*by, "_p"])
    rank = F.row_number().over(Window.partitionBy(*by, "_p").orderBy("_h", key))
    return met.withColumn(index, (F.col("_before") + rank - 1).cast("long")).drop("_h", "_p", "_before")


def folds(entities: DataFrame, key: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """key, fold 1..k: shuffled and balanced, ids of any type, whatever the order of the rows; SQL can repeat it for integers."""
    ids = entities.select(key).where(F.col(key).isNotNull()).distinct()
    dealt = indexed(ids, key, "_i", order=lcg(F.lit(seed), number(F.col(key), dict(ids.dtypes)[key])))
    return dealt.select(key, (F.pmod("_i", F.lit(k)) + 1).cast("int").alias("fold"))


def inner_folds(people: DataFrame, key: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """people once for each test_fold, with inner: 0 in the test fold itself, else 1..k, shuffled and balanced anew among those that train."""
    spread = people.withColumn("test_fold", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("_test", F.col("fold") == F.col("test_fold"))
    order = lcg(F.lit(seed), F.col("test_fold"), number(F.col(key), dict(people.dtypes)[key]))
    dealt = indexed(spread, key, "_i", by=["test_fold", "_test"], order=order)
    return dealt.withColumn("inner", F.when(F.col("_test"), 0).otherwise(F.pmod("_i", F.lit(k)) + 1).cast("int")).drop("_i", "_test")


def greedy_shares(loads: Sequence[int], size: int, groups: int) -> list[int]:
    """How many of ``groups`` groups of one size each fold gets if every group goes to the lightest fold, the first on ties.

    Fold f takes its j-th group at the load loads[f] + j * size, so those taken are the ``groups`` least such loads; a
    search for the load that is not passed finds them without a step for each group.
    """
    below = lambda level: [max(0, -(-(level - x) // size)) for x in loads]  # noqa: E731  taken at loads under level
    low, high = min(loads), max(loads) + size * (groups + 1)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(below(mid)) <= groups else (low, mid)
    taken = below(low)
    for f, x in enumerate(loads):  # the rest are taken at the load low itself, in order of folds
        if sum(taken) < groups and low >= x and (low - x) % size == 0:
            taken[f] += 1
    return taken


def group_folds(rows: DataFrame, key: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """key, fold 1..k, so that no group is in two folds and folds have like numbers of rows: the largest groups first, each to the lightest fold.

    Only the number of groups of each size reaches the driver; groups of one size are dealt out in an order of hashes.
    """
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_size"))
    histogram = sizes.groupBy("_size").agg(F.count("*").alias("m")).orderBy(F.desc("_size")).collect()  # a row a size
    loads, cuts = [0] * k, []
    for row in histogram:
        shares = greedy_shares(loads, row["_size"], row["m"])
        loads = [x + c * row["_size"] for x, c in zip(loads, shares, strict=True)]
        cuts.append((row["_size"], [int(x) for x in np.cumsum(shares)]))
    table = rows.sparkSession.createDataFrame(cuts, "_size long, _cuts array<long>")
    order = lcg(F.lit(seed), number(F.col(key), dict(rows.dtypes)[key]))
    dealt = sizes.withColumn("_h", order).withColumn("_i", F.row_number().over(Window.partitionBy("_size", F.shiftright("_h", 21)).orderBy("_h", key)))
    parts = sizes.select("_size", F.shiftright(order, 21).alias("_p")).groupBy("_size", "_p").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_size").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = dealt.withColumn("_p", F.shiftright("_h", 21)).join(parts.select("_size", "_p", before.alias("_before")), ["_size", "_p"]).join(table, "_size")
    return met.select(key, (F.size(F.filter("_cuts", lambda c: c < F.col("_before") + F.col("_i"))) + 1).cast("int").alias("fold"))


def row_folds(rows: DataFrame, ids: Sequence[str], k: int = 5, seed: int = SEED) -> Column:
    """fold 1..k of each row by a hash of its ids: shuffled, and even but for chance."""
    kinds = dict(rows.dtypes)
    return (F.pmod(lcg(F.lit(seed), *[number(F.col(c), kinds[c]) for c in ids]), F.lit(k)) + 1).cast("int")


def whole_runs(batches: Iterator[pa.RecordBatch], starts: Callable[[pa.Table], np.ndarray]) -> Iterator[pa.Table]:
    """The rows of a sorted partition again, cut only where a run begins: starts gives the places of the first rows of runs."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        at = starts(table)
        cut = int(at[-1]) if len(at) else 0  # the last run may go on
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held


def block_counts(n: int, block: int, draws: int, seed: int = SEED) -> np.ndarray:
    """How many of each draw's n picks fall on a block of persons: a multinomial share, found by halving the range of blocks.

    Each half's share is binomial, from a generator of its own, so every block finds the same shares by itself.
    """
    low, high, counts = 0, -(-n // BLOCK_PEOPLE), np.full(draws, n, np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        share = (mid - low) * BLOCK_PEOPLE / (min(high * BLOCK_PEOPLE, n) - low * BLOCK_PEOPLE)
        left = np.random.default_rng([seed, low, high]).binomial(counts, share)
        low, high, counts = (low, mid, left) if block < mid else (mid, high, counts - left)
    return counts


def _bootstrapped(people: DataFrame, key: str, draws: int, seed: int) -> tuple[DataFrame, list[str], Callable]:
    """The persons by blocks and parts of the draws, their columns, and what gives the weights there: a block's rows, some draws, and a weight for each of both."""
    numbered = indexed(people.persist(StorageLevel.DISK_ONLY), key).drop(key)  # a row a person, read for ranges, numbers and their count
    n = numbered.count()
    blocks = max(1, -(-n // BLOCK_PEOPLE))
    parts = min(draws, max(1, -(-DRAW_PARTS // blocks)))  # few blocks share their draws out
    spread = numbered.withColumn("_block", F.expr(f"idx div {BLOCK_PEOPLE}")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = spread.repartition(blocks * parts if blocks * parts < 64 else blocks, "_block", "_part").sortWithinPartitions("_block", "_part", "idx")

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        for table in whole_runs(batches, lambda t: np.flatnonzero(t.column("idx").to_numpy() % BLOCK_PEOPLE == 0)):
            firsts = np.flatnonzero(table.column("idx").to_numpy() % BLOCK_PEOPLE == 0)
            for a, b in zip(firsts, [*firsts[1:], table.num_rows], strict=True):
                block, part = table.column("_block")[int(a)].as_py(), table.column("_part")[int(a)].as_py()
                rows, size = table.slice(a, b - a).combine_chunks(), int(b - a)
                counts = block_counts(n, block, draws, seed)
                last = (part + 1) * draws // parts
                step = max(1, BLOCK_PEOPLE // size)
                for first in range(part * draws // parts, last, step):
                    some = np.arange(first, min(first + step, last))
                    of = np.repeat(np.arange(len(some)), counts[some])
                    slot = np.arange(len(of)) - np.repeat(np.cumsum(counts[some]) - counts[some], counts[some])
                    place = (some[of],) if blocks == 1 else (some[of], block)
                    yield rows, some, np.bincount(of * size + lcg_array(seed, *place, slot) % size, minlength=len(some) * size).reshape(len(some), size)

    return dealt, [c for c in numbered.columns if c != "idx"], weights


def bootstrap(people: DataFrame, key: str, draws: int, seed: int = SEED, **statistics: Column) -> DataFrame:
    """A row for each draw of as many persons as there are: statistics, aggregates in which weight says how often a person is drawn.

    Weights are made beside the persons, block by block; a row for each draw and person drawn goes into the aggregates, so
    what means can say is left to ``bootstrap_means``.  Up to BLOCK_PEOPLE persons are one block, whose picks SQL can repeat.
    """
    dealt, kept, weights = _bootstrapped(people, key, draws, seed)

    def run(batches):
        for rows, some, weight in weights(batches):
            draw, picked = np.nonzero(weight)
            found = rows.take(picked)
            columns = [pa.array(some[draw]), pa.array(weight[draw, picked]), *[found.column(c).combine_chunks() for c in kept]]
            yield pa.RecordBatch.from_arrays(columns, names=["draw", "weight", *kept])

    schema = StructType([StructField("draw", LongType()), StructField("weight", LongType()), *[dealt.schema[c] for c in kept]])
    return dealt.mapInArrow(run, schema).groupBy("draw").agg(*[v.alias(k) for k, v in statistics.items()])


def bootstrap_means(people: DataFrame, key: str, draws: int, columns: Sequence[str], seed: int = SEED) -> DataFrame:
    """draw and the mean of each column over the persons drawn that have a value, with the weights of ``bootstrap``.

    Weights meet the columns as matrices, so a row for each draw and block of persons leaves a task.
    """
    kept = people.select(key, *[F.col(f"`{c}`").cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    dealt, names, weights = _bootstrapped(kept, key, draws, seed)
    sums = [f"{s}{i}" for s in "sn" for i in range(len(names))]

    def run(batches):
        held = x = finite = None
        for rows, some, weight in weights(batches):
            if rows is not held:
                held, x = rows, np.column_stack([rows.column(c).to_numpy() for c in names])
                null = np.column_stack([rows.column(c).is_null().to_numpy() for c in names])
                x = np.hstack([np.where(null, 0.0, x), ~null])
                finite = np.isfinite(x).all()
            # whom a draw leaves out has no part in it, whatever the value
            total = weight.astype(float) @ x if finite else np.stack([w[w > 0] @ x[w > 0] for w in weight])
            yield pa.RecordBatch.from_arrays([pa.array(some), *map(pa.array, total.T.copy())], names=["draw", *sums])

    g = dealt.mapInArrow(run, f"draw bigint, {', '.join(f'{c} double' for c in sums)}").groupBy("draw")
    return g.agg(*[F.try_divide(F.sum(f"s{i}"), F.sum(f"n{i}")).alias(c) for i, c in enumerate(columns)])


def weighted_correlation(x: str, y: str, w: str = "weight") -> Column:
    """Pearson correlation of weighted rows; null where a side does not vary."""
    def mean(c):
        return F.sum(F.col(w) * c) / F.sum(w)

    a, b = F.col(x), F.col(y)
    cov, va, vb = mean(a * b) - mean(a) * mean(b), mean(a * a) - mean(a) * mean(a), mean(b * b) - mean(b) * mean(b)
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, F.try_divide(cov, F.sqrt(va * vb)))


def percentile_interval(draws: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    aggs = [F.percentile(column, 0.025).alias("low"), F.percentile(column, 0.975).alias("high"), F.avg(column).alias("mean"), F.count(column).alias("draws")]
    return draws.groupBy(*by).agg(*aggs) if by else draws.agg(*aggs)


def permuted(rows: DataFrame, entity: Sequence[str], key: str, draws: int, seed: int = SEED) -> DataFrame:
    """Per draw the values of each entity in a new order (y_new); positions and all else stay."""
    spread = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    order = lcg(F.lit(seed), F.col("draw"), number(F.col(key), dict(rows.dtypes)[key]), F.col("rn"))
    whole = Window.partitionBy("draw", *entity)
    spread = spread.withColumn("_to", F.row_number().over(whole.orderBy(order, "rn")).cast("long"))
    return _rearranged(spread, ["draw", *entity])


def shifted(rows: DataFrame, entity: Sequence[str], key: str, draws: int, seed: int = SEED) -> DataFrame:
    """Per draw the series of each entity turned by 1..n-1 places, so neighbours stay neighbours."""
    spread = rows.where("n > 1").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    shift = 1 + F.pmod(lcg(F.lit(seed), F.col("draw"), number(F.col(key), dict(rows.dtypes)[key])), F.col("n") - 1)
    return _rearranged(spread.withColumn("_to", F.pmod(F.col("rn") - 1 + shift, F.col("n")) + 1), ["draw", *entity])


def _rearranged(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """y_new: the value of the row of the group whose _to is this row's rn, 1..n both."""
    # one shuffle: the values in order of _to and the rows in order of rn meet in the same partitioning
    values = rows.select(*by, F.col("_to").alias("rn"), F.col("y").alias("y_new"))
    return rows.drop("_to").join(values, [*by, "rn"])


def null_summary(draws: DataFrame, statistic: str, observed: Column) -> DataFrame:
    """Mean, SD and interval of a null, its z and the one-sided Monte-Carlo p of an observed value."""
    x = F.col(statistic)
    return draws.agg(
        F.avg(x).alias("null_mean"), F.stddev_samp(x).alias("null_sd"), F.percentile(x, 0.025).alias("null_low"), F.percentile(x, 0.975).alias("null_high"),
        F.try_divide(F.max(observed) - F.avg(x), F.stddev_samp(x)).alias("z"), ((1 + F.count_if(x >= observed)) / (F.count("*") + 1)).alias("p"),
    )


# -- simulated series of one entity ------------------------------------------------------------------


def benefit_slope(y: np.ndarray, k: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Mean benefit and slope on log age (in reports) of each row of a draws x time array."""
    draws, n = y.shape
    x = np.log1p(np.arange(1, n - k + 1))
    x = x - x.mean()
    benefit, slope = np.empty(draws), np.empty(draws)
    for a in range(0, draws, PATHS_HELD):  # time by draws, few enough for a core's own memory
        part = np.ascontiguousarray(y[a : a + PATHS_HELD].T)
        c = np.zeros((n + 1, part.shape[1]))
        for t in range(n):
            np.add(c[t], part[t], out=c[t + 1])
        recent = c[k:-1] - c[: -1 - k]
        recent /= k
        np.abs(np.subtract(part[k:], recent, out=recent), out=recent)
        gain = part[k:] - c[k] / k
        np.abs(gain, out=gain)
        gain -= recent
        benefit[a : a + PATHS_HELD], slope[a : a + PATHS_HELD] = gain.mean(axis=0), x @ gain
    return benefit, slope / max(float(x @ x), 1e-300)


def ar1_paths(y: np.ndarray, phi: float, draws: int, rng: np.random.Generator, bounds: tuple[float, float] | None = None, sd: float | None = None) -> np.ndarray:
    """Stationary Gaussian AR(1) series with the mean, SD (or the one given) and length of y."""
    sd = y.std() if sd is None else sd
    out = rng.standard_normal((len(y), draws))  # time by draws: a step works on neighbours in memory
    out[0] *= sd
    out[1:] *= sd * np.sqrt(1 - phi * phi)
    step = np.empty(draws)
    for t in range(1, len(y)):
        out[t] += np.multiply(out[t - 1], phi, out=step)
    out += y.mean()
    return (np.clip(out, *bounds, out=out) if bounds else out).T


def block_paths(y: np.ndarray, mean_length: float, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Stationary bootstrap: blocks of geometric length, wrapped around the end."""
    n = len(y)
    at = np.empty((n, draws), np.int64)  # time by draws
    at[0] = rng.integers(0, n, draws)
    for t in range(1, n):
        np.add(at[t - 1], 1, out=at[t])
        begins = rng.random(draws) < 1 / mean_length
        np.copyto(at[t], rng.integers(0, n, draws), where=begins)
    return np.concatenate([y, y])[at].T  # a block goes on for less than n places


def drawn_fold(draw: Column, key: Column, k: int, seed: int = SEED) -> Column:
    """fold 1..k of an entity, dealt anew in each draw."""
    return (F.pmod(lcg(F.lit(seed), draw, key), F.lit(k)) + 1).cast("int")


def cyclic_pairs(rows: DataFrame, entity: Sequence[str]) -> DataFrame:
    """entity, z, y: each value and the next one, the first again after the last."""
    w = Window.partitionBy(*entity).orderBy("rn")
    first = F.first("y").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select(*entity, F.coalesce(F.lead("y").over(w), first).alias("z"), "y")


def path_marginals(paths: np.ndarray, low: float, high: float) -> np.ndarray:
    """mean, sd, floor, ceiling, lag1, outside and grid of each row of a draws x time array; lag1 is missing for constant rows."""
    x, y = (z - z.mean(axis=1, keepdims=True) for z in (paths[:, :-1], paths[:, 1:]))
    spread = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        lag1 = np.where(spread > 0, (x * y).sum(axis=1) / spread, np.nan)
    shares = [(paths == low), (paths == high), (paths < low) | (paths > high), np.abs(paths - np.rint(paths)) <= 1e-10]
    floor, ceiling, outside, grid = (s.mean(axis=1) for s in shares)
    return np.stack([paths.mean(axis=1), paths.std(axis=1), floor, ceiling, lag1, outside, grid], axis=1)


MARGINALS = ("mean", "sd", "floor", "ceiling", "lag1", "outside", "grid")
