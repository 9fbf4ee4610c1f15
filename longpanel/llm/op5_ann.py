"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to unit length (for unequal lengths an extra coordinate keeps the order of inner
products) and hashed by two pseudo-random rotations (three rounds of random signs and a fast Hadamard
transform each): the nearest signed axis of the first, and of the second's first ``FINE`` coordinates.  Each
of ``TABLES`` tables deals all vectors into such buckets.  A query probes the buckets of all tables in the
order of what its coordinates fall short of the nearest axes, until they hold ``reach`` vectors, counted once a
table.  Candidates are ranked by the exact inner product of the original vectors, in double precision and one order of
summing.

``reach`` is measured, not set: the exact neighbours of ``SAMPLE`` queries, found in one pass over all vectors, tell how far
each query would have had to look for each of them, and the reach is what finds the share ``TARGET`` of them.  So recall does not
depend on the number of vectors, their dimension or their lengths; what such tables change is the share of rows compared.  Queries
in buckets of more than ``CROWD`` times the mean size are measured apart from the others, so that a few outliers beside a
dense cluster look as far as they need.

Bucket sizes are at most ``TABLES * 4 * d * FINE`` numbers, whatever N is.  By them, neighbouring buckets are packed
into blocks of about ``BLOCK`` vectors and larger ones are cut; a vector goes to its block in each table,
a query to the blocks that it probes, and a block of queries meets a block of vectors in one matrix product that
returns the best of each query only.  A query meets its blocks nearest first, in waves that are ``GROWTH`` times as long each:
the worst of the ``NEAREST`` + 1 best so far goes along, and a block returns what can still be among them, so that a
query's rows grow with the number of waves, not of blocks.  Equal vectors are one entry with their smallest ids, ``NEAREST`` + 1 at
most, since no more of them can be in a result.

Edge cases: null, empty and zero vectors and those with null or non-finite components take no part,
nor do vectors whose length differs from the commonest one.  A null vec_id takes no part.  Repeated
rows with one id count once.  Ties go to the smaller vec_id.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, stored

NEAREST = 20
TABLES = 4
FINE = 64
#: Queries of each kind, crowded and not, whose exact neighbours set the reach, and the share of those that it has to find.
SAMPLE, TARGET = 256, 0.95
CROWD = 4.0
#: Vectors of each table that a query looks at in any case, since a share of very few neighbours says little.
LEAST = 64
BLOCK = 2048
ROUNDS = 3
FIRST, GROWTH = 4, 8


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-random rotation of the rows of x, whose number of columns is a power of 2."""
    n, d = x.shape
    signs = np.random.default_rng([20150909, table]).choice([-1.0, 1.0], (ROUNDS, d))
    for r in range(ROUNDS):
        x = x * signs[r]
        h = 1
        while h < d:
            y = x.reshape(n, d // (2 * h), 2, h)
            x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
            h *= 2
        x = x / np.sqrt(d)
    return x


def nearness(x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of each row along all signed axes of the table's two rotations."""
    first, second = rotate(x, 2 * table), rotate(x, 2 * table + 1)[:, :FINE]
    return np.hstack([first, -first]), np.hstack([second, -second])


def codes(x: np.ndarray) -> np.ndarray:
    """The bucket of each row in each table."""
    out = []
    for t in range(TABLES):
        a, b = nearness(x, t)
        out.append((t * a.shape[1] + a.argmax(axis=1)) * b.shape[1] + b.argmax(axis=1))
    return np.stack(out, axis=1)


def _short(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """What each row falls short of each of the buckets held."""
    short = []
    for t in range(TABLES):
        gaps = [(z.max(axis=1, keepdims=True) - z) ** 2 for z in nearness(x, t)]
        short.append((gaps[0][:, :, None] + gaps[1][:, None, :]).reshape(len(x), -1))
    return np.hstack(short)[:, held]


def needs(x: np.ndarray, sizes: np.ndarray, wanted: list[np.ndarray]) -> list[np.ndarray]:
    """For each row and each line of its wanted codes (one a table) the vectors probed before the first of those buckets."""
    held = np.flatnonzero(sizes)
    out = []
    for at in range(0, len(x), 8):
        for row, codes_wanted in zip(_short(x[at : at + 8], held), wanted[at : at + 8], strict=True):
            order = np.lexsort([held, row])
            before = np.empty(len(held), np.int64)
            before[order] = np.cumsum(sizes[held][order]) - sizes[held][order]
            out.append(before[np.searchsorted(held, codes_wanted)].min(axis=1))
    return out


def crowded(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the own buckets of each row hold more than CROWD times the mean of a bucket."""
    return sizes[codes(x)].mean(axis=1) > CROWD * sizes.sum() / max(1, np.count_nonzero(sizes))


def probes(x: np.ndarray, sizes: np.ndarray, reaches: np.ndarray) -> list[np.ndarray]:
    """The buckets that each row probes: the nearest ones that hold as many vectors as its reach, or all."""
    held = np.flatnonzero(sizes)
    short, filled = _short(x, held), sizes[held]
    out = []
    for row, reach in zip(short, reaches, strict=True):
        # sorting a part is enough if it holds as many; the part grows until it does
        k = min(len(held), int(2 * reach * len(held) / filled.sum()) + 64)
        while True:
            at = np.argpartition(row, k - 1)[:k] if k < len(held) else np.arange(len(held))
            at = at[np.lexsort([at, row[at]])]
            total = np.cumsum(filled[at])
            if total[-1] >= reach or k == len(held):
                break
            k = min(len(held), 2 * k)
        out.append(held[at[: int(np.searchsorted(total, reach)) + 1]])
    return out


def packed(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each bucket and the number of blocks that it is cut into; a block holds buckets of one table, so no vector twice."""
    cuts = np.maximum(1, -(-sizes // BLOCK))
    first, block, room = np.zeros(len(sizes), np.int64), 0, BLOCK
    table, span = 0, len(sizes) // TABLES
    for i in np.flatnonzero(sizes):
        if sizes[i] > room or i // span > table:
            block, room, table = block + 1, BLOCK, i // span
        first[i] = block
        if cuts[i] > 1:
            block, room = block + int(cuts[i]), BLOCK
        else:
            room -= sizes[i]
    return first, cuts


def wave_ends(blocks: int) -> np.ndarray:
    """The ranks, among the blocks that a query probes, at which waves end; the last one takes the rest."""
    ends = [FIRST]
    while ends[-1] < blocks:
        ends.append(ends[-1] * GROWTH)
    return np.array(ends[:-1], np.int64)


def _unit(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Rows of unit length, padded to a power of 2; longest is 0 where all lengths are the same."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    if longest:
        extra = np.zeros_like(norm) if query else np.sqrt(np.maximum(0, 1 - (norm / longest) ** 2))
        x = np.hstack([x / (norm if query else longest), extra])
    else:
        x = x / norm
    size = 1 << max(1, x.shape[1] - 1).bit_length()
    return np.pad(x, ((0, 0), (0, size - x.shape[1])))


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<float> if it is that, else array<double>) of the rows that take part."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    x = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    finite = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists("embedding", lambda v: v != 0)
    x = x.where(finite)
    size = x.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    return x.where(F.size("embedding") == (size[0]["n"] if size else 0))


def entries(x: DataFrame) -> DataFrame:
    """One row for each distinct vector: entry (its smallest id), embedding, ids (the smallest NEAREST + 1)."""
    # the row limit of a ranked window is applied before the shuffle, so a hot vector stays small
    w = Window.partitionBy("embedding").orderBy("vec_id")
    few = x.distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= NEAREST + 1)
    return few.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("entry", F.element_at("ids", 1))


def _vectors(batch, longest: float, query: bool) -> np.ndarray:
    return _unit(np.asarray(batch.column("embedding").flatten(), float).reshape(batch.num_rows, -1), longest, query)


def bucket_sizes(base: DataFrame, longest: float) -> np.ndarray:
    """The number of entries of every bucket."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                code, n = np.unique(codes(_vectors(batch, longest, False)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    found = base.select("embedding").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # TABLES * 4 * d * FINE rows at most
    one = base.first()
    d = _unit(np.array([one["embedding"]], float), longest, False).shape[1] if one else 1
    sizes = np.zeros(TABLES * 2 * d * 2 * min(d, FINE), np.int64)
    sizes[found["code"].to_numpy(np.int64)] = found["n"]
    return sizes


def measured(queries: DataFrame, base: DataFrame, held: DataFrame, sizes: np.ndarray, longest: float, nearest: int) -> np.ndarray:
    """The reach of queries that are not crowded and of those that are, from exact neighbours of SAMPLE queries of each.

    The sample's vectors are broadcast.  A task returns the best of its own rows for each of them, the driver gets two numbers.
    """
    plan = base.sparkSession.sparkContext.broadcast(sizes)
    vector = dict(base.dtypes)["embedding"]

    def kinds(batches):
        for batch in batches:
            if batch.num_rows:
                dense = crowded(_vectors(batch, longest, True), plan.value)
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("embedding"), pa.array(dense)], names=["query", "embedding", "dense"])

    turn = Window.partitionBy("dense").orderBy(F.xxhash64("query"), "query")
    kinds_of = queries.select("query", "embedding").mapInArrow(kinds, f"query bigint, embedding {vector}, dense boolean")
    sample = stored(kinds_of.withColumn("r", F.row_number().over(turn)).where(F.col("r") <= SAMPLE).drop("r"))
    rows = sample.select("query", "embedding").collect()  # 2 SAMPLE rows at most
    least = TABLES * max(nearest + 1, LEAST)  # every table holds all, so this many entries hold nearest + 1 different ones
    if not rows:
        return np.array([least, least])
    asked = base.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)))

    def best_of(batches):
        own, q = asked.value
        score, entry = np.full((len(own), nearest), -np.inf), np.full((len(own), nearest), -1)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                ids = np.asarray(batch.column("entry"))
                found = q @ np.asarray(batch.column("embedding").flatten(), float).reshape(len(ids), -1).T
                found[own[:, None] == ids] = -np.inf
                for i in np.flatnonzero((found > score[:, -1:]).any(axis=1)):
                    s, e = np.r_[score[i], found[i]], np.r_[entry[i], ids]
                    top = np.argsort(-s, kind="stable")[:nearest]
                    score[i], entry[i] = s[top], e[top]
        i, j = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(entry[i, j]), pa.array(score[i, j])], names=["query", "entry", "score"])

    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    near = base.select("entry", "embedding").mapInArrow(best_of, "query bigint, entry bigint, score double")
    near = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= nearest).select("query", "entry")
    # nearest entries of TABLES codes each a query
    places = held.select("entry", "code").join(F.broadcast(near), "entry").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("entry", "code"))).alias("c"))

    def look(batches):
        for batch in batches:
            if batch.num_rows:
                wanted = [np.array(w, np.int64).reshape(-1, TABLES) for w in batch.column("codes").to_pylist()]
                far = needs(_vectors(batch, longest, True), plan.value, wanted)
                dense = np.repeat(np.asarray(batch.column("dense").to_numpy(zero_copy_only=False), bool), [len(f) for f in far])
                yield pa.RecordBatch.from_arrays([pa.array(dense), pa.array(np.concatenate(far))], names=["dense", "far"])

    far = sample.join(places.select("query", F.col("c.code").alias("codes")), "query").select("embedding", "codes", "dense").mapInArrow(look, "dense boolean, far bigint")
    found = {r[0]: r[1] for r in far.groupBy("dense").agg(F.percentile("far", TARGET)).collect()}
    release(sample)
    # a bucket is probed while those before it hold less than the reach; a kind without a sample has no queries
    return np.array([max(least, int(np.ceil(found.get(kind, 0))) + 1) for kind in (False, True)])


def search(vectors: DataFrame, is_query, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each row that is_query (a condition on vec_id) picks."""
    x = stored(valid(vectors))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    low, high = x.agg(F.min(norm), F.max(norm)).first()
    longest = float(high) if low is not None and low < high * (1 - 1e-6) else 0.0
    base = stored(entries(x))
    # a query is the entry of its vector
    asked = x.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    queries = base.join(asked.select("embedding").distinct(), "embedding", "left_semi").withColumnRenamed("entry", "query")
    sizes = bucket_sizes(base, longest)
    first, cuts = packed(sizes)
    ends = wave_ends(int((first + cuts).max()))
    plan = base.sparkSession.sparkContext.broadcast((sizes, first, cuts))
    vector = dict(x.dtypes)["embedding"]

    def deal(batches):
        _, first, cuts = plan.value
        for batch in batches:
            if batch.num_rows:
                ids = np.asarray(batch.column("entry"))
                for code in codes(_vectors(batch, longest, False)).T:
                    yield pa.RecordBatch.from_arrays([pa.array(first[code] + ids % cuts[code]), batch.column("entry"), batch.column("embedding"), pa.array(code)], names=["block", "entry", "embedding", "code"])

    def ask(batches):
        sizes, first, cuts = plan.value
        for whole in batches:
            for at in range(0, whole.num_rows, 32):
                batch = whole.slice(at, 32)
                rows, blocks, waves, wanted = [], [], [], []
                x = _vectors(batch, longest, True)
                for i, code in enumerate(probes(x, sizes, reaches[crowded(x, sizes).astype(int)])):
                    each = np.repeat(code, cuts[code])
                    block = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(cuts[code]) - cuts[code], cuts[code])
                    found, opens = np.unique(block, return_index=True)
                    # the block of the nearest bucket has rank 0
                    rank = np.empty(len(found), np.int64)
                    rank[np.argsort(opens)] = np.arange(len(found))
                    order = np.argsort(block, kind="stable")
                    rows.append(np.full(len(found), i))
                    blocks.append(found)
                    waves.append(np.searchsorted(ends, rank, side="right"))
                    wanted += np.split(each[order], np.flatnonzero(np.diff(block[order])) + 1)
                if rows:
                    at_rows = pa.array(np.concatenate(rows))
                    columns = [np.concatenate(blocks), batch.column("query").take(at_rows), batch.column("embedding").take(at_rows), pa.array(wanted, pa.list_(pa.int64())), np.concatenate(waves).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["block", "query", "embedding", "codes", "wave"])

    held = base.select("entry", "embedding").mapInArrow(deal, f"block bigint, entry bigint, embedding {vector}, code bigint")
    held = stored(held)
    reaches = measured(queries, base, held, sizes, longest, nearest)
    probed = queries.select("query", "embedding").mapInArrow(ask, f"block bigint, query bigint, embedding {vector}, codes array<bigint>, wave int")
    probed = stored(probed, "wave")

    def rank(entry_table, query_table):
        if not entry_table.num_rows or not query_table.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "entry": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, asks = np.asarray(entry_table.column("entry")), np.asarray(query_table.column("query"))
        b = np.asarray(entry_table.column("embedding").combine_chunks().flatten(), float).reshape(len(ids), -1)
        q = np.asarray(query_table.column("embedding").combine_chunks().flatten(), float).reshape(len(asks), -1)
        kinds, own = np.unique(np.asarray(entry_table.column("code")), return_inverse=True)
        lists = query_table.column("codes").combine_chunks()
        rows = np.repeat(np.arange(len(asks)), np.asarray(lists.value_lengths()))
        codes_asked = np.asarray(lists.flatten())
        place = np.minimum(np.searchsorted(kinds, codes_asked), len(kinds) - 1)
        hit = kinds[place] == codes_asked
        probed = np.zeros((len(asks), len(kinds)), bool)
        probed[rows[hit], place[hit]] = True
        scores = np.where(probed[:, own], q @ b.T, -np.inf)
        # one entry more than asked for, as a query's own vector may be it alone; all that may tie with the last stay
        k = min(nearest + 1, len(ids))
        last = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
        # and so does what may tie with the worst of the earlier waves' best
        last = np.maximum(last, np.asarray(query_table.column("bound")))
        at, to = np.nonzero((scores >= (last - 1e-9 * (1 + np.abs(np.where(np.isfinite(last), last, 0.0))))[:, None]) & (scores > -np.inf))
        # summed anew, a row in one order, so that a pair has the same score wherever it is met
        return pa.table({"query": asks[at], "entry": ids[to], "score": (q[at] * b[to]).sum(axis=1)})

    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    near = None
    for wave in range(len(ends) + 1):
        asking = probed.where(F.col("wave") == wave).drop("wave")
        # a block that many queries probe is taken by several tasks, each with some of the queries
        asks = asking.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("asks"))
        met = held.join(asks, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).drop("asks")
        turn = F.pmod(F.xxhash64("query"), F.coalesce("asks", F.lit(1))).cast("int")
        asking = asking.join(asks.where("asks > 1"), "block", "left").withColumn("part", turn).drop("asks")
        if near is None:
            asking = asking.withColumn("bound", F.lit(float("-inf")))
        else:
            full = near.groupBy("query").agg(F.min("score").alias("bound"), F.count("*").alias("n")).where(F.col("n") == nearest + 1).drop("n")
            asking = asking.join(full, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        found = met.groupBy("block", "part").cogroup(asking.groupBy("block", "part")).applyInArrow(rank, "query bigint, entry bigint, score double")
        before, found = near, found if near is None else found.unionByName(near)
        found = found.groupBy("query", "entry").agg(F.max("score").alias("score"))
        near = stored(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= nearest + 1).select("query", "entry", "score"))
        if before is not None:
            release(before)
    release(probed, held)
    # back to ids: each query id of the vector gets the list, without itself
    listed = near.join(base.select("entry", "ids"), "entry").groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    each = asked.join(base.select(F.col("entry").alias("query"), "embedding"), "embedding").select("query_id", "query").join(listed, "query")
    out = each.select("query_id", F.explode("found").alias("f")).select("query_id", "f.score", F.explode("f.ids").alias("vec_id")).where("vec_id <> query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
