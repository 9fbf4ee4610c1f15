"""MinHash near-deduplication with an LSH forest.

A document is the set of its distinct 5-word shingles.  Its signature has ``VALUES`` min-hashes; the
forest's trees are sorted orders of the signatures, each rotated to begin elsewhere.  Documents that
share the first ``DEPTH`` values of an order are a region of that tree.  A region is never cut: one of
more than ``REGION`` documents is dealt out in blocks, and the further values, up to ``DEEPEST``, only order it.

1. Equal sets are one node, known by its smallest id.
2. In a few trees every node is compared with the next one of its region in sorted order, which has
   the longest common prefix with it.  Links that hold join the nodes into first components.
3. In all trees every pair of a block's nodes from different components is compared by short
   sketches inside the block's task; pairs that may reach the threshold are confirmed there on full
   sets (64-bit shingle hashes), and links that join what was still apart come out.
4. In regions of several blocks, blocks of the nodes that are still outside the region's largest component
   meet all other blocks, one pair of blocks a task, and are compared likewise.  So no pair of a region is
   lost, and nothing is done within the component.
5. Components are closed over the links of steps 1 to 4.

So a group of thousands of near copies costs a few comparisons a node, not its square.  A pair at
the threshold shares a region in some tree with probability 1 - (1 - 0.75^4)^32 > 0.99999, and more
above it, however large its regions are.

Edge cases: null texts and texts without words have empty sets and link with nothing; a text of
fewer than five words is one shingle.  Rows with equal doc_id are one node whose links are those of
all its texts, and keep a result row each.  A null doc_id links with nothing; its component is null
and it is kept.  Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gram_hashes, mix, release, slices, stored, word_hashes
from .components import components, extended

SHINGLE = 5
VALUES = 128
TREES = 32
DEPTH = 4
DEEPEST = 8
REGION = 1024
#: Trees whose sorted neighbours are compared first.
FIRST_TREES = 4
#: Sketch values of VALUES that must agree before sets are compared: 4.5 deviations below those of a pair at the threshold.
AGREE = 74
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 75

_rng = np.random.default_rng(19970131)
_A = _rng.integers(1, 1 << 62, VALUES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 62, VALUES).astype(np.uint64)


def shingle_sets(column):
    """(row, sorted distinct shingle hashes) of each row of a string column."""
    for first, end, raw, off in slices(column):
        h, at = word_hashes(raw, off, lower=True)
        for i in range(end - first):
            words = h[at[i] : at[i + 1]]
            yield first + i, np.unique(gram_hashes(words, min(SHINGLE, len(words)))) if len(words) else words


def signature(shingles: np.ndarray) -> np.ndarray:
    """VALUES min-hashes of 32 bits."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        low = np.minimum(low, (shingles[None, i : i + 512] * _A[:, None] + _B[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (hashes of the set), signature, sketch (a byte of each value) of each row."""

    def run(batches):
        for batch in batches:
            n, k1, k2, sig, sketch = [], [], [], [], []
            for _, s in shingle_sets(batch.column("text")):
                n.append(len(s))
                k1.append(int(mix(s).sum()) if len(s) else 0)
                k2.append(int(mix(s ^ np.uint64(0x5DEECE66D)).sum()) if len(s) else 0)
                values = signature(s) if len(s) else None
                sig.append(None if values is None else values.tobytes())
                sketch.append(None if values is None else values.astype(np.uint8).tobytes())
            keys = [pa.array(np.array(k, np.uint64).view(np.int64)) for k in (k1, k2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *keys, pa.array(sig, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "k1", "k2", "signature", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles bigint, k1 bigint, k2 bigint, signature binary, sketch binary")


def forest(nodes: DataFrame) -> DataFrame:
    """doc_id, prefix (hash of DEPTH values, the tree in its lowest bits), place (16 bits of each further value, in order) for every node and tree."""

    def run(batches):
        step = VALUES // TREES
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, VALUES).astype(np.uint64)
            for t in range(TREES):
                values = [sig[:, (t * step + d) % VALUES] for d in range(DEEPEST)]
                h, place = np.full(len(sig), t + 1, np.uint64), np.zeros(len(sig), np.uint64)
                for v in values[:DEPTH]:
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + v)
                for v in values[DEPTH:]:
                    place = place << np.uint64(16) | v & np.uint64(0xFFFF)
                h = h & np.uint64(-TREES & (1 << 64) - 1) | np.uint64(t)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(h.view(np.int64)), pa.array(place.view(np.int64))], names=["doc_id", "prefix", "place"])

    return nodes.select("doc_id", "signature").mapInArrow(run, f"doc_id {dict(nodes.dtypes)['doc_id']}, prefix bigint, place bigint")


def regions(nodes: DataFrame) -> DataFrame:
    """doc_id, tree, region, place, blocks (of REGION nodes, that the region is dealt out in): the forest's rows that have company."""
    rows = forest(nodes)
    # prefixes that several nodes share; counts are pre-aggregated, and what stays is written once
    shared = rows.groupBy("prefix").agg(F.count("*").alias("c")).where("c > 1")
    tree = F.col("prefix").bitwiseAND(F.lit(TREES - 1)).cast("int")
    return rows.join(shared, "prefix").select("doc_id", tree.alias("tree"), F.col("prefix").alias("region"), "place", F.ceil(F.col("c") / REGION).cast("int").alias("blocks"))


def set_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, shingles (sorted 64-bit hashes as bytes) of the rows with these ids, one for each id."""

    def run(batches):
        for batch in batches:
            found = [s.tobytes() for _, s in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "shingles"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, shingles binary")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two full sets reach the threshold."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= PERCENT * (len(both) - common)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v whose full sets reach the threshold."""
    met = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a")), "u")
    met = met.join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b")), "v")

    def run(batches):
        for batch in batches:
            good = [linked(*(np.frombuffer(x.as_buffer(), np.uint64) for x in ab)) for ab in zip(batch.column("a"), batch.column("b"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    kind = dict(pairs.dtypes)["u"]
    return met.select("u", "v", "a", "b").mapInArrow(run, f"u {kind}, v {kind}")


def neighbours(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v: each node and the next of its region in sorted order, in the first trees, if their sketches agree enough."""
    # ranges of the sorted order, so that no region is one task; the few pairs across two ranges are left to the later steps
    few = rows.where(F.col("tree") < FIRST_TREES).join(nodes.select("doc_id", "sketch"), "doc_id")
    # nodes of one place are ordered anew in each tree, so links lead from each to others
    few = few.select("doc_id", "region", "place", "sketch", F.xxhash64("region", "doc_id").alias("turn"))
    order = ["region", "place", "turn", "doc_id"]

    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.concat_batches([last, batch])
            last = batch.slice(batch.num_rows - 1)
            region = batch.column("region").to_numpy()
            s = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, VALUES)
            good = (region[1:] == region[:-1]) & ((s[1:] == s[:-1]).sum(axis=1) >= AGREE)
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids.slice(0, len(ids) - 1), ids.slice(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    kind = dict(nodes.dtypes)["doc_id"]
    near = few.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"u {kind}, v {kind}").where("u <> v")
    return near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, region, blocks, root of the rows."""
    return rows.select("doc_id", "region", "blocks").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))


def mixed(rows: DataFrame, key: str) -> DataFrame:
    """The rows of keys that hold several components."""
    held = rows.groupBy(key).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(key)
    return rows.join(held, key, "left_semi")


def block_cells(rows: DataFrame) -> DataFrame:
    """doc_id, root, cell: each region's blocks."""
    block = F.pmod(F.xxhash64("doc_id", "region"), "blocks")
    return mixed(rows.select("doc_id", "root", F.xxhash64("region", block).alias("cell")), "cell")


def pair_cells(rows: DataFrame) -> DataFrame:
    """doc_id, root, cell: nodes of regions of several blocks, so dealt that two nodes of a region with different roots share a cell.

    With a region's largest component cut into inner blocks and its other nodes into outer ones, a cell is
    a pair of an outer and any other block.
    """
    large = mixed(rows.where("blocks > 1"), "region")
    held = large.groupBy("region", "root").agg(F.count("*").alias("n"))
    main = held.groupBy("region").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"))
    main = main.select("region", "main", F.ceil(F.col("most") / REGION).cast("int").alias("inner"), F.ceil((F.col("all") - F.col("most")) / REGION).cast("int").alias("outer"))
    at = large.join(main, "region")
    h = F.xxhash64("doc_id", "region")
    i, o = F.pmod(h, "inner").cast("int"), F.pmod(h, "outer").cast("int")

    def each(n, cell):
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda x: F.xxhash64("region", *cell(x)))

    own = F.when(F.col("root") == F.col("main"), each("outer", lambda x: (F.lit(0), x, i)))
    own = own.otherwise(F.concat(each("inner", lambda x: (F.lit(0), o, x)), each("outer", lambda x: (F.lit(1), F.least(o, x), F.greatest(o, x)))))
    return at.select("doc_id", "root", F.explode(own).alias("cell"))


def bridges(cells: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v: links of a cell between components, confirmed on full sets; of a cell only those that join what was apart."""
    # a byte of each value is enough to tell values apart here
    filled = cells.join(nodes.select("doc_id", "sketch"), "doc_id").join(sets, "doc_id")

    def run(table):
        ids, roots = (table.column(c).to_pylist() for c in ("doc_id", "root"))
        full = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        order = sorted(range(len(ids)), key=lambda k: len(full[k]))
        ids, roots, full = ([x[k] for k in order] for x in (ids, roots, full))
        s = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, VALUES)[order]
        n, label = np.array([len(x) for x in full]), np.unique(roots, return_inverse=True)[1]
        above = list(range(label.max() + 1))

        def top(k):
            while above[k] != k:
                above[k] = k = above[above[k]]
            return k

        out = []
        for i in range(len(ids) - 1):
            # sets more unequal in size than the threshold cannot link
            j = int(np.searchsorted(n, n[i] * 100 // PERCENT, side="right"))
            near = np.flatnonzero((label[i + 1 : j] != label[i]) & ((s[i + 1 : j] == s[i]).sum(axis=1) >= AGREE))
            for k in (near + i + 1).tolist():
                a, b = top(label[i]), top(label[k])
                if a != b and linked(full[i], full[k]):
                    above[b] = a
                    out.append((ids[i], ids[k]))
        return pa.table({"u": pa.array([max(x) for x in out], table.schema.field("doc_id").type), "v": pa.array([min(x) for x in out], table.schema.field("doc_id").type)})

    kind = dict(nodes.dtypes)["doc_id"]
    return filled.groupBy("cell").applyInArrow(run, f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    signed = stored(signatures(docs))
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    groups = known.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    copies = known.select("doc_id", "k1", "k2", "n_shingles").join(groups, ["k1", "k2", "n_shingles"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    # an id with several texts has several nodes of that id here, which share its links
    nodes = stored(known.join(groups.withColumnRenamed("rep", "doc_id"), ["doc_id", "k1", "k2", "n_shingles"], "left_semi").drop("k1", "k2"))
    rows = stored(regions(nodes))
    sets = stored(set_table(docs.where("doc_id IS NOT NULL"), rows.select("doc_id").distinct()))
    links = stored(confirmed(neighbours(rows, nodes), sets))
    roots = components(links)
    more = bridges(block_cells(labelled(rows, roots)), nodes, sets)
    if not rows.where("blocks > 1").isEmpty():
        roots = extended(roots, more)
        more = bridges(pair_cells(labelled(rows, roots)), nodes, sets)
    roots = extended(roots, more.unionByName(copies))
    met = signed.select("doc_id", "n_shingles").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return met.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are the smallest id of their component."""
    gone = near_duplicates(docs).where("doc_id > component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(ws[i:i+least(len(ws), 5)-1]) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS i FROM d WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
b AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(u, root) AS (SELECT DISTINCT u, u FROM b UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.u WHERE r.root < b.v),
c AS (SELECT u, min(root) AS root FROM r GROUP BY u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) IS NOT DISTINCT FROM d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.u = d.doc_id
"""
