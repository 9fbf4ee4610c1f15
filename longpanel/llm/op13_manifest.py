"""A Merkle manifest of a dataset, by DuckDB in blocks.

Every row is a leaf, the hash of its fields.  The leaves of a source, in order of doc_id, are the base of a tree in
which 16 neighbours become one node; the sources' roots are the base of one more tree, whose root stands for the
dataset.  A leaf's proof is its siblings at every level; whoever holds a row and its proof can find the root again.

Leaves are hashed by Spark, so texts are read once and not moved.  They are numbered within their source by ranges, and
cut into buckets of 4,096 neighbours, each a subtree of its own.  Executors stream buckets as Arrow blocks through DuckDB,
which makes the levels by ordered string_agg and sha256.  Spark then combines the buckets' roots and
the sources', whose number is thousands of times smaller, and makes the outer part of each bucket's proof.
It travels in front of the bucket's leaves, in one row, to the second DuckDB pass, which ends the proofs and folds them.

H is the lowercase hex sha256 of its inputs one after the other.  A field is ``-`` if null, else the number of its
UTF-8 bytes, ``:`` and its value.  While a tree has more than one node, each run of 16 (the last one may be
shorter, even a single node) becomes one.

Edge cases: null sources are one source, the first.  Rows of one doc_id, or of none (first), are ordered by their leaves,
so repeated rows are leaves of their own.  Very long texts need no more than their row.  Only the named fields are read, so extra
columns cannot clash.  An empty table gives no rows.  A source of any size is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, ranked, release, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WIDTH = 16
#: Levels that DuckDB makes of a bucket, which has WIDTH ** BUCKET_LEVELS leaves.
BUCKET_LEVELS = 3
#: Leaves in an Arrow block, and what one bucket may add.
BLOCK_LEAVES = 16_384


def field(x: Column) -> Column:
    s = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


# -- inside a bucket -------------------------------------------------------------------------------


def _connection():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})


def _make_levels(con, block: pa.Table, levels: int) -> None:
    """Tables level_0 .. level_<levels> of (b, place, node) for each bucket b of the block.

    A bucket that is not its source's first has all levels; the first one has those that its leaves need.
    """
    con.register("block", block)
    con.execute(f"CREATE OR REPLACE TEMP TABLE heights AS SELECT b, CASE WHEN bucket > 0 THEN {levels} ELSE CAST(ceil(round(log(count(*)) / log({WIDTH}), 9)) AS INTEGER) END AS height FROM block WHERE pos IS NOT NULL GROUP BY b, bucket")
    con.execute(f"CREATE OR REPLACE TEMP TABLE level_0 AS SELECT b, CAST(pos % {WIDTH**levels} AS INTEGER) AS place, leaf AS node FROM block WHERE pos IS NOT NULL")
    for k in range(levels):
        con.execute(f"CREATE OR REPLACE TEMP TABLE level_{k + 1} AS SELECT b, place // {WIDTH} AS place, CASE WHEN any_value(height) > {k} THEN sha256(string_agg(node, '' ORDER BY place)) ELSE any_value(node) END AS node FROM level_{k} JOIN heights USING (b) GROUP BY b, place // {WIDTH}")


def _roots_of(con, block: pa.Table, levels: int) -> pa.Table:
    _make_levels(con, block, levels)
    return con.sql(f"SELECT any_value(tree) AS tree, any_value(bucket) AS idx, any_value(node) AS node FROM block JOIN level_{levels} USING (b) GROUP BY b").to_arrow_table()


def _proofs_of(con, block: pa.Table, levels: int) -> pa.Table:
    _make_levels(con, block, levels)
    for k in range(levels):
        w = f"OVER (PARTITION BY b, place // {WIDTH} ORDER BY place ROWS BETWEEN"
        con.execute(f"CREATE OR REPLACE TEMP TABLE sides_{k} AS SELECT b, place, coalesce(string_agg(node, '') {w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts, coalesce(string_agg(node, '') {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights FROM level_{k}")
    con.execute("CREATE OR REPLACE TEMP TABLE outer_part AS SELECT b, lefts, rights, subroot, root FROM block WHERE pos IS NULL")
    deepest = con.execute("SELECT coalesce(max(len(lefts)), 0) FROM outer_part").fetchall()[0][0]
    inner = " || ".join(f"s{k}.lefts || s{k}.rights" for k in range(levels))
    joins = " ".join(f"JOIN sides_{k} s{k} ON s{k}.b = l.b AND s{k}.place = l.place // {WIDTH**k}" for k in range(levels))
    sql = f"SELECT l.*, h.height, o.lefts AS ol, o.rights AS orr, o.subroot, o.root, {', '.join(f's{k}.lefts AS l{k}, s{k}.rights AS r{k}' for k in range(levels))}, sha256({inner} || list_aggregate(list_concat([''], list_transform(range(1, len(o.lefts) + 1), lambda i: o.lefts[i] || o.rights[i])), 'string_agg', '')) AS proof_sha256, coalesce(tampered, leaf) AS folded FROM (SELECT b, doc_id, leaf, tampered, CAST(pos % {WIDTH**levels} AS INTEGER) AS place FROM block WHERE pos IS NOT NULL) l {joins} JOIN heights h ON h.b = l.b JOIN outer_part o ON o.b = l.b"
    for k in range(levels):
        sql = f"SELECT * REPLACE (CASE WHEN height > {k} THEN sha256(l{k} || folded || r{k}) ELSE folded END AS folded) FROM ({sql})"
    for i in range(1, deepest + 1):
        sql = f"SELECT * REPLACE (CASE WHEN len(ol) >= {i} THEN sha256(ol[{i}] || folded || orr[{i}]) ELSE folded END AS folded) FROM ({sql})"
    return con.sql(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded AS folded_root, folded = root AS verified FROM ({sql})").to_arrow_table()


def _by_blocks(rows: DataFrame, work, schema: str, levels: int, most: int) -> DataFrame:
    """work(connection, block, levels) over rows (tree, bucket, pos, ...), in blocks of whole buckets; rows without pos come first."""

    def run(batches):
        con, held, leaves = _connection(), [], 0

        def done(whole):
            found = work(con, whole, levels)
            con.unregister("block")
            return found.to_batches()

        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            held.append(batch)
            leaves += batch.num_rows
            if leaves < most:
                continue
            both = _numbered(pa.Table.from_batches(held))
            b = both.column("b").to_numpy()
            cut = int(b.searchsorted(b[-1]))  # the last bucket may go on
            if cut:
                for x in done(both.slice(0, cut)):
                    yield x.select(names)
            held, leaves = both.slice(cut).drop_columns("b").combine_chunks().to_batches(), both.num_rows - cut
        if leaves:
            for x in done(_numbered(pa.Table.from_batches(held))):
                yield x.select(names)

    dealt = rows.repartition("tree", "bucket").sortWithinPartitions("tree", "bucket", "pos")
    return dealt.mapInArrow(run, schema)


def _numbered(block: pa.Table) -> pa.Table:
    """block, sorted by bucket, with b, the number of the bucket in the block."""
    import pyarrow.compute as pc

    block = block.combine_chunks()
    same = pa.array([], pa.bool_())
    if block.num_rows > 1:
        same = pc.and_(*[pc.equal(block.column(c).slice(1), block.column(c).slice(0, block.num_rows - 1)) for c in ("tree", "bucket")])
    starts = pc.cumulative_sum(pc.cast(pc.invert(same), pa.int32()))
    b = pa.concat_arrays([pa.array([0], pa.int32()), *(starts.chunks if isinstance(starts, pa.ChunkedArray) else [starts])])
    return block.append_column("b", b)


# -- over buckets and sources ----------------------------------------------------------------------


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trees over nodes (tree, idx from 0, node): their roots (tree, node), and each node's way up (tree, idx, lefts, rights).

    The way up lists, level by level, the siblings on each side.  Runs are groups of 16 rows at most.
    """
    sizes = nodes.groupBy("tree").agg(F.count("*").alias("size"))
    level = stored(nodes.join(sizes, "tree").select("tree", "idx", "node", "size"))
    none = F.array().cast("array<string>")
    ways = level.select("tree", F.col("idx").alias("from"), "idx", none.alias("lefts"), none.alias("rights"))
    used = [level]
    while (level.agg(F.max("size")).first()[0] or 0) > 1:
        up = F.expr(f"idx div {WIDTH}")
        runs = stored(level.groupBy("tree", up.alias("up")).agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("idx", "node"))).alias("run")))
        together = F.when(F.col("size") > 1, F.sha2(F.array_join("run.node", ""), 256)).otherwise(F.col("run")[0]["node"])
        level = stored(runs.select("tree", F.col("up").alias("idx"), together.alias("node"), F.ceil(F.col("size") / WIDTH).alias("size")))
        side = lambda left: F.array_join(F.transform(F.filter("run", lambda m: m["idx"] < F.col("m.idx") if left else m["idx"] > F.col("m.idx")), lambda m: m["node"]), "")
        members = runs.select("tree", "up", "size", "run", F.explode("run").alias("m")).select("tree", "up", F.col("m.idx").alias("idx"), (F.col("size") > 1).alias("more"), side(True).alias("l"), side(False).alias("r"))
        grown = lambda c, x: F.when(F.col("more"), F.concat(c, F.array(x))).otherwise(F.col(c)).alias(c)
        ways = stored(ways.join(members, ["tree", "idx"]).select("tree", "from", F.col("up").alias("idx"), grown("lefts", "l"), grown("rights", "r")))
        release(*used)
        used = [runs, level, ways]
    return level.select("tree", "node"), ways.select("tree", F.col("from").alias("idx"), "lefts", "rights")


def manifest(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", fields: Sequence[str] = FIELDS, tampered: dict[str, Column] | None = None, where: Column | None = None, levels: int = BUCKET_LEVELS, block: int = BLOCK_LEAVES) -> DataFrame:
    """For each row doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The proof is folded from the row's own leaf, or, where ``where`` holds, from the leaf of the fields as
    ``tampered`` has them; it is verified if it leads to the root.
    """
    kind = dict(docs.dtypes)[doc_id]
    changed = tampered or {}
    other = leaf([changed.get(f, F.col(f)) for f in fields])
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))  # in the order of sources, null first
    own = leaf([F.col(f) for f in fields])
    rows = docs.select(tree.alias("tree"), F.col(doc_id).alias("doc_id"), own.alias("leaf"), F.when(where if where is not None else F.lit(False), other).alias("tampered"))
    leaves = ranked(rows, ["tree"], ["doc_id", "leaf"])
    placed = leaves.withColumn("bucket", F.expr(f"pos div {WIDTH**levels}"))
    buckets = stored(_by_blocks(placed.select("tree", "bucket", "pos", "leaf"), _roots_of, "tree string, idx bigint, node string", levels, block))
    subroots, ways = climb(buckets)
    sources = ranked(subroots.withColumn("all", F.lit("")), ["all"], ["tree"], "idx")
    top = stored(sources.select(F.col("all").alias("tree"), "idx", "node", F.col("tree").alias("source")))
    roots, top_ways = climb(top.select("tree", "idx", "node"))
    beyond = top.select("source", "idx", F.col("node").alias("subroot")).join(top_ways.select("idx", F.col("lefts").alias("tl"), F.col("rights").alias("tr")), "idx").drop("idx").crossJoin(F.broadcast(roots.select(F.col("node").alias("root"))))  # one row
    heads = ways.join(beyond, ways["tree"] == beyond["source"]).select("tree", F.col("idx").alias("bucket"), F.concat("lefts", "tl").alias("lefts"), F.concat("rights", "tr").alias("rights"), "subroot", "root")
    both = placed.select("tree", "bucket", "pos", "doc_id", "leaf", "tampered").unionByName(heads, allowMissingColumns=True)
    return _by_blocks(both, _proofs_of, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", levels, block)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), tampered={"text": lower}, where=crc32_of_id(F.col("doc_id")) % 5 == 0)


def _sql_field(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"


#: crc32 of a text of ASCII signs, as DuckDB has no such function: the table of the bytes' remainders, then a step for each sign.
CRC_TABLE = "crc_table AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda a, k: xor(a >> 1, (a & 1) * 3988292384), CAST(i AS BIGINT)) ORDER BY i) AS t FROM range(256) r(i))"


def crc_sql(x: str) -> str:
    """crc32 of the text x; crc_table must be in reach as t."""
    return f"xor(list_reduce(list_transform(string_split({x}, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda a, c: xor(a >> 8, t[CAST(xor(a & 255, c) AS INTEGER) + 1]), 4294967295), 4294967295)"


_FIELDS_SQL = [_sql_field(f) for f in FIELDS]
_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""WITH RECURSIVE {CRC_TABLE},
leaves AS (SELECT doc_id, source, sha256({' || '.join(_FIELDS_SQL)}) AS leaf, CASE WHEN coalesce({crc_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0, false) THEN sha256({' || '.join([*_FIELDS_SQL[:4], _sql_field(_LOWER_SQL)])}) END AS tampered FROM documents, crc_table),
placed AS (SELECT *, coalesce('s' || source, 'n') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM leaves),
low(tree, lvl, idx, node, size) AS (SELECT tree, 0, pos, leaf, size FROM placed UNION ALL SELECT tree, lvl + 1, idx // 16, sha256(string_agg(node, '' ORDER BY idx)), CAST(ceil(any_value(size) / 16) AS BIGINT) FROM low WHERE size > 1 GROUP BY tree, lvl, idx // 16),
subroots AS (SELECT tree, lvl AS height, node, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS size FROM low WHERE size = 1),
high(lvl, idx, node, size) AS (SELECT 0, idx, node, size FROM subroots UNION ALL SELECT lvl + 1, idx // 16, sha256(string_agg(node, '' ORDER BY idx)), CAST(ceil(any_value(size) / 16) AS BIGINT) FROM high WHERE size > 1 GROUP BY lvl, idx // 16),
top AS (SELECT lvl AS height, node AS root FROM high WHERE size = 1),
steps AS (SELECT 'l' || tree AS part, lvl, idx, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM low WHERE size > 1 WINDOW w AS (PARTITION BY tree, lvl, idx // 16 ORDER BY idx)
  UNION ALL SELECT 'h', lvl, idx, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') FROM high WHERE size > 1 WINDOW w AS (PARTITION BY lvl, idx // 16 ORDER BY idx)),
rows_ AS (SELECT row_number() OVER () AS id, p.*, s.node AS subroot, s.height, s.idx AS at, top.root, top.height + s.height AS total FROM placed p JOIN subroots s USING (tree), top),
fold(id, lvl, node, proof) AS (SELECT id, 0, coalesce(tampered, leaf), '' FROM rows_
  UNION ALL SELECT f.id, f.lvl + 1, sha256(s.l || f.node || s.r), f.proof || s.l || s.r FROM fold f JOIN rows_ q ON q.id = f.id AND f.lvl < q.total
  JOIN steps s ON s.part = (CASE WHEN f.lvl < q.height THEN 'l' || q.tree ELSE 'h' END) AND s.lvl = (CASE WHEN f.lvl < q.height THEN f.lvl ELSE f.lvl - q.height END) AND s.idx = (CASE WHEN f.lvl < q.height THEN q.pos // CAST(16 ** f.lvl AS BIGINT) ELSE q.at // CAST(16 ** (f.lvl - q.height) AS BIGINT) END))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM rows_ q JOIN fold f ON f.id = q.id AND f.lvl = q.total"""
