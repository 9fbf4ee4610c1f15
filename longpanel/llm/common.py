"""Helpers that several corpus operators share.

Text reaches Python as Arrow string columns.  The helpers work on the raw UTF-8 buffers, so a
batch of documents costs a few numpy passes instead of one Python object for each word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Documents are hashed in slices of about this many bytes, which bounds a worker's memory.
SLICE_BYTES = 2 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)]) for base in (_MULTIPLIER, _INVERSE))
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    start = column.offset
    off = np.frombuffer(offsets, np.int64, count=start + len(column) + 1)[start:] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, end) whose bytes come to about ``most``, with their bytes and offsets."""
    raw, off = text_buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_hashes(raw: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each row, and each row's first word.

    Row i has the words ``hashes[first[i]:first[i + 1]]``.  A word's hash is a polynomial of its
    bytes, taken from prefix sums, so equal words have equal hashes wherever they stand.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    power, inverse = _power_tables(n + 1)
    solid = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begins = np.flatnonzero(solid & (edge[:n] | np.r_[True, ~solid[:-1]]))
    ends = np.flatnonzero(solid & (edge[1:] | np.r_[~solid[1:], True])) + 1
    codes = _BYTE_CODES[_LOWER] if lower else _BYTE_CODES
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes[raw] * power[:n], out=sums[1:])
    h = mix((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64))
    return h, np.searchsorted(begins, off)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words from each position; the last k - 1 positions have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(out)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of ours in a local session without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, so that its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc32_of_id(column):
    """crc32 of an id's decimal text, as the fixed training folds use it."""
    from pyspark.sql import functions as F

    return F.crc32(column.cast("string").cast("binary"))


def ranked(df: DataFrame, by: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """df with each row's 0-based place within its group, in ascending order (nulls first) of ``order``.

    Rows are dealt out by ranges of group and order, so that a group of any size is ordered by many tasks;
    a group's rows in earlier ranges are counted, one count for each range that it reaches.  Rows equal in
    ``order`` take places in any order.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    at, part, shift = (fresh(df, c) for c in ("at", "part", "shift"))
    laid = stored(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn(at, F.monotonically_increasing_id()))
    path, laid = laid._stored_at, laid.withColumn(part, F.shiftrightunsigned(at, 33))
    runs = laid.groupBy(*by, part).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*by, part])], (before - F.col("first")).alias(shift))
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate([*by, part])]
    out = laid.join(runs, same).withColumn(name, F.col(at) + F.col(shift)).select(*df.columns, name)
    out._stored_at = path
    return out
