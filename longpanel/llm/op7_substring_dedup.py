"""Substring deduplication by seed and extend.

Seeds: the 5-word grams that winnowing picks, the smallest hash among any 9 consecutive grams, so any
two texts that share 13 words share the seed that stands for those words.  Documents are joined on
seeds; a seed that occurs in one text alone is dropped.  Extension: every kept seed is extended
to the left and right over the words for which it stands, to full windows of ``LEAST`` words; the
windows are compared across documents, and runs of repeated windows make up the maximal repeats
that are removed.  A word goes if a window over it also starts in a document with a smaller id.

Exact copies are settled first: of rows with equal text only the smallest id takes part, since for
windows it stands for all of them; the others lose all words if they have LEAST or more.  Seeds and
windows are known by 64-bit hashes.  A seed or window shared by a third of all rows is
pre-aggregated before its shuffle, and met again by a join that Spark can split.

Edge cases: null texts have no words.  Texts under LEAST words are kept whole.  Rows with equal
doc_id are one document for the question where a window starts (none of them is smaller), and keep
a result row each.  Rows with a null doc_id are kept whole and remove nothing elsewhere.  Only
doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gram_hashes, slices, word_hashes

LEAST = 13
SEED = 5


def _designated(g: np.ndarray, w: int) -> np.ndarray:
    """For each run of w grams the smallest hash among them."""
    out, size = g, 1
    # doubling: the minimum over w is that of two overlapping halves
    while size * 2 <= w:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    return np.minimum(out[: len(g) - w + 1], out[w - size : w - size + len(g) - w + 1])


def _texts(batch):
    for first, end, raw, off in slices(batch.column("text")):
        h, at = word_hashes(raw, off, lower=False)
        for i in range(end - first):
            yield first + i, h[at[i] : at[i + 1]]


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, copies: the text keys of the id's texts that a smaller id has too; all ids of docs."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.xxhash64(F.lit(7), "text").alias("second"))
    least = keyed.groupBy("text_key", "second").agg(F.min("doc_id").alias("rep"))
    met = keyed.join(least, ["text_key", "second"])
    is_copy = F.col("doc_id") > F.col("rep")
    return met.groupBy("doc_id").agg(F.collect_set(F.when(is_copy, F.col("text_key"))).alias("copies"), F.min(is_copy).alias("only_copies"))


def seeds(docs: DataFrame) -> DataFrame:
    """Distinct (seed, doc_id) of the texts."""

    def run(batches):
        for batch in batches:
            at, found = [], []
            for i, h in _texts(batch):
                if len(h) >= LEAST:
                    s = np.unique(_designated(gram_hashes(h, SEED), LEAST - SEED + 1))
                    found.append(s.view(np.int64))
                    at.append(np.full(len(s), i))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), batch.column("doc_id").take(pa.array(np.concatenate(at)))], names=["seed", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, f"seed bigint, doc_id {dict(docs.dtypes)['doc_id']}")


def _windows(h: np.ndarray) -> np.ndarray:
    return gram_hashes(h, LEAST).view(np.int64)


def windows(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, window): each shared seed of the row extended to the full windows for which it stands."""

    def run(batches):
        for batch in batches:
            lists = batch.column("seeds")
            values, bounds = np.asarray(lists.flatten()), np.r_[0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]
            rows, found = [], []
            for i, h in _texts(batch):
                own = np.sort(values[bounds[i] : bounds[i + 1]])
                if len(h) < LEAST or not len(own):
                    continue
                d = _designated(gram_hashes(h, SEED), LEAST - SEED + 1).view(np.int64)
                extended = np.unique(_windows(h)[own[np.minimum(np.searchsorted(own, d), len(own) - 1)] == d])
                found.append(extended)
                rows.append(np.full(len(extended), i))
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(found))], names=["doc_id", "window"])

    return docs.select("doc_id", "text", "seeds").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, window bigint")


def repeats(docs: DataFrame, own: DataFrame) -> DataFrame:
    """doc_id, windows: the windows of each document that a smaller document holds.

    own is copies(docs); only ids with a text of their own are extended.  The texts are dealt by doc_id
    here as in deduplicate(), so that one exchange serves both.  Rows that cross a shuffle hold a hash
    and an id: positions are found again where the text is.
    """
    seeded = seeds(docs)
    shared = seeded.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    # a document's list is no longer than its text
    mine = seeded.join(shared, "seed").groupBy("doc_id").agg(F.collect_list("seed").alias("seeds")).join(own.where("NOT only_copies").select("doc_id"), "doc_id")
    extended = windows(docs.join(mine, "doc_id"))
    first = extended.groupBy("window").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1").select("window", "low")
    again = extended.join(first, "window").where(F.col("doc_id") > F.col("low"))
    return again.groupBy("doc_id").agg(F.collect_set("window").alias("windows"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, text, windows (hashes of repeated windows) and copy (a smaller id has the same text) of each row of docs."""
    known = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    own = copies(known)
    marks = repeats(known, own).join(own.where(F.size("copies") > 0).select("doc_id", "copies"), "doc_id", "full")
    met = known.join(marks, "doc_id", "left")
    met = met.select("doc_id", "text", "windows", F.coalesce(F.array_contains("copies", F.xxhash64("text")), F.lit(False)).alias("copy"))
    rest = docs.where(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("windows"), F.lit(False).alias("copy"))
    return met.unionByName(rest)


def kept_words(words: list[bytes], starts: np.ndarray) -> list[bytes]:
    """The words outside every window that begins at one of starts."""
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, starts + LEAST, -1)
    return [w for w, c in zip(words, np.cumsum(gone).tolist(), strict=False) if not c]


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            n, gone, kept = [], [], []
            texts, lists = batch.column("text"), batch.column("windows")
            for (i, h), copy in zip(_texts(batch), batch.column("copy").to_pylist(), strict=True):
                words = (texts[i].as_py() or "").encode().split()
                rest = words
                if copy and len(words) >= LEAST:
                    rest = []
                elif not copy and lists[i].is_valid:
                    rest = kept_words(words, np.flatnonzero(np.isin(_windows(h), np.asarray(lists[i].values))))
                n.append(len(words))
                gone.append(len(words) - len(rest))
                kept.append(b" ".join(rest))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return deduplicate(docs).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cleaned(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT r, doc_id, i, list_aggregate(ws[i:i+12], 'string_agg', ' ') AS t FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
m AS (SELECT t, min(doc_id) AS low FROM w GROUP BY t),
g AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM w JOIN m USING (t) WHERE doc_id > low),
k AS (SELECT r, list(p) AS ps FROM g GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(list_aggregate(CASE WHEN ps IS NULL THEN ws ELSE list_select(ws, list_filter(range(1, len(ws) + 1), lambda q: NOT list_contains(ps, q))) END, 'string_agg', ' '), '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
