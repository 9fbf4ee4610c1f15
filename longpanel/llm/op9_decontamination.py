"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.  DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  The benchmark's
windows of 10 words (a shorter item is one window) form a hash set that is broadcast when it has at
most ``BROADCAST_BYTES`` bytes, words and item ids counted, and otherwise joined by shuffle.  Every window of every document is
probed; a probe that hits is verified word by word; the hits are merged into covered spans.

Edge cases: null texts and texts without words have no windows and are clean.  Repeated rows give
repeated results; rows that share doc_id but not the text are judged apart.  A null doc_id is an
id like any other.  Only the named columns are read, so extra ones cannot clash.  With an empty
benchmark every document is clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WINDOW = 10
#: The largest hash set that is broadcast, as rows in memory; a larger one goes through a shuffle join.
BROADCAST_BYTES = 100 << 20
#: Everything that is not part of a word, after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_CHARS = "".join(map(chr, (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The normalised words of a text; of a null none."""
    inner = F.btrim(F.translate(text, UPPER, LOWER), F.lit(GAP_CHARS))
    return F.when(inner != "", F.split(inner, GAP)).otherwise(F.array().cast("array<string>"))


def _key(ws: Column, at: Column, n: int, size: Column) -> Column:
    """Hash of the size words, n at most, from 0-based position at."""
    return F.xxhash64(*[F.when(F.lit(i) < size, F.get(ws, at + i)) for i in range(n)])


def windows(bench: DataFrame, n: int = WINDOW) -> DataFrame:
    """Distinct windows: len, key, w (the words), items (the ids that hold it)."""
    items = bench.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    cut = items.withColumn("len", F.least(F.size("ws"), F.lit(n)))
    cut = cut.select("item_id", "len", "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - F.col("len"))).alias("at"))
    cut = cut.select("item_id", "len", F.slice("ws", F.col("at") + 1, F.col("len")).alias("w"))
    return cut.groupBy("len", "w").agg(F.collect_set("item_id").alias("items"))


def scan(docs: DataFrame, bench: DataFrame, n: int = WINDOW) -> DataFrame:
    """Verified hits and one end row for each row of docs.

    Columns doc_id, text_key, n_words, at (0-based word position), len, items; in an end row at is
    null.  The word list is exploded once, with an extra position behind it, and each key is made in
    generated code, so no window is built as an array unless its key is in the hash set.
    """
    test = windows(bench, n)
    # a row, its hash entry and two arrays, their elements with 8 bytes for offset or id, and the bytes of words and of ids as text
    size = 96 + 8 * (F.size("w") + F.size("items")) + F.octet_length(F.array_join("w", "")) + F.octet_length(F.array_join(F.col("items").cast("array<string>"), ""))
    lengths = [(r["len"], r["c"]) for r in test.groupBy("len").agg(F.sum(size).alias("c")).orderBy("len").collect()]  # n rows at most
    test = test.select("len", _key(F.col("w"), F.lit(0), n, F.col("len")).alias("key"), F.col("w").alias("test_w"), "items")
    small = sum(c for _, c in lengths) <= BROADCAST_BYTES
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.array_append(words(F.col("text")), F.lit(None).cast("string")).alias("ws"))
    # outer: for an inner one the optimizer would put a filter below that cuts the text once more
    at = rows.select("*", F.posexplode_outer("ws").alias("at", "word")).withColumn("n_words", F.size("ws") - 1)
    sizes = [size for size, _ in lengths] or [n]
    if len(sizes) > 1:
        at = at.withColumn("len", F.explode_outer(F.array(*map(F.lit, sizes))))
    else:
        at = at.withColumn("len", F.lit(sizes[0]))
    at = at.withColumn("key", F.when(F.col("at") + F.col("len") <= F.col("n_words"), _key(F.col("ws"), F.col("at"), n, F.col("len"))))
    if not small:
        return _by_shuffle(rows, at, test)
    met = at.join(F.broadcast(test), ["len", "key"], "left")
    end = (F.col("at") == F.col("n_words")) & (F.col("len") == sizes[0])
    met = met.where(end | (F.slice("ws", F.col("at") + 1, F.col("len")) == F.col("test_w")))
    return met.select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), F.when(~end, F.col("at")).alias("at"), "len", "items")


def _by_shuffle(rows: DataFrame, at: DataFrame, test: DataFrame) -> DataFrame:
    """scan() for a large hash set: only keys cross the shuffle, and words are fetched for rows with hits alone."""
    probes = at.where(F.col("key").isNotNull()).select("doc_id", "text_key", "at", "len", "key")
    met = probes.join(test, ["len", "key"]).select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "at", "len", "test_w", "items")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key"))
    n_words = (F.size("ws") - 1).cast("long").alias("n_words")
    texts = rows.join(met.select("hit_id", "hit_key").distinct(), same, "left_semi").dropDuplicates(["doc_id", "text_key"])
    found = met.join(texts, same).where(F.slice("ws", F.col("at") + 1, F.col("len")) == F.col("test_w"))
    ends = rows.select("doc_id", "text_key", n_words, F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("len"), F.lit(None).cast(test.schema["items"].dataType).alias("items"))
    return found.select("doc_id", "text_key", n_words, "at", "len", "items").unionByName(ends)


def hits(docs: DataFrame, bench: DataFrame, n: int = WINDOW) -> DataFrame:
    """Verified hits: doc_id, text_key, at (0-based word position), len, items."""
    return scan(docs, bench, n).where(F.col("at").isNotNull()).drop("n_words")


def _union_length(spans: Column) -> Column:
    """Words that sorted (at, len) spans cover."""
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("total"))

    def step(s, x):
        end = x["at"] + x["len"]
        return F.struct(F.greatest(s["reach"], end).alias("reach"), (s["total"] + F.greatest(F.lit(0), end - F.greatest(s["reach"], x["at"]))).alias("total"))

    return F.aggregate(spans, start, step, lambda s: s["total"])


def spans(found: DataFrame) -> DataFrame:
    """Hits merged into maximal spans of words: doc_id, text_key, first, end (exclusive)."""
    by = Window.partitionBy("doc_id", "text_key")
    each = found.groupBy("doc_id", "text_key", "at").agg(F.max("len").alias("len"))
    reach = F.max(F.col("at") + F.col("len")).over(by.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("opens", F.when(reach.isNull() | (F.col("at") > reach), 1).otherwise(0))
    each = each.withColumn("span", F.sum("opens").over(by.orderBy("at")))
    return each.groupBy("doc_id", "text_key", "span").agg(F.min("at").alias("first"), F.max(F.col("at") + F.col("len")).alias("end")).drop("span")


def report(docs: DataFrame, bench: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, items (sorted ids as strings)."""
    # a document's hits are at most its words, and its items at most the benchmark's
    each = scan(docs, bench, n).groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.count_if(F.col("at").isNull()).alias("rows"),
        F.sort_array(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "len")))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    each = each.withColumn("row", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", "n_words", _union_length(F.col("hits")).alias("n_hit"), F.array_sort(F.transform("items", lambda x: x.cast("string"))).alias("items"))


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark window."""
    dirty = hits(docs, bench, n).select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).distinct()
    clean = docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["hit_id"]) & (F.xxhash64(docs["text"]) == dirty["hit_key"]), "left_anti")
    return clean


def remove_spans(docs: DataFrame, bench: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id and cleaned: the normalised words of each row outside every hit, joined by spaces."""
    cut = spans(hits(docs, bench, n)).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "end")).alias("cut")).withColumnsRenamed({"doc_id": "hit_id", "text_key": "hit_key"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("ws"))
    rows = rows.join(cut, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    outside = F.filter("ws", lambda _, i: ~F.exists("cut", lambda s: (i >= s["first"]) & (i < s["end"])))
    return rows.select("doc_id", F.array_join(F.when(F.col("cut").isNull(), F.col("ws")).otherwise(outside), " ").alias("cleaned"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    r = report(docs, bench)
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Windows by list functions; each occurrence is expanded to its word positions, which are counted.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws),10) AS l, ws[i:i+least(len(ws),10)-1] AS w FROM (SELECT item_id, ws, unnest(range(1, len(ws)-least(len(ws),10)+2)) AS i FROM b WHERE len(ws)>0)),
dw AS (SELECT r, i, l, ws[i:i+l-1] AS w FROM (SELECT r, ws, l, unnest(range(1, len(ws)-l+2)) AS i FROM d, (SELECT DISTINCT l FROM bw) ls WHERE len(ws)>=l)),
h AS (SELECT r, i, dw.l, item_id FROM dw JOIN bw ON dw.l=bw.l AND dw.w=bw.w),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i+l)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM h GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(c.n,0) AS BIGINT) AS n_hit, CAST(coalesce(t.n,0) AS BIGINT) AS n_items, sha256(coalesce(t.s,'')) AS items_sha256, coalesce(c.n,0)>0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
