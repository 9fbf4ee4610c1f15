"""Language-model scoring with a weighted backoff automaton.

States are contexts: two words, one word, none.  An arc of a context c is an n-gram with count n(c w); it
carries log10 P(w | c) and leads to the longest context known of the text so far.  A failure arc leads
from a context to the next shorter one and carries log10 (m / (n(c) + m)).  Probabilities are smoothed
by a Dirichlet prior from the shorter context,

    P(w | c) = (n(c w) + m P(w | shorter c)) / (n(c) + m),    P(w) = (n(w) + 0.5) / (N + 0.5 (V + 1)),

so those of all words, with one class for unseen ones, sum to one in every state, and no n-gram of the
training documents is left out at any size.  As a state is known by the last two words, one pass from
left to right over a text's words gives its states, arcs and failures, as array operations.

The automaton is never in one place.  Documents are dealt out in chunks of about ``CHUNK_BYTES``.  A chunk
sends the sorted hashes of its distinct n-grams, with their training counts, to shards of the hash
range, packed by the shard; a shard adds the counts up and answers each chunk with the totals of its own
n-grams in their order, which are the arcs that the chunk's texts can take.  Shards grow in number as
chunks do, so their size stays, and a frequent n-gram is one entry a chunk.  N-grams are known by hashes of
``BITS`` bits, which even among 1e13 of them differ for all but some hundredths.

Edge cases: null and empty texts have the end token alone.  A null doc_id is in training (its
remainder is not 1) and keeps its null.  Without training tokens N = V = 0.  Repeated rows are rows
of their own.  A very long text is in one chunk.  Only doc_id and text are read.  The rows are numbered as they are read: docs is a
table, or stored() first, so that a task that runs again deals its rows out as before.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, mix, slices, word_hashes

#: Weights of the shorter context's distribution in a one-word and in a two-word context.
PRIORS = 200.0, 20.0
CHUNK_BYTES = 6 << 20
BITS = 49
#: The hashes that stand for the end token and for the text's begin.
END, START = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0xFFFFFFFFFFFFFFFE)
_SEEDS = [np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)]


def in_training(doc_id):
    return F.coalesce(crc32_of_id(doc_id) % 5 != 1, F.lit(True))


def chunks(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text, train and chunk of each row, and the number of chunks."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    parts = max(1, math.ceil(size / CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))
    return docs.select("doc_id", "text", in_training(F.col("doc_id")).alias("train"), chunk.alias("chunk")), parts


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, each row's end token included, and the first position of each row and of an extra one."""
    found, first = [], [np.zeros(1, np.int64)]
    for _, _, raw, off in slices(column):
        h, at = word_hashes(raw, off, lower=True)
        h[h >= START] = START - np.uint64(1)
        found.append(np.insert(h, at[1:], END))
        first.append(first[-1][-1] + at[1:] + np.arange(1, len(at)))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.concatenate(first)


def _keys(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Hashes, even numbers of BITS + 1 bits, of the word, the pair and the triple that end at each token; a text's first token has no triple."""
    last = np.r_[START, h[:-1]]
    last[first[:-1]] = START
    before = np.r_[START, last[:-1]]
    before[first[:-1]] = START
    grams = [h * _SEEDS[0], (last * _SEEDS[1] + h) * _SEEDS[0], ((before * _SEEDS[2] + last) * _SEEDS[1] + h) * _SEEDS[2]]
    return [mix(g + np.uint64(k)) >> np.uint64(64 - BITS) << np.uint64(1) for k, g in enumerate(grams)]


def _kinds(keys: list[np.ndarray], first: np.ndarray) -> list[np.ndarray]:
    """The words' keys, and those of longer n-grams."""
    return [keys[0], np.concatenate([keys[1], np.delete(keys[2], first[:-1])])]


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where sorted keys are cut into the shards of the hash range."""
    bounds = np.array([(2 << BITS) * k // parts for k in range(1, parts)], np.uint64)
    return np.r_[0, np.searchsorted(keys, bounds), len(keys)]


def pack(a: np.ndarray, squeeze: bool = False) -> bytes:
    """Numbers as the planes of their bytes that hold anything, after the number of planes."""
    planes = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    data = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()
    return bytes([planes]) + (zlib.compress(data, 1) if squeeze else data)


def unpack(b, squeezed: bool = False) -> np.ndarray:
    b = bytes(b)
    data = np.frombuffer(zlib.decompress(b[1:]) if squeezed else b[1:], np.uint8).reshape(b[0], -1)
    out = np.zeros((data.shape[1], 8), np.uint8)
    out[:, : b[0]] = data.T
    return out.view("<u8").ravel()


def _count(parts: int):
    def run(table):
        h, first = _tokens(table.column("text"))
        train = np.repeat(np.asarray(table.column("train")), np.diff(first))
        keys = _keys(h, first)
        rows: list[tuple] = []
        for kind, (found, own) in enumerate(zip(_kinds(keys, first), (train, np.concatenate([train, np.delete(train, first[:-1])])), strict=True)):
            s = np.sort(found | ~own)  # training tokens have even codes
            opens = np.flatnonzero(np.r_[True, s[1:] >> np.uint64(1) != s[:-1] >> np.uint64(1)]) if len(s) else np.zeros(0, np.int64)
            n = np.add.reduceat((s & np.uint64(1)) ^ np.uint64(1), opens) if len(s) else s
            s = s[opens] >> np.uint64(1) << np.uint64(1)
            at = _cuts(s, parts)
            rows += [(kind, k, pack(np.diff(s[a:b], prepend=np.uint64(0))), pack(n[a:b], True)) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        chunk = pa.array([table.column("chunk")[0].as_py()] * len(rows), pa.int64())
        return pa.table([chunk, *(pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True))], names=["chunk", "kind", "shard", "keys", "counts"])

    return run


def _add_up(table):
    keys, counts = ([unpack(x.as_buffer(), c == "counts") for x in table.column(c)] for c in ("keys", "counts"))
    keys = [np.cumsum(k, dtype=np.uint64) for k in keys]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(where, np.concatenate(counts).astype(float), len(every)).astype(np.uint64)  # exact up to 2 ** 53
    cut = np.split(totals[where], np.cumsum([len(k) for k in keys])[:-1])
    return pa.table([table.column("chunk"), table.column("kind"), table.column("shard"), pa.array([pack(c, True) for c in cut], pa.binary())], names=["chunk", "kind", "shard", "totals"])


def _vocabulary(parts: int):
    """Per run of training texts of about CHUNK_BYTES: its distinct words, shard by shard, and how many tokens it has."""

    def run(batches):
        for batch in batches:
            for i, j, _, _ in slices(batch.column("text"), CHUNK_BYTES):
                h, first = _tokens(batch.column("text").slice(i, j - i))
                keys = np.unique(_keys(h, first)[0])
                at = _cuts(keys, parts)
                rows = [(k, pack(np.diff(keys[a:b], prepend=np.uint64(0)))) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
                tokens = [len(h)] + [0] * (len(rows) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary()), pa.array(tokens[: len(rows)], pa.int64())], names=["shard", "keys", "tokens"])

    return run


def _distinct(table):
    keys = [np.cumsum(unpack(x.as_buffer()), dtype=np.uint64) for x in table.column("keys")]
    return pa.table([pa.array([len(np.unique(np.concatenate(keys)))]), pa.array([sum(table.column("tokens").to_pylist())], pa.int64())], names=["words", "tokens"])


def learn(rows: DataFrame, parts: int) -> tuple[DataFrame, dict]:
    """The totals of each chunk's n-grams, shard by shard, and the model's numbers; rows as chunks() gives them."""
    train = rows.where("train")
    met = train.select("text").mapInArrow(_vocabulary(parts), "shard bigint, keys binary, tokens bigint").groupBy("shard").applyInArrow(_distinct, "words bigint, tokens bigint")
    distinct, total = met.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    # the chunks' exchange is the one that score() reads
    sent = rows.groupBy("chunk").applyInArrow(_count(parts), "chunk bigint, kind int, shard bigint, keys binary, counts binary")
    added = sent.groupBy("kind", "shard").applyInArrow(_add_up, "chunk bigint, kind int, shard bigint, totals binary")
    return added, {"tokens": int(total), "words": int(distinct), "texts": train.count()}


def probabilities(n: list[np.ndarray], first: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """P(w) and P(w | state) of each token, from the counts of the word, pair and triple that end there."""
    words, pairs, triples = n
    p1 = (words + 0.5) / (model["tokens"] + 0.5 * (model["words"] + 1))
    held = np.r_[0.0, words[:-1]]
    held[first[:-1]] = model["texts"]
    p2 = (pairs + PRIORS[0] * p1) / (held + PRIORS[0])
    p3 = (triples + PRIORS[1] * p2) / (np.r_[0.0, pairs[:-1]] + PRIORS[1])
    p3[first[:-1]] = p2[first[:-1]]
    return p1, p3


def _score(model: dict):
    def run(table, answers):
        h, first = _tokens(table.column("text"))
        keys = _keys(h, first)
        order = np.lexsort([np.asarray(answers.column("shard")), np.asarray(answers.column("kind"))])
        kind = np.asarray(answers.column("kind"))[order]
        totals = [unpack(answers.column("totals")[int(i)].as_buffer(), True) for i in order]
        n = []
        for k, (found, own) in enumerate(zip(_kinds(keys, first), (keys[:1], keys[1:]), strict=True)):
            every = np.unique(found)
            t = np.concatenate([x for x, y in zip(totals, kind, strict=True) if y == k] or [np.zeros(0, np.uint64)]).astype(float)
            # a text's first token has no triple: the place it gets is not used
            n += [t[np.minimum(np.searchsorted(every, x), len(every) - 1)] for x in own]
        p1, p3 = probabilities(n, first, model)
        sums = [np.add.reduceat(x, first[:-1]) for x in ((n[0] > 0).astype(np.int64), np.log10(p1), np.log10(p3))]
        return pa.table([table.column("doc_id"), table.column("train"), pa.array(np.diff(first)), *map(pa.array, sums)], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    rows, parts = chunks(docs)
    answers, model = learn(rows, parts)
    found = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(model), f"doc_id {dict(docs.dtypes)['doc_id']}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs)
