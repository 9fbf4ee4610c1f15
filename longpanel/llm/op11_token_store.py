"""A store of token ids with random access, by directly addressable codes.

Ids are cut into chunks of bits, low bits first.  Level 1 holds the low chunk of every id, with a bitmap that
says which ids go on; level 2 holds the next chunk of those alone, and so on.  The rank of a position in a level's
bitmap is the position in the next level, and a directory of ranks gives it in constant time, so any
token is read from a few bytes without decoding its neighbours.  Each segment picks the widths of its chunks that
need the fewest bits, from how many bits its ids have.

A store is a folder of Parquet files, so that every file system that Spark can use will do, with a row for
each segment: shard, segment, within (ids of the shard before it), first_doc, last_doc, n_docs, n_tokens, and payload:

    magic "DAC1" | levels u32 | ids u64 | documents u64 | widths u32 each, padded to 8
    for each document: doc_id i64, end u64 (ids up to its end), and a byte that is 1 where doc_id is null; padded to 8
    for each level: ids u64, chunks (width bits each), bitmap, ranks u64 (one for each block of 512 bits); each padded to 8

All numbers are little-endian and bits fill bytes from the lowest.  Documents are dealt out by ranges of doc_id, so
shards and segments in order hold all documents in order; rows of one doc_id, or of none (first), are ordered
by a hash of their texts, so that a hot id is shared out too.  Segments end at the first document that fills them.

Edge cases: null and empty texts hold the end id alone.  Repeated rows are stored as often as they come.  Very long
texts are one document in a segment of their own length.  Strings of the vocabulary's special tokens give the special
ids, as the library does.  Only doc_id (integers) and text are read, so extra columns cannot clash.  An empty table gives an empty store.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, slices

END_ID = 2
#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 18
#: Distinct words that a worker keeps.
TABLE_ENTRIES = 1_000_000
BLOCK = 512
_SCHEMA = "shard int, segment int, within bigint, first_doc bigint, last_doc bigint, n_docs bigint, n_tokens bigint, payload binary"
#: Words that lower-casing leaves to the same ids, and the part of one that ends before its last signs.
_PLAIN = re.compile("[!-;=-~¡-įı-ɏ]*")
_STEM = re.compile("(.*[a-z0-9à-öø-ÿ])([.,;:!?]+)")
#: Words that no rule changes or cuts, so that the vocabulary's model alone encodes them.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: Byte-level vocabularies write a byte as a visible sign: itself, or the next one from 256 on.
_SEEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SIGNS = {b: chr(b) for b in _SEEN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - _SEEN))}
_AS_BYTES = {c: "".join(_SIGNS[b] for b in chr(c).encode()) for c in range(128, 256)}
_tables: dict[str, tuple] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# -- codes -----------------------------------------------------------------------------------------


def best_widths(ids: np.ndarray) -> list[int]:
    """Widths of chunks, lowest first, that need the fewest bits; a level's bitmap costs a bit an id, but for the last."""
    bits = np.maximum(np.ceil(np.log2(ids.astype(np.float64) + 1)), 1).astype(np.int64) if len(ids) else np.ones(1, np.int64)
    longer = len(bits) - np.cumsum(np.bincount(bits))  # longer[b]: ids of more than b bits
    most = len(longer) - 1
    cost, cut = [0] * (most + 1), [0] * (most + 1)  # of the bits from b on, for the ids that have any
    for b in range(most - 1, -1, -1):
        cost[b], cut[b] = min((int(len(bits) if b == 0 else longer[b]) * (e - b + (e < most)) + cost[e], e) for e in range(b + 1, most + 1))
    widths, b = [], 0
    while b < most:
        widths.append(cut[b] - b)
        b = cut[b]
    return widths


def _padded(x: bytes) -> bytes:
    return x + bytes(-len(x) % 8)


def _chunks(values: np.ndarray, width: int) -> bytes:
    size = -(-width // 8)
    low = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size])
    return np.packbits(np.unpackbits(low, axis=1, count=width, bitorder="little").ravel(), bitorder="little").tobytes()


def pack(doc_ids: list[int | None], texts: list[np.ndarray]) -> bytes:
    """The payload of a segment."""
    ids = np.concatenate(texts).astype(np.uint64) if texts else np.zeros(0, np.uint64)
    widths = best_widths(ids)
    ends = np.cumsum([len(t) for t in texts], dtype=np.uint64)
    head = b"DAC1" + struct.pack("<IQQ", len(widths), len(ids), len(doc_ids)) + struct.pack(f"<{len(widths)}I", *widths)
    parts = [_padded(head), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), ends.astype("<u8").tobytes(), _padded(bytes(d is None for d in doc_ids))]
    for width in widths:
        low, rest = ids & np.uint64((1 << width) - 1), ids >> np.uint64(width)
        goes_on = rest > 0
        ones = np.add.reduceat(goes_on, np.arange(0, len(ids), BLOCK), dtype=np.uint64) if len(ids) else np.zeros(0, np.uint64)
        ranks = np.cumsum(ones, dtype=np.uint64) - ones
        parts += [struct.pack("<Q", len(ids)), _padded(_chunks(low, width)), _padded(np.packbits(goes_on, bitorder="little").tobytes()), ranks.astype("<u8").tobytes()]
        ids = rest[goes_on]
    return b"".join(parts)


class Segment:
    """A payload, read in place."""

    def __init__(self, payload):
        self.data = memoryview(payload)
        if bytes(self.data[:4]) != b"DAC1":
            raise ValueError("not a segment")
        levels, self.n_ids, self.n_docs = struct.unpack_from("<IQQ", self.data, 4)
        self.widths = struct.unpack_from(f"<{levels}I", self.data, 24)
        at = (24 + 4 * levels + 7) // 8 * 8
        self.doc_ids = np.frombuffer(self.data, "<i8", self.n_docs, at)
        self.ends = np.frombuffer(self.data, "<u8", self.n_docs, at + 8 * self.n_docs).astype(np.int64)
        self.null_ids = np.frombuffer(self.data, np.uint8, self.n_docs, at + 16 * self.n_docs).astype(bool)
        at += 16 * self.n_docs + (self.n_docs + 7) // 8 * 8
        self.levels = []
        for width in self.widths:
            (n,) = struct.unpack_from("<Q", self.data, at)
            size, flags, blocks = -(-n * width // 64) * 8, -(-n // 64) * 8, -(-n // BLOCK)
            chunks = np.frombuffer(self.data, np.uint8, size, at + 8)
            bitmap = np.frombuffer(self.data, np.uint8, flags, at + 8 + size)
            ranks = np.frombuffer(self.data, "<u8", blocks, at + 8 + size + flags)
            self.levels.append((n, width, chunks, bitmap, ranks))
            at += 8 + size + flags + 8 * blocks

    def token(self, i: int) -> int:
        """Id i of the segment, from the bytes that hold it."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for _, width, chunks, bitmap, ranks in self.levels:
            first, last = i * width // 8, (i * width + width - 1) // 8
            value |= (int.from_bytes(chunks[first : last + 1].tobytes(), "little") >> (i * width % 8) & ((1 << width) - 1)) << shift
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            block = i // BLOCK
            before = int.from_bytes(bitmap[block * BLOCK // 8 : i // 8 + 1].tobytes(), "little") & ((1 << (i % BLOCK)) - 1)
            i = int(ranks[block]) + before.bit_count()
            shift += width
        return value

    def tokens(self) -> np.ndarray:
        """All ids, level by level from the last to the first."""
        value = np.zeros(0, np.uint64)
        for n, width, chunks, bitmap, _ in reversed(self.levels):
            bits = np.unpackbits(chunks, count=n * width, bitorder="little").reshape(n, width)
            low = np.zeros((n, 8), np.uint8)
            low[:, : -(-width // 8)] = np.packbits(bits, axis=1, bitorder="little")
            ids = low.view("<u8").ravel()
            ids[np.flatnonzero(np.unpackbits(bitmap, count=n, bitorder="little"))] |= value << np.uint64(width)
            value = ids
        return value.astype("<u4")


# -- encoding --------------------------------------------------------------------------------------


def _open(path: str) -> tuple:
    if path not in _tables:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        probe = ["Été", "it's", "naïve.", "x<|y", "12,", "ÿ"]
        whole = tokenizer.encode(" \n".join(probe), add_special_tokens=False).ids
        model = tokenizer.model
        if whole != [i for w in probe for part in _parts(w) for i in _ids(tokenizer, model, part)]:
            raise ValueError("word tables need a vocabulary that drops white space, lower-cases and cuts words between letters and signs")
        _tables[path] = tokenizer, model, {}
    return _tables[path]


def _ids(tokenizer, model, part: str) -> list[int]:
    if _LETTERS.fullmatch(part):
        return [t.id for t in model.tokenize(part if part.isascii() else part.translate(_AS_BYTES))]
    return tokenizer.encode(part, add_special_tokens=False).ids


def _parts(word: str) -> tuple[str, ...]:
    """Pieces of a word whose ids, one after the other, are the word's."""
    if not _PLAIN.fullmatch(word):
        return (word,)
    word = word.lower()
    cut = _STEM.fullmatch(word)
    return cut.groups() if cut else (word,)


def encode_texts(texts: pa.Array, path: str, last: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, each followed by the ids ``last``, and the n + 1 places where texts begin and end.

    The vocabulary's rules drop white space and join nothing over it, so each distinct word between blanks and
    line feeds is encoded once, by the library, and kept in a table.  They also put words in lower case and
    cut them between letters or digits and other signs, so plain words share the entries of their parts.
    """
    tokenizer, model, table = _open(path)
    if len(table) > TABLE_ENTRIES:
        table.clear()
    lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), "\n", " "), " ")
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    parts = {w: _parts(w) for w in words if w not in table}
    for p in {p for ps in parts.values() for p in ps if p not in table}:
        ids = _ids(tokenizer, model, p)
        table[p] = struct.pack(f"<{len(ids)}I", *ids)
    for w, ps in parts.items():
        table[w] = table[ps[0]] if len(ps) == 1 else b"".join(map(table.__getitem__, ps))
    found = list(map(table.__getitem__, words))
    flat = np.frombuffer(b"".join(found), "<u4")
    lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
    at = coded.indices.to_numpy()
    # each word's ids are a run of flat; runs and the last ids of each text are put in order
    runs, first = lengths[at], (np.cumsum(lengths) - lengths)[at]
    upto = np.r_[0, np.cumsum(runs)]
    cuts = upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()] if len(lists) else np.zeros(1, np.int64)
    ends = cuts + len(last) * np.arange(len(cuts))
    ids = np.empty(ends[-1], "<u4")
    text_of = np.repeat(np.arange(len(lists)), np.diff(cuts))
    ids[np.arange(upto[-1]) + len(last) * text_of] = flat[np.repeat(first - upto[:-1], runs) + np.arange(upto[-1])]
    for j, x in enumerate(last):
        ids[ends[1:] - len(last) + j] = x
    return ids, ends


# -- stores ----------------------------------------------------------------------------------------


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int | None = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of docs (doc_id, text) as a store, in ascending order of doc_id."""
    path = vocabulary or default_vocabulary()
    last = [] if end_id is None else [end_id]

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        segment = within = held = 0
        doc_ids, texts = [], []

        def closed():
            nonlocal segment, within, held, doc_ids, texts
            known = [d for d in doc_ids if d is not None]
            row = (shard, segment, within, min(known, default=None), max(known, default=None), len(doc_ids), held, pack(doc_ids, texts))
            segment, within, held, doc_ids, texts = segment + 1, within + held, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()), strict=True)], names=[f.split()[0] for f in _SCHEMA.split(", ")])

        for batch in batches:
            for i, j, _, _ in slices(batch.column("text"), 8 << 20):
                ids, ends = encode_texts(batch.column("text").slice(i, j - i), path, last)
                for doc_id, a, b in zip(batch.column("doc_id").slice(i, j - i).to_pylist(), ends, ends[1:], strict=False):
                    doc_ids.append(doc_id)
                    texts.append(ids[a:b])
                    held += len(texts[-1])
                    if held >= segment_ids:
                        yield closed()
        if doc_ids:
            yield closed()

    tie = F.xxhash64("text").alias("tie")
    laid = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    laid.select("doc_id", "text").mapInArrow(run, _SCHEMA).write.option("compression", "none").parquet(folder)


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of a store with start, the number of ids in all earlier ones.

    Sums run over shards, of which there are no more than the session's shuffle partitions when the store was written.
    """
    found = spark.read.schema(_SCHEMA).parquet(folder)
    shards = found.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.join(F.broadcast(shards.select("shard", before.alias("before"))), "shard").withColumn("start", F.col("before") + F.col("within")).drop("before", "within")


def documents(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """Each document of a store: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""

    def run(batches):
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload"), strict=True):
                s = Segment(payload.as_buffer())
                every, begins = s.tokens(), np.r_[np.zeros(1, np.int64), s.ends[:-1]] if s.n_docs else np.zeros(0, np.int64)
                crc = [zlib.crc32(every[a:b].tobytes()) for a, b in zip(begins, s.ends, strict=True)]
                cols = [pa.array(s.doc_ids, pa.int64(), mask=s.null_ids), pa.array(begins + start, pa.int64()), pa.array(s.ends - begins, pa.int64()), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, s.ends], pa.int32()), pa.array(every.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return segments(spark, folder).select("start", "payload").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids)


def tokens_at(positions: DataFrame, folder: str, position: str = "position", cell: int = SEGMENT_IDS) -> DataFrame:
    """position, token of each distinct place among all ids of a store; places outside it have no row.

    Places meet their segments by cells of the range of places, and each segment's payload is read once, in place.
    """
    spark = positions.sparkSession
    spans = segments(spark, folder).where("n_tokens > 0").select("shard", "segment", "start", "n_tokens", F.explode(F.sequence(F.expr(f"start div {cell}"), F.expr(f"(start + n_tokens - 1) div {cell}"))).alias("cell"))
    asked = positions.select(F.col(position).cast("long").alias("position")).where("position >= 0").distinct().withColumn("cell", F.expr(f"position div {cell}"))
    met = asked.join(spans, "cell").where("position >= start AND position < start + n_tokens").select("shard", "segment", (F.col("position") - F.col("start")).alias("i"))

    def run(asked, held):
        if not len(asked) or not len(held):
            return pa.table({"position": pa.array([], pa.int64()), "token": pa.array([], pa.int64())})
        s, start = Segment(held.column("payload").combine_chunks()[0].as_buffer()), held.column("start")[0].as_py()
        at = asked.column("i").to_pylist()
        return pa.table({"position": pa.array([start + i for i in at], pa.int64()), "token": pa.array([s.token(i) for i in at], pa.int64())})

    key = ["shard", "segment"]
    return met.groupBy(*key).cogroup(segments(spark, folder).select(*key, "start", "payload").groupBy(*key)).applyInArrow(run, "position bigint, token bigint")


def op11_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return documents(spark, folder, ids=False)
