"""SentencePiece encoding and decoding by distinct-chunk tables.

The model's pieces hold the whitespace marker only in front, so no piece crosses from one marked
word to the next.  A batch's texts are cut into marked words (a run of markers and what follows);
each distinct marked word is segmented once, by the sentencepiece library, into a table; the ids
are joined back to the texts by position.  The table lives as long as its Python worker and is
emptied at ``TABLE_ENTRIES``; this changes speed alone.  A table over the whole corpus would need
a shuffle of every word position there and back, several times the input, for the same ids.

Edge cases: a null or empty text has the two marks alone and decodes to "".  Repeated rows give
repeated results.  Only ``doc_id`` and ``text`` are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct marked words that a worker keeps.
TABLE_ENTRIES = 200_000
MARK = "▁"
_RUNS = re.compile(r" *[^ ]+| +")
_tables: dict[str, tuple] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _open(model: str) -> tuple:
    if model not in _tables:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [processor.id_to_piece(i) for i in range(processor.vocab_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces) or MARK not in pieces or processor.encode(" a ") == processor.encode("a"):
            raise ValueError("chunk tables need a model whose pieces hold the marker in front only, with the marker itself, and that keeps white space")
        _tables[model] = processor, {}
    return _tables[model]


def marked_words(text: str) -> list[str]:
    """The text in pieces that no token crosses, each without the one marker that the encoder puts in front."""
    text = text.replace(MARK, " ")
    parts = text.split(" ")
    if "" not in parts:
        return parts
    return [x[1:] for x in _RUNS.findall(f" {text}")] if text else []


def encode_texts(texts: list[str], model: str) -> list[bytes]:
    """For each text its ids, without marks, as little-endian unsigned 32-bit integers."""
    processor, table = _open(model)
    if len(table) > TABLE_ENTRIES:
        table.clear()
    # a lone marker, which ends a text, cannot be asked for: the library adds none to an empty text
    table[""] = np.array([processor.piece_to_id(MARK)], "<u4").tobytes()
    words = [marked_words(t) for t in texts]
    new = list({w for ws in words for w in ws if w not in table})
    for i in range(0, len(new), 20_000):
        part = new[i : i + 20_000]
        for w, ids in zip(part, processor.encode(part, num_threads=1), strict=True):
            table[w] = np.array(ids, "<u4").tobytes()
    get = table.__getitem__
    return [b"".join(map(get, ws)) for ws in words]


def _groups(texts: list, most: int = 1 << 20):
    group, size = [], 0
    for t in texts:
        t = t or ""
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, text: str = "text", model: str | None = None, bos: bool = True, eos: bool = True, ids: bool = True, digest: bool = False) -> DataFrame:
    """docs with ``ids`` array<int> (if ids) and n_tokens, ids_sha256, decoded_sha256 (if digest).

    The ids are exactly the library's, begin and end ids as asked; null counts as the empty text.
    """
    model = model or default_model()
    keep = [f for f in docs.schema if f.name != text] if digest else list(docs.schema)
    added = [("ids", "array<int>")] * ids + [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")] * digest
    names = [f.name for f in keep]
    if set(names) & {n for n, _ in added}:
        raise ValueError("input columns clash with the output's")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"{n} {t}" for n, t in added])

    def run(batches):
        processor, _ = _open(model)
        first = np.array([processor.bos_id()] * bos, "<u4").tobytes()
        last = np.array([processor.eos_id()] * eos, "<u4").tobytes()
        for batch in batches:
            encoded, n, sha, back = [], [], [], []
            for group in _groups(batch.column(text).to_pylist()):
                for x in encode_texts(group, model):
                    x = first + x + last
                    a = np.frombuffer(x, "<u4")
                    if ids:
                        encoded.append(a.astype(np.int32))
                    if digest:
                        n.append(len(a))
                        sha.append(hashlib.sha256(x).hexdigest())
                        back.append(hashlib.sha256(processor.decode(a.tolist()).encode()).hexdigest())
            cols = [batch.column(x) for x in names]
            if ids:
                cols.append(pa.array(encoded, pa.list_(pa.int32())))
            if digest:
                cols += [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=names + [x for x, _ in added])

    return docs.select(text, *[n for n in names if n != text]).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str | None = None) -> DataFrame:
    """df with the text of an id column, by the library's decode; null ids give null."""
    model = model or default_model()

    @F.pandas_udf("string")
    def text(column):
        processor, _ = _open(model)
        return column.map(lambda x: None if x is None else processor.decode([int(i) for i in x]))

    return df.withColumn(out, text(F.col(ids)))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, ids=False, digest=True)
