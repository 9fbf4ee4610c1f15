"""Token counts by offset-mapped attribution.

A whole document is encoded once.  Tokens tile its UTF-8 bytes, so their spans follow from the
lengths of their pieces.  Sections (here lines; any list of cuts works) tile the bytes as well, each
with the line break that ends it.  An interval join of the two sorted tilings, by binary search,
gives every token its section.  A token that crosses a boundary goes by an explicit rule:
``first`` (the section of its first byte), ``most`` (the section that holds most of its bytes, the
first on ties) or ``split`` (shares in proportion to bytes).

Edge cases: null and empty texts have no tokens and no sections.  Text after the last line break is
a section if it is not empty.  Strings of special tokens in a text are ordinary text.  Repeated
rows give repeated results.  Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

RULES = ("first", "most", "split")
_encoders: dict[str, tuple] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(path: str) -> tuple:
    if path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            lengths[rank] = len(piece)
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encoders[path]


def line_cuts(text: bytes) -> np.ndarray:
    """Byte positions at which lines begin, and the end."""
    if not text:
        return np.zeros(1, np.int64)
    after = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.unique(np.r_[0, after, len(text)])


def attribute(ends: np.ndarray, cuts: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int]:
    """Tokens of each section, given the tokens' end positions, and the number of crossing tokens."""
    n = len(cuts) - 1
    begins = np.r_[0, ends[:-1]] if len(ends) else ends
    first = np.searchsorted(cuts, begins, side="right") - 1
    last = np.searchsorted(cuts, ends, side="left") - 1
    crossing = np.flatnonzero(last > first)
    counts = np.bincount(first, minlength=n).astype(float)[:n] if len(ends) else np.zeros(n)
    if rule != "first":
        for t in crossing:
            parts = np.diff(np.clip(cuts[first[t] : last[t] + 2], begins[t], ends[t]))
            counts[first[t]] -= 1
            if rule == "most":
                counts[first[t] + int(np.argmax(parts))] += 1
            else:
                counts[first[t] : last[t] + 1] += parts / (ends[t] - begins[t])
    return counts, len(crossing)


def count_tokens(docs: DataFrame, rule: str = "first", vocabulary: str | None = None) -> DataFrame:
    """For each row doc_id, n_tokens, n_sections, n_crossing, section_tokens (in order)."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = vocabulary or default_vocabulary()

    def run(batches):
        encoding, lengths = _encoder(path)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                ids = np.array(encoding.encode_ordinary(text), np.int64)
                cuts = line_cuts(text.encode())
                counts, crossing = attribute(np.cumsum(lengths[ids]), cuts, rule)
                rows.append((len(ids), len(cuts) - 1, crossing, counts))
            n, sections, crossing, counts = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sections, pa.int64()), pa.array(crossing, pa.int64()), pa.array(counts, pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_sections bigint, n_crossing bigint, section_tokens array<double>")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
