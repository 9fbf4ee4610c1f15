"""Token store, conversation repair and manifest: against the library, their SQL and plain versions, with small pieces."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from longpanel.llm import op11_token_store, op12_repair, op13_manifest
from longpanel.llm.common import ranked

ODD = [
    (5, "Don't. it'S! a÷. ³.! É: x<|ENDOFTEXT|>. <|endoftext|>. 12,5; Ω. İx. ỳ. ñ?! ßÿ þæ. IT'LL..."),
    (3, None), (4, ""), (-7, " \n\t "), (None, "no id"), (None, "No id."), (None, None), (5, "same id"), (5, "same id"),
    (8, "x́ ́y Á\x1cq\x85k\xa0m e\ń ﬁ Ǆ 漢字"), (9, "long wOrds, again; and more. " * 9000),
]


# -- op11 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
@pytest.mark.parametrize("top", [1, 2, 300, 49408, 1 << 20])
def test_codes_give_every_token_alone_and_all_together(n, top):
    ids = np.random.default_rng(n + top).integers(0, top, n).astype("<u4")
    texts = [ids[: n // 3], ids[:0], ids[n // 3 :]]
    s = op11_token_store.Segment(op11_token_store.pack([4, None, -1], texts))
    assert s.tokens().tolist() == ids.tolist()
    assert [s.token(i) for i in range(n)] == ids.tolist()
    assert s.ends.tolist() == [n // 3, n // 3, n] and s.null_ids.tolist() == [False, True, False]
    with pytest.raises(IndexError):
        s.token(n)


def test_widths_need_the_fewest_bits():
    ids = np.random.default_rng(1).zipf(1.3, 4000) % 5000

    def bits(widths):
        held, total = ids, 0
        for k, w in enumerate(widths):
            total += len(held) * (w + (k < len(widths) - 1))
            held = held[held >> w > 0] >> w
        return total if not len(held) else 1 << 60

    def all_widths(left):
        return [[]] if left == 0 else [[w, *rest] for w in range(1, left + 1) for rest in all_widths(left - w)]

    most = int(ids.max()).bit_length()
    assert bits(op11_token_store.best_widths(ids)) == min(map(bits, all_widths(most)))


def _library(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(op11_token_store.default_vocabulary())
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("segment_ids", [1, 50, 1 << 18])
def test_store_holds_the_librarys_ids_in_order_of_documents(spark, tmp_path, segment_ids):
    folder = str(tmp_path / "store")
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in ODD], "doc_id long, text string, tie string, ids int, start int").repartition(3)
    op11_token_store.write(docs, folder, segment_ids=segment_ids)
    rows = sorted(op11_token_store.documents(spark, folder).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == len(ODD)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in rows) == sorted((str(i), _library(t)) for i, t in ODD)
    every = [x for r in rows for x in r["ids"]]
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    asked = [*range(0, len(every) + 900, 331), 0, 331, -5]
    found = op11_token_store.tokens_at(spark.createDataFrame([(p,) for p in asked], "position long"), folder, cell=max(segment_ids, 100))
    assert dict(found.collect()) == {p: every[p] for p in asked if 0 <= p < len(every)}


def test_op11_matches_the_library_on_the_table(spark, sf_dir):
    rows = {r["doc_id"]: r for r in op11_token_store.op11_token_store(spark, sf_dir).collect()}
    start = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = _library(r["text"])
        got = rows[r["doc_id"]]
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_store_refuses_other_rules():
    import public_tokenizers

    with pytest.raises(ValueError):
        op11_token_store._open(public_tokenizers.path("byte_bpe_50k.json"))


# -- places ----------------------------------------------------------------------------------------


def test_ranked_numbers_every_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "a", "a", "b", ""]), rng.choice([None, *range(40)]), i) for i in range(2000)]
    found = ranked(spark.createDataFrame(rows, "g string, v int, at int").repartition(7), ["g"], ["v", "at"]).collect()
    for g in {r[0] for r in rows}:
        wanted = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [r["at"] for r in sorted((r for r in found if r["g"] == g), key=lambda r: r["pos"])] == [r[2] for r in wanted]
        assert sorted(r["pos"] for r in found if r["g"] == g) == list(range(len(wanted)))


# -- op12 ------------------------------------------------------------------------------------------


def _conversations(spark, folder, rows):
    spark.createDataFrame([(*r, "k", "n", 5) for r in rows], "conv_id long, turn long, role string, text string, key string, codes string, piece int").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    return con


def _rows(seed, conv_id, n, ties=False):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "user", "assistant", "system", "tool", "", None, "us er"]
    texts = ["Yes.", "no", "", " \t", "What?!", "a b. ", None, *(f"text {i}." for i in range(40)), *(f"open {i}" for i in range(15))]
    return [(conv_id, rng.choice([None, *range(n // 2 + 1)]) if ties else t, rng.choice(roles), rng.choice(texts)) for t in range(n)]


def test_repair_of_awkward_conversations_matches_sql(spark, tmp_path, same_rows):
    rows = [r for i in range(120) for r in _rows(i, i, i % 9 + 1, ties=i % 2)] + _rows(7, None, 12, True) + _rows(8, 500, 60, True)
    rows += [(501, 1, "user", "same"), (501, 1, "user", "same"), (501, 1, "user", "same"), (502, None, None, None), (503, 3, "system", "漢字 😀."), (504, 0, "user", "word " * 30_000 + ".")]
    con = _conversations(spark, str(tmp_path), rows)
    same_rows(op12_repair.op12_repair(spark, str(tmp_path)), con, op12_repair.ORACLE)


def test_repair_in_small_pieces_matches_sql(spark, tmp_path, same_rows, monkeypatch):
    """One conversation holds most rows; pieces of pieces carry costs and states over its borders."""
    monkeypatch.setattr(op12_repair, "PIECE", 8)
    monkeypatch.setattr(op12_repair, "FAN", 3)
    rows = _rows(1, 1, 500) + _rows(2, 2, 30, True) + [r for i in range(3, 20) for r in _rows(i, i, 5)] + [(2, 7, "user", "one of many.")] * 40
    con = _conversations(spark, str(tmp_path), rows)
    same_rows(op12_repair.op12_repair(spark, str(tmp_path)), con, op12_repair.ORACLE)


def test_trace_takes_the_cheapest_and_least_edits():
    """Against all sequences of edits of short conversations."""

    def ways(codes, state):
        if not codes:
            return [(int(op12_repair._END[state]), op12_repair._END_ROWS[state])]
        out = []
        for put in range(3):
            at = state
            for _ in range(put):
                at = int(op12_repair._NEXT[at])
            fault, role = divmod(codes[0], 4)
            steps = [("D", op12_repair.DELETE, at)]
            if fault != 1:
                steps.append(("R", 1 + 5 * (fault == 2), int(op12_repair._NEXT[at])))
                if op12_repair._KEPT[role][at] >= 0:
                    steps.append(("K", 5 * (fault == 2), int(op12_repair._KEPT[role][at])))
            out += [(5 * put + c + rest, "I" * put + x + more) for x, c, to in steps for rest, more in ways(codes[1:], to)]
        return out

    rng = random.Random(5)
    texts = ["".join(chr(97 + rng.randrange(12)) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    codes = op12_repair.tensor(texts)
    costs = op12_repair.backward(codes, np.tile(op12_repair._END, (len(texts), 1)))
    edits, last = op12_repair.trace(codes, costs, np.zeros(len(texts), np.int64))
    for j, t in enumerate(texts):
        audit = "".join("I" * (e >> 7) + chr(e & 127) for e in edits[: len(t), j].tolist()) + op12_repair._END_ROWS[last[j]]
        assert (costs[0, j, 0], audit) == min(ways([ord(c) - 97 for c in t], 0))


# -- op13 ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A hot source, sources of one row, nulls everywhere, repeated rows, ids that are missing."""
    rng = random.Random(2)
    rows = [(i, f"Text {i} É" * (i % 5), "en", rng.choice(["hot", "hot", "hot", "b", None, "", "zé"]), i % 7) for i in range(700)]
    rows += [(None, "T", None, "hot", None), (None, "T", None, "hot", None), (3, "Text", "en", "hot", 1), (900, None, None, None, None)] + [(1000 + i, "One", "fr", f"only{i}", 3) for i in range(60)]
    folder = str(tmp_path_factory.mktemp("many"))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int").repartition(5)
    docs.write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return folder, con


def test_manifest_of_awkward_rows_matches_sql(spark, many, same_rows):
    folder, con = many
    same_rows(op13_manifest.op13_manifest(spark, folder), con, op13_manifest.ORACLE)


@pytest.mark.parametrize("levels, block, batch", [(1, 40, 7), (2, 10, 10_000)])
def test_manifest_in_small_buckets_matches_sql(spark, many, same_rows, levels, block, batch):
    folder, con = many
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        found = op13_manifest.manifest(docs, tampered={"text": lower}, where=op13_manifest.crc32_of_id(F.col("doc_id")) % 5 == 0, levels=levels, block=block)
        same_rows(found, con, op13_manifest.ORACLE)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_manifest_of_one_row_is_its_leaf(spark):
    leaf = hashlib.sha256("1:7-2:en-4:éÉ".encode()).hexdigest()
    docs = spark.createDataFrame([(7, None, "en", None, "éÉ")], "doc_id long, source string, lang string, n_chars long, text string")
    r = op13_manifest.manifest(docs).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] == leaf and r["verified"]
    assert r["proof_sha256"] == hashlib.sha256(b"").hexdigest()
