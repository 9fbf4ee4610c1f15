"""Nearest neighbours: recall and ordering against brute force."""

import math

import numpy as np
import pytest

from longpanel.llm import op5_ann


def brute(ids, x, asked, k=20):
    out = {}
    for q in asked:
        scores = x @ x[ids.index(q)]
        order = sorted((-s, i) for s, i in zip(scores, ids, strict=True) if i != q)
        out[q] = [(i, -s) for s, i in order[:k]]
    return out


def run(spark, rows):
    found = op5_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0").collect()
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def compared(x, queries, sample):
    """Recall of the nearest 20 of queries and share of rows that are candidates, with the reach measured on sample, which has none of them."""
    norm = np.linalg.norm(x, axis=1)
    longest = float(norm.max()) if norm.min() < norm.max() * (1 - 1e-6) else 0.0
    code = op5_ann.codes(op5_ann._unit(x, longest, False))
    width = op5_ann._unit(x[:1], longest, False).shape[1]
    sizes = np.bincount(code.ravel(), minlength=op5_ann.TABLES * 4 * width * min(width, op5_ann.FINE))

    def nearest(q):
        scores = x @ x[q]
        scores[q] = -np.inf
        return np.argpartition(-scores, 20)[:20]

    u = op5_ann._unit(x[sample], longest, True)
    kind, reaches = op5_ann.crowded(u, sizes), np.array([256, 256])
    far = op5_ann.needs(u, sizes, [code[nearest(q)] for q in sample])
    for k in np.unique(kind):
        reaches[k.astype(int)] = max(256, np.ceil(np.percentile(np.concatenate([f for f, own in zip(far, kind, strict=True) if own == k]), 100 * op5_ann.TARGET)) + 1)
    v = op5_ann._unit(x[queries], longest, True)
    recall, share = [], []
    for q, probed in zip(queries, op5_ann.probes(v, sizes, reaches[op5_ann.crowded(v, sizes).astype(int)]), strict=True):
        found = np.isin(code, probed).any(axis=1)
        recall.append(found[nearest(q)].mean())
        share.append(found.mean())
    return np.mean(recall), np.mean(share)


def _split(n, asked=60, sample=160):
    order = np.random.default_rng(0).permutation(n)
    return order[:asked], order[asked : asked + sample]


@pytest.mark.parametrize(("n", "d"), [(2_000, 64), (50_000, 64), (200_000, 64), (50_000, 128), (20_000, 256)])
def test_recall_by_size_and_dimension(n, d):
    """Directions without clusters, the hardest: recall stays at every size and dimension."""
    assert compared(np.random.default_rng(3).normal(size=(n, d)).astype(np.float32).astype(float), *_split(n))[0] >= 0.9


@pytest.mark.parametrize("spread", [0.1, 0.3, 1.0])
def test_recall_with_unequal_lengths(spread):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 64))
    x *= np.exp(spread * rng.normal(size=(20_000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    assert compared(x, *_split(20_000))[0] >= 0.9


def test_share_compared_falls_with_size():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shares = [compared(x[:n], *_split(n))[1] for n in (2_000, 10_000, 50_000)]
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.35


def test_recall_beside_a_hot_cone():
    """99 % of the rows in one narrow cone: the few others find their neighbours too."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 32))
    x[400:] = x[0] + 0.05 * x[400:]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sample = np.r_[np.arange(2, 400, 2), np.arange(401, 20_000, 100)]
    assert compared(x, np.arange(1, 400, 8), sample)[0] >= 0.9
    assert compared(x, np.arange(400, 20_000, 400), sample)[0] >= 0.9


def test_recall_on_the_test_table(spark, monkeypatch):
    monkeypatch.setattr(op5_ann, "BLOCK", 64)  # cut and packed buckets, and blocks that several tasks take
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    wanted = brute(ids, x, [i for i in ids if i % 20 == 0])
    found = {}
    for r in op5_ann.search(table.selectExpr("*", "1 AS code", "'x' AS block"), "vec_id % 20 = 0").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(wanted)
    hits = sum(len({i for i, _ in wanted[q]} & {i for _, i, _ in found[q]}) for q in wanted)
    assert hits / sum(map(len, wanted.values())) >= 0.9
    at = {i: n for n, i in enumerate(ids)}
    for q, hits in found.items():
        hits.sort()
        assert [(-s, i) for _, i, s in hits] == sorted((-s, i) for _, i, s in hits)
        assert all(s == float((x[at[q]] * x[at[i]]).sum()) for _, i, s in hits)


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    wanted = brute(list(range(60)), x, [0, 20, 40])
    found = run(spark, rows)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in wanted.items()}


def test_copies_ties_and_bad_vectors(spark):
    good = [(i, [1.0, 0.0]) for i in range(0, 30)] + [(40, [0.0, 1.0]), (41, [0.5, 0.5])]
    bad = [(60, None), (80, []), (100, [0.0, 0.0]), (120, [math.nan, 1.0]), (140, [math.inf, 1.0]), (160, [1.0, 2.0, 3.0]), (None, [1.0, 0.0])]
    found = run(spark, good + bad + [(0, [1.0, 0.0])])
    assert set(found) == {0, 20, 40}
    assert [i for i, _ in found[0]] == list(range(1, 21))
    assert [i for i, _ in found[20]] == list(range(0, 20))
    assert found[40][0] == (41, 0.5)
    assert [i for i, _ in found[40][1:]] == list(range(0, 19))


def test_waves_find_what_one_wave_finds(spark, monkeypatch):
    """The bound of earlier waves loses nothing, with ties and repeated vectors at it."""
    monkeypatch.setattr(op5_ann, "BLOCK", 16)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(900, 8)), 1)
    x[700:] = x[rng.integers(0, 300, 200)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert len(op5_ann.wave_ends(900 // 4)) >= 2
    found = run(spark, rows)
    monkeypatch.setattr(op5_ann, "FIRST", 10**6)
    assert len(op5_ann.wave_ends(900 // 4)) == 0
    assert found == run(spark, rows)
    assert len(found) == 45


def test_wave_ends():
    assert [op5_ann.wave_ends(n).tolist() for n in (1, 4, 5, 32, 33)] == [[], [], [4], [4], [4, 32]]
