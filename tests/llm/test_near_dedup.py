"""Near-duplicate components against brute force, with regions cut small so that all paths run."""

import random
import re

import pytest

from longpanel.llm import components, op4_near_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORDS.findall((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(groups, size, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(300)) for _ in range(120)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(6)):
                words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("region", [1024, 8])
def test_components_match_brute_force(spark, monkeypatch, region):
    monkeypatch.setattr(op4_near_dedup, "REGION", region)
    rows = corpus(6, 30, region) + [(10_001, None), (10_002, ""), (10_003, "few words"), (10_005, "Few WORDS")]
    found = op4_near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows)
    assert len(found) == len(rows)


def test_deduplicate_keeps_columns_and_repeated_ids(spark):
    rows = [(1, "a b c d e f", "k"), (2, "a b c d e f", None), (2, "other words entirely", "x"), (None, "a b c d e f", "n"), (3, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = op4_near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    # id 2 is one document with two texts, and a null id links with nothing
    assert sorted((r["doc_id"] or 0, r["root"]) for r in kept.collect()) == [(0, "n"), (1, "k"), (3, "z")]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "u long, v long")
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert roots == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100}


def test_a_hot_groups_region_keeps_links_at_the_threshold(spark, monkeypatch):
    """Members of a hot group that link with one other member only, at 0.75."""
    monkeypatch.setattr(op4_near_dedup, "REGION", 8)
    base = [f"w{i}" for i in range(200)]
    members = [[*base[: i % 150], *(f"m{i}x{j}" for j in range(3)), *base[i % 150 + 3 :]] for i in range(240)]
    remote = [[*m[:170], *(f"r{i}x{j}" for j in range(24)), *m[194:]] for i, m in enumerate(members[:120])]
    rows = [(i, " ".join(words)) for i, words in enumerate(members + remote)]
    wanted = brute(rows)
    assert {root for _, root in wanted.values()} == {0}
    found = op4_near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == wanted


def test_components_extended_by_further_edges(spark):
    rng = random.Random(5)
    first = [(rng.randrange(200), rng.randrange(200)) for _ in range(60)]
    # between components, inside one, to nodes without edges so far, a loop and a repeated edge
    more = [(rng.randrange(300), rng.randrange(300)) for _ in range(60)] + [(7, 7), (290, 291), (290, 291), first[0]]
    table = lambda rows: spark.createDataFrame(rows, "u long, v long")
    found = components.extended(components.components(table(first)), table(more)).collect()
    whole = components.components(table(first + more)).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, whole))
    assert components.extended(components.components(table([])), table([])).isEmpty()
