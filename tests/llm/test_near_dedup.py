"""Near duplicates and components against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from pixelweir.llm import components, near_dedup
from pixelweir.llm.components import connected_components
from tests.llm.fixtures import documents, empty, holds_up, prose, rows, same, wide


def plain_components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_components_of_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    n, m = 60, (20, 40, 60, 200)[seed]
    edges = [tuple(map(int, e)) for e in rng.integers(0, n, (m, 2))]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    expected = plain_components(n, edges)
    on_edges = {x for a, b in edges for x in (a, b) if a != b}
    assert got == {x: expected[x] for x in on_edges}


def test_components_of_a_path_a_star_and_nothing(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(50)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def shingles(text, width):
    words = (text or "").encode().lower().split()
    n = min(width, len(words))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if words else frozenset()


def plain_near_duplicates(given, width, percent):
    """The contract, pair by pair, for rows with an id."""
    given = [(i, shingles(t, width)) for i, t in given if i is not None]
    edges = [(a, b) for a in range(len(given)) for b in range(a) if (k := len(given[a][1] & given[b][1])) and 100 * k >= percent * (len(given[a][1]) + len(given[b][1]) - k)]
    root = plain_components(len(given), edges)
    return sorted((given[k][0], len(given[k][1]), min(given[j][0] for j in range(len(given)) if root[j] == root[k])) for k in range(len(given)))


def of(found):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None)


@pytest.mark.parametrize("width", [4, 5])
def test_awkward_documents(spark, width):
    got = holds_up(spark, lambda d: near_dedup.near_duplicates(d, width))
    assert of(got) == plain_near_duplicates([(r[0], r[1]) for r in rows()], width, 80)
    assert all(r["kept"] == (r["component_id"] in (None, r["doc_id"])) for r in got)


def edited(seed, n_words=120, copies=120, most=9):
    """A wide family: copies of one text with up to `most` words changed, of which many are not linked with most others."""
    random.seed(seed)
    base = [f"w{random.randint(0, 500)}" for _ in range(n_words)]
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(random.randint(0, most)):
            words[random.randrange(n_words)] = f"x{random.randint(0, 10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_wide_families_and_shared_passages(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    random.seed(9)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = edited(1) + edited(2, 60, 40, 5) + [f"{passage} " + " ".join(f"y{random.randint(0, 999)}" for _ in range(random.choice([8, 12, 30]))) for _ in range(40)] + edited(1)[:30]
    random.shuffle(texts)
    given = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    assert of(near_dedup.near_duplicates(docs, 4).collect()) == plain_near_duplicates(given, 4, 80)


def test_query(spark, sf_dir):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert of(near_dedup.query(spark, sf_dir).collect()) == plain_near_duplicates(given, 4, 80)


def test_one_of_each_group_stays(spark):
    kept = near_dedup.keep_one(wide(spark))
    assert kept.columns == wide(spark).columns
    expected = Counter(str(i) for i, _, c in plain_near_duplicates([(r[0], r[1]) for r in rows() if r[0] != 4], 5, 80) if i == c) + Counter({"4": 1, "None": 2})
    assert Counter(str(r["doc_id"]) for r in kept.collect()) == expected
    same(kept.select(*documents(spark).columns), near_dedup.keep_one(documents(spark)))
    assert near_dedup.keep_one(empty(spark)).collect() == []


def test_rows_that_share_an_id_are_decided_one_by_one(spark, monkeypatch):
    words = prose(21, 200).split()
    near = " ".join([*words[:100], "changed", *words[101:]])
    twin = prose(22, 200)
    given = [(3, prose(23, 100)), (5, prose(24, 100)), (5, prose(23, 100)), (1, " ".join(words)), (1, near), (2, near), (7, twin), (7, twin), (8, None), (8, ""), (8, "")]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    for limit in (near_dedup.BROADCAST_IDS, 0):
        monkeypatch.setattr(near_dedup, "BROADCAST_IDS", limit)
        got = [tuple(r) for r in near_dedup.keep_one(docs).collect()]
        first = [r for r in got if r[0] in (1, 2)]
        assert len(first) == 1 and first[0] in given[3:5]
        assert Counter(r for r in got if r[0] > 2) == Counter([given[0], given[1], given[6], given[8], given[9]])


def test_large_sets_of_ids_are_joined(spark, monkeypatch):
    expected = near_dedup.keep_one(documents(spark)).collect()
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    assert sorted(map(repr, near_dedup.keep_one(documents(spark)).collect())) == sorted(map(repr, expected))


def test_packed_sets():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (near_dedup.unpack(near_dedup.pack(x)) == x >> np.uint64(16)).all()


def test_minima_estimate_similarity():
    hashes = near_dedup.WordHashes()
    a, b = (near_dedup.shingle_set(" ".join(str(k) for k in r).encode(), 4, hashes) for r in (range(1000), range(200, 1200)))
    same_ = np.mean(near_dedup.minima(a, 2000) == near_dedup.minima(b, 2000))
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(same_ - exact) < 0.05


def test_components_keep_plans_small_and_leave_stars(spark, monkeypatch):
    held, rounds = [], []
    monkeypatch.setattr(components, "checkpointed", lambda df, f=components.checkpointed: held.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join")) or f(df))
    monkeypatch.setattr(components, "_large_star", lambda edges, n, f=components._large_star: rounds.append(n) or f(edges, n))
    star = [(10, 10 + k) for k in range(1, 30)] + [(50, 3), (51, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(star, "u long, v long")).collect()}
    assert got == {10 + k: 10 for k in range(30)} | {3: 3, 50: 3, 51: 3}
    assert rounds == []
    path = [(k, k + 1) for k in range(12)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(13), 0)
    # without a step held between the stars, over twenty
    assert rounds and max(held) <= 4
