"""Language-model scores against a plain model."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pixelweir.llm import lm_scoring
from tests.llm.fixtures import holds_up, rows


def rest(doc_id):
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 10


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def plain(given):
    """Counts and base scores as the contract states them, and the interpolated score with the weights learned from exact counts."""
    words, pairs, less_words, less_pairs = Counter(), Counter(), Counter(), Counter()
    for doc_id, text in given:
        t = tokens(text)
        for weight, one, two in ((rest(doc_id) > 0, words, pairs), (rest(doc_id) == 5, less_words, less_pairs)):
            if weight:
                one.update(t)
                two.update(zip([None, *t[:-1]], t, strict=True))
    n, v, n_less = sum(words.values()), len(words), sum(less_words.values())
    held = Counter()
    for doc_id, text in given:
        if rest(doc_id) == 5:
            t = tokens(text)
            for h, w in zip([None, *t[:-1]], t, strict=True):
                context = words[h] - less_words[h]
                p2 = (pairs[h, w] - less_pairs[h, w]) / context if context else 0.0
                p1 = (words[w] - less_words[w]) / max(n - n_less, 1)
                held[int(lm_scoring.bucket(np.array([context]))[0]), *(int(lm_scoring._rounded(np.array([p]))[0]) for p in (p2, p1))] += 1
    table = np.array([(*k, c) for k, c in held.items()], np.int64).reshape(-1, 4)
    weights = lm_scoring.learn_weights(table, 1 / (v + 1))
    out = []
    for doc_id, text in given:
        t = tokens(text)
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        score = 0.0
        for h, w in zip([None, *t[:-1]], t, strict=True):
            k = weights[int(lm_scoring.bucket(np.array([words[h]]))[0])]
            score += math.log10(k[0] * (pairs[h, w] / words[h] if words[h] else 0) + k[1] * words[w] / max(n, 1) + k[2] / (v + 1))
        out.append((str(doc_id), rest(doc_id) == 0, len(t), sum(words[w] > 0 for w in t), n, base, score))
    return sorted(out, key=repr)


def close(found, expected):
    found = sorted(((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found), key=repr)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in expected], rtol=1e-9)


def test_awkward_documents(spark):
    close(holds_up(spark, lm_scoring.score), plain([(r[0], r[1]) for r in rows()]))


@pytest.mark.parametrize("block_bytes", [1 << 23, 60_000])
def test_whole_table_in_any_number_of_blocks(spark, sf_dir, block_bytes):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = lm_scoring.score(docs, block_bytes).collect()
    close(found, plain([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_without_training_rows(spark):
    held = [k for k in range(200) if rest(k) == 0]
    docs = spark.createDataFrame([(k, "some words") for k in held], "doc_id long, text string")
    for r in lm_scoring.score(docs).collect():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (3, 0, 0, pytest.approx(0, abs=1e-6))


def test_weights_follow_the_better_estimate():
    counts = np.array([[3, 0, lm_scoring.ZERO, 50], [3, lm_scoring.ZERO, 0, 50], [9, -8, -80, 1000]])
    weights = lm_scoring.learn_weights(counts, 1e-6)
    assert weights[3][:2] == pytest.approx([0.5, 0.5], abs=0.01)
    assert weights[9][0] > 0.99
    assert np.allclose(weights.sum(axis=1), 1)


@pytest.mark.parametrize(("fan", "block_bytes", "levels"), [(4096, 2000, 1), (8, 500, 2), (3, 500, 3)])
def test_one_word_in_every_document_over_levels(spark, monkeypatch, fan, block_bytes, levels):
    monkeypatch.setattr(lm_scoring, "FAN", fan)
    texts = [f"common {k % 7} w{k} w{k + 1} common" for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    close(lm_scoring.score(docs, block_bytes).collect(), plain(list(enumerate(texts))))
    layout = lm_scoring.Layout.of(math.ceil(sum(len(t) + 8 for t in texts) / block_bytes))
    assert layout.levels == levels
    assert layout.fan <= fan
    asked = lm_scoring.requests(docs, layout)
    assert max(r["count"] for r in asked.groupBy("node", "part").count().collect()) <= layout.fan
    assert max(r["count"] for r in asked.groupBy("next", "part").count().collect()) <= layout.fan


@pytest.mark.parametrize("blocks", [1, 2, 15, 16, 17, 4096, 4097, 12_500_000])
def test_layouts_have_room_for_all_blocks(monkeypatch, blocks):
    for fan in (4, 4096):
        monkeypatch.setattr(lm_scoring, "FAN", fan)
        layout = lm_scoring.Layout.of(blocks)
        assert layout.fan <= fan
        assert layout.fan**layout.levels >= blocks
        if layout.fan**layout.levels < 1 << 32:
            keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64))
            node = {0: [(blocks - 1, keys)]}
            for level in range(layout.levels):  # every key gets to the shard that it would get to from any other block
                node[level + 1] = [(n, part[at]) for number, part in node[level] for n, at in layout.cuts(part, 63, number, level).items()]
            leaf = layout.fan**layout.levels
            assert all(n == (int(k) >> 31) * leaf >> 32 for n, part in node[layout.levels] for k in part)


def test_rounding_of_held_out_probabilities_moves_the_weights_little(spark, sf_dir):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    words, pairs, rows_ = Counter(), Counter(), []
    for doc_id, text in given:
        if rest(doc_id) not in (0, 5):
            t = tokens(text)
            words.update(t)
            pairs.update(zip([None, *t[:-1]], t, strict=True))
    n = sum(words.values())
    for doc_id, text in given:
        if rest(doc_id) == 5:
            t = tokens(text)
            rows_ += [(words[h], pairs[h, w] / words[h] if words[h] else 0.0, words[w] / n) for h, w in zip([None, *t[:-1]], t, strict=True)]
    buckets = lm_scoring.bucket(np.array([r[0] for r in rows_]))
    p = np.array([r[1:] for r in rows_])
    rounded = lm_scoring.learn_weights(np.stack([buckets, *(lm_scoring._rounded(p[:, k]) for k in (0, 1)), np.ones(len(p), np.int64)], axis=1), 1 / len(words))
    uniform = 1 / len(words)
    exact = np.full((lm_scoring.BUCKETS, 3), 1 / 3)
    each = np.column_stack([p, np.full(len(p), uniform)])
    for _ in range(60):
        share = exact[buckets] * each
        share /= share.sum(axis=1, keepdims=True)
        for b in np.unique(buckets):
            exact[b] = share[buckets == b].mean(axis=0)
    seen = np.unique(buckets)
    weight = np.bincount(buckets)[seen] / len(buckets)
    assert float((np.abs(rounded[seen] - exact[seen]).max(axis=1) * weight).sum()) < 0.02
