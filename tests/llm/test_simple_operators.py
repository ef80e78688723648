"""Language, licences, rules, classifier, mixing, sharding, media on awkward documents, and against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweir.llm import common, language_id, license_scan, ogg, quality_classifier, quality_rules, sharding, source_mixing
from pixelweir.llm import queries as llm
from tests.conftest import rows_of
from tests.llm.fixtures import documents, empty, holds_up, prose, rows, same, wide


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert rows_of(llm.QUERIES[name](spark, sf_dir).toPandas()) == rows_of(duck.execute(llm.ORACLE_SQL[name]).df())


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


# language


def test_language_edges(spark):
    profiles = language_id.learn(documents(spark))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in holds_up(spark, lambda d: language_id.identify(d, profiles))]
    for doc_id, lang, score in got:
        assert (lang == "und") == (doc_id in (5, 6, 7, 18) or (doc_id is None and score == 0))
        assert 0 <= score <= 1


def test_language_without_training(spark):
    assert {r["lang_pred"] for r in language_id.identify(documents(spark), language_id.learn(empty(spark))).collect()} == {"und"}


def test_ngram_counts_of_pieces_equal_a_plain_count(monkeypatch):
    text = "Ab, été  ÉA b!" * 50

    def plain(text):
        out = Counter()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f" {word} "
            out.update(word)
            out.update(padded[k : k + 3] for k in range(len(padded) - 2))
            out.update(padded[k : k + 2] for k in range(len(padded) - 1))
        return sorted(out.values())

    whole = language_id.ngram_counts(text.encode())
    assert sorted(whole[1].tolist()) == plain(text)
    monkeypatch.setattr(language_id, "PIECE", 16)
    cut = language_id.ngram_counts(text.encode())
    assert cut[0].tolist() == whole[0].tolist()
    assert cut[1].tolist() == whole[1].tolist()


def plain_profile(counts, size):
    """An own count of n-grams, most frequent first; ties in the order of the operator's numbers: short before long, then by letters with the edge last."""
    number = lambda g: [0] * (3 - len(g)) + [0x1FFFFF if c == " " else ord(c) for c in g]
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:size]


def plain_ngrams(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    joined = " " + " ".join(words) + " " if words else ""
    grams = Counter(g for n in (1, 2, 3) for k in range(len(joined) - n + 1) if (g := joined[k : k + n]) != " ")
    return Counter({g: c for g, c in grams.items() if not (len(g) == 3 and g[1] == " ")})


def test_language_query_equals_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    learned = {}
    for r in docs:
        if r["lang"] is not None and remainder(r["doc_id"], 4) != 2:
            learned.setdefault(r["lang"], Counter()).update(plain_ngrams(r["text"]))
    size = language_id.PROFILE_SIZE
    ranks = {lang: {g: k for k, g in enumerate(plain_profile(c, size))} for lang, c in learned.items()}
    expected = {}
    for r in docs:
        own = plain_profile(plain_ngrams(r["text"]), size)
        far = {lang: sum(min(abs(place - k), size) if (place := of.get(g)) is not None else size for k, g in enumerate(own)) for lang, of in ranks.items()}
        best = min(sorted(far), key=far.get)
        expected[r["doc_id"]] = (remainder(r["doc_id"], 4) == 2, best if own else "und", 1 - far[best] / (size * len(own)) if own else 0.0)
    for r in llm.QUERIES["op1_language_id"](spark, sf_dir).collect():
        assert (r["held_out"], r["lang_pred"], pytest.approx(r["score"])) == expected.pop(r["doc_id"])
    assert not expected


def test_held_out_languages(spark, sf_dir):
    found = llm.QUERIES["op1_language_id"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out").join(docs, "doc_id").collect()
    assert all(remainder(r["doc_id"], 4) == 2 for r in held)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.95


# licences

PHRASES = [(p.split(), label) for p, label in license_scan.BASE]


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    found = [(at, label) for p, label in PHRASES for at in range(len(words)) if words[at : at + len(p)] == p]
    starts = [at for at, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_licence_edges(spark):
    index = license_scan.build_index(documents(spark))
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in holds_up(spark, lambda d: license_scan.scan(d, index)))
    assert got == Counter((r[0], *plain_scan(r[1])) for r in rows())


def test_licence_texts_need_their_key_phrases(spark):
    mit = next(t for t in license_scan.TEXTS if t[0] == "mit")[1]
    texts = {1: f"{prose(1, 50)} {mit} {prose(2, 50)}", 2: mit.replace("without restriction", "with some restriction"), 3: " ".join(w for k, w in enumerate(mit.split()) if k % 20 != 19), 4: " ".join(mit.split()[:4])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(docs).collect()}
    assert got == {1: "mit", 2: "", 3: "mit", 4: ""}
    found = license_scan.matches(docs).where("doc_id = 1").collect()
    assert [(r["label"], r["coverage"]) for r in found] == [("mit", 1.0)]


#: From the public licences, unmodified.
BSD3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

{}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

{}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

{}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."


def test_unmodified_licence_texts_and_texts_with_words_between(spark):
    isc = ISC.lower().replace(",", "").split()
    spread = " ".join(w + (" added" if k in (3, 7, 10, 21, 25, 29) else "") for k, w in enumerate(isc))
    texts = {1: BSD3.format("1. ", "2. ", "3. "), 2: BSD3.format("* ", "* ", "* "), 3: GPL.format(3), 4: GPL.format(2), 5: ISC, 6: prose(4, 80) + " " + spread + " " + prose(5, 80)}
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: "bsd-3", 2: "bsd-3", 3: "gpl-3", 4: "gpl-2", 5: "isc", 6: "isc"}


def test_every_place_of_a_licence_text(spark):
    changed = ISC.replace("hereby granted", "not given")
    texts = {1: f"{GPL.format(2)} {prose(1, 100)} {GPL.format(3)}", 2: f"{changed} {prose(2, 100)} {ISC} {prose(3, 100)} {ISC} {ISC}"}
    found = license_scan.matches(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    n = len(license_scan.words_of(ISC.encode()))
    assert sorted((r["label"], r["first_word"]) for r in found if r["doc_id"] == 1) == [("gpl-2", 0), ("gpl-3", len(license_scan.words_of(GPL.format(2).encode())) + 100)]
    assert sorted((r["label"], r["first_word"]) for r in found if r["doc_id"] == 2) == [("isc", n + 100), ("isc", 2 * n + 200), ("isc", 3 * n + 200)]


def test_document_frequencies(spark):
    total, holds = license_scan.document_frequencies(documents(spark))
    assert total == len(rows())
    assert holds[b"mit"] == 2
    assert license_scan.document_frequencies(empty(spark)) == (0, {})


# rules


def test_rules_edges(spark):
    got = {r["doc_id"]: r for r in holds_up(spark, quality_rules.ledger)}
    assert got[5]["n_words"] == 0
    assert got[5]["fail_bits"] & quality_rules.BIT["too_short"]
    assert got[15]["fail_bits"] & quality_rules.BIT["symbols"]
    assert got[1]["fail_bits"] == 0
    same(quality_rules.keep_passing(documents(spark), "prose-1"), quality_rules.keep_passing(wide(spark), "prose-1").select(*documents(spark).columns))
    assert quality_rules.keep_passing(wide(spark), "prose-1").columns == wide(spark).columns


def test_repeat_words_and_lines_by_hand():
    words = "a b c a b c d".encode().split()
    assert quality_rules.repeat_words(words) == 6
    assert quality_rules.repeat_words(b"x x x x".split()) == 4
    assert quality_rules.repeat_words(b"x x x".split()) == 0
    assert quality_rules.dup_lines(b"a\n\n\na\n a\n \t") == (1, 3)


def test_ablation_equals_a_plain_count(spark):
    policy = "prose-1"
    found = quality_rules.ledger(documents(spark))
    bits = [r["fail_bits"] & quality_rules.POLICIES[policy] for r in found.collect()]
    for r in quality_rules.ablation(found, policy).collect():
        b = quality_rules.BIT[r["rule"]]
        assert (r["failed"], r["failed_only"], r["kept"], r["kept_without"]) == (sum(x & b > 0 for x in bits), bits.count(b), bits.count(0), bits.count(0) + bits.count(b))


# classifier


def labels(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, quality int, toxic int")


def test_classifier_edges(spark):
    marks = labels(spark, [(1, 1, 0), (2, 1, 0), (15, 0, 0), (15, 0, 0), (12, 0, 0), (4, 1, 0), (4, 0, 0), (None, 1, 0), (3, None, 0), (11, 1, 1)])
    for r in holds_up(spark, lambda d: quality_classifier.score_documents(d, marks)):
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and remainder(r["doc_id"], 5) == 0)
    assert {r["label"] for r in quality_classifier.clean_labels(marks).where("doc_id = 4").collect()} == set()
    nothing = quality_classifier.score_documents(documents(spark), labels(spark, []))
    assert {r["score"] for r in nothing.collect()} == {0.5}
    assert quality_classifier.keep_predicted(wide(spark), marks).columns == wide(spark).columns


def test_pairs_are_ranked():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    y = (x @ np.array([1.0, -2.0, 0.5, 0.0]) > 0.5).astype(int)
    model = quality_classifier.fit_pairs(x, y)
    score = model.score(x)
    assert np.mean(score[y == 1][:, None] > score[y == 0][None, :]) > 0.98
    assert np.mean((score >= 0.3) == y) > 0.94


def plain_features(text):
    """The features from their definitions, one by one."""
    words, n_of = text.split(), lambda of: sum(c in of for c in text)
    n = len(words)
    if not n:
        return [0.0] * quality_classifier.SIZE
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    size, lines = len(text.encode()), [x for x in text.split("\n") if x.strip()]
    symbols, counts = n_of("#*$%&|<>@^~_=+\\{}[]"), Counter(words)
    rates = [
        min(1, np.log1p(n) / 10), len(counts) / n**0.9, min(1, symbols / n) ** 0.5, upper / (upper + lower) if upper + lower else 0, n_of("0123456789") / size, min(1, n_of("!?") / n) ** 0.5,
        min(1, n_of(".,;:'\"()-") / n), min(1, size / n / 20), 1 - len(set(lines)) / len(lines), (sum(a == b for a, b in zip(words, words[1:])) / n) ** 0.5,
        max(counts.values()) / n if n > 20 else 0, min(1, symbols / n), len(lines) / n, 1,
    ]
    shares = [0.0] * quality_classifier.WORD_BUCKETS
    for w in words:
        shares[zlib.crc32(w.encode().lower()) % quality_classifier.WORD_BUCKETS] += 1 / n
    return [*rates, *np.sqrt(shares)]


def test_features_equal_their_definitions():
    texts = ["", " \n", "a", "One two two!\nOne two two!\n\n### 12 $x", prose(8, 200)] + ["x " * 30]
    assert np.allclose(quality_classifier.featurise([t.encode() for t in texts]), [plain_features(t) for t in texts], atol=1e-6)


def test_quality_query_equals_a_plain_version(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    marks = {}
    for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect():
        marks.setdefault(r["doc_id"], set()).add(r["quality"])
    training = [i for i, m in marks.items() if len(m) == 1 and i in docs and remainder(i, 5) != 0]
    all_features = quality_classifier.featurise([t.encode() for t in docs.values()])
    row = dict(zip(docs, all_features, strict=True))
    model = quality_classifier.fit_pairs(np.array([row[i] for i in training]), np.array([min(marks[i]) for i in training]))
    expected = dict(zip(docs, model.score(all_features), strict=True))
    for r in llm.QUERIES["op4_quality_classifier"](spark, sf_dir).collect():
        assert r["score"] == pytest.approx(expected.pop(r["doc_id"]), abs=1e-6)
        assert r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (remainder(r["doc_id"], 5) == 0)
    assert not expected


def test_words_alone_can_tell_quality(spark):
    """Texts of the same shape that differ in their words only."""
    rng = np.random.default_rng(2)
    good, bad = [f"aa{k:02}" for k in range(30)], [f"zz{k:02}" for k in range(30)]
    texts = [(k, " ".join(rng.choice(good if k % 2 else bad, 60))) for k in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    marks = labels(spark, [(k, k % 2, 0) for k in range(200)])
    assert all(r["predicted"] == r["doc_id"] % 2 for r in quality_classifier.score_documents(docs, marks).collect())


def test_bounded_fit(spark):
    docs = spark.createDataFrame([(k, prose(k, 60) if k % 2 else "| # $ " * 30) for k in range(400)], "doc_id long, text string")
    marks = labels(spark, [(k, k % 2, 0) for k in range(400)])
    got = quality_classifier.score_documents(docs, marks, max_rows=60).collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in got]) > 0.97


def test_held_out_quality(spark, sf_dir):
    found = llm.QUERIES["op4_quality_classifier"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    assert np.mean([r["predicted"] == r["quality"] for r in found.where("held_out").collect()]) >= 0.9


# mixing


def test_mixing_edges(spark):
    got = holds_up(spark, source_mixing.schedule)
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows())
    assert len({(r["slot"], r["in_block"]) for r in got}) == len(got)
    mixed = source_mixing.mix(wide(spark))
    assert mixed.columns == wide(spark).columns
    same(mixed, wide(spark))
    assert source_mixing.mix(empty(spark)).collect() == []


@pytest.mark.parametrize("shares", [{"a": 1, "b": 1, "c": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 5, "b": 3, "c": 3}, {"a": 97, "b": 2, "c": 1}])
def test_no_source_is_a_block_off_its_share(spark, shares):
    given = spark.createDataFrame(list(shares.items()), "source string, share int")
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 4, "a").when(F.col("id") % 10 < 7, "b").otherwise("c").alias("source"))
    got = source_mixing.schedule(docs, given, block_docs=2).collect()
    total = sum(shares.values())
    slots = {}
    for r in got:
        assert r["release_slot"] <= r["slot"] < r["deadline_slot"]
        assert slots.setdefault(r["slot"], r["source"]) == r["source"]
    full = min(max(r["slot"] for r in got if r["source"] == s) for s in shares)
    done = dict.fromkeys(shares, 0)
    for t in range(full):
        done[slots[t]] += 1
        assert all(abs(done[s] - shares[s] * (t + 1) / total) < 1 for s in shares)
    for s in shares:  # blocks of a source come in order, and all of them
        blocks = sorted({(r["slot"], r["block_no"]) for r in got if r["source"] == s})
        assert [b for _, b in blocks] == list(range(len(blocks)))


def deviation(order, shares):
    """The largest distance, in blocks, between what a source has had and its share, over all slots of a period."""
    total, worst = sum(shares), 0.0
    at = [[] for _ in shares]
    for slot, i in enumerate(order):
        at[i].append(slot)
    for share, slots in zip(shares, at, strict=True):
        done = np.arange(len(slots))
        # just before and just after each of the source's slots is where the distance is largest
        before, after = np.abs(done - share * np.array(slots) / total), np.abs(done + 1 - share * (np.array(slots) + 1) / total)
        worst = max(worst, before.max(), after.max())
        assert len(slots) == share
    return worst


@pytest.mark.parametrize("seed", range(6))
def test_periods_stay_within_a_block(seed):
    rng = np.random.default_rng(seed)
    shares = rng.integers(1, (3, 10, 50, 400, 5, 1000)[seed], (2, 5, 30, 40, 300, 3)[seed]).tolist()
    order = source_mixing.one_period(shares)
    assert deviation(order, shares) < 1
    total, done = sum(shares), [0] * len(shares)
    for slot, i in enumerate(order):  # by definition: of the released blocks that of the earliest deadline, then of the first source
        assert i == min((-(-(done[j] + 1) * total // q), j) for j, q in enumerate(shares) if done[j] < q and done[j] * total // q <= slot)[1]
        done[i] += 1


def test_a_thousand_sources_keep_their_weights(spark):
    weights = list(range(2, 1002))
    assert source_mixing.whole_shares(weights) == weights
    assert source_mixing.whole_shares([w * 6 for w in weights]) == weights
    assert deviation(source_mixing.one_period(weights), weights) < 1
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.lpad((F.col("id") % 1000).cast("string"), 4, "0")).alias("source"))
    given = spark.createDataFrame([(f"s{k:04}", w) for k, w in enumerate(weights)], "source string, share int")
    total = sum(weights)
    for r in source_mixing.schedule(docs, given, block_docs=1).collect():
        share = weights[int(r["source"][1:])]
        assert (r["release_slot"], r["deadline_slot"]) == (r["block_no"] * total // share, -(-(r["block_no"] + 1) * total // share))
        assert r["release_slot"] <= r["slot"] < r["deadline_slot"]


def test_weights_beyond_the_period_are_rounded_by_less_than_a_slot():
    weights = [3_000_017, *[31] * 400, 7, 1]
    got = source_mixing.whole_shares(weights, 10_000)
    assert sum(got) == 10_000
    assert min(got) == 1
    big = [w for w in weights if w * 10_000 > sum(weights)]
    assert all(abs(g - w * 10_000 / sum(weights)) <= 1 + len(weights) * w / sum(weights) for g, w in zip(got, weights, strict=True) if w in big)
    for bad in ([0, 1], [-1], [1] * 10_001):
        with pytest.raises(ValueError, match="weights"):
            source_mixing.whole_shares(bad, 10_000)


# sharding


def test_sharding_edges(spark):
    got = holds_up(spark, sharding.shard_documents)
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) <= set(range(8))
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_copies_stay_together_and_sizes_are_near(spark, sf_dir):
    got = sharding.query(spark, sf_dir).toPandas()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id")["text"]
    assert got.groupby(got["doc_id"].map(text))["shard"].nunique().max() == 1
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8
    assert sizes.max() <= 1.05 * sizes.mean()


def plain_best_fit(sizes, capacity):
    """The bin of each item, one at a time, by falling size."""
    bins, out = [], []
    for size in sorted(sizes, reverse=True):
        fits = [(left, b) for b, left in enumerate(bins) if left >= size]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append(capacity)
        bins[b] = max(0, bins[b] - size)
        out.append(b)
    return out


def runs_of(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


def one_by_one(pieces):
    return [b for start, stop, b in pieces for _ in range(start, stop)]


@pytest.mark.parametrize("seed", range(20))
def test_runs_pack_like_a_plain_search_of_single_groups(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, (100, 12)[seed % 2], rng.integers(0, 400)).tolist()
    for capacity in (90, 25, 7):
        assert one_by_one(sharding.best_fit_decreasing(runs_of(sizes), capacity)) == plain_best_fit(sizes, capacity)
    if sizes:
        assert max(one_by_one(sharding.pack_into(runs_of(sizes), 5))) < 5
    assert sharding.best_fit_decreasing([(10, 3)], 10, 2) is None


def used(spark, groups, capacity):
    given = spark.createDataFrame(groups, "group_ string, size long")
    return sorted(r["n"] for r in sharding.packed(given, shards=None, capacity=capacity).groupBy("shard").agg(F.sum("size").alias("n")).collect())


def test_fixed_capacity(spark):
    assert used(spark, [(f"g{k}", 30) for k in range(10)] + [("big", 500)], 90) == [30, 90, 90, 90, 500]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_fixed_capacity_of_many_small_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    assert used(spark, [(f"g{k}", 10) for k in range(20_000)], 25) == [20] * 10_000
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 60, 3000).tolist()
    plain = Counter()
    for size, b in zip(sorted(sizes, reverse=True), plain_best_fit(sizes, 100), strict=True):
        plain[b] += size
    assert used(spark, [(f"g{k}", n) for k, n in enumerate(sizes)], 100) == sorted(plain.values())


def test_sharding_query_equals_a_plain_version(spark, sf_dir):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    copies = Counter(t for _, t in docs)
    name = {t: hashlib.md5(t.encode()).hexdigest() for t in copies}
    order = sorted(copies, key=lambda t: (-copies[t] * (len(t.encode()) + 1), name[t]))
    sizes = [copies[t] * (len(t.encode()) + 1) for t in order]
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.query(spark, sf_dir).collect()}
    loads = Counter()
    for t, size in zip(order, sizes, strict=True):
        loads[got[next(i for i, x in docs if x == t)][0]] += size
    # the bins are those of the one-by-one packing at a capacity between the largest load and a thousandth above it
    shard_of = dict(zip(order, next(p for c in range(max(loads.values()), max(loads.values()) * 1002 // 1000 + 2) if max(p := plain_best_fit(sizes, c)) < 8 and all(got[i][0] == p[order.index(t)] for i, t in docs[:20])), strict=True))
    assert {i: s for i, (s, _) in got.items()} == {i: shard_of[t] for i, t in docs}
    for shard in range(8):
        rows_ = sorted((i, name[t]) for i, t in docs if shard_of[t] == shard)
        assert [got[i][1] for i, _ in rows_] == list(range(len(rows_)))


def test_one_text_copied_very_often(spark, monkeypatch):
    monkeypatch.setattr(common, "RANGE_ROWS", 50)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("copied")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    got = sharding.shard_documents(docs, 4).toPandas()
    assert len(got) == 600
    assert got[got.doc_id % 2 == 0]["shard"].nunique() == 1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
        assert part.sort_values("slot").doc_id.is_monotonic_increasing


# media


def test_media_edges(spark):
    for r in holds_up(spark, ogg.round_trip):
        assert r["payload_bytes"] % 64 == 0
        assert r["payload_bytes"] >= 64
    by = {}
    for r in ogg.round_trip(documents(spark)).collect():
        by.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(x) == 1 for x in by.values())
    expected = Counter(hashlib.sha256(ogg.payload((r[1] or "").encode())).hexdigest() for r in rows())
    assert expected == Counter(r["payload_sha256"] for r in ogg.round_trip(documents(spark)).collect())


def plain_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum_is_that_of_the_format():
    for data in (b"", b"\0", b"123456789", bytes(range(256)) * 3):
        assert ogg.checksum(data) == plain_crc(data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 255, 4080, 4081, 65025, 65026, 65025 * 3 + 7, 1 << 20])
def test_media_round_trip(n):
    data = bytes(k * 7 % 256 for k in range(n))
    found = ogg.read_samples(ogg.write_samples(ogg.payload(data), n))
    assert found.samples == ogg.payload(data)
    assert found.n_bytes == n
    assert found.times[-1] == len(found.samples) / ogg.RATE


def test_media_query_equals_a_plain_version(spark, sf_dir):
    for r, text in ((r, (t or "").encode()) for r in ogg.query(spark, sf_dir).collect() for t in [by_id(spark, sf_dir)[r["doc_id"]]]):
        data = text + bytes(64 - len(text) % 64 if len(text) % 64 or not text else 0)
        media, n, values = ogg.write_samples(data, len(text)), len(data), list(data)
        mean = sum(values) / n
        rms = (sum((v - mean) ** 2 for v in values) / n) ** 0.5
        crossings = sum((a > mean) != (b > mean) for a, b in zip(values, values[1:]))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), n, hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        got = dict(x.split("=") for x in r["feature"].split(";"))
        assert (got["seconds"], int(got["packets"]), int(got["peak"]), int(got["crossings"])) == (f"{n / 8000:.6f}", -(-n // ogg.PACKET), max(values), crossings)
        assert (float(got["mean"]), float(got["rms"])) == (pytest.approx(mean, abs=1e-5), pytest.approx(rms, abs=1e-5))


_TEXTS = {}


def by_id(spark, sf_dir):
    if not _TEXTS:
        _TEXTS.update({r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()})
    return _TEXTS


def test_packets_over_pages_and_their_granules():
    packets = [(b"h", 0), (b"", 5), (b"x" * 255, 10), (b"y" * 70_000, 20), (b"z" * 254, 30)]
    streams = ogg.demultiplex(b"".join(ogg.pages(7, packets)))
    assert streams[7].packets == [p for p, _ in packets]
    assert streams[7].granules[-1] == 30
    assert all(g in (-1, e) for g, (_, e) in zip(streams[7].granules, packets, strict=True))


def test_damage_is_found(spark):
    media = ogg.write_samples(ogg.payload(b"text" * 30_000), 120_000)
    pages = media.split(b"OggS")
    bad = [media[:-1], media[:100] + bytes([media[100] ^ 1]) + media[101:], b"OggS".join(pages[:3] + pages[4:]), b"OggS".join([*pages[:3], pages[4], pages[3], *pages[5:]]), b"junk" + media, b"", media + b"x"]
    df = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(bad)] + [(99, bytearray(media)), (100, None)], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in ogg.read_media(df).collect()}
    assert all(got[k]["error"] and got[k]["samples"] is None for k in [*range(len(bad)), 100])
    assert bytes(got[99]["samples"]) == ogg.payload(b"text" * 30_000)
    assert ogg.write_media(documents(spark)).count() == len(rows())


def plain_labels(text, found):
    """Labels and best coverage, by trying every phrase at every word and every licence text at every relative position."""
    words, labels, best = license_scan.words_of((text or "").encode()), set(), 0.0
    for template in found:
        size = len(template.words)
        if template.whole:
            if any(words[k : k + size] == template.words for k in range(len(words))):
                labels.add(template.label)
                best = 1.0
            continue
        need, quarter = Counter(template.words), size // 4
        for shift in range(-size, len(words)):
            window = words[max(0, shift - quarter) : max(0, min(len(words), shift + size + quarter))]
            have = Counter(window)
            coverage = sum(min(n, have[w]) for w, n in need.items()) / size
            keys = coverage >= license_scan.COVERAGE and all(any(window[k : k + len(key)] == key for k in range(len(window))) for key in template.keys)
            if keys:
                labels.add(template.label)
                best = max(best, coverage)
    return ",".join(sorted(labels)), best


def test_license_labels_equal_plain_ones(spark):
    """Every licence text whole, with words lost, among prose, twice, and halves; and notices, phrases and mere prose."""
    found, rng = license_scan.templates(), random.Random(8)
    texts = ["", prose(1, 400), "Under the MIT License. All rights reserved!"]
    for template in found:
        words = [w.decode() for w in template.words]
        lost = [w for k, w in enumerate(words) if k % 11 != 7]
        texts += [" ".join(words), f"{prose(2, 30)} {' '.join(words)} {prose(3, 50)}", f"{' '.join(words)} {prose(4, 5)} {' '.join(words)}", f"{prose(5, 9)} {' '.join(words[: len(words) // 2])}", f"{prose(6, rng.randrange(40))} {' '.join(lost)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = license_scan.build_index(docs)
    for r in license_scan.scan(docs, index).collect():
        labels, best = plain_labels(texts[r["doc_id"]], found)
        assert r["labels"] == labels, texts[r["doc_id"]]
        # the index looks at one of several neighbouring positions, so its coverage is that of a place, at most the best
        assert (r["score"] == 0) == (best == 0)
        assert license_scan.COVERAGE <= r["score"] <= best or best == 0
