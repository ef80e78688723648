"""The pipeline stage by stage against plain versions of each."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from pixelweir.llm import bpe, quality_classifier, quality_rules, source_mixing
from tests.llm.fixtures import SCHEMA, documents, empty, wide
from tests.llm.test_near_dedup import plain_near_duplicates

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_on_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "quality_classifier", "near_dedup", "source_mixing", "bpe"]
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
        if name != "bpe":
            assert out[-1].columns == docs.columns
            assert out[-1].count() > 0
    ledger = quality_rules.ledger(docs).where(quality_rules.passes("prose-1"))
    assert ids(out[1]) == ids(ledger)
    model_scores = quality_classifier.score_documents(out[1], marks).where("predicted = 1")
    assert ids(out[2]) == ids(model_scores)
    given = [(r["doc_id"], r["text"]) for r in out[2].collect()]
    assert ids(out[3]) == [i for i, _, c in plain_near_duplicates(given, 5, 80) if i == c]
    assert ids(out[4]) == ids(out[3])
    tokenizer = bpe.encoder(bpe.default_file())
    text = {r["doc_id"]: r["text"] for r in out[4].collect()}
    final = out[5].collect()
    assert {r["doc_id"]: r["input_ids"] for r in final} == {k: tokenizer.ids(t) for k, t in text.items()}
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(repr, run.collect())) == sorted(map(repr, final))
    # of the documents marked good, (nearly) all that no copy stands for stay
    good = {r["doc_id"] for r in marks.where("quality = 1").collect()}
    kept = set(ids(out[2]))
    long = {r["doc_id"] for r in docs.collect() if len(r["text"].split()) >= 50}
    assert len(good & long & kept) >= 0.97 * len(good & long)


def test_awkward_documents(spark, sf_dir):
    tokenizer = bpe.encoder(bpe.default_file())
    for given in (documents(spark), wide(spark), empty(spark)):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, sf_dir)
            if name != "bpe":
                assert found.columns == given.columns
                docs = found
        rows = docs.select("doc_id", "text").collect()
        assert sorted(((str(r["doc_id"]), r["input_ids"]) for r in found.collect())) == sorted(((str(i), tokenizer.ids(t or "")) for i, t in rows))
        assert (len(rows) > 0) == (given.count() > 0)
    # every text as it is, those too that the first stages would reject
    found = corpus_pipeline.tokens(spark, wide(spark), sf_dir)
    assert found.columns == ["doc_id", "source", "slot", "in_block", "input_ids"]
    assert sorted((str(r["doc_id"]), r["input_ids"]) for r in found.collect()) == sorted((str(r["doc_id"]), tokenizer.ids(r["text"] or "")) for r in wide(spark).collect())


def plain_schedule(rows, block_docs=64):
    """doc_id to (slot, in_block), one slot at a time: of the sources with a released block, the one whose deadline comes first."""
    names = sorted({s for _, s in rows})
    queues = {s: sorted((i for i, x in rows if x == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()) for s in names}
    share = {s: math.isqrt(len(q)) for s, q in queues.items()}
    total, done, out, slot = sum(share.values()), dict.fromkeys(names, 0), {}, 0
    while len(out) < len(rows):
        _, s = min((-(-(done[s] + 1) * total // share[s]), s) for s in names if done[s] * total < (slot + 1) * share[s])
        for k, i in enumerate(queues[s][done[s] * block_docs : (done[s] + 1) * block_docs]):
            out[i] = (slot, k)
        done[s] += 1
        slot += 1
    return out


def test_places_of_the_mixture_reach_the_result(spark, sf_dir):
    sources = ["a"] * 700 + ["b"] * 150 + ["c"] * 40
    rows = [(i, f"text number {i}", "en", s, 10) for i, s in enumerate(sources)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = corpus_pipeline.tokens(spark, corpus_pipeline.mixture(spark, docs, sf_dir).repartition(5), sf_dir).collect()
    assert {r["doc_id"]: (r["slot"], r["in_block"]) for r in found} == plain_schedule([(i, s) for i, _, _, s, _ in rows])
    tokenizer = bpe.encoder(bpe.default_file())
    assert {r["doc_id"]: r["input_ids"] for r in found} == {i: tokenizer.ids(t) for i, t, *_ in rows}


def test_run_has_the_schedule_of_the_deduplicated_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir)
    found = corpus_pipeline.run(spark, sf_dir).select("doc_id", "slot", "in_block").collect()
    assert {r["doc_id"]: (r["slot"], r["in_block"]) for r in found} == plain_schedule([(r["doc_id"], r["source"]) for r in docs.select("doc_id", "source").collect()])


def test_the_last_stage_returns_the_places_of_the_mixture(spark, sf_dir, tmp_path):
    rows = [(i, f"text number {i}", "en", "ab"[i % 3 == 0], 10) for i in range(300)]
    rows += [(None, f"text {i % 2}", "en", None, 10) for i in range(150)] + [(7, "again", "en", "a", 10)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    shares = spark.createDataFrame([("a", 5), ("b", 1), (None, 2)], "source string, share int")
    mixed = source_mixing.mix_and_note(docs, shares)
    assert mixed.columns == docs.columns
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, docs.collect()))
    mixed.write.parquet(f"{tmp_path}/mixed")
    again = spark.read.parquet(f"{tmp_path}/mixed")
    found = corpus_pipeline.tokens(spark, again.repartition(3), sf_dir)
    expected = source_mixing.schedule(docs, shares).select("doc_id", "source", "slot", "in_block")
    assert sorted(map(repr, found.drop("input_ids").collect())) == sorted(map(repr, expected.collect()))
    # a row that came later, or one without a mixture, has no place; one that left takes none from others
    later = again.where("doc_id > 10").withColumn("doc_id", F.when(F.col("doc_id") == 20, 5000).otherwise(F.col("doc_id")))
    places = {r["doc_id"]: (r["slot"], r["in_block"]) for r in expected.collect()} | {5000: (None, None)}
    got = corpus_pipeline.tokens(spark, later, sf_dir).collect()
    assert len(got) == 289 and all((r["slot"], r["in_block"]) == places[r["doc_id"]] for r in got)
    assert corpus_pipeline.tokens(spark, docs, sf_dir).select("slot", "in_block").distinct().collect() == [(None, None)]


def test_texts_meet_their_places_by_one_shuffle_without_a_sort(spark, sf_dir, monkeypatch):
    docs = spark.createDataFrame([(i, f"text number {i}", "en", "ab"[i % 3 == 0], 10) for i in range(300)], SCHEMA)
    mixed = corpus_pipeline.mixture(spark, docs, sf_dir)
    monkeypatch.setattr(corpus_pipeline, "written", lambda df, name: pytest.fail(f"{name} written"))
    found = corpus_pipeline.tokens(spark, mixed, sf_dir)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    # the ids are made above the join, which neither sorts rows nor depends on how small the places are
    assert plan.index("ArrowEvalPython") < plan.index("ShuffledHashJoin")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan[: plan.index("ShuffledHashJoin")]
    assert found.count() == 300
