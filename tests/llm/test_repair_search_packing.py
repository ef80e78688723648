"""Repair of conversations, ranked search and packing against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixelweir.llm import conversation_repair, packing, ranked_search
from tests.llm import fixtures

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


# --- conversations


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        for _ in range(2 if kind == 3 else 1):
            yield conv, None if kind == 0 else (turn, "user" if kind == 4 else role, text)


def plain_repair(rows):
    """The result for ordered rows (turn, role, text), by keeping the least (cost, letters) of every state."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    forced = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

    def with_inserts(best):
        best = dict(best)
        for _ in range(4):
            for state, (cost, letters, turns) in list(best.items()):
                to, role = forced[state]
                best[to] = min(best.get(to, (9e9,)), (cost + 3, letters + "I", (*turns, f"{role}:")))
        return best

    best, seen, faults = {0: (0, "", ())}, set(), []
    for _, role, text in rows:
        ending = text.encode().rstrip(b" \t\n\v\f\r")[-1:]
        faults.append("blank" if not ending else "duplicate" if (role, text) in seen else "" if ending in b".!?" else "truncated")
        seen.add((role, text))
        new = {}
        for state, (cost, letters, turns) in with_inserts(best).items():
            options = [(state, (cost + 4, letters + "D", turns))]
            if faults[-1] not in ("blank", "duplicate"):
                extra = 3 * (faults[-1] == "truncated")
                if (state, role[:1]) in after:
                    options.append((after[state, role[:1]], (cost + extra, letters + "K", (*turns, f"{role}:{text}"))))
                to, other = forced[state]
                options.append((to, (cost + 3 + extra, letters + "R", (*turns, f"{other}:{text}"))))
            for to, option in options:
                new[to] = min(new.get(to, (9e9,)), option)
        best = new
    cost, letters, turns = min(v for k, v in with_inserts(best).items() if k in (0, 3))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def ordered(conv, rows):
    key = "" if conv is None else f"={conv}"
    digest = lambda r: hashlib.md5(f"{len(key)}:{key}:{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))


def expected_repairs(rows):
    found = defaultdict(list)
    for conv, row in plain_damage(rows):
        found[conv] += [] if row is None else [row]
    return {conv: plain_repair(ordered(conv, many)) for conv, many in found.items()}


def conversations(seed):
    random.seed(seed)
    rows = []
    for conv in [*range(40), None, 1000]:
        for turn in range(120 if conv in (None, 1000) else random.choice([1, 2, 3, 5, 8])):
            text = random.choice(["Hi.", "Yes!", "no", "", " \n", " ", "Really? \t\n", f"x.{turn}", f"y{turn}", f"Why {turn}?", " ", None])
            rows.append((conv, random.choice([turn, turn, turn, None, turn - 1]), random.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Assistant"]), text))
    return rows


@pytest.mark.parametrize(("fragment", "fan"), [(1024, 512), (7, 3), (2, 2)])
def test_repairs_equal_plain_ones(spark, fragment, fan):
    rows = conversations(fragment)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = conversation_repair.digests(conversation_repair.damaged(df), fragment, fan).collect()
    want = expected_repairs(rows)
    assert len(found) == len(want)
    assert {r[0]: tuple(r)[1:] for r in found} == want


def test_repairs_of_the_table_equal_plain_ones(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in conversation_repair.query(spark, sf_dir).collect()} == expected_repairs(rows)


def test_sql_of_repairs_equals_plain_ones():
    import pyarrow as pa

    rows = conversations(11)
    kinds = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}
    con = duckdb.connect()
    con.register("conversations", pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())}))
    assert {r[0]: tuple(r[1:]) for r in con.execute(conversation_repair.SQL).fetchall()} == expected_repairs(rows)


@pytest.mark.parametrize("fragment", [1024, 2])
def test_repaired_turns_hold_the_grammar(spark, fragment):
    import re

    df = spark.createDataFrame(conversations(5), "conv_id long, turn long, role string, text string").withColumn("audit", F.lit(1)).withColumn("block_", F.lit("x"))
    edits = conversation_repair.repaired(df, fragment, 3).collect()
    by = defaultdict(list)
    for r in sorted(edits, key=lambda r: (r["fragment"], r["at"])):
        by[r["conv_id"]].append(r)
    audits = {r["conv_id"]: (r["audit"], r["repaired_sha256"]) for r in conversation_repair.digests(df, fragment, 3).collect()}
    assert set(audits) == {r[0] for r in conversations(5)}
    for conv, (audit, digest) in audits.items():
        assert "".join(r["edit"] for r in by[conv]) == audit
        kept = [r for r in by[conv] if r["edit"] != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in kept))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in kept).encode()).hexdigest() == digest
        assert all(r["turn"] is None and r["text"] == "" for r in kept if r["edit"] == "I")


def test_repairs_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.digests(conversation_repair.damaged(none)).collect() == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    lost = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert tuple(conversation_repair.digests(conversation_repair.damaged(lost)).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_walk_makes_few_vectors(monkeypatch):
    """The forward walk holds vectors at checkpoints and of one block: each row's is computed at most twice."""
    calls = Counter()
    before = conversation_repair._before
    monkeypatch.setattr(conversation_repair, "_before", lambda *a: calls.update(n=1) or before(*a))
    rows = [(False, 0, random.choice("usax")) for _ in range(900)]
    list(conversation_repair.walk(rows, 0, conversation_repair.LAST))
    assert calls["n"] == 1800


# --- search

ITEMS = [(1, "Stone light under the paper garden"), (2, "MIT license Version 2"), (3, None), (4, ""), (5, "zzzunknown"), (6, "one TWO three one"), (7, "École été 漢字"), (None, "river"), (8, "a" * 50_000), (1, "Stone light under the paper garden"), (9, "aaa ONE")]


def sql_rows(tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toArrow())
    return con.execute(ranked_search.SQL).fetchall()


@pytest.fixture
def asked(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_search_equals_sql_on_awkward_documents(spark, asked):
    docs = fixtures.documents(spark)
    found = ranked_search.search(docs, asked)
    want = sql_rows({"documents": docs, "benchmark": asked})
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, want))
    fixtures.same(found, ranked_search.search(fixtures.wide(spark), asked.withColumn("score", F.lit("x")).withColumn("rank", F.lit(1))))
    assert ranked_search.search(fixtures.empty(spark), asked).collect() == []
    assert ranked_search.search(docs, asked.limit(0)).collect() == []


def test_search_ties_and_copies(spark, monkeypatch):
    """Many copies tie at the threshold, in many small blocks and tasks; batches of items; those asked for are found by shuffles."""
    monkeypatch.setattr(ranked_search, "BLOCK", 16)
    monkeypatch.setattr(ranked_search, "MAX_ITEMS", 3)
    monkeypatch.setattr(ranked_search, "BROADCAST_ROWS", 0)
    rows = [(1000 - k, "river stone river") for k in range(300)] + [(k, fixtures.prose(k, 40 + k % 7)) for k in range(400)] + [(5, "river stone river")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(k, fixtures.prose(k, 5)) for k in range(7)] + [(50, "river stone river paper")], "item_id long, text string")
    want = sql_rows({"documents": docs, "benchmark": items})
    assert sorted(tuple(r) for r in ranked_search.search(docs, items).collect()) == sorted(want)


def test_bounds_are_never_below_scores(spark):
    random.seed(3)
    texts = [" ".join(random.choice(fixtures.WORDS[: random.choice([3, 80])]) for _ in range(random.randint(1, 400))).encode() for _ in range(60)]
    items = ranked_search.Items([1, 2], [b"the river of stone", b"paper window in that in that"])
    docs = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    rows = ranked_search.index(docs, set(items.hashes.tolist())).collect()
    counts = {t: Counter(ranked_search.terms(texts[t])) for t in range(60)}
    df = {int(h): sum(term in c for c in counts.values()) for term, h in zip(items.vocabulary, items.hashes.view(np.int64), strict=True)}
    assert dict(zip(*(next(r for r in rows if r["width"] == 0)[c] for c in ("df_terms", "df")), strict=True)) == {h: n for h, n in df.items() if n}
    items.know(60, sum(map(Counter.total, counts.values())), df)
    seen, loose = 0, 0
    for r in rows:
        if not r["width"]:
            continue
        bounds, _ = items.bounds(r["width"], r["n_terms"], bytes(r["bits"]))
        for column, doc in enumerate(r["doc_ids"]):
            seen += 1
            for i in range(2):
                exact = items.score(counts[doc], counts[doc].total(), i)
                assert bounds[i, column] >= exact
                loose += bounds[i, column] > 1.5 * exact
    assert seen == 60
    assert loose < 20


# --- packing


def plain_ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


TEXTS = [
    None, "", " ", "a", " a", "a ", "a  b", "a \n b", "\n\n", "it's  we'll 's  x", "x <|endoftext|> y<|endoftext|>z", "été  déjà   vu", "漢字 仮名 😀", "tab\t tab", "a" * 3000, "word " * 2000, "1 22 333 !? ... ", "x\u0085 y \x1c z",
]


def test_words_are_encoded_as_in_whole_texts():
    tokenizer, encoder = Tokenizer.from_file(BYTE_BPE), packing.Encoder(BYTE_BPE)
    random.seed(9)
    texts = [x or "" for x in TEXTS] + ["".join(random.choice(["a", "Bc", " ", " ", "\n", ".", "'s", "1", "é", " ", "　", "<|endoftext|>", "漢"]) for _ in range(30)) for _ in range(400)]
    for _ in range(2):
        assert encoder.encode(texts) == [np.array(tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def check_packing(pieces, texts, window):
    """pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) hold each id of each text once; returns padding and tokens."""
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    docs, sequences, padding = defaultdict(list), defaultdict(list), 0
    for p in pieces:
        docs[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    assert set(docs) == set(texts)
    for doc, many in docs.items():
        ids, at = plain_ids(tokenizer, texts[doc]), 0
        for p in sorted(many, key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["length"] > 0
            assert bytes(p["ids"]) == ids[at : at + p["length"]].tobytes()
            at += p["length"]
        assert at == len(ids)
    for many in sequences.values():
        at = 0
        for p in sorted(many, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, sum(p["length"] for p in pieces)


@pytest.mark.parametrize(("window", "buffer", "parts"), [(1024, 1 << 23, 1), (64, 500, 3), (10, 7, 2)])
def test_packing(spark, window, buffer, parts):
    texts = dict(enumerate(TEXTS + [fixtures.prose(k, k % 90 + 1) for k in range(200)]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(parts)
    padding, tokens = check_packing(packing.pack(docs, BYTE_BPE, window, buffer=buffer).collect(), texts, window)
    assert padding <= tokens / 100


def test_packing_of_awkward_documents(spark):
    found = packing.pack(fixtures.documents(spark), BYTE_BPE).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    tokenizer, want = Tokenizer.from_file(BYTE_BPE), Counter()
    for doc, text, *_ in fixtures.rows():
        want[doc] += len(plain_ids(tokenizer, text))
    assert {r["doc_id"]: r["n"] for r in found} == want
    fixtures.same(packing.pack(fixtures.documents(spark), BYTE_BPE), packing.pack(fixtures.wide(spark), BYTE_BPE))
    assert packing.pack(fixtures.empty(spark), BYTE_BPE).collect() == []


def test_packing_of_the_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    whole = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), BYTE_BPE).collect()
    padding, tokens = check_packing(whole, texts, 1024)
    assert padding <= tokens / 200
    got = sorted(map(repr, packing.query(spark, sf_dir).collect()))
    assert len(got) == len(whole)
    one = packing.query(spark, sf_dir).first()
    assert one["ids_crc32"] == next(zlib.crc32(p["ids"]) for p in whole if (p["doc_id"], p["start"]) == (one["doc_id"], one["start"]))


def plain_best_fit(sizes, window):
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= size]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else window) - size)
    return sorted(rooms)


@pytest.mark.parametrize("sizes", [[], [1], [1024] * 3, [700] * 50, [513, 511, 512, 1, 1023]])
def test_best_fit(sizes):
    random.seed(len(sizes))
    for many in (sizes, [random.randint(1, 1023) for _ in range(300)]):
        windows = packing.best_fit(many, 1024)
        assert sorted(1024 - sum(many[i] for i in w) for w in windows) == plain_best_fit(many, 1024)
        assert sorted(i for w in windows for i in w) == list(range(len(many)))
        laid = packing.lay_out(many)
        assert sum(n for s in laid for _, _, n in s) == sum(many)
        assert sum(packing.padding(sum(n for _, _, n in s), 1024) for s in laid) <= 4 * len(laid)
