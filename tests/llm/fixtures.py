"""Small documents with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use for themselves.
CLASHING = ["score", "node", "bucket", "slot", "shard", "size", "fail_bits", "measured", "row_", "share", "total", "name", "k", "block", "rest", "rank_", "n_words", "kept", "input_ids", "features"]

WORDS = "the of and to in that river stone light under paper garden window morning quiet letter summer north bridge market silver garden table story people always never before after between through without against letter number system program question answer problem school country family water mother father friend minute office result reason research moment teacher education history party power city community president team member law car government idea body information back parent face others level door health person art war".split()


def prose(seed, n):
    random.seed(seed)
    return " ".join(random.choice(WORDS) + random.choice(["", "", "", ",", "."]) for _ in range(n))


def rows():
    base, other = prose(1, 300), prose(2, 120)
    words = base.split()
    near = " ".join([*words[:150], "changed", *words[151:]])
    long = prose(3, 60_000)
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (4, other, "de", "b"), (4, other, "de", "b"), (5, None, "en", "a"), (6, "", None, "a"), (7, " \t\n\v\f\r ", "en", None),
        (8, "one", "fr", "c"), (9, "one two three", "fr", "c"), (10, "ONE two Three", "fr", "c"), (None, base, "en", "a"), (None, None, None, None), (11, long, "en", "a"), (12, "a" * 50_000, "en", "a"),
        (13, "Under the MIT License, Apache License Version 2 and CC BY-NC.", "en", "d"), (14, "ÉCOLE été ΑΣ ß ﬁ   漢字 😀 İ", "fr", "d"), (15, "| ### a | *** b | $$$ c " * 40, "en", "e"), (16, "<|endoftext|> it's <|startoftext|>", "en", "e"),
        (17, "under the mit under the mit license license under the mit license", "en", "e"), (18, "12345 67", None, "e"),
    ]
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def wide(spark):
    """The same documents with columns whose names clash, filled with text and nulls."""
    from pyspark.sql import functions as F

    df = documents(spark)
    for k, name in enumerate(CLASHING):
        df = df.withColumn(name, F.lit("x") if k % 2 else F.lit(None).cast("string"))
    return df


def same(a, b):
    key = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert key(a) == key(b)


def holds_up(spark, operator, n=None):
    """The operator on awkward, widened and empty documents: the same rows with clashing columns as without, none for none."""
    found = operator(documents(spark))
    assert found.count() == (len(rows()) if n is None else n)
    same(found, operator(wide(spark)))
    assert operator(empty(spark)).collect() == []
    return found.collect()
