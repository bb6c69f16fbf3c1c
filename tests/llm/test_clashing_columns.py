"""Stages that return the columns of documents keep them, whatever they are called."""

import random

from pyspark.sql import functions as F

from voxlattice.llm import decontamination, mixing, simhash

from test_llm import docs, prose

NAMES = ["_own_id", "_own_key", "_leak_key", "_kept_id", "_kept_key", "_whole_row", "text_key", "fp", "root", "least", "doc.id", "item_id"]


def named(df):
    return df.withColumns({c: F.lit("keep-me") for c in NAMES})


def test_columns_pass_through(spark):
    rng = random.Random(3)
    texts = [prose(rng, 60) for _ in range(8)] + [None, "", "x"]
    d = named(docs(spark, texts + texts[:2]))
    item = spark.createDataFrame([(0, texts[3])], "item_id long, text string")
    for kept, n in ((simhash.one_each(d), 10), (decontamination.clean(d, item), 12), (mixing.sample(d), None)):
        assert kept.columns == d.columns
        rows = kept.collect()
        assert n is None or len(rows) == n
        assert all(r[c] == "keep-me" for r in rows for c in NAMES)
    assert {r["doc_id"] for r in simhash.one_each(d).collect()} == {*range(9), 10}
    assert 3 not in {r["doc_id"] for r in decontamination.clean(d, item).collect()}
