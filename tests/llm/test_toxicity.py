"""Class-conditional Kneser-Ney models against a plain version, held-out accuracy, and edge cases."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voxlattice.llm import toxicity as tx

from test_llm import docs, extra, odd_texts


def corpus(n, seed=0):
    """Texts of invented syllables; toxic ones hold a word of one stem, as one of some thirty words."""
    rng = random.Random(seed)
    part = ["an", "er", "ti", "on", "le", "st", "ou", "che", "ü", "ión"]
    word = lambda: "".join(rng.choice(part) for _ in range(rng.randrange(1, 5)))
    texts, toxic = [], []
    for _ in range(n):
        w = [word() for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.15
        if bad:
            for k in range(0, len(w), 30):
                w[rng.randrange(len(w))] = "Zqv" + word()
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return texts, toxic


def plain_differences(texts, toxic):
    """The same model, word by word with dictionaries."""
    n = {1: collections.Counter(), 0: collections.Counter()}
    for t, y in zip(texts, toxic):
        for w in {x for x in "".join(c if c.isalnum() else " " for c in t).lower().split()}:
            m = b"\x01" + w.encode() + b"\x02"
            for e in range(1, len(m)):
                n[y][m[max(0, e + 1 - tx.ORDER) : e + 1]] += 1
    both = n[1] + n[0]

    def discount(c):
        once, twice = (sum(v == k for v in c.values()) for k in (1, 2))
        return once / (once + 2 * twice) if once and twice else 0.5

    levels = {tx.ORDER: both}
    have = set(both)
    for k in range(tx.ORDER - 1, 0, -1):
        grams = {g[-k - 1 :] for g in have if len(g) > k}
        levels[k] = collections.Counter(g[1:] for g in grams)
    p = {b"": 1 / 256}

    def add(level):
        d, of, types = discount(level), collections.Counter(), collections.Counter()
        for g, v in level.items():
            of[g[:-1]] += v
            types[g[:-1]] += 1
        return {g: (max(v - d, 0) + d * types[g[:-1]] * (p[g[1:]] if len(g) > 1 else 1 / 256)) / of[g[:-1]] for g, v in level.items()}

    for k in range(1, tx.ORDER):
        p |= add(levels[k])
    shared = add(both)
    of = {y: collections.Counter() for y in n}
    types = {y: collections.Counter() for y in n}
    for y in n:
        for g, v in n[y].items():
            of[y][g[:-1]] += v
            types[y][g[:-1]] += 1
    d = {y: discount(n[y]) for y in n}
    free = lambda y, c: (tx.PRIOR + d[y] * types[y][c]) / (of[y][c] + tx.PRIOR)
    own = lambda y, g: max(n[y][g] - d[y], 0) / (of[y][g[:-1]] + tx.PRIOR) + free(y, g[:-1]) * shared[g]
    key = lambda g: int.from_bytes(g, "big")
    out = {key(g): math.log(own(1, g) / own(0, g)) for g in both}
    out |= {key(c) + tx._CONTEXT: math.log(free(1, c) / free(0, c)) for c in {g[:-1] for g in both}}
    return out


def test_differences_agree_with_a_plain_model(spark):
    texts, toxic = corpus(60)
    rows = spark.createDataFrame(list(zip(texts, toxic)), "text string, y int")
    got = {r["key"]: r["value"] for r in tx.differences(tx.gram_counts(rows)).collect()}
    want = plain_differences(texts, toxic)
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_shared_probabilities_sum_to_less_than_one_for_seen_bytes(spark):
    texts, toxic = corpus(60)
    counts = tx.gram_counts(spark.createDataFrame(list(zip(texts, toxic)), "text string, y int"))
    p = tx.shared_probabilities(counts.select("g", (F.col("n1") + F.col("n0")).alias("n")))
    assert p.count() == counts.count()
    worst = p.groupBy(F.shiftright("g", 8)).agg(F.sum("p").alias("p")).agg(F.max("p")).first()[0]
    assert worst <= 1 + 1e-9


def test_files_of_the_table_do_not_change_scores(spark, monkeypatch):
    texts, toxic = corpus(400)
    d = docs(spark, texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    want = [r["score"] for r in tx.apply(d, tx.train(d, labels)).orderBy("doc_id").collect()]
    monkeypatch.setattr(tx, "FILE_ROWS", 300)
    model = tx.train(d, labels)
    assert len(model.files) > 6
    got = [r["score"] for r in tx.apply(d, model).orderBy("doc_id").collect()]
    assert np.allclose(got, want, atol=1e-12)


def test_held_out_accuracy_and_only_text_counts(spark):
    texts, toxic = corpus(2500)
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(toxic)], "doc_id long, toxic int, quality int")
    found = tx.apply(d, tx.train(d, labels)).toPandas().sort_values("doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in range(len(texts))])
    assert (found["held_out"].to_numpy() == held).all()
    y, p = np.array(toxic)[held], found["predicted"].to_numpy()[held]
    assert p[y == 1].mean() > 0.95 and p[y == 0].mean() < 0.01
    assert ((found["score"] >= 0.5).astype(int) == found["predicted"]).all()
    # labels of held-out rows, language and source have no influence
    turned = spark.createDataFrame([(i, 1 - v if held[i] else v, 1) for i, v in enumerate(toxic)], "doc_id long, toxic int, quality int")
    other = extra(docs(spark, texts, lang="xx", source="t"))
    again = tx.apply(other, tx.train(other, turned)).toPandas().sort_values("doc_id")
    assert np.allclose(again["score"], found["score"], atol=1e-12)


def test_repeating_a_word_says_no_more(spark):
    texts, toxic = corpus(1500)
    d = docs(spark, texts)
    model = tx.train(d, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"))
    one = "leanti onou stche anerti letiou"
    a, b = tx.apply(docs(spark, [one, " ".join([one] * 50)]), model).orderBy("doc_id").collect()
    assert a["score"] == b["score"]


def test_odd_and_empty_tables(spark):
    texts, toxic = corpus(1200)
    d = extra(docs(spark, texts))
    labels = spark.createDataFrame([*enumerate(toxic), (None, 1), (3, None), (5, 0), (5, 0)], "doc_id long, toxic int")
    model = tx.train(d, labels)
    odd = extra(docs(spark, odd_texts(), [None, 1, 1, *range(3, 13)]))
    found = tx.apply(odd, model).collect()
    assert len(found) == 13 and all(0 <= r["score"] <= 1 for r in found)
    # texts without words, or with none that tells: not toxic; copies get equal scores
    assert all(r["predicted"] == 0 for r in found if r["doc_id"] in (None, 1, 3))
    assert next(r for r in found if r["doc_id"] is None)["held_out"]
    assert tx.apply(odd.limit(0), model).collect() == []
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        other = tx.train(d, some)
        got = {r["predicted"] for r in tx.apply(odd, other).collect()}
        assert got == ({1} if some.where("toxic = 1").count() else {0})
    assert tx.apply(odd, tx.train(d.limit(0), labels)).where("predicted = 1").count() == 0


def test_words_are_lower_runs_of_letters_and_digits():
    data, off, which, text = tx.words(pa.array(["Ab, ab c3!", None, "", "C3 É"]))
    own = [bytes(data[a:b]).decode() for a, b in zip(off[:-1], off[1:])]
    assert sorted((int(t), own[w]) for t, w in zip(text, which)) == [(0, "ab"), (0, "c3"), (3, "c3"), (3, "É")]
