"""Spelling variants against all pairs of words, and edge cases."""

import collections
import random
import re
import zlib

import numpy as np

from voxlattice.llm import spelling

from test_llm import docs, duck, extra, odd_texts

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, every):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            n[w] += 1
    n.pop("", None)
    return n


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n, length, count, factor):
    words = {w: c for w, c in n.items() if len(w) >= length and c >= count}
    form, out = {}, {}
    for w, c in words.items():
        others = [(-words[o], o) for o in words if near(w, o)]
        best = min(others, default=None)
        form[w] = best[1] if best and -best[0] >= factor * c else None
        out[w] = [len(others), -best[0] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], *out[w])
    return out


def corpus(seed, n_docs=60):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abéß") for _ in range(rng.randrange(4, 9))) for _ in range(25)]
    texts = []
    for _ in range(n_docs):
        w = []
        for _ in range(rng.randrange(0, 120)):
            x = stems[int(rng.expovariate(0.3)) % len(stems)]
            if rng.random() < 0.3:
                k = rng.randrange(len(x) + 1)
                x = rng.choice([x[:k] + x[k + 1 :], x[:k] + rng.choice("abé") + x[k:], x[:k] + rng.choice("abé") + x[k + 1 :]])
            w.append(rng.choice([x, x.upper() if x.isascii() else x, x.capitalize()]))
        texts.append(rng.choice([" ", ", ", "\n", "5"]).join(w))
    return texts


def found(spark, frame, every, length, count, factor):
    rows = spelling.variants(spelling.word_counts(frame, every), length, count, factor).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_against_all_pairs(spark):
    for seed, every, length, count, factor in ((0, 7, 4, 2, 2), (1, 3, 5, 1, 3), (2, 0, 4, 1, 2)):
        texts = corpus(seed)
        ids = [None, *range(1, len(texts))]
        got = found(spark, extra(docs(spark, texts, ids)), every, length, count, factor)
        want = plain_variants(plain_counts(zip(ids, texts), every), length, count, factor)
        assert got == want
        assert sum(v[0] is not None for v in want.values()) > 5


def test_chains_end_in_one_root(spark):
    n = {"abcdef": 3**6, "abcdeg": 3**5, "abcdhg": 3**4, "abcihg": 3**3, "abjihg": 9, "akjihg": 3, "lkjihg": 1}
    counts = spark.createDataFrame([(w, c) for w, c in n.items()], "word string, n long")
    rows = {r["word"]: r for r in spelling.variants(counts, 6, 1, 3).collect()}
    assert {r["root"] for r in rows.values()} == {"abcdef"}
    assert rows["lkjihg"]["form"] == "akjihg" and rows["abcdef"]["form"] is None


def test_ties_take_the_first_in_code_point_order(spark):
    counts = spark.createDataFrame([("zzzzzz", 1), ("zzzzza", 9), ("zzzzzé", 9), ("zzzzz", 9), ("zzzzzzz", 9)], "word string, n long")
    rows = {r["word"]: r for r in spelling.variants(counts, 5, 1, 5).collect()}
    assert rows["zzzzzz"]["form"] == "zzzzz" and rows["zzzzzz"]["n_near"] == 4
    # the same place of a run of equal letters counts once
    assert rows["zzzzz"]["n_near"] == 3


def test_keys_of_equal_hash_are_parted_by_strings(spark, monkeypatch):
    """Keys of a few bits only: nearly all groups are collisions."""
    texts = corpus(4, 30)
    want = plain_variants(plain_counts(enumerate(texts), 5), 4, 2, 2)
    whole = spelling.deletion_keys

    def few(words):
        key, word, place = whole(words)
        return (key & 1) | (key & 0b1110000), word, place

    monkeypatch.setattr(spelling, "deletion_keys", few)
    n = spark.createDataFrame(list(plain_counts(enumerate(texts), 5).items()), "word string, n long")
    rows = spelling.variants(n, 4, 2, 2).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows} == want


def test_crc_of_joined_bytes():
    rng = random.Random(3)
    a = [bytes(rng.randrange(256) for _ in range(rng.randrange(12))) for _ in range(20)]
    b = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 7, 47, 48, 49, 300]))) for _ in range(30)]
    i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
    assert spelling.joint_crc(a, b, i, j).tolist() == [zlib.crc32(a[x] + b[y]) for x, y in zip(i, j)]


def test_odd_and_empty_tables(spark):
    long = "x" * 3000 + "y" * 500
    texts = [*odd_texts(), *[long] * 3, *[long[1:]] * 12, "abcdef" * 2, "ABCDEF×÷"]
    got = found(spark, extra(docs(spark, texts)), 0, 6, 3, 4)
    want = plain_variants({w: c for w, c in plain_counts(enumerate(texts), 0).items() if c >= 3}, 6, 3, 4)
    assert got == want and got[long][0] == long[1:]
    assert spelling.variants(spelling.word_counts(docs(spark, []), 199)).collect() == []
    assert spelling.variants(spelling.word_counts(docs(spark, [None, "", "1 2"]), 199)).collect() == []


def test_agrees_with_sql(spark):
    texts = corpus(5)
    frame = docs(spark, texts)
    got = found(spark, frame, 3, 4, 2, 2)
    rows = duck(spelling.sql(3, 4, 2, 2), documents=frame.toArrow())
    assert rows == {(w, *v): 1 for w, v in got.items()}
