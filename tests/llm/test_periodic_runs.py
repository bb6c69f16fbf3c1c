"""Maximal runs against all starts and periods, and the digest against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlattice.llm import periodic_runs as pr

from test_llm import docs, extra, odd_texts, words_of


def plain_runs(w, least=6, exponent=4):
    """start, length, smallest period of all maximal runs, by trying every period."""
    out, n = {}, len(w)
    for q in range(1, n // exponent + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            length = e - s + q
            # a shorter period of the same stretch was met before
            if length >= max(least, exponent * q) and not any(a == s and b == length for a, b, _ in out):
                out[(s, length, q)] = None
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def altered(doc_id, text):
    w = words_of(text)
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def plain_digest(doc_id, text):
    w = altered(doc_id, text)
    runs = plain_runs(w)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def periodic(rng, n, letters):
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        unit = [rng.randrange(letters) for _ in range(rng.randrange(1, 7))]
        at = rng.randrange(len(w) + 1)
        w[at:at] = (unit * 8)[: rng.randrange(3, 8 * len(unit) + 1)]
    return w


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (3, 3)])
def test_runs_of_many_texts_against_all_periods(least, exponent):
    rng = random.Random(exponent)
    for _ in range(400):
        texts = [periodic(rng, rng.randrange(30), rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(1, 5))]
        words = np.array([x + 7 for t in texts for x in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        text = np.repeat(np.arange(len(texts)), np.diff(off))
        s, n, q = pr.runs_of_words(words, text, least, exponent)
        got = sorted((int(text[a]), int(a - off[text[a]]), int(b), int(c)) for a, b, c in zip(s, n, q))
        assert got == sorted((i, *r) for i, t in enumerate(texts) for r in plain_runs(t, least, exponent))


def test_suffix_array_and_branching_repeats():
    rng = random.Random(2)
    for _ in range(200):
        w = np.array(periodic(rng, rng.randrange(2, 30), 2))
        order, rank, common = pr.suffix_array(w)
        n = len(w)
        suffix = [tuple(w[i:].tolist()) for i in range(n)]
        assert order.tolist() == sorted(range(n), key=lambda i: suffix[i]) and rank[order].tolist() == list(range(n))
        same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[1:].tolist() == [same(suffix[a], suffix[b]) for a, b in zip(order[:-1], order[1:])]
        got = sorted(zip(*(x.tolist() for x in pr.branching_repeats(w))))
        want = [(i, d) for i in range(n) for d in range(1, (n - i) // 2 + 1) if (w[i : i + d] == w[i + d : i + 2 * d]).all() and (i + 2 * d == n or w[i + 2 * d] != w[i + d])]
        assert got == sorted(want)


def test_long_runs_take_time_in_proportion():
    w = np.ones(300_000, np.uint64)
    s, n, q = pr.runs_of_words(w, np.zeros(len(w), np.int64))
    assert (s.tolist(), n.tolist(), q.tolist()) == ([0], [300_000], [1])


def test_digest_against_plain_python(spark):
    rng = random.Random(7)
    spaces = [" ", "\n", "  ", "\t", "\x0b", "\r\n"]
    texts = []
    for _ in range(150):
        w = periodic(rng, rng.randrange(60), rng.choice([2, 4, 500]))
        texts.append("".join(f"{rng.choice(spaces)}é{x}" for x in w) + rng.choice(["", "\n"]))
    # Trying every period takes too long for the very long texts among the odd ones.
    texts += [t for t in odd_texts() if t is None or len(t) < 100_000]
    ids = [None, *range(1, len(texts))]
    found = pr.digest(pr.find_runs(pr.made_periodic(extra(docs(spark, texts, ids))))).collect()
    assert {tuple(r) for r in found} == {plain_digest(i, t) for i, t in zip(ids, texts)} and len(found) == len(texts)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids if i is not None) > 5


def test_very_long_texts(spark):
    rng = random.Random(8)
    head, unit = [f"w{rng.randrange(4000)}" for _ in range(20_000)], [f"u{n}" for n in range(3_000)]
    found = pr.find_runs(docs(spark, [" ".join(head + unit * 5), None])).orderBy(F.desc("n_words")).collect()
    assert [tuple(r) for r in found[0]["runs"]] == [(20_000, 15_000, 3_000)] and found[0]["n_words"] == 35_000
    assert found[0]["collapsed"] == " ".join(head + unit) and found[1]["collapsed"] == ""


def test_repeated_rows_and_empty_tables(spark):
    text = "a b " * 5 + "c"
    rows = pr.find_runs(docs(spark, [text, text], [4, 4])).collect()
    assert [(r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows] == [(11, [(0, 10, 2)], "a b c")] * 2
    assert pr.digest(pr.find_runs(pr.made_periodic(docs(spark, [])))).collect() == []
    assert re.fullmatch("[0-9a-f]{64}", pr.digest(pr.find_runs(docs(spark, [None]))).first()["runs_sha256"])
