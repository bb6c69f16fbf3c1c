"""Each operator against brute force, and its edge cases: nulls, empty and long texts, ties, repeats, empty tables."""

import base64
import collections
import gzip
import hashlib
import io
import itertools
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxlattice.llm import components, decontamination, license_scan, mixing, quality_rules, sharding, simhash, store, substring_dedup, textkernel, token_counts, token_output, tokenizer, warc

RANKS = os.environ.get("VOXLATTICE_RANKS", tokenizer.RANKS)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = "[^\x20\x09-\x0d]+"


def words_of(t):
    return re.findall(SPACE, t or "")


def prose(rng, n, vocab=4000):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def docs(spark, texts, ids=None, source="s", lang="en"):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, lang, source, len(t) if t is not None else None) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    rng = random.Random(0)
    long = prose(rng, 30_000)
    return [None, "", " \n\t ", "one", "two words", prose(rng, 80), prose(rng, 80), long, "É" * 50 + " ü x　y", "a\x00b c", "tail \n", "\n\nhead", long]


def extra(df):
    return df.withColumns({"key": F.lit(1), "fp": F.lit("x"), "n": F.lit(2), "text_key": F.lit(3), "_h": F.lit(4), "hash": F.lit(5)})


# --- the text kernel --------------------------------------------------------------------------------------------------

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t #*\x0b\x00ßA", max_size=40)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_kernel_words_and_statistics(texts):
    col = pa.array(texts, pa.string())
    t = textkernel.Texts(col)
    raw = t.data.tobytes()
    found = [raw[a:b].decode() for a, b in zip(t.start, t.end)]
    assert found == [w for x in texts for w in words_of(x)]
    counts, x = quality_rules.statistics(col)
    assert np.isfinite(x).all()
    for text, row in zip(texts, counts.tolist()):
        assert row == list(base_statistics(text or ""))
    h = t.word_hash()
    assert len(set(zip(found, h.tolist()))) == len(set(found)) == len(set(h.tolist()))


def base_statistics(t):
    w = words_of(t)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {p for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_slices_never_cut_a_text():
    col = pa.array(["a" * 10, None, "b" * 100, "", "c"])
    assert list(textkernel.slices(col, 20)) == [(0, 2), (2, 3), (3, 5)] and list(textkernel.slices(col[:0], 5)) == []


# --- 1 WARC -----------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 70_000, "<p>a</p>", "x\r\n\r\ny", "WARC/1.1\r\n"]
    rows = [(n, None if n == 4 else f"http://h/{n}\r\nX: y", h) for n, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    last = {}
    for n, h in enumerate(html):
        last[h or ""] = n
    for least in (0, 5):
        got = {r["page_id"]: r for r in warc.round_trip(extra(pages), least).collect()}
        assert len(got) == len(html)
        for n, h in enumerate(html):
            data, r = (h or "").encode(), got[n]
            assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
            revisit = len(data) >= least and last[h or ""] != n
            assert (r["record_type"], r["refers_to"]) == (("revisit", last[h or ""]) if revisit else ("response", None))
    assert warc.round_trip(pages.where("false")).count() == 0


def duck(sql, **tables):
    """Rows of the SQL over tables of Arrow, as a multiset."""
    import duckdb

    with duckdb.connect() as db:
        for name, table in tables.items():
            db.register(name, table)
        return collections.Counter(db.sql(sql).fetchall())


def test_warc_of_repeated_and_missing_ids(spark, tmp_path):
    rng = random.Random(2)
    rows = [(1, "u", "aaaa"), (1, "u", "bbbb"), (2, "u", "bbbb"), (3, "u", "cc"), (3, "u", "cc"), (None, "u", "dd"), (None, "v", "dd"), (None, "w", "aaaa"), (None, None, None), (4, "a", "e"), (4, "b", "e")]
    rows += [(rng.choice([None, 5, 6, 7, 8]), rng.choice("uvw"), rng.choice(["x", "y", "z", None, ""])) for _ in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.repartition(3).write.parquet(str(tmp_path / "pages"))
    for source in (pages, spark.read.parquet(str(tmp_path / "pages"))):
        got = warc.round_trip(extra(source))
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        table = pa.table({k: list(c) for k, c in zip(("page_id", "url", "html"), zip(*rows))})
        assert collections.Counter(map(tuple, got.select(*names).collect())) == duck(f"SELECT {', '.join(names)} FROM ({warc.SQL})", pages=table)
        archives = warc.write_archives(source, f"file://{tmp_path}/{random.random()}")
        back = warc.read_archives(spark, archives, True).toPandas()
        assert len(back) == len(rows) and back["record_id"].is_unique
        held = back[back.record_type == "response"]
        assert sorted(bytes(x) for x in held["payload"]) == sorted({(h or "").encode() for _, _, h in rows})
        assert set(back["refers_to"].dropna()) <= set(held["record_id"])


def test_warc_members_stand_alone_and_errors_are_found():
    first = warc.Row(1, "f", 0)
    one, two = warc.record(first, "u", b"abc" * 50_000, None), warc.record(warc.Row(2, "f", 1), "u", b"abc", first)
    archive = warc.gzip_member(one) + warc.gzip_member(two)
    assert gzip.decompress(archive) == one + two
    got = list(warc.records(io.BytesIO(archive), True))
    assert got[0]["payload"] == b"abc" * 50_000 and got[1]["refers_to"] == got[0]["record_id"] and got[1]["payload"] is None
    for broken in (one.replace(b"abc", b"abd", 1), one.replace(b"Content-Length: 1", b"Content-Length: 2", 2), b"WARC/0.9" + one[8:], one[:-1]):
        with pytest.raises((ValueError, EOFError)):
            list(warc.records(io.BytesIO(warc.gzip_member(broken))))
    with pytest.raises((EOFError, ValueError)):
        list(warc.records(io.BytesIO(archive[:-20])))


# --- 2 substring dedup ------------------------------------------------------------------------------------------------


def test_compact_windows_group_all_passages():
    rng = np.random.default_rng(0)
    for n in (0, 5, 6, 40, 90):
        values = rng.integers(0, 1 << 63, n).astype(np.uint64)
        text, left, c, right = substring_dedup.compact_windows(np.concatenate([values, values[::-1]]), np.array([0, n, 2 * n]), 6)
        for which, v in ((0, values), (1, values[::-1])):
            mine = [(a - which * n, m - which * n, b - which * n) for t, a, m, b in zip(text, left, c, right) if t == which]
            for i in range(n):
                for j in range(i + 5, n):
                    m = i + int(np.argmin(v[i : j + 1]))
                    assert [w[1] for w in mine if w[0] <= i <= w[1] <= j <= w[2]] == [m]


def test_passages(spark):
    rng = random.Random(1)
    shared, near = prose(rng, 70).split(), prose(rng, 60).split()
    edited = near[:30] + ["edit"] + near[31:]
    body = lambda n: prose(rng, n).split()
    a, b = body(40) + shared + body(90), body(120) + shared + body(10)
    c, d = body(33) + near + body(50), body(70) + edited + body(20)
    short = prose(rng, 40).split()
    e, f = body(60) + short + body(60), body(80) + short + body(30)
    whole = body(60)
    texts = [" ".join(x) for x in (a, b, c, d, e, f, whole, whole)] + odd_texts()
    got = collections.defaultdict(list)
    for r in substring_dedup.passages(extra(docs(spark, texts))).collect():
        got[r["doc_id"]].append(r)
    hit = lambda n, lo, hi: any(r["start_word"] <= lo and r["end_word"] >= hi for r in got[n])
    assert hit(0, 40, 110) and hit(1, 120, 190)
    assert got[0][0]["class_id"] == got[1][0]["class_id"] == 0
    assert got[2] and got[3]
    assert not got[4] and not got[5]
    assert hit(6, 0, 60) and hit(7, 0, 60)
    odd = {8 + n for n, t in enumerate(odd_texts())}
    assert {n for n in got if n in odd and got[n]} == {8 + 7, 8 + 12}
    assert substring_dedup.passages(docs(spark, [])).count() == 0
    nulls = substring_dedup.passages(docs(spark, [" ".join(whole)] * 3, [None, None, 5])).collect()
    assert len(nulls) == 3


def test_copies_do_not_fill_tiles(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(6):
        shared = prose(rng, 60)
        texts += [f"{prose(rng, 40)} {shared} {prose(rng, 40)}"] * 40 + [f"{prose(rng, 70)} {shared} {prose(rng, 30)}"]
    got = {r["doc_id"]: r for r in substring_dedup.passages(docs(spark, texts).repartition(4), tile=8).collect()}
    assert all(n in got and got[n]["start_word"] <= 70 and got[n]["end_word"] >= 130 for n in range(40, len(texts), 41))
    assert len(substring_dedup.passages(docs(spark, texts[:41] * 3, [5] * 123)).collect()) == 123


@pytest.mark.parametrize("levels", [0, 2])
def test_partners_are_found_in_keys_of_any_size(spark, monkeypatch, levels):
    """Around a footer that all texts have, pairs share 20 words more: every text has one partner, whatever the tiles."""
    apart = substring_dedup._verified_apart
    monkeypatch.setattr(substring_dedup, "_verified_apart", lambda hot, level, _, tile, __: apart(hot, level, levels, tile, 2))
    rng = random.Random(4)
    footer, texts = prose(rng, 40), []
    for _ in range(60):
        more = prose(rng, 20)
        texts += [f"{prose(rng, 60)} {footer} {more}", f"{prose(rng, 80)} {footer} {more}"]
    texts += [f"{prose(rng, 60)} {footer} {prose(rng, 20)}" for _ in range(20)]
    got = {r["doc_id"]: r for r in substring_dedup.passages(docs(spark, texts), tile=8).collect()}
    assert set(got) == set(range(120))
    assert all(got[n]["start_word"] <= 60 + 20 * (n % 2) and got[n]["n_words"] >= 60 and got[n]["class_id"] == n // 2 * 2 for n in got)
    one = substring_dedup.passages(docs(spark, texts)).collect()
    assert sorted(one) == sorted(got.values())


def most_alike(a, b):
    """The greatest Jaccard similarity of passages of LEAST shingles or more of two texts that repeat none, by all pairs."""
    least = substring_dedup.LEAST
    x, y = ([tuple(t[i : i + 5]) for i in range(len(t) - 4)] for t in (a, b))
    if min(len(x), len(y)) < least:
        return 0.0
    total = np.zeros((len(x) + 1, len(y) + 1), np.int64)
    where = {s: q for q, s in enumerate(y)}
    for p, s in enumerate(x):
        if s in where:
            total[p + 1, where[s] + 1] = 1
    total = total.cumsum(0).cumsum(1)
    runs = [np.array([(i, j) for i in range(len(t)) for j in range(i + least, len(t) + 1)]).T for t in (x, y)]
    (i, j), (k, m) = runs
    common = total[j][:, m] - total[i][:, m] - total[j][:, k] + total[i][:, k]
    return float((common / ((j - i)[:, None] + (m - k)[None] - common)).max())


@pytest.mark.parametrize("tile", [substring_dedup.TILE, 6])
def test_passages_against_all_pairs(spark, tile):
    """Edits, insertions, halves of two documents and everyday phrases: whoever has a partner is found, and nobody else."""
    rng = random.Random(14)
    texts, phrases = [], [prose(rng, 10, 10**6).split() for _ in range(6)]
    for _ in range(9):
        core = prose(rng, rng.randrange(50, 70), 10**6).split()
        for _ in range(3):
            own = list(core)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(own))
                rng.choice([lambda a=at: own.__setitem__(a, "x%d" % rng.randrange(10**9)), lambda a=at: own.insert(a, "y%d" % rng.randrange(10**9)), lambda a=at: own.pop(a)])()
            texts.append(prose(rng, rng.randrange(15), 10**6).split() + own + prose(rng, rng.randrange(15), 10**6).split())
        half = prose(rng, 35, 10**6).split()
        texts += [core[:35] + prose(rng, 30, 10**6).split(), prose(rng, 30, 10**6).split() + half, core[:35] + half]
    for _ in range(25):
        texts.append([w for p in rng.sample(phrases, 5) for w in [*p, *prose(rng, 5, 10**6).split()]])
    linked = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if set(texts[i]) & set(texts[j]) and most_alike(texts[i], texts[j]) >= 0.8}
    expected = {n for pair in linked for n in pair}
    assert 15 < len(expected) < 40
    got = {r["doc_id"]: r for r in substring_dedup.passages(docs(spark, [" ".join(t) for t in texts]), tile=tile).collect()}
    assert set(got) <= expected and len(got) >= 0.95 * len(expected)
    root = list(range(len(texts)))
    for _ in root:
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    assert all(root[r["class_id"]] == root[n] and r["class_id"] <= n for n, r in got.items())


def test_pairs_at_the_limit_are_rarely_missed():
    assert (1 - substring_dedup.SIMILARITY) ** substring_dedup.FUNCTIONS < 0.002
    rng = np.random.default_rng(8)
    missed = 0
    for _ in range(2000):
        # 72 of 90 shingles in common
        common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (72, 9, 9))
        values = [[substring_dedup._values(np.concatenate([common, x]), f).min() for x in (a, b)] for f in range(substring_dedup.FUNCTIONS)]
        missed += all(x != y for x, y in values)
    assert missed <= 9


def test_minima_of_very_long_texts():
    rng = np.random.default_rng(7)
    values = rng.integers(0, 1 << 63, (1 << 24) + 1000).astype(np.uint64)
    got = substring_dedup.sliding_argmin(values, 46)
    assert len(got) == len(values) - 45
    for at in (0, (1 << 24) - 100, len(values) - 300):
        seen = np.lib.stride_tricks.sliding_window_view(values[at : at + 300], 46)
        assert (got[at : at + len(seen)] == at + np.arange(len(seen)) + (seen >> np.uint64(24)).argmin(1)).all()


def test_longest_runs_against_brute_force():
    rng = np.random.default_rng(6)
    side, wide = substring_dedup._SIDE, substring_dedup._WIDE
    held = rng.random((300, wide)) < rng.choice([0.8, 0.88, 0.92], (300, 1))
    held[:100, 120:] = False
    for row, start, stop in zip(held, *substring_dedup.longest_runs(held)):
        sums = np.concatenate([[0], np.cumsum(row)])
        good = [j - i for i in range(side + 1) for j in range(max(side + 1, i + substring_dedup.LEAST), wide + 1) if 9 * (sums[j] - sums[i]) >= 8 * (j - i)]
        assert stop - start == max(good, default=0)
        assert stop == 0 or (start <= side < stop and 9 * (sums[stop] - sums[start]) >= 8 * (stop - start))


def test_contexts_are_alike_only_if_passages_are():
    rng = np.random.default_rng(9)
    side, wide = substring_dedup._SIDE, substring_dedup._WIDE
    fresh = lambda n: rng.integers(1, 1 << 32, n).astype(np.uint32) | 1
    a, b, kinds = [], [], []
    for n in range(400):
        x, kind = fresh(wide), n % 4
        y = fresh(wide)
        y[side] = x[side]
        if kind < 2:
            lo, hi = side - rng.integers(20, 40), side + rng.integers(25, 40)
            y[lo:hi] = x[lo:hi]
            edited = rng.choice(np.arange(lo, hi), rng.integers(1, 4), False)
            y[edited] = fresh(len(edited))
            if kind:  # shifted to one side of the centre
                y[side + 1 : wide] = np.concatenate([fresh(3), y[side + 1 : wide - 3]])
        elif kind == 2:  # one half of the passage before, the other elsewhere and spread
            y[side - 36 : side] = x[side - 36 : side]
        a.append(x)
        b.append(y)
        kinds.append(kind)
    a, b = np.array(a), np.array(b)
    a0, a1, b0, b1, sim = substring_dedup.alike(a, b)
    for n in range(400):
        if sim[n]:
            x, y = set(a[n, a0[n] : a1[n]].tolist()), set(b[n, b0[n] : b1[n]].tolist())
            assert len(x & y) / len(x | y) >= 0.8 - 1e-9 and min(a1[n] - a0[n], b1[n] - b0[n]) >= 41
        assert not (kinds[n] > 1 and sim[n])
    assert np.mean([s > 0 for s, k in zip(sim, kinds) if k == 0]) > 0.8
    lo = np.arange(800)
    c = substring_dedup.Contexts(np.concatenate([a, b]), lo, lo)
    found = c.links(np.arange(400), np.arange(400, 800))[0]
    assert set(found) == set(np.flatnonzero(sim))
    assert not len(substring_dedup.Contexts(np.concatenate([a, a]), np.tile(lo[:400], 2), np.tile(lo[:400], 2)).links(np.arange(400), np.arange(400, 800))[0])


def test_edits_in_the_middle_of_longer_passages(spark):
    rng = random.Random(5)
    texts, similar = [], []
    for _ in range(60):
        n, edits = rng.randrange(58, 100), rng.choice([2, 3, 8])
        a = prose(rng, n, 10**6).split()
        b = a[: n // 2 - edits // 2] + prose(rng, edits, 10**6).split() + a[n // 2 - edits // 2 + edits :]
        x, y = ({tuple(t[i : i + 5]) for i in range(n - 4)} for t in (a, b))
        j = len(x & y) / len(x | y)
        # not near the limit, and with no part that is similar by itself
        if j >= 0.81 or (j < 0.75 and n < 80):
            texts += [" ".join(prose(rng, 60, 10**6).split() + t + prose(rng, 60, 10**6).split()) for t in (a, b)]
            similar += [j >= 0.81] * 2
    got = {r["doc_id"] for r in substring_dedup.passages(docs(spark, texts)).collect()}
    assert 20 < sum(similar) < len(similar)
    assert got == {n for n, s in enumerate(similar) if s}


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_verification_does_not_depend_on_batches(size):
    rng = np.random.default_rng(2)
    wide = substring_dedup._WIDE
    base = rng.integers(1, 1 << 32, (3, wide)).astype(np.uint32) | 1
    rows = []
    for k in range(5):
        for t in range(20):
            c = base[t % 3].copy() if t < 12 else rng.integers(1, 1 << 32, wide).astype(np.uint32) | 1
            if t < 12:
                c[rng.integers(0, wide, 2)] = rng.integers(1, 1 << 32, 2)
            rows.append((k, 0, t, t, t, 100 + t, c.tobytes()))
    schema = pa.schema([(n, pa.int64()) for n in substring_dedup._CONTEXT_NAMES[:-1]] + [("context", pa.binary())])
    batches = (pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[a : a + size]], schema) for a in range(0, len(rows), size))
    got = [r for b in substring_dedup._verified(batches) for r in b.to_pylist()]
    assert len(got) == 60 and all(r["least"] == 100 + r["ck"] % 3 and r["ck"] < 12 for r in got)
    assert all(r["stop"] - r["start"] >= substring_dedup.LEAST and r["similarity"] >= 0.8 for r in got)


def test_rows_that_tell_a_key_is_shared():
    rng = np.random.default_rng(10)
    key, text = rng.integers(0, 60, 500), np.sort(rng.integers(0, 30, 500))
    known = substring_dedup.known_shared(key, text)
    for k in range(60):
        own = text[key == k]
        left = text[(key == k) & ~known]
        assert len(left) == len(set(left)) == 2 if len(set(own)) > 1 else len(left) == len(own)
    assert not len(substring_dedup.known_shared(key[:0], text[:0]))


# --- 3 and 5 tokens ---------------------------------------------------------------------------------------------------

needs_ranks = pytest.mark.skipif(not os.path.exists(RANKS), reason="no rank file")


@needs_ranks
@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab 's\n\t.é 　 1 𝒳", max_size=60)), max_size=8))
def test_encoder_agrees_with_the_plain_one(texts):
    enc = tokenizer.encoder(tokenizer.Vocabulary.read(RANKS).content)
    ids, n = enc.encode(pa.array(texts, pa.string()))
    expected = [enc.bpe.encode_ordinary(t or "") for t in texts]
    assert n.tolist() == [len(x) for x in expected] and ids.tolist() == list(itertools.chain(*expected))
    assert enc.encode(pa.array(texts, pa.string()), True)[1].tolist() == n.tolist()


@needs_ranks
def test_histogram(spark):
    texts = odd_texts()
    enc = tokenizer.encoder(tokenizer.Vocabulary.read(RANKS).content)
    n = np.array([len(enc.bpe.encode_ordinary(t or "")) for t in texts])
    hist = token_counts.histogram(token_counts.token_counts(extra(docs(spark, texts)), RANKS)).cache()
    for r in hist.collect():
        x = r["n_tokens"]
        assert (r["documents"], r["tokens"]) == ((n == x).sum(), n[n == x].sum())
        assert (r["docs_at_least"], r["tokens_at_least"], r["docs_below"], r["tokens_below"]) == ((n >= x).sum(), n[n >= x].sum(), (n < x).sum(), n[n < x].sum())
        assert r["truncated_total"] == np.minimum(n, x).sum()
    for r in token_counts.at_limits(hist, [0, 3, 512, 10**6]).collect():
        assert r["truncated_total"] == np.minimum(n, r["context_limit"]).sum() and r["truncated_docs"] == (n > r["context_limit"]).sum()
    for q in (0.1, 0.5, 0.99, 1.0):
        assert token_counts.quantile(hist, q).first()[0] == np.sort(n)[int(np.ceil(q * len(n))) - 1]
    assert token_counts.histogram(token_counts.token_counts(docs(spark, []), RANKS)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 1000, 4096, 5001])
def test_feistel_is_a_permutation(n):
    p = token_output.permuted(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    assert n < 1000 or (p != np.arange(n)).mean() > 0.9
    assert n < 1000 or (token_output.permuted(np.arange(n), n, 7) != p).mean() > 0.9


@needs_ranks
def test_token_shards(spark, tmp_path):
    texts = odd_texts()
    d = extra(docs(spark, texts, [*range(len(texts) - 1), None]))
    d.repartition(3).write.parquet(str(tmp_path / "docs"))
    enc = tokenizer.encoder(tokenizer.Vocabulary.read(RANKS).content)
    expected = collections.Counter()
    for n, t in enumerate(texts):
        ids = enc.bpe.encode_ordinary(t or "") + [enc.end]
        for c in range(0, len(ids), 64):
            expected[(None if n == len(texts) - 1 else n), c // 64, tuple(ids[c : c + 64])] += 1
    for source in (d, spark.read.parquet(str(tmp_path / "docs"))):
        layout, manifest = token_output.write_shards(source, f"file://{tmp_path}/{random.random()}", RANKS, 64, 10_000)
        got = list(token_output.read_slots(layout))
        assert [s for s, _, _ in got] == list(range(layout.sequences)) and layout.shards > 2
        assert token_output.Layout.read(layout.path) == layout
        assert collections.Counter((None if h["n"] >= token_output.NO_ID else int(h["doc_id"]), int(h["chunk"]), tuple(x.tolist())) for _, h, x in got) == expected
        resumed = list(token_output.read_slots(layout, layout.per_shard - 2, 5))
        assert [s for s, _, _ in resumed] == list(range(layout.per_shard - 2, layout.per_shard + 3))
        assert all(np.array_equal(x, got[s][2]) for s, _, x in resumed)
        back = token_output.read_back(spark, layout, manifest).toPandas().sort_values("slot")
        assert back["ids_crc32"].tolist() == [zlib.crc32(x.astype("<u2").tobytes()) for _, _, x in got]
        assert back["byte_offset"].tolist() == [s % layout.per_shard * token_output.stride(64) for s, _, _ in got]
        known = back[~back["doc_id"].isna()]
        assert collections.Counter(zip(known["doc_id"].astype(int), known["chunk"], known["n_tokens"])) == collections.Counter((i, c, len(x)) for i, c, x in expected.elements() if i is not None)
    assert token_output.materialise(docs(spark, []), ranks=RANKS).count() == 0


@needs_ranks
def test_token_shards_do_not_depend_on_the_scan(spark, tmp_path, monkeypatch):
    """The second pass sees other splits than the first, as after a change of cores or executors."""
    rng = random.Random(12)
    d = docs(spark, [prose(rng, rng.randrange(1, 400)) for _ in range(600)], [n % 300 for n in range(600)])
    d.repartition(2).write.option("parquet.block.size", 40_000).option("parquet.page.size", 4_000).parquet(str(tmp_path / "docs"))
    number, before = token_output.number_rows, spark.conf.get("spark.sql.files.maxPartitionBytes")
    found, parts = [], []
    for first, second in ((None, None), ("20k", "400k"), ("400k", "20k")):

        def numbered(counts, folder, block, second=second):
            out = number(counts, folder, block)
            if second:
                spark.conf.set("spark.sql.files.maxPartitionBytes", second)
            return out

        monkeypatch.setattr(token_output, "number_rows", numbered)
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", first or before)
            source = spark.read.parquet(str(tmp_path / "docs"))
            parts.append(source.rdd.getNumPartitions())
            layout, manifest = token_output.write_shards(source, f"file://{tmp_path}/{random.random()}", RANKS, 64, 10_000, block=64)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert manifest.agg(F.sum("n_sequences")).first()[0] == layout.sequences
        found.append([(int(h["doc_id"]), int(h["chunk"]), x.tolist()) for _, h, x in token_output.read_slots(layout)])
    assert len(set(parts)) > 1
    assert found[0] == found[1] == found[2] and {i for i, _, _ in found[0]} == set(range(300))


@needs_ranks
def test_shards_that_lack_sequences_are_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "number_rows", lambda *a, number=token_output.number_rows: number(*a) + 1)
    with pytest.raises(Exception, match="shard|slots"):
        token_output.write_shards(docs(spark, ["a b c"] * 30), f"file://{tmp_path}/x", RANKS, 64, 1000)


# --- 4 SimHash --------------------------------------------------------------------------------------------------------


def simhash_of(t):
    w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(ids, fps):
    parent = list(range(len(fps)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            parent[root(j)] = root(i)
    least = {}
    for n, i in enumerate(ids):
        least[root(n)] = min(least.get(root(n), i), i)
    return [least[root(n)] for n in range(len(fps))]


def test_simhash_of_texts(spark):
    rng = random.Random(4)
    base = prose(rng, 400).split()
    near = [" ".join(base[:p] + ["zz"] + base[p + 1 :]).upper() for p in range(0, 400, 37)]
    texts = [*odd_texts(), " ".join(base), *near, " ".join(base)]
    ids = list(range(100, 100 + len(texts)))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(extra(docs(spark, texts, ids))).collect()}
    fps = [simhash_of(t) for t in texts]
    assert [got[i]["fp"] % (1 << 64) for i in ids] == fps
    assert [got[i]["component_id"] for i in ids] == least_reachable(ids, fps)
    one = simhash.one_each(extra(docs(spark, texts, ids)))
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(least_reachable(ids, fps))) and "fp" in one.columns
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.one_each(docs(spark, [])).count() == 0
    assert simhash.one_each(docs(spark, ["a b c"] * 3, [None, None, 1])).count() == 1
    assert simhash.near_duplicates(docs(spark, ["a b c"] * 3, [None, 7, 7])).count() == 3


@pytest.mark.parametrize("tile", [simhash.TILE, 4])
def test_anchors_lose_no_link(spark, tile):
    rng = random.Random(5)
    fps = []
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.append(x)
        for _ in range(6):
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4, 5])):
                x ^= 1 << b
            fps.append(x)
    centre = rng.getrandbits(64)
    fps += [centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12, 20)]
    fps = list(dict.fromkeys(fps))
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), tile).collect()
    parent = {f: f for f in fps}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for r in links:
        a, b = r["a"] % (1 << 64), r["b"] % (1 << 64)
        assert (a ^ b).bit_count() <= 3
        parent[root(a)] = root(b)
    expected = least_reachable(range(len(fps)), fps)
    groups = collections.defaultdict(set)
    for n, f in enumerate(fps):
        groups[root(f)].add(expected[n])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expected))


def test_anchors_are_sent_from_all_tasks(spark, monkeypatch):
    plans = []

    def seen(df, name, write=store.written):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(simhash, "written", seen)
    distinct = spark.range(5000).select(F.xxhash64("id").alias("fp")).groupBy("fp").agg(F.count(F.lit(1)))
    simhash.links(distinct.select("fp")).count()
    plan = dict(plans)["simhash-anchors"]
    assert "REPARTITION_BY_NUM" in plan and plan.index("Generate") < plan.index("REPARTITION_BY_NUM")


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


# --- 6 quality rules --------------------------------------------------------------------------------------------------


def test_boosted_trees_are_monotone_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] + 0.2 * rng.random(3000) > 0.3)).astype(float)
    f = quality_rules.fit(x[:2000], y[:2000], [-1, 1, 0], trees=40)
    assert ((f.probability(x[2000:]) >= 0.5) == (y[2000:] > 0)).mean() > 0.93
    grid = np.linspace(0, 1, 200)
    for col, sign in ((0, -1), (1, 1)):
        for other in rng.random((20, 3)):
            line = np.repeat(other[None], 200, 0)
            line[:, col] = grid
            assert (sign * np.diff(f.probability(line)) >= -1e-12).all()
    for y in (np.zeros(0), np.ones(5)):
        assert (quality_rules.fit(np.zeros((len(y), 3)), y, [0, 0, 0]).probability(x[:4]) > 0.99).all()


def test_fitting_rows_are_bounded_and_do_not_depend_on_their_order(spark, monkeypatch):
    rng = random.Random(13)
    texts = [prose(rng, 30) if n % 2 else "%%% " * 12 for n in range(400)]
    rows = docs(spark, texts * 5, [n % 50 for n in range(2000)])
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(50)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality_rules, "fit", lambda x, y, monotone: seen.append((x.tolist(), y.tolist())))
    for d in (rows, rows.repartition(7)):
        quality_rules.train(d, labels, fit_rows=30)
    assert len(seen[0][1]) == 30 and seen[0] == seen[1]


def test_trees_agree_with_a_walk():
    rng = np.random.default_rng(3)
    x = rng.random((500, 4))
    f = quality_rules.fit(x, (x[:, 0] + x[:, 1] ** 2 > 0.8).astype(float), [0, 1, 0, -1], trees=25)

    def walk(node, row):
        while f.left[node] != node:
            node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
        return f.value[node]

    for row, p in zip(x[:100], f.probability(x[:100])):
        assert p == pytest.approx(1 / (1 + np.exp(-f.bias - sum(walk(r, row) for r in f.roots))))


def test_quality_rules(spark):
    rng = random.Random(6)
    good = [prose(rng, 120) for _ in range(60)]
    junk = [" ".join(w + rng.choice(["***", "%%%"]) for w in prose(rng, 120).split()) for _ in range(60)]
    texts = [*good, *junk, *odd_texts(), " ".join(["again and again and so"] * 9)]
    d = extra(docs(spark, texts))
    labels = spark.createDataFrame([(n, int(n < 60), 0) for n in range(0, 120, 2)] + [(None, 1, 0), (1, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    forest = quality_rules.train(d, labels)
    got = {r["doc_id"]: r for r in quality_rules.apply(d, forest).collect()}
    for n, t in enumerate(texts):
        w, *_, repeat = base_statistics(t or "")
        assert got[n]["base_failed"] == (w < 10 or 100 * repeat > 20 * w) and not (got[n]["base_failed"] and got[n]["kept"])
    assert all(got[n]["kept"] for n in range(60)) and not any(got[n]["kept"] for n in range(60, 120))
    kept = quality_rules.keep_rows(d, forest)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {n for n in got if got[n]["kept"]}
    none = quality_rules.train(d, labels.where("false"))
    assert quality_rules.apply(docs(spark, []), none).count() == 0


# --- 7 sharding -------------------------------------------------------------------------------------------------------


def test_copies_and_missing_ids_are_interleaved(spark):
    rows = [(None, f"t{n}", "en", "a", 1) for n in range(400)] + [(7, "same", "en", "b", 1)] * 9000 + [(n, "x", "en", "c", 1) for n in range(600)]
    d = spark.createDataFrame(rows, DOCS)
    got = sharding.shard_documents(d).toPandas()
    assert len(got) == 10_000 and all(sorted(g["slot"]) == list(range(625)) for _, g in got.groupby("shard"))
    assert got[got["source"] == "a"].groupby("shard").size().between(23, 27).all()
    assert got[got["source"] == "b"].groupby("shard").size().between(560, 565).all()
    names = ["doc_id", "source", "size", "text_crc32", "shard", "slot"]
    table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[3] for r in rows]})
    expected = duck(f"SELECT {', '.join(names)} FROM ({sharding.sql()})", documents=table)
    assert collections.Counter(map(tuple, sharding.shard_documents(d).select(*names).collect())) == expected


def test_sharding(spark):
    rng = random.Random(7)
    sizes = {"hot": 3000, "a": 700, "b": 333, None: 50, **{f"tiny{n}": 1 for n in range(200)}}
    rows = [(rng.randrange(1 << 40), f"t{n}" if n % 9 else None, "en", s, 1) for s, m in sizes.items() for n in range(m)]
    rows += [rows[0]] * 5 + [(None, "x", "en", "a", 1)] * 2
    d = spark.createDataFrame(rows, DOCS)
    got = sharding.shard_documents(extra(d)).toPandas()
    n = len(rows)
    assert len(got) == n and got["shard"].between(0, 15).all()
    per = got.groupby("shard").size()
    assert per.max() - per.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    for s, m in sizes.items():
        own = got[got["source"].isna()] if s is None else got[got["source"] == s]
        count = own.groupby("shard").size().reindex(range(16), fill_value=0)
        # phases of the small sources are random, so equal cuts may fall a few rows early or late
        assert count.max() - count.min() <= 2 + 0.06 * m / 16 * 2, s
    tiny = got[got["source"].fillna("").str.startswith("tiny")].groupby("shard").size()
    assert len(tiny) >= 12
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert collections.Counter((None if x != x else int(x), a, b) for x, a, b in zip(got["doc_id"], got["size"], got["text_crc32"])) == want
    again = sharding.shard_documents(d.repartition(5)).toPandas()
    key = ["doc_id", "text_crc32", "shard", "slot"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert sharding.shard_documents(d.where("false")).count() == 0
    assert sorted(r["slot"] for r in sharding.shard_documents(d.limit(3)).collect()) == [0, 0, 0]


# --- 8 licence scan ---------------------------------------------------------------------------------------------------


def test_license_scan_base(spark):
    texts = ["CC BY, cc-by cc by-nc; All Rights   reserved all rights reserved", "gnu general public LICENSE's", "accby cc bye", *odd_texts()]
    for row in license_scan.digest(license_scan.find_notices(extra(docs(spark, texts)))).collect():
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[row["doc_id"]] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        found = sorted((i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        assert row["n_words"] == len(w) and row["n_base"] == len(found)
        assert (row["first_word"], row["last_word"]) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert row["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1
    assert license_scan.find_notices(docs(spark, [])).count() == 0


def edits_of(a, b):
    """The least edits between a and each beginning of b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row


def has_notice(body, words, most):
    """Whether the notice stands in the body, by a whole table of edits on either side of every place of its telling words."""
    before, _, rest = words.partition("[")
    telling, _, after = rest.partition("]")
    if not telling:
        return regex.search(rb"(?:%s){e<=%d}" % (regex.escape(words.encode()), most), body) is not None
    for m in re.finditer(rb"(?= %s )" % telling.encode(), body):
        left, right = body[: m.start()], body[m.start() + len(telling) + 2 :]
        if min(edits_of(before.rstrip().encode()[::-1], left[::-1])) + min(edits_of(after.lstrip().encode(), right)) <= most:
            return True
    return False


def test_licences_are_told_apart(spark):
    cases = {
        "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa",
        "licenced under CC BY-ND 4.0": "cc-by,cc-by-nd",
        "Licensed under CC-BY-NC-SA 4.0": "cc-by,cc-by-nc-sa",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "Released under the MPL license": "mpl",
        "Releasd under the MIT licence": "mit",
        "SPDX-License-Identifier: Apache-2.0": "apache",
        "SPDX-License-Identifier: MIT": "mit",
        "Licensed under the GNU Affero General Public License": "agpl,gpl",
        "GNU Lesser General Public License": "gpl,lgpl",
        "Released under the Xyz license": "",
    }
    got = license_scan.digest(license_scan.find_notices(docs(spark, [f"before it {t} after it" for t in cases]))).collect()
    assert {list(cases)[r["doc_id"]]: r["labels"] for r in got} == cases


def test_licence_places_are_found_in_linear_time():
    import time

    sought = license_scan.compiled(license_scan.NOTICES)
    took = []
    for n in (2000, 16000):
        began = time.process_time()
        words, spans = license_scan.scan("cc by released under the mit license " * n, license_scan.PHRASES, sought)
        took.append(time.process_time() - began)
        assert words == 7 * n and [s[2] for s in spans if s[1]] == list(range(0, 7 * n, 7)) and sum(s[0] == "mit" for s in spans) == n
    assert took[1] < 24 * took[0]


def test_fuzzy_notices_agree_with_a_whole_search():
    rng = random.Random(8)
    sought = license_scan.compiled(license_scan.NOTICES)
    written = dict(zip([n.text for n in sought], license_scan.NOTICES))
    for _ in range(150):
        notice = rng.choice(sought)
        chars = list(notice.text.decode())
        edits = rng.randrange(notice.most + 3)
        for _ in range(edits):
            p = rng.randrange(len(chars))
            rng.choice([lambda p=p: chars.__setitem__(p, rng.choice("xyz ")), lambda p=p: chars.insert(p, "q"), lambda p=p: chars.pop(p)])()
        text = prose(rng, 30) + " " + "".join(chars) + " " + prose(rng, 30)
        body, _ = license_scan.normal(text)
        found = {n.text for n in sought if list(license_scan.matches(body, n))}
        assert found == {n.text for n in sought if has_notice(body, written[n.text], n.most)}
        assert edits > notice.most or notice.telling or notice.text in found
        spans = license_scan.scan(text, {}, sought)[1]
        assert bool(spans) == bool(found) and all(a[3] <= b[2] for a, b in zip(spans, spans[1:]))


# --- 9 mixing ---------------------------------------------------------------------------------------------------------


def expected_shares(spark, rows, target, share):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, w long")
    raked = mixing.fitted(df, target, "w", share)
    got = mixing.calibrated(df, raked, target).toPandas()
    got["e"] = got["w"] * got["_probability"]
    assert got["_probability"].between(0, 1).all()
    return got, {(r["dimension"], r["value"]): r for r in mixing.margins(raked, target).collect()}


def test_raking_holds_margins(spark):
    rng = random.Random(9)
    target = {"source": {"a": 1.0, "b": 1.0, "gone": 3.0}, "lang": {"x": 0.7, "y": 0.3}}
    rows = [(n, rng.choice("aaaabz"), rng.choice("xyy"), rng.randrange(1, 50)) for n in range(500)]
    got, table = expected_shares(spark, rows, target, 0.2)
    total = got["w"].sum()
    assert got["e"].sum() == pytest.approx(0.2 * total)
    named = got.groupby("source")["e"].sum()
    rest = got.loc[got.source == "z", "w"].sum()
    assert named["z"] == pytest.approx(0.2 * rest) and named["a"] == pytest.approx(named["b"]) == pytest.approx(0.1 * (total - rest))
    lang = got.groupby("lang")["e"].sum()
    assert lang["x"] / got["e"].sum() == pytest.approx(0.7, abs=5e-4)
    assert table["source", "*"]["target"] is None and not any(r["whole"] for r in table.values())
    for (dim, value), r in table.items():
        if value != "*":
            assert r["expected"] == pytest.approx(got.loc[got[dim] == value, "e"].sum())
    with pytest.warns(UserWarning, match="margins miss"):
        expected_shares(spark, [(0, "a", "x", 10), (1, "b", "y", 10)], {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}, 0.2)
    with pytest.raises(ValueError, match="bound"):
        mixing.fitted(spark.createDataFrame(rows, "doc_id long, source string, lang string, w long"), {c: {str(n): 1.0 for n in range(300)} for c in ("source", "lang")}, "w")


def test_targets_out_of_reach_are_kept_whole_and_named(spark):
    """Bounds are inside the fit: what a rare source lacks goes to the others of its dimension, other margins hold."""
    target = {"source": {"a": 12.0, "c": 12.0, "b": 1.0}, "lang": {"x": 0.7, "y": 0.3}}
    rows = [(n, "b" if n in (7, 8) else "ac"[n % 2], "xyy"[n % 3], 10) for n in range(2000)]
    got, table = expected_shares(spark, rows, target, 0.25)
    share = got.groupby("source")["e"].sum() / got["e"].sum()
    assert (got.loc[got.source == "b", "_probability"] > 1 - 1e-6).all() and share["a"] == pytest.approx(share["c"])
    assert {v for (d, v), r in table.items() if r["whole"]} == {"b"}
    lang = got.groupby("lang")["e"].sum() / got["e"].sum()
    assert abs(lang["x"] - 0.7) < 1e-3 and got["e"].sum() == pytest.approx(0.25 * 20_000)


def test_mixing_agrees_with_sql(spark):
    rng = random.Random(15)
    texts = [prose(rng, rng.randrange(0, 60), 300).replace("w1", "É") for _ in range(400)] + [None, "", " "]
    d = docs(spark, texts).withColumn("source", F.concat(F.lit("src"), (F.col("doc_id") % 22).cast("string"))).withColumn("lang", F.when(F.col("doc_id") % 7 > 0, F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr"), F.lit("es")), (F.col("doc_id") % 4 + 1).cast("int"))))
    got = mixing.mix(d)
    names = ["doc_id", "source", "lang", "topic", "n_tokens", "sampled"]
    table = pa.Table.from_pandas(d.toPandas(), preserve_index=False)
    assert collections.Counter(map(tuple, got.select(*names).collect())) == duck(f"SELECT {', '.join(names)} FROM ({mixing.sql()})", documents=table)
    p = dict(duck(f"SELECT doc_id, probability FROM ({mixing.sql()})", documents=table).keys())
    assert all(abs(p[r["doc_id"]] - r["probability"]) < 2e-6 for r in got.collect())
    topics = collections.Counter(r["topic"] for r in got.collect())
    assert set(topics) == {None, "t0", "t1", "t2", "t3"}


def test_missing_ids_are_drawn_by_their_texts(spark):
    rng = random.Random(16)
    d = docs(spark, [prose(rng, 20) for _ in range(400)], [None] * 400)
    assert 50 < sum(r["sampled"] for r in mixing.mix(d, {"lang": {"en": 1.0}}).collect()) < 150


def test_mixing_edge_cases(spark):
    d = extra(docs(spark, odd_texts())).withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.lit("src1"))).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.lit("en")))
    got = {r["doc_id"]: r for r in mixing.mix(d).collect()}
    assert [got[n]["n_tokens"] for n in range(len(got))] == [len(words_of(t)) for t in odd_texts()]
    kept = mixing.sample(d)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {n for n in got if got[n]["sampled"]}
    assert mixing.mix(d.where("false")).count() == 0 and mixing.sample(d.where("false")).count() == 0


# --- 10 decontamination -----------------------------------------------------------------------------------------------


def test_decontamination_against_all_pairs(spark):
    rng = random.Random(10)
    items = [prose(rng, n, 300) for n in (5, 6, 8, 14, 20, 33, 60)] + ["four words are few", "one", None, "", prose(rng, 20, 300)]
    items.append(items[4])
    texts = []
    for n, item in enumerate(items[:7]):
        w = item.split()
        for drop in (0, 1, len(w) // 6, len(w) // 3):
            cut = w[drop:] if n % 2 else w[: len(w) - drop]
            texts.append(f"{prose(rng, 200)} {' '.join(cut).upper()}\n{prose(rng, 900)}")
    texts += [items[3], *odd_texts(), prose(rng, 3000, 300), f"{prose(rng, 30)} Four words are few {prose(rng, 9)}", "Four words are fewer", "four words  are\nfew", "ONE, more one"]
    bench = spark.createDataFrame([(n, t) for n, t in enumerate(items)] + [(None, items[6])], "item_id long, text string")
    shingles = lambda t, k: {tuple(w[i : i + k]) for w in [words_of((t or "").lower())] for i in range(len(w) - k + 1)}
    expected = {}
    for (d, t), (i, item) in itertools.product(enumerate(texts), [*enumerate(items), (None, items[6])]):
        k = min(5, len(words_of(item)))
        s = shingles(item, k) if k else set()
        n = len(s & shingles(t, k)) if k else 0
        if s and n >= 0.8 * len(s) - 1e-9:
            expected[d, i] = (len(s), n)
    df = extra(docs(spark, texts))
    got = {(r["doc_id"], r["item_id"]): (r["n_item_shingles"], r["n_shared"]) for r in decontamination.contaminated(df, bench.withColumn("hash", F.lit(1))).collect()}
    assert got == expected and len(expected) > 15 and sum(i == 7 for _, i in expected) == 2 and sum(i == 8 for _, i in expected) == 2
    whole = [pa.table({"doc_id": range(len(texts)), "text": texts}), pa.table({"item_id": range(len(items)), "text": items})]
    sql = duck(f"SELECT doc_id, item_id, n_item_shingles, n_shared FROM ({decontamination.SQL})", documents=whole[0], benchmark=whole[1])
    assert sql == collections.Counter((d, i, *x) for (d, i), x in expected.items() if i is not None)
    kept = decontamination.clean(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in expected}
    assert decontamination.contaminated(docs(spark, []), bench).count() == 0 and decontamination.clean(df, bench.where("false")).count() == len(texts)
    twice = docs(spark, [items[5]] * 3 + ["x"], [None, 1, 1, 1])
    assert decontamination.clean(twice, bench).count() == 1 and decontamination.contaminated(twice, bench).count() == 3


# --- the shared folder and the pipeline -------------------------------------------------------------------------------


def test_files_appear_whole(tmp_path):
    uri = f"file://{tmp_path}/a/b.bin"
    with pytest.raises(RuntimeError):
        with store.WholeFile(uri) as f:
            f.write(b"x")
            raise RuntimeError
    assert not any(os.scandir(tmp_path / "a"))
    with store.WholeFile(uri) as f:
        f.write(b"xyz")
    with store.reader(uri) as f:
        assert f.read() == b"xyz"


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(dict)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        store.shared_dir(Session())


def test_rows_are_located_whatever_the_scan(spark, tmp_path):
    d = docs(spark, [f"t{n}" for n in range(50)])
    d.repartition(2).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    for source in (d, read, read.where("doc_id < 40"), read.unionByName(read), read.withColumn("_metadata", F.lit(1))):
        got = store.located(source, "doc_id")
        assert got.count() == source.count() == got.select("_file", "_row").distinct().count()
    kept = store.written(d, "kept")
    store.discard(kept)
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|not found|No such"):
        spark.read.parquet(kept._voxlattice_path).count()


@needs_ranks
def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    clean = [prose(rng, rng.randrange(60, 200)) for _ in range(60)]
    item = prose(rng, 25)
    leak = f"{prose(rng, 100)} {item} {prose(rng, 100)}"
    junk = [" ".join(w + "%%%" for w in prose(rng, 100).split()) for _ in range(30)]
    texts = [*clean, *clean[:5], leak, *junk, None, "", "short text"]
    d = docs(spark, texts).withColumn("source", F.concat(F.lit("src"), (F.col("doc_id") % 4).cast("string")))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(n, int(n < 66), 0) for n in range(0, 96)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        at = store.written(stage(spark, at, str(tmp_path)), name)
        seen[name] = at
        if name != "token_output":
            assert at.columns == d.columns
    ids = lambda name: sorted(r["doc_id"] for r in seen[name].collect())
    assert ids("quality_rules") == list(range(66))
    fps = [simhash_of(t) for t in texts[:66]]
    assert ids("simhash_near_dedup") == sorted(set(least_reachable(range(66), fps)))
    assert ids("benchmark_decontamination") == [n for n in ids("simhash_near_dedup") if n != 65]
    assert set(ids("source_mixing")) <= set(ids("benchmark_decontamination")) and ids("source_mixing")
    enc = tokenizer.encoder(tokenizer.Vocabulary.read(RANKS).content)
    expected = sorted((n, len(enc.bpe.encode_ordinary(texts[n])) + 1) for n in ids("source_mixing"))
    got = seen["token_output"].groupBy("doc_id").agg(F.sum("n_tokens")).collect()
    assert sorted(map(tuple, got)) == expected
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, seen["token_output"].collect()))


@needs_ranks
def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(17)
    texts = [*odd_texts(), *[prose(rng, 80) for _ in range(30)]]
    rows = extra(docs(spark, texts, [None, None, *range(len(texts) - 2)]))
    rows = rows.unionByName(rows).withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.lit("src1")))
    for name, d in (("odd", rows), ("none", rows.where("false"))):
        at = str(tmp_path / name)
        d.write.parquet(f"{at}/documents.parquet")
        labels = spark.createDataFrame([(n, n % 2, 0) for n in range(12)], "doc_id long, quality int, toxic int")
        labels.where("false" if name == "none" else "true").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(0, texts[20]), (1, None), (None, "")], "item_id long, text string").where("false" if name == "none" else "true").write.parquet(f"{at}/benchmark.parquet")
        got = corpus_pipeline.run(spark, at)
        assert got.count() == 0 if name == "none" else got.select("slot").distinct().count() == got.count()
