"""Results do not depend on whether a key has more nodes than a tile."""

import collections
import random

import numpy as np
import pytest

from test_large_keys import CONTEXT, templates
from voxlattice.llm import store, substring_dedup as sd


def whole(codes, ck):
    """Classes and spans by definition: all links, each node's first, and what is first of others."""
    n = len(codes)
    order = np.argsort(ck)
    codes, ids = codes[order], order
    i, j = np.triu_indices(n, 1)
    which, s0, s1, t0, t1, _ = sd.Contexts(codes, ids, ids).links(i, j)
    first = {}
    for a, b, *ends in zip(i[which].tolist(), j[which].tolist(), s0.tolist(), s1.tolist(), t0.tolist(), t1.tolist()):
        first.setdefault(a, (b, ends[:2], ends[2:]))
        if b not in first or first[b][0] > a:
            first[b] = (a, ends[2:], ends[:2])
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for a, b in zip(i[which].tolist(), j[which].tolist()):
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    spans = collections.defaultdict(list)
    for a, (b, mine, theirs) in first.items():
        spans[a].append(mine)
        spans[b].append(theirs)
    least = collections.defaultdict(lambda: n)
    for a in first:
        least[root[a]] = min(least[root[a]], int(ids[a]))
    return {int(ck[ids[a]]): (min(x for x, _ in v) - sd._SIDE, max(x for _, x in v) - sd._SIDE, least[root[a]]) for a, v in spans.items()}


@pytest.mark.parametrize("slots,tile,leaders", [(2, 130, 5), (4, 50, 20), (6, 130, 0)])
def test_large_keys_have_the_classes_and_spans_of_small_ones(spark, slots, tile, leaders):
    codes = templates(220, slots, slots)
    ck = np.random.default_rng(slots).integers(-(1 << 63), 1 << 63, len(codes))
    rows = [(5, len(codes), int(k), n, n, n, c.tobytes()) for n, (k, c) in enumerate(zip(ck, codes))]
    hot = store.written(spark.createDataFrame(rows, CONTEXT).repartition(3), "test-hot")
    verdicts = [r for v in sd._one_class(sd._verified_apart(hot, 0, 0, tile, leaders)) for r in v.collect()]
    got = {r["ck"]: (r["start"], r["stop"], r["least"]) for r in verdicts}
    expected = whole(codes, ck)
    assert len(expected) > 10 and got == expected
    # a key that is verified at once, and one of few nodes
    for some in (np.arange(len(codes)), np.arange(60)):
        expected = whole(codes[some], ck[some])
        batch = [r for r in sorted(rows, key=lambda r: r[2]) if r[3] in set(some.tolist())]
        table = sd.pa.Table.from_pylist([dict(zip(sd._CONTEXT_NAMES, r)) for r in batch])
        got = [r for b in sd._verified(iter(table.to_batches())) for r in b.to_pylist()]
        assert {r["ck"]: (r["start"], r["stop"], r["least"]) for r in got} == expected


def test_passages_are_the_same_for_all_tiles(spark):
    """A phrase that all texts have, and pairs, templates and chains around it."""
    rng = random.Random(9)
    body = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    phrase, texts = body(30), []
    for k in range(12):
        before, after = body(25), body(25)
        for _ in range(1 + k % 4 * 3):
            own = before + phrase + after
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(body(rng.randrange(20)) + own[rng.randrange(12) : 80 - rng.randrange(12)] + body(rng.randrange(20))))
    docs = store.written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "test-docs")
    one, *others = (sorted(sd.passages(docs, tile=tile).collect()) for tile in (sd.TILE, 10))
    assert len(one) > 30 and all(one == o for o in others)
