"""Keys with more nodes than a tile, filled with templates whose slots vary: links against all pairs."""

import collections

import numpy as np
import pytest

from voxlattice.llm import store, substring_dedup as sd

CONTEXT = "key long, part long, ck long, lo long, hi long, least long, context binary"


def templates(n, slots, seed):
    """n contexts of 13 blocks of 14 shingles, each block one of `slots` variants: related in part, and widely."""
    rng = np.random.default_rng(seed)
    blocks = rng.integers(1, 2**32, (13, slots, 14), dtype=np.uint64).astype(np.uint32)
    codes = np.concatenate([blocks[b][rng.integers(0, slots, n)] for b in range(13)], 1)[:, : sd._WIDE]
    codes[:, sd._SIDE] = 7
    return np.unique(codes, axis=0)


def all_pairs(codes):
    """Components of all links, and each node's span over all its links."""
    n = len(codes)
    ids = np.arange(n)
    contexts = sd.Contexts(codes, ids, ids)
    i, j = np.triu_indices(n, 1)
    which, s0, s1, t0, t1, _ = contexts.links(i, j)
    root = ids.copy()
    while True:
        before = root.copy()
        low = np.minimum(root[i[which]], root[j[which]])
        np.minimum.at(root, i[which], low)
        np.minimum.at(root, j[which], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    start, stop = np.full(n, sd._WIDE), np.zeros(n, np.int64)
    for x, a, b in ((i[which], s0, s1), (j[which], t0, t1)):
        np.minimum.at(start, x, a)
        np.maximum.at(stop, x, b)
    return root, start, stop


@pytest.mark.parametrize("slots", [6, 4, 20])
@pytest.mark.parametrize("tile,levels", [(128, 0), (300, 0)])
def test_nodes_and_components_equal_all_pairs(spark, slots, tile, levels):
    codes = templates(420, slots, slots)
    root, start, stop = all_pairs(codes)
    rows = [(5, len(codes), n, n, n, n, c.tobytes()) for n, c in enumerate(codes)]
    hot = store.written(spark.createDataFrame(rows, CONTEXT).repartition(3), "test-hot")
    found = sd._verified_apart(hot, 0, levels, tile, 4)
    least, lo, hi = {}, {}, {}
    for v in sd._one_class(found):
        for r in v.collect():
            least[r["ck"]] = min(least.get(r["ck"], r["least"]), r["least"])
            lo[r["ck"]], hi[r["ck"]] = min(lo.get(r["ck"], 999), r["start"]), max(hi.get(r["ck"], -999), r["stop"])
    linked = {n for n in range(len(codes)) if stop[n]}
    assert set(least) == linked
    groups = lambda of: {frozenset(g) for g in collections.defaultdict(set, {k: {n for n in linked if of(n) == k} for k in {of(n) for n in linked}}).values()}
    assert groups(lambda n: least[n]) == groups(lambda n: int(root[n]))
    # no span is longer than that of all links
    assert all(lo[n] + sd._SIDE >= start[n] and hi[n] + sd._SIDE <= stop[n] for n in linked)


def test_rows_that_are_alone_meet_every_other(spark):
    codes = templates(200, 6, 1)
    ids = np.arange(len(codes))
    root, start, stop = all_pairs(codes)
    alone = np.zeros(len(codes), bool)
    alone[::3] = True
    got = sd.forest(np.zeros(len(codes), np.int64), sd.Contexts(codes, ids, ids), alone)
    # what is alone has the span of all its links
    assert (got[0][alone] == np.where(stop[alone] > 0, start[alone], 0)).all() and (got[1][alone] == stop[alone]).all()
