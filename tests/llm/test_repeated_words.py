"""Texts that say a word again and again: few nodes, and passages that are alike all the same."""

import numpy as np

from voxlattice.llm import substring_dedup as sd


def test_repeated_values_have_few_nodes_and_every_run_has_one():
    rng = np.random.default_rng(3)
    least = sd.LEAST
    for _ in range(20):
        values = np.concatenate([np.repeat(rng.integers(0, 1 << 63, 1), rng.integers(1, 400)) if rng.random() < 0.5 else rng.integers(0, 1 << 63, rng.integers(1, 120)) for _ in range(6)]).astype(np.uint64)
        cut = int(rng.integers(0, len(values)))
        text, left, c, right = sd.compact_windows(values, np.array([0, cut, len(values)]))
        for a, b in ((0, cut), (cut, len(values))):
            for i in range(a, b - least + 1):
                run = values[i : i + least]
                assert any(lo <= i <= m < i + least <= hi + 1 and values[m] == run.min() for lo, m, hi in zip(left, c, right))
    # before, each of a thousand equal values was a node
    values = np.concatenate([rng.integers(0, 1 << 63, 50), np.full(1000, 5), rng.integers(0, 1 << 63, 50)]).astype(np.uint64)
    assert (values[sd.compact_windows(values, np.array([0, len(values)]))[2]] == 5).sum() <= 2 + 1000 // least


def test_passages_of_repeated_codes_are_alike_wherever_their_centres_are():
    rng = np.random.default_rng(4)
    fresh = lambda n: rng.integers(1, 1 << 32, n).astype(np.uint32) | 1
    tail = fresh(20)

    def context(times, centre):
        row, whole = np.zeros(sd._WIDE, np.uint32), np.concatenate([np.full(times, 9, np.uint32), tail])
        for at, code in enumerate(whole, sd._SIDE - centre):
            if 0 <= at < sd._WIDE:
                row[at] = code
        return row

    a = np.array([context(30, 12), context(30, 2), context(30, 29)])
    b = np.array([context(30, 25), context(200, 150), context(90, 60)])
    lo = np.arange(6)
    found, a0, a1, b0, b1, similarity = sd.Contexts(np.concatenate([a, b]), lo, lo).links(np.arange(3), np.arange(3, 6))
    assert found.tolist() == [0, 1, 2] and (similarity >= 0.8).all()
    # one against many goes by the same rule
    one = sd.forest(np.zeros(80, np.int64), sd.Contexts(np.array([context(30 + n, 5 + n // 2) for n in range(80)]), np.arange(80), np.arange(80)))
    assert len(set(one[3].tolist())) == 1
