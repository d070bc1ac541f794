"""Recall and selectivity of the walk keys, without the exact check."""

import random

import numpy as np
import pytest

from agoralens.llm import decontaminate as dc

RNG = np.random.default_rng(2)


def fresh(n):
    return RNG.integers(2, 2**63, n, dtype=np.uint64)


def block_of(item):
    """A block with the one item given by its word hashes, made as `block` makes it."""
    dc_hashes = dc.word_hashes
    try:
        dc.word_hashes = lambda texts: (item, np.zeros(len(item), np.int64))
        return dc.block([(1, "x")], dc.TOLERANCE)
    finally:
        dc.word_hashes = dc_hashes


def edited(item, edits, mode, rng):
    words, n = list(item), len(item)
    places = sorted(rng.sample(range(n), edits)) if mode == "random" else [(k + 1) * n // (edits + 1) for k in range(edits)]
    for at in reversed(places):
        kind = rng.randrange(3) if mode == "random" else 0
        words[at : at + (kind != 1)] = [] if kind == 2 else [fresh(1)[0]]
    return np.array(words, dtype=np.uint64)


@pytest.mark.parametrize("mode", ["random", "even"])
@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 8, 10, 15, 25, 40, 100])
def test_recall_of_the_keys_at_full_tolerance(size, mode):
    """Even edits are the worst: every run between them is as short as it can be."""
    rng, found, tries = random.Random(size), 0, 120
    for _ in range(tries):
        item = fresh(size)
        changed = edited(item, int(dc.TOLERANCE * size), mode, rng)
        words = np.concatenate([fresh(30), changed, fresh(30)])
        starts, _ = block_of(item).candidates(words, np.full(len(words), len(words)))
        found += bool((np.abs(starts - 30) <= int(dc.TOLERANCE * size)).any())
    assert found >= 0.97 * tries if int(dc.TOLERANCE * size) else found == tries


def test_keys_reject_other_windows():
    """Of windows of words drawn alike from a small vocabulary, with frequent ones, few are candidates."""
    vocabulary = fresh(3000)
    p = 1 / np.arange(1, 3001)
    p /= p.sum()
    item, words = (RNG.choice(vocabulary, n, p=p) for n in (40, 200_000))
    starts, _ = block_of(item).candidates(words, np.full(len(words), len(words)))
    assert len(starts) < 0.01 * len(words)


def test_keys_are_those_of_a_plain_walk():
    words, texts = fresh(40), [(0, 7), (7, 8), (8, 25), (25, 40)]
    ends = np.concatenate([np.full(b - a, b) for a, b in texts])
    for walk in range(dc.WALKS):
        got = dc.keys(words, ends, walk, sorted(dc.SAMPLED))
        for c, steps in dc.SAMPLED.items():
            read = {}
            for k in range(40):
                at, out = k, []
                for step in range(steps[-1] + 1):
                    symbol = words[min(at, 39)]
                    if step in steps:
                        out.append(int(symbol))
                    last = at
                    at += int(dc._coins(walk, step, words[min(at, 39) : min(at, 39) + 1])[0])
                assert got[c][1][k] == (last < ends[k])
                read[k] = tuple(out)
            assert len(set(zip(read.values(), got[c][0].tolist()))) == len(set(read.values())) == len(set(got[c][0].tolist()))


def test_windows_that_lack_words_are_not_aligned(monkeypatch):
    """A window with a run of an item's words, but not enough of the others, can't be an item; the best windows stay the same."""
    rng = random.Random(7)
    item = [f"w{k}" for k in range(40)]
    texts = [" ".join([f"x{rng.randrange(500)}" for _ in range(30)] + item[k : k + 10] + [f"y{rng.randrange(500)}" for _ in range(60)]) for k in range(30)]
    near = item.copy()
    near[3], near[20:22] = "other", ["w21", "w20"]
    texts += [" ".join(["a", "b", *near, "c"]), " ".join(item[5:37])]
    block, aligned, real = dc.block([(9, " ".join(item))], 0.2), [], dc.edits
    monkeypatch.setattr(dc, "edits", lambda words, lows, highs, items: aligned.append(len(lows)) or real(words, lows, highs, items))
    rows = [tuple(int(x) for x in r) for r in zip(*dc._searched(texts, block), strict=True)]
    assert [(t, cost) for t, _, _, cost in rows] == [(30, 3), (31, 8)]
    assert len(block.candidates(*dc_words(texts))[0]) > 2 * sum(aligned)


def dc_words(texts):
    """The words of the texts, and for each where its text ends."""
    words, of = dc.word_hashes([dc.normalised(t) for t in texts])
    return words, np.searchsorted(of, np.arange(len(texts) + 1))[of + 1]
