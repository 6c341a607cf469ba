"""Filters whose number follows the table: recall, growth of the pairs compared, links counted once."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewake.llm import near_vectors as module
from tidewake.llm.near_vectors import codes, filters_of, shape, threshold


def units(n, d, seed=1):
    rows = np.random.default_rng(seed).standard_normal((n, d))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def listed(rows, words):
    book = codes(rows.shape[1], words)
    return [f for at in range(0, len(rows), 500) for f in filters_of(rows[at : at + 500], book)]


@pytest.mark.parametrize("d", [2, 3, 4, 8, 16, 64, 384])
@pytest.mark.parametrize("rows", [100, 10_000, 1_000_000])
def test_recall_holds_at_every_size(d, rows):
    rng = np.random.default_rng(6)
    a, b = units(300, d, 7), rng.standard_normal((300, d))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + (1 - 0.95**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    words = shape(rows, d)[0]
    assert np.mean([len(np.intersect1d(f, g)) > 0 for f, g in zip(listed(a, words), listed(b, words))]) >= 0.95


def test_pairs_compared_grow_with_the_rows():
    pairs = []
    for n in (4_000, 16_000):
        _, times = np.unique(np.concatenate(listed(units(n, 64), shape(n, 64)[0])), return_counts=True)
        pairs.append((times * (times - 1) // 2).sum())
    assert np.log(pairs[1] / pairs[0]) / np.log(4) < 1.3


def test_a_random_vector_has_the_filters_foretold():
    for d, words in ((16, 128), (64, 256), (384, 128)):
        _, own = threshold(d, words * words)
        found = np.mean([len(f) for f in listed(units(600, d, 3), words)])
        assert 0.75 * own < found < 1.5 * own


def test_shapes_are_bounded():
    for d in (1, 2, 3, 5, 8, 64, 768):
        for rows in (0, 1, 1000, 10**6, 10**9):
            words, span = shape(rows, d)
            assert module.LEAST_CODEWORDS <= words < 2**17 and 1 <= span <= words
    assert shape(10**6, 64)[0] > 2 * shape(10**5, 64)[0]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(2, 40), st.integers(1, 4), st.sampled_from([3, 1024]))
def test_links_of_a_bucket_are_counted_once(seed, n, span_count, tile):
    """Over all buckets and blocks: every pair that shares a filter and is near counts once."""
    rng = np.random.default_rng(seed)
    vectors = units(4, 6, seed % 97)[rng.integers(0, 4, n)] + rng.standard_normal((n, 6)) * 0.08
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    filters = [np.unique(rng.integers(0, 12, rng.integers(1, 6))) for _ in range(n)]
    copies, block = rng.integers(1, 4, n), rng.integers(0, 3, n)
    span = 12 // span_count
    counts, label = np.zeros(n, int), np.arange(n)
    old, module.TILE = module.TILE, tile
    try:
        for bucket in range(-(-12 // span)):
            at = np.array([i for i in range(n) if any(f // span == bucket for f in filters[i])], int)
            for i in range(3):
                for j in range(i, 3):
                    rows = at[(block[at] == i) | (block[at] == j)]
                    if not len(rows):
                        continue
                    more, roots, _ = module._links_of(
                        vectors[rows], [filters[r] for r in rows], copies[rows], block[rows], i, j, bucket * span, (bucket + 1) * span, 0.95)
                    counts[rows] += more
                    label = module._joined(label, rows, rows[roots])
    finally:
        module.TILE = old
    shared = np.array([[bool(set(f) & set(g)) for g in filters] for f in filters])
    linked = (vectors @ vectors.T >= 0.95) & shared
    np.fill_diagonal(linked, False)
    assert (counts == linked @ copies).all()
    assert (label == module._forest(linked)).all()
