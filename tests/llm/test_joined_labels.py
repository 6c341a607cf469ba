"""Labels of components that grow edge list by edge list keep what earlier lists have linked."""

import numpy as np

from tidewake.llm.near_vectors import _forest, _joined


def test_two_new_edges_at_one_component():
    """3 and 4 are one component; new edges link 4 with 1 and 3 with 0."""
    label = _joined(np.arange(5), np.array([3]), np.array([4]))
    assert _joined(label, np.array([4, 3]), np.array([1, 0])).tolist() == [0, 0, 2, 0, 0]


def test_edges_in_parts_equal_all_at_once():
    rng = np.random.default_rng(1)
    for _ in range(500):
        n = rng.integers(2, 40)
        linked = np.triu(rng.random((n, n)) < 0.05, 1)
        a, b = np.nonzero(linked)
        order, label = rng.permutation(len(a)), np.arange(n)
        for part in np.array_split(order, 4):
            label = _joined(label, a[part], b[part])
        assert (label == _forest(linked | linked.T)).all()
