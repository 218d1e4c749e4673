"""Splits don't depend on a size from which counts are rounded."""

import numpy as np
import pytest

from cellmend.llm import splits
from cellmend.llm.splits import Counts, place, settle, stratified
from test_splits import _records


def test_no_size_changes_a_split(spark, monkeypatch):
    targets = {"train": 0.8, "validation": 0.1, "test": 0.1}
    _, df = _records(spark, 6000, 7)
    runs = []
    for rows, cells in ((200_000, 20_000_000), (30, 20_000_000), (200_000, 7)):
        monkeypatch.setattr(splits, "CLASS_ROWS", rows)
        monkeypatch.setattr(splits, "CLASS_CELLS", cells)
        monkeypatch.setattr(splits, "HEAD", 20)
        runs.append({r.grp: r.split for r in stratified(spark, df, "grp", "lab", targets).collect()})
    assert runs[0] == runs[1] == runs[2]


@pytest.mark.parametrize("seed", range(4))
def test_entries_are_placed_as_the_table_is(seed):
    rng = np.random.default_rng(seed)
    table, members, shares = rng.integers(0, 3, (40, 6)) * rng.integers(1, 9, (40, 1)), rng.integers(1, 5, 40), np.array([0.8, 0.1, 0.1])
    row, label = np.nonzero(table)
    sparse = Counts(np.searchsorted(row, np.arange(41)), label, table[row, label], 6)
    done = settle(place(table, members, shares), table, shares)
    assert (done == settle(place(sparse, members, shares), sparse, shares)).all() and (done.sum(axis=1) == members).all()
