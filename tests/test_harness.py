import numpy as np
import pytest

from gridloom.dataset import GridDataset
from gridloom.testing import assert_grid_close, cold, timed


def test_grids_are_compared_by_label():
    v = np.arange(6.0).reshape(2, 3)
    v[1, 1] = np.nan
    want = GridDataset({"v": (("a", "b"), v)}, {"a": np.array([1, 2]), "b": np.array([10, 20, 30])})
    turned = GridDataset({"v": (("b", "a"), v[:, [2, 0, 1]].T), "w": (("a",), np.zeros(2))}, {"a": np.array([1, 2]), "b": np.array([30, 10, 20])})
    assert_grid_close(turned, want)
    with pytest.raises(AssertionError, match="labels"):
        assert_grid_close(want.isel({"b": slice(0, 2)}), want)
    with pytest.raises(AssertionError):
        assert_grid_close(GridDataset({"v": (("a", "b"), v + 1)}, want.coords), want)
    with pytest.raises(AssertionError, match="missing"):
        assert_grid_close(GridDataset({}, want.coords), want)


def test_runs_are_measured():
    found = timed(lambda: None, 4)
    assert found["min"] <= found["median"] <= found["max"] and found["stdev"] >= 0
    assert cold("x = bytearray(30_000_000)", 2)["peak_mb"] >= 30
