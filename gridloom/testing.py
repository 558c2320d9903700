"""Comparison of gridded answers and measurement of runs."""

from __future__ import annotations

import resource
import statistics
import subprocess
import sys
import time
from collections.abc import Callable

import numpy as np

from .dataset import GridDataset


def assert_grid_close(got: GridDataset, want: GridDataset, rtol: float = 1e-7, atol: float = 0.0) -> None:
    """The variables of want in got, cell by cell by the labels of their axes, in whatever order axes and labels are; NaN equals NaN. Axes must hold the same labels, so that missing cells are a fault."""
    for name, v in want.data.items():
        assert name in got.data, f"{name} is missing"
        found = got.data[name]
        assert set(found.dims) == set(v.dims), f"{name} has dimensions {found.dims}, not {v.dims}"
        values = np.transpose(found.values, [found.dims.index(d) for d in v.dims])
        for axis, d in enumerate(v.dims):
            if d not in want.coords or d not in got.coords:
                continue
            have, need = got.coords[d].values, want.coords[d].values
            assert len(have) == len(need) and np.array_equal(np.sort(have), np.sort(need)), f"{d} has other labels"
            values = np.take(values, np.argsort(have)[np.argsort(np.argsort(need))], axis)
        np.testing.assert_allclose(np.asarray(values, float), np.asarray(v.values, float), rtol=rtol, atol=atol, equal_nan=True, err_msg=name)


def timed(run: Callable[[], object], times: int = 3) -> dict[str, float]:
    """Seconds of so many runs: median, deviation, least and most."""
    found = []
    for _ in range(times):
        start = time.perf_counter()
        run()
        found.append(time.perf_counter() - start)
    return {"median": round(statistics.median(found), 3), "stdev": round(statistics.stdev(found), 3) if times > 1 else 0.0, "min": round(min(found), 3), "max": round(max(found), 3)}


def cold(code: str, times: int = 3) -> dict[str, float]:
    """The same for code that a process of its own runs each time, with the largest resident size of any of them and their children in MB."""
    found = timed(lambda: subprocess.run([sys.executable, "-c", code], check=True, capture_output=True), times)
    return found | {"peak_mb": round(resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss / 1024)}
