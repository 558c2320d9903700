"""Labelled N-D arrays: named dimensions, coordinates, variables."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd

Chunks = Mapping[str, int] | None


@dataclass
class GridVar:
    dims: tuple[str, ...]
    values: np.ndarray
    attrs: dict = field(default_factory=dict)
    encoding: dict = field(default_factory=dict)

    def __post_init__(self):
        self.dims = (self.dims,) if isinstance(self.dims, str) else tuple(self.dims)
        self.values = np.asarray(self.values)
        if self.values.ndim != len(self.dims):
            raise ValueError(f"{self.values.ndim} axes for dimensions {self.dims}")

    @property
    def shape(self) -> tuple[int, ...]:
        return self.values.shape

    @property
    def dtype(self) -> np.dtype:
        return self.values.dtype

    def at(self, cuts: tuple[slice, ...]) -> np.ndarray:
        """The values of a block."""
        return self.values[cuts]


class BlockVar(GridVar):
    """A variable that is never held as a whole: block, a function that Spark can ship to its workers, gives the values of a tuple of slices. Registering it costs the driver no more than its shape."""

    def __init__(self, dims, shape: tuple[int, ...], dtype, block: Callable[[tuple[slice, ...]], np.ndarray], attrs: dict | None = None, encoding: dict | None = None):
        self.dims = (dims,) if isinstance(dims, str) else tuple(dims)
        self._shape, self._dtype, self.block = tuple(shape), np.dtype(dtype), block
        self.attrs, self.encoding = attrs or {}, encoding or {}
        if len(self._shape) != len(self.dims):
            raise ValueError(f"{len(self._shape)} axes for dimensions {self.dims}")

    shape = property(lambda self: self._shape)
    dtype = property(lambda self: self._dtype)

    def at(self, cuts: tuple[slice, ...]) -> np.ndarray:
        cuts = tuple(slice(*c.indices(n)) for c, n in zip(cuts, self._shape, strict=True))
        out, want = np.asarray(self.block(cuts), self._dtype), tuple(len(range(c.start, c.stop, c.step)) for c in cuts)
        if out.shape != want:
            raise ValueError(f"a block of shape {out.shape} where {want} was asked for")
        return out

    @property
    def values(self) -> np.ndarray:
        return self.at((slice(None),) * len(self.dims))

    def cut(self, at: Mapping[str, slice]) -> BlockVar:
        """The part within slices of step 1, still not read."""
        spans = [range(n)[at.get(d, slice(None))] for d, n in zip(self.dims, self._shape, strict=True)]
        return BlockVar(self.dims, tuple(map(len, spans)), self._dtype, _Shifted(self.block, tuple(r.start for r in spans)), dict(self.attrs), dict(self.encoding))


@dataclass
class _Shifted:
    block: Callable
    start: tuple[int, ...]

    def __call__(self, cuts: tuple[slice, ...]) -> np.ndarray:
        return self.block(tuple(slice(c.start + a, c.stop + a, c.step) for c, a in zip(cuts, self.start, strict=True)))


@dataclass
class NpyBlocks:
    """Blocks of a .npy file that workers map into memory; file must lie in a folder that they share."""

    file: str

    def __call__(self, cuts: tuple[slice, ...]) -> np.ndarray:
        return np.load(self.file, mmap_mode="r")[cuts]


def open_npy(dims, file: str, attrs: dict | None = None) -> BlockVar:
    """A .npy file as a variable whose blocks are read where they are needed."""
    head = np.load(file, mmap_mode="r")
    return BlockVar(dims, head.shape, head.dtype, NpyBlocks(file), attrs)


@dataclass
class GridDataset:
    """data and coords map names to GridVar, or to (dims, values[, attrs[, encoding]]). chunks: existing sizes by dimension."""

    data: dict[str, GridVar]
    coords: dict[str, GridVar] = field(default_factory=dict)
    attrs: dict = field(default_factory=dict)
    chunks: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self):
        as_var = lambda name, v: v if isinstance(v, GridVar) else GridVar(*v) if isinstance(v, tuple) else GridVar((name,), v)
        self.data = {k: as_var(k, v) for k, v in self.data.items()}
        self.coords = {k: as_var(k, v) for k, v in self.coords.items()}
        sizes: dict[str, int] = {}
        for v in itertools.chain(self.data.values(), self.coords.values()):
            for d, n in zip(v.dims, v.shape, strict=True):
                if sizes.setdefault(d, n) != n:
                    raise ValueError(f"dimension {d} has sizes {sizes[d]} and {n}")
        self.sizes = sizes

    @property
    def dim_coords(self) -> dict[str, GridVar]:
        """Coordinates that label an axis, in the order given."""
        return {k: v for k, v in self.coords.items() if v.dims == (k,)}

    def __getitem__(self, name: str) -> GridVar:
        return self.data[name] if name in self.data else self.coords[name]

    def only(self, names) -> GridDataset:
        """With these variables, and the coordinates along their dimensions."""
        data = {n: self.data[n] for n in names}
        dims = {d for v in data.values() for d in v.dims}
        return replace(self, data=data, coords={k: v for k, v in self.coords.items() if set(v.dims) <= dims}, chunks={d: c for d, c in self.chunks.items() if d in dims})

    def isel(self, at: Mapping[str, slice | int | np.ndarray]) -> GridDataset:
        def cut(v: GridVar) -> GridVar:
            own = [at[d] for d in v.dims if d in at]
            if isinstance(v, BlockVar) and all(isinstance(k, slice) and k.step in (None, 1) for k in own):
                return v.cut(at)
            values = v.values
            for axis in reversed(range(len(v.dims))):
                if v.dims[axis] in at:
                    values = values[(slice(None),) * axis + (at[v.dims[axis]],)]
            return replace(v, dims=tuple(d for d in v.dims if not isinstance(at.get(d), int | np.integer)), values=values)

        return GridDataset({k: cut(v) for k, v in self.data.items()}, {k: cut(v) for k, v in self.coords.items()}, dict(self.attrs))

    def chunk(self, spec: Chunks) -> GridDataset:
        return replace(self, chunks=resolve_chunks(self, spec))

    def groups(self) -> dict[tuple[str, ...], list[str]]:
        """Variables by their ordered dimensions."""
        out: dict[tuple[str, ...], list[str]] = {}
        for name, v in self.data.items():
            out.setdefault(v.dims, []).append(name)
        return out

    def to_pandas(self) -> pd.DataFrame:
        """One row a cell; coordinates first, then variables. All variables share their dimensions."""
        dims = next(iter(self.data.values())).dims if self.data else tuple(self.sizes)
        shape = tuple(self.sizes[d] for d in dims)
        cols = {k: np.broadcast_to(v.values.reshape([-1 if d == k else 1 for d in dims]), shape).ravel() for k, v in self.dim_coords.items() if k in dims}
        return pd.DataFrame(cols | {k: v.values.ravel() for k, v in self.data.items()})

    def equals(self, other: GridDataset) -> bool:
        def same(a: GridVar, b: GridVar) -> bool:
            if a.dims != b.dims or a.values.shape != b.values.shape:
                return False
            return bool(np.array_equal(a.values, b.values, equal_nan=a.values.dtype.kind in "fcmM"))

        return all(x.keys() == y.keys() and all(same(x[k], y[k]) for k in x) for x, y in ((self.data, other.data), (self.coords, other.coords)))


def even_cuts(size: int, step: int) -> tuple[int, ...]:
    """Sizes of the stretches that boundaries every step cells make of an axis; one stretch if there are none within it."""
    edges = [0, *range(step, size, step), size] if step > 0 else [0, size]
    return tuple(b - a for a, b in itertools.pairwise(edges))


def resolve_chunks(ds: GridDataset, spec: Chunks) -> dict[str, tuple[int, ...]]:
    """Chunk sizes by dimension: those that spec names are cut evenly with a remainder, others keep their chunks or are one. Keys that are no dimension count for nothing; where none is left, existing chunks hold."""
    steps = {d: spec[d] for d in ds.sizes if spec and d in spec}
    kept = {d: ds.chunks.get(d, (n,)) for d, n in ds.sizes.items()}
    return kept | {d: even_cuts(ds.sizes[d], n) for d, n in steps.items()} if steps else dict(ds.chunks)


def block_slices(ds: GridDataset, chunks: Chunks = None) -> Iterator[dict[str, slice]]:
    """Slices of every block, the last dimension fastest; one empty block for a dataset without dimensions."""
    sizes = resolve_chunks(ds, chunks)
    if not sizes and ds.sizes:
        raise AssertionError("chunks must be given, as the dataset has none")
    cuts = {d: [slice(a, b) for a, b in itertools.pairwise(itertools.accumulate(n, initial=0))] for d, n in sizes.items()}
    for combo in itertools.product(*cuts.values()):
        yield dict(zip(cuts, combo, strict=True))


def explode(ds: GridDataset, chunks: Chunks = None) -> Iterator[GridDataset]:
    return (ds.isel(b) for b in block_slices(ds, chunks))
