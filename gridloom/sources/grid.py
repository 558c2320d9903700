"""The `grid` data source: one scan partition a chunk of an array store; and `grid_parts`: one a stream of batches.

A store is a folder with a manifest and, for each coordinate or variable, a .npy file or, if it is read in blocks, the function that gives them. Workers map the files into memory, or call the function, for their chunk of the columns they are asked for. Predicates on dimensions drop chunks by exact bounds before any is read.
"""

from __future__ import annotations

import datetime as dt
import itertools
import json
import os
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import LongType, StructType

from .. import calendars as cal
from ..dataset import BlockVar, GridDataset, resolve_chunks
from ..types import infer_schema, to_arrow, whole_micros

BATCH = 65_536
#: A touched file in this folder for each chunk read, if it is set; tests count them.
TRACE = "GRIDLOOM_TRACE"


def write_store(ds: GridDataset, place: str, chunks=None, batch: int = BATCH) -> str:
    """ds as a store in the folder place. All variables share their dimensions."""
    if len(ds.groups()) > 1:
        raise ValueError("variables of a table must share their dimensions: " + ", ".join(map(str, ds.groups())))
    if batch < 1:
        raise ValueError("batches have one row at least")
    sizes = resolve_chunks(ds, chunks)
    if not sizes and ds.sizes:
        raise AssertionError("chunks must be given, as the dataset has none")
    os.makedirs(place, exist_ok=True)
    dims = next(iter(ds.data.values())).dims if ds.data else tuple(ds.sizes)
    schema = infer_schema(ds)
    for v in (*ds.dim_coords.values(), *ds.data.values()):
        if not isinstance(v, BlockVar) and v.dtype == "datetime64[ns]":
            whole_micros(v.values)
    for name, v in {**{k: v for k, v in ds.dim_coords.items() if k in dims}, **ds.data}.items():
        file = f"{place}/{schema.fieldNames().index(name)}"
        if isinstance(v, BlockVar):
            with open(f"{file}.block", "wb") as f:
                cloudpickle.dump(v, f)
        elif cal.is_caldate(v.values):
            whole = isinstance(schema[name].dataType, LongType)
            n = cal.to_offsets(v.values, schema[name].metadata["units"]) if whole else cal.to_microseconds(v.values).view("datetime64[us]")
            np.save(f"{file}.npy", n.reshape(v.values.shape))
        elif v.dtype == object and v.values.size and all(isinstance(x, str) for x in v.values.ravel()):
            np.save(f"{file}.npy", v.values.astype(str))
        elif v.dtype == object:
            with open(f"{file}.pkl", "wb") as f:
                pickle.dump(v.values, f)
        else:
            np.save(f"{file}.npy", v.values)
    bounds = {}
    for d in dims:
        cuts = list(itertools.pairwise(itertools.accumulate(sizes[d], initial=0)))
        bounds[d] = [_bounds(ds.coords[d].values[a:b], schema[d]) for a, b in cuts] if d in ds.dim_coords else [None] * len(cuts)
    manifest = {"schema": schema.jsonValue(), "dims": dims, "shape": [ds.sizes[d] for d in dims], "chunks": {d: list(sizes[d]) for d in dims}, "bounds": bounds, "batch": batch}
    with open(f"{place}/manifest.json", "w") as f:
        json.dump(manifest, f)
    return place


def _bounds(values: np.ndarray, field) -> list | None:
    """Least and greatest of a slice in the column's own terms (times as microseconds); none for strings and empty slices."""
    if not values.size:
        return None
    if cal.is_caldate(values):
        n = cal.to_offsets(values, field.metadata["units"]) if isinstance(field.dataType, LongType) else cal.to_microseconds(values)
        return [int(n.min()), int(n.max())]
    if values.dtype.kind == "M":
        n = values.astype("datetime64[us]").view(np.int64)
        return [int(n.min()), int(n.max())]
    return [values.min().item(), values.max().item()] if values.dtype.kind in "iuf" and not (values.dtype.kind == "f" and np.isnan(values).any()) else None


def _comparable(value, is_time: bool):
    """A literal on the scale of bounds; None if it has no place there."""
    if is_time:
        if isinstance(value, dt.datetime):
            return round((value.replace(tzinfo=None) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
        return None
    return value if isinstance(value, int | float) and not isinstance(value, bool) else float(value) if hasattr(value, "as_tuple") else None


def may_hold(f, bounds: dict[str, list | None], times: set[str]) -> bool:
    """Whether a chunk with these bounds can have rows that pass a filter; unknown counts as yes."""
    if isinstance(f, D.Not):
        inner = f.child
        if isinstance(inner, D.EqualTo) and (b := bounds.get(inner.attribute[0])) and (v := _comparable(inner.value, inner.attribute[0] in times)) is not None:
            return not b[0] == b[1] == v
        return True
    name = f.attribute[0] if hasattr(f, "attribute") else None
    if not (b := bounds.get(name)):
        return True
    if isinstance(f, D.In):
        known = [_comparable(v, name in times) for v in f.value]
        return any(v is None or b[0] <= v <= b[1] for v in known)
    if not hasattr(f, "value") or (v := _comparable(f.value, name in times)) is None:
        return True
    for kind, keep in ((D.EqualTo, b[0] <= v <= b[1]), (D.GreaterThan, b[1] > v), (D.GreaterThanOrEqual, b[1] >= v), (D.LessThan, b[0] < v), (D.LessThanOrEqual, b[0] <= v)):
        if isinstance(f, kind):
            return keep
    return True


def may_pass(told: list | None, bounds: dict[str, list | None]) -> bool:
    """The same for a condition as told by conditions.told(): ["and" | "or", ...], [operator, column, value] or None for what isn't known."""
    if told is None:
        return True
    kind, *rest = told
    if kind in ("and", "or"):
        return (all if kind == "and" else any)(may_pass(x, bounds) for x in rest)
    name, value = rest
    if not (b := bounds.get(name)):
        return True
    if kind == "in":
        return any(b[0] <= v <= b[1] for v in value)
    return {"=": b[0] <= value <= b[1], ">": b[1] > value, ">=": b[1] >= value, "<": b[0] < value, "<=": b[0] <= value, "<>": not b[0] == b[1] == value}[kind]


class Chunk(D.InputPartition):
    def __init__(self, index: tuple[int, ...]):
        self.index = index


class GridReader(D.DataSourceReader):
    def __init__(self, place: str, columns: list[str] | None, where: list | None = None):
        self.place, self.where = place, where
        with open(f"{place}/manifest.json") as f:
            self.m = json.load(f)
        self.columns, self.filters = columns, []

    def pushFilters(self, filters):
        self.filters = list(filters)
        return filters  # rows are filtered again by Spark

    def chosen(self) -> list[tuple[int, ...]]:
        m, dims = self.m, self.m["dims"]
        times = {f["name"] for f in m["schema"]["fields"] if f["type"] == "timestamp_ntz"}
        keep = []
        for d in dims:  # a conjunct on one dimension drops that dimension's chunks at once
            keep.append([i for i in range(len(m["chunks"][d])) if m["chunks"][d][i] and all(may_hold(f, {d: m["bounds"][d][i]}, times) for f in self.filters)])
        found = itertools.product(*keep)
        if self.where is None:
            return list(found)
        return [at for at in found if may_pass(self.where, {d: m["bounds"][d][i] for d, i in zip(dims, at, strict=True)})]

    def partitions(self):
        return [Chunk(i) for i in self.chosen()]

    def read(self, partition):
        if partition is None:
            return
        m, schema = self.m, StructType.fromJson(self.m["schema"])
        dims, shape = m["dims"], m["shape"]
        start = [sum(m["chunks"][d][:i]) for d, i in zip(dims, partition.index, strict=True)]
        size = [m["chunks"][d][i] for d, i in zip(dims, partition.index, strict=True)]
        if trace := os.environ.get(TRACE):
            open(f"{trace}/{'-'.join(map(str, partition.index))}-{os.urandom(4).hex()}", "w").close()
        cuts = tuple(slice(a, a + n) for a, n in zip(start, size, strict=True))
        columns: list = []
        total = int(np.prod(size, dtype=np.int64))
        for i, f in enumerate(schema):
            if self.columns is not None and f.name not in self.columns:
                columns.append(None)
                continue
            path = f"{self.place}/{i}"
            if os.path.exists(f"{path}.block"):
                with open(f"{path}.block", "rb") as file:
                    part = np.ascontiguousarray(pickle.load(file).at(cuts)).ravel()
                columns.append((part, None, None))
                continue
            if os.path.exists(f"{path}.npy"):
                whole = np.load(f"{path}.npy", mmap_mode="r")
            else:
                with open(f"{path}.pkl", "rb") as file:
                    whole = pickle.load(file)
            if f.metadata.get("role") == "dim":
                axis = dims.index(f.name)
                columns.append((whole[cuts[axis]], int(np.prod(size[axis + 1 :], dtype=np.int64)), size[axis]))
            else:
                columns.append((np.ascontiguousarray(whole[cuts]).ravel() if shape else whole.reshape(1), None, None))
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for at in range(0, total, m["batch"]):
            row = np.arange(at, min(at + m["batch"], total))
            out = []
            for f, target, c in zip(schema, arrow, columns, strict=True):
                if c is None:
                    out.append(pa.nulls(len(row), target.type) if f.nullable else _filler(len(row), target.type))
                else:
                    out.append(to_arrow(c[0][row] if c[1] is None else c[0][(row // c[1]) % c[2]], f))
            yield pa.RecordBatch.from_arrays(out, names=schema.fieldNames())


def _filler(n: int, kind: pa.DataType) -> pa.Array:
    """Rows of a column that the query does not look at."""
    return pa.array(["" if pa.types.is_string(kind) else 0] * n).cast(kind) if not pa.types.is_timestamp(kind) else pa.array([0] * n, pa.int64()).cast(kind)


class GridDataSource(D.DataSource):
    @classmethod
    def name(cls):
        return "grid"

    def place(self) -> str:
        """The store's folder; the catalog writes paths as URIs."""
        path = self.options["path"]
        return "/" + path[5:].lstrip("/") if path.startswith("file:") else path

    def schema(self):
        with open(f"{self.place()}/manifest.json") as f:
            return StructType.fromJson(json.load(f)["schema"])

    def reader(self, schema):
        wanted = self.options.get("columns")
        return GridReader(self.place(), json.loads(wanted) if wanted is not None else None, json.loads(self.options.get("where", "null")))


#: How a part of a stream is described: a function that gives its batches, bounds by dimension, number of rows.
Part = tuple[Callable[[], Iterable[pa.RecordBatch]], dict[str, tuple], int]


def write_parts(parts: Iterable[Part], schema: StructType, place: str) -> int:
    """Parts of a table as a store in the folder place, taken from the iterable one at a time; the number of rows. Nothing is read from them."""
    os.makedirs(place, exist_ok=True)
    entries, rows = [], 0
    with open(f"{place}/parts.pkl", "wb") as f:
        for part in parts:
            if not (isinstance(part, tuple) and len(part) == 3 and callable(part[0]) and isinstance(part[1], dict) and isinstance(part[2], int)):
                raise TypeError("a part is a tuple of a function, bounds by dimension and a number of rows")
            if unknown := set(part[1]) - set(schema.names):
                raise TypeError(f"bounds of {sorted(unknown)}, which are no columns")
            entries.append({"at": f.tell(), "rows": part[2], "bounds": {d: None if b is None else [_scaled(x) for x in b] for d, b in part[1].items()}})
            cloudpickle.dump(part[0], f)
            rows += part[2]
    if not entries:
        raise ValueError("a table needs one part at least")
    with open(f"{place}/manifest.json", "w") as f:
        json.dump({"schema": schema.jsonValue(), "parts": entries}, f)
    return rows


def _scaled(x):
    """A bound as a number; times as microseconds."""
    if isinstance(x, np.datetime64):
        return int(x.astype("datetime64[us]").astype(np.int64))
    return _comparable(x, True) if isinstance(x, dt.datetime) else x.item() if isinstance(x, np.generic) else x


class PartsReader(D.DataSourceReader):
    def __init__(self, place: str, where: list | None):
        self.place, self.where, self.filters = place, where, []
        with open(f"{place}/manifest.json") as f:
            self.m = json.load(f)

    def pushFilters(self, filters):
        self.filters = list(filters)
        return filters

    def partitions(self):
        times = {f["name"] for f in self.m["schema"]["fields"] if f["type"] == "timestamp_ntz"}
        return [Chunk((p["at"],)) for p in self.m["parts"] if all(may_hold(f, p["bounds"], times) for f in self.filters) and may_pass(self.where, p["bounds"])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        with open(f"{self.place}/parts.pkl", "rb") as f:
            f.seek(partition.index[0])
            made = pickle.load(f)()
        for batch in made:
            yield batch.select(StructType.fromJson(self.m["schema"]).names)


class PartsDataSource(GridDataSource):
    @classmethod
    def name(cls):
        return "grid_parts"

    def reader(self, schema):
        return PartsReader(self.place(), json.loads(self.options.get("where", "null")))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridDataSource)
    spark.dataSource.register(PartsDataSource)
