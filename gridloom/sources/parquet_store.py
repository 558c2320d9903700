"""Datasets as Parquet tables: written once, with native column pruning, filters of any shape and exact statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..dataset import Chunks, GridDataset, block_slices
from ..types import infer_schema
from .batches import block_batches
from .grid import register, write_store


def write_parquet(spark: SparkSession, ds: GridDataset, place: str, store: str, chunks: Chunks = None, mode: str = "error") -> DataFrame:
    """ds by way of the array store at store (a shared folder), one task a chunk, as Parquet files sorted by their dimensions at place."""
    register(spark)
    write_store(ds, store, chunks)
    schema = infer_schema(ds)
    dims = [f.name for f in schema if f.metadata["role"] == "dim"]
    rows = spark.read.format("grid").option("path", store).load()
    (rows.sortWithinPartitions(*dims) if dims else rows).write.mode(mode).parquet(place)
    return spark.read.parquet(place)


def analyzed_table(spark: SparkSession, name: str, place: str) -> DataFrame:
    """The Parquet files at place as a table with exact row count and column statistics, by which Catalyst chooses build sides."""
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{place}'")
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    return spark.table(name)


def save_npz(ds: GridDataset, file: str) -> None:
    """One compressed file; attributes and climate dates are not kept."""
    import numpy as np

    np.savez_compressed(file, **{f"{kind}/{name}/{','.join(v.dims)}": v.values for kind, group in (("data", ds.data), ("coords", ds.coords)) for name, v in group.items()})


def open_npz(file: str, chunks: Chunks = None) -> GridDataset:
    import numpy as np

    parts: dict[str, dict] = {"data": {}, "coords": {}}
    with np.load(file, allow_pickle=False) as found:
        for key in found.files:
            kind, name, dims = key.split("/")
            parts[kind][name] = (tuple(d for d in dims.split(",") if d), found[key])
    return GridDataset(parts["data"], parts["coords"]).chunk(chunks)


def from_labelled(ds) -> GridDataset:
    """Any object with data_vars, coords, attrs and chunks in the manner of labelled-array libraries."""
    take = lambda v: (tuple(v.dims), v.values, dict(v.attrs), dict(getattr(v, "encoding", {})))
    out = GridDataset({str(k): take(v) for k, v in ds.data_vars.items()}, {str(k): take(v) for k, v in ds.coords.items()}, dict(ds.attrs))
    out.chunks = {str(k): tuple(v) for k, v in (getattr(ds, "chunksizes", None) or {}).items()}
    return out


__all__ = ["analyzed_table", "block_batches", "block_slices", "from_labelled", "open_npz", "save_npz", "write_parquet"]
