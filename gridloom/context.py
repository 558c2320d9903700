"""Datasets as tables of a Spark session."""

from __future__ import annotations

import json
import math
import re
import shutil
import tempfile
import uuid
import warnings
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import calendars as cal
from . import conditions
from .dataset import Chunks, GridDataset
from .frame import GridDataFrame
from .session import configure
from .sources.grid import BATCH, Part, register, write_parts, write_store


#: Bytes up to which a table is broadcast in joins.
SMALL_BYTES = 8 << 20


def dialect(query: str) -> str:
    """Standard SQL names and parameters in Spark's spelling: "name" as `name`, $name as :name; string literals and comments stay."""
    part = re.compile(r"('(?:[^']|'')*'|--[^\n]*|/\*.*?\*/|`[^`]*`)|\"((?:[^\"]|\"\")*)\"|\$([A-Za-z_]\w*)", re.S)
    return part.sub(lambda m: m[1] or (f":{m[3]}" if m[3] else "`" + m[2].replace('""', '"').replace("`", "``") + "`"), query)


def view_name(name: str) -> str:
    return name.replace(".", "__")


def outside_strings(text: str, pattern: str, new: str) -> str:
    return re.sub(r"('(?:[^']|'')*'|--[^\n]*)|" + pattern, lambda m: m[1] or new, text)


class GridContext:
    """Registers datasets and runs SQL over them and over any other table of the session."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        """folder must be shared by driver and executors; by default a local one, for Spark in local mode."""
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("a folder that all executors share must be given")
        self.spark, self._own = configure(spark), folder is None
        self.folder = folder or tempfile.mkdtemp(prefix="gridloom-")
        self.datasets: dict[str, GridDataset] = {}
        self.stores: dict[str, str] = {}
        self.parts: dict[str, int] = {}
        self._databases: list[str] = []
        self._calendar: tuple[str, str] | None = None
        register(spark)

    def __enter__(self) -> GridContext:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        for name in self._databases:
            self.spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
        for name in self.stores:
            self.spark.catalog.dropTempView(view_name(name))
        if self._own:
            shutil.rmtree(self.folder, ignore_errors=True)

    def from_dataset(self, name: str, ds: GridDataset, *, table_names: dict[tuple[str, ...], str] | None = None, chunks: Chunks = None, batch_size: int = BATCH) -> GridContext:
        """Registers ds as the table name, or, if its variables have several sets of dimensions, as a database of that name with a table for each."""
        groups = ds.groups()
        if len(groups) <= 1:
            self._table(name, ds, chunks, batch_size)
        else:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
            self._databases.append(name)
            ds = ds.chunk(chunks)
            for dims, names in groups.items():
                self._table(f"{name}.{(table_names or {}).get(dims, '_'.join(dims) or 'scalar')}", ds.only(names), None, batch_size)
        return self

    def _table(self, name: str, ds: GridDataset, chunks: Chunks, batch_size: int) -> None:
        place = f"{self.folder}/{uuid.uuid4().hex}"
        chunked = ds.chunk(chunks)
        write_store(chunked, place, None, batch_size)
        self.datasets[name], self.stores[name] = chunked, place
        if "." in name:
            # the catalog lists the table, but hands a Python source no options when it is read; queries go to a view
            table = ".".join(f"`{x}`" for x in name.split("."))
            self.spark.sql(f"CREATE TABLE {table} USING grid OPTIONS (path '{place}')")
        self.read(name).createOrReplaceTempView(view_name(name))
        for k, v in ds.dim_coords.items():
            calendar = cal.calendar_of(v.values) if v.dtype == object else None
            if calendar and not cal.is_gregorian_like(calendar):
                found = (v.encoding.get("units", cal.DEFAULT_UNITS), calendar)
                if self._calendar not in (None, found):
                    warnings.warn(f"cftime() now counts in the units and calendar of {name}.{k}", stacklevel=3)
                self._calendar = found
                self.spark.udf.register("cftime", _cftime(*found))

    def from_parts(self, name: str, parts: Iterable[Part], schema: StructType) -> GridContext:
        """Registers a table of parts, each a function that gives its batches, bounds by dimension (or None) and a number of rows; no part is read before a query needs it, and queries skip those that their bounds rule out."""
        place = f"{self.folder}/{uuid.uuid4().hex}"
        self.parts[name] = write_parts(parts, schema, place)
        self.stores[name] = place
        self.read(name).createOrReplaceTempView(view_name(name))
        return self

    def read(self, name: str, columns: list[str] | None = None, where: list | None = None) -> DataFrame:
        """A registered table; columns names those whose arrays are read, where is a condition by which chunks are left out."""
        reader = self.spark.read.format("grid_parts" if name in self.parts else "grid").option("path", self.stores[name])
        for option, value in (("columns", columns), ("where", where)):
            if value is not None:
                reader = reader.option(option, json.dumps(value))
        df = reader.load()
        return F.broadcast(df) if self._small(name) else df

    def _small(self, name: str) -> bool:
        return 0 < self.size(name)[1] <= SMALL_BYTES

    def size(self, name: str) -> tuple[int, int]:
        """Rows and bytes of a table, exact, from its shape alone; strings count as 32 bytes. A Python source has no statistics of its own, so small tables carry a broadcast hint by this size."""
        if name in self.parts:
            return self.parts[name], 0
        ds = self.datasets[name]
        rows = math.prod(len(c) and sum(c) for c in ds.chunks.values()) if ds.chunks else 1
        width = sum(v.dtype.itemsize if v.dtype.kind not in "OUS" else 32 for v in (*ds.dim_coords.values(), *ds.data.values()))
        return rows, rows * width

    def statistics(self, name: str) -> dict:
        """rows and, by dimension, exact (min, max, nulls), from the manifest alone; times are microseconds."""
        with open(f"{self.stores[name]}/manifest.json") as f:
            m = json.load(f)
        if "parts" in m:
            return {"rows": self.parts[name], "columns": {}}
        found = {}
        for d, bounds in m["bounds"].items():
            held = [b for b, n in zip(bounds, m["chunks"][d], strict=True) if n]
            if held and None not in held:
                found[d] = (min(b[0] for b in held), max(b[1] for b in held), 0)
        return {"rows": math.prod(m["shape"]), "columns": found}

    def _answered(self, df: DataFrame) -> DataFrame | None:
        """COUNT, MIN and MAX over a whole table from its statistics, without a scan, where these have the answer."""
        asked = conditions.counted(df)
        name = asked and next((n for n, p in self.stores.items() if p == asked[0] and n not in self.parts), None)
        if not name:
            return None
        known, dims = self.statistics(name), {f.name: f.dataType.typeName() for f in self.read(name).schema if f.metadata.get("role") == "dim"}
        out = []
        for alias, what, column, kind in asked[1]:
            if what == "count":
                if column is not None and column not in dims:
                    return None
                value = F.lit(known["rows"])
            elif column not in known["columns"] or not known["rows"]:
                return None
            else:
                value = F.lit(known["columns"][column][what == "max"])
                if dims[column] == "timestamp_ntz":
                    value = F.timestamp_micros(value)
            out.append(value.cast(kind).alias(alias))
        return self.spark.range(1).select(*out)

    def register_table(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)

    def register_udf(self, name: str, function, returns=None) -> None:
        self.spark.udf.register(name, function, returns) if returns else self.spark.udf.register(name, function)

    def table_names(self, database: str | None = None) -> list[str]:
        return [t.name for t in self.spark.catalog.listTables(database) if database is None or not t.isTemporary]

    def sql(self, query: str, param_values: dict | None = None) -> GridDataFrame:
        """Plans the query; faults of text and names are raised here, arrays are read when rows are asked for.

        A second plan of the same text reads only the arrays whose columns the first one refers to.
        """
        text = dialect(query)
        if re.search(r"\bWHERE\s*;?\s*$", text, re.I):  # Spark would take the word for an alias
            raise ValueError("WHERE without a condition")
        for name in self.stores:
            if "." in name:
                text = outside_strings(text, r"\b" + r"\.".join(f"`?{re.escape(x)}`?" for x in name.split(".")) + r"(?!\w)", view_name(name))
        if self._calendar:
            text = cal.fold_cftime(text, *self._calendar)
        run = lambda t: self.spark.sql(t, args=param_values) if param_values else self.spark.sql(t)
        df = run(text)
        used = {n for n in self.stores if re.search(rf"(?<!\w){re.escape(view_name(n))}(?!\w)", text)}
        # a command is carried out as soon as it is planned, so only queries are planned twice
        if used and re.match(r"\s*(SELECT|WITH|\(|FROM)\b", text, re.I) and not re.search(r"\bINSERT\b", outside_strings(text, r"(?!)", ""), re.I):
            answer = self._answered(df)
            df = answer if answer is not None else self._pruned(df, text, used, run)
        return GridDataFrame(df, dict(self.datasets))

    def _pruned(self, df: DataFrame, text: str, used: set[str], run) -> DataFrame:
        """The same query over scans that read only the columns and chunks it needs: common table expressions in front of it take the names of its tables, so that other queries of the session are not touched."""
        wanted, conditioned = conditions.referenced(df), list(conditions.scans(df))
        views, tables, joins = [], [], conditions.has_join(df)
        for name in sorted(used):
            own = view_name(name)
            if joins and self._small(name):
                continue  # a hint does not reach through such an expression, and a small table is soon read
            if re.search(rf"(?<!\w)`?{re.escape(own)}`?\s*(\([^()]*\))?\s*AS\s*\(", text, re.I):
                continue  # the query has an expression of that name itself
            found = [w for path, w in conditioned if path == self.stores[name]]
            where = ["or", *found] if found and None not in found else None
            view = f"{own}_{uuid.uuid4().hex}"
            self.read(name, [c for c in self.read(name).columns if c in wanted], where).createOrReplaceTempView(view)
            views.append(view)
            tables.append(f"`{own}` AS (SELECT * FROM `{view}`)")
        if not tables:
            return df
        head = re.match(r"\s*WITH\s+(RECURSIVE\b)?", text, re.I)
        try:
            return run(f"{head[0]} {', '.join(tables)}, {text[head.end() :]}" if head else f"WITH {', '.join(tables)} {text}")
        finally:
            for view in views:
                self.spark.catalog.dropTempView(view)


def _cftime(units: str, calendar: str):
    @F.arrow_udf("bigint")
    def convert(texts: pa.Array) -> pa.Array:
        known = texts.dictionary_encode()
        numbers = pa.array([cal.date2num(cal.parse(t, calendar), units) for t in known.dictionary.to_pylist()], pa.int64())
        return numbers.take(known.indices)

    return convert
