"""Indexes as folders of Parquet tables and a specification.

An index is its specification and parameters (JSON), its small matrices (raw numbers in
rows of one Parquet table) and its stored rows, partitioned by list where there are lists,
so that probing few lists reads few folders.  ``index_to_bytes`` keeps a small index in one
string."""

from __future__ import annotations

import dataclasses
import io
import json
import zipfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators import codecs, transforms
from ..operators.spec import BinaryIndex, Index, parse, parse_binary


_CLASSES = {c.__name__: c for m in (codecs, transforms) for c in vars(m).values() if isinstance(c, type) and dataclasses.is_dataclass(c)}


def _plain(value, arrays: list[np.ndarray]):
    """A value of numbers, strings, lists, arrays and this package's codecs and transforms
    as JSON; arrays are put aside."""
    if isinstance(value, np.ndarray):
        arrays.append(value)
        return {"array": len(arrays) - 1}
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, (list, tuple)):
        return [_plain(v, arrays) for v in value]
    if isinstance(value, dict):
        return {"dict": {k: _plain(v, arrays) for k, v in value.items()}}
    if dataclasses.is_dataclass(value):
        return {"class": type(value).__name__, "fields": {f.name: _plain(getattr(value, f.name), arrays) for f in dataclasses.fields(value)}}
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    raise TypeError(f"cannot store {type(value).__name__}")


def _revive(value, arrays: list[np.ndarray]):
    if isinstance(value, list):
        return [_revive(v, arrays) for v in value]
    if not isinstance(value, dict):
        return value
    if "array" in value:
        return arrays[value["array"]]
    if "dict" in value:
        return {k: _revive(v, arrays) for k, v in value["dict"].items()}
    return _CLASSES[value["class"]](**{k: _revive(v, arrays) for k, v in value["fields"].items()})


def _head_rows(index: Index) -> list[tuple]:
    """(place, text, data): a JSON head at place -1, then the arrays."""
    arrays: list[np.ndarray] = []
    small = {k: _plain(getattr(index, k), arrays) for k in ("chain", "centroids", "codec", "by_residual", "extra")}
    tables = [t for t in ("edges", "instances") if getattr(index, t) is not None]
    head = {"spec": str(index.spec), "d": index.d, "metric": index.metric, "columns": index.rows.columns, "tables": tables, "small": small}
    return [(-1, json.dumps(head), bytearray())] + [(i, json.dumps([str(x.dtype), x.shape]), bytearray(np.ascontiguousarray(x).tobytes())) for i, x in enumerate(arrays)]


def _from_head(rows: list, tables: Callable[[str], DataFrame | None]) -> Index:
    (head,) = [json.loads(r[1]) for r in rows if r[0] < 0]
    arrays = []
    for _, text, data in sorted((tuple(r) for r in rows if r[0] >= 0), key=lambda r: r[0]):
        kind, shape = json.loads(text)
        arrays.append(np.frombuffer(bytes(data), np.dtype(kind)).reshape(shape).copy())
    small = {k: _revive(v, arrays) for k, v in head["small"].items()}
    stored = tables("rows")
    stored = stored.select(head["columns"]) if stored is not None else None
    others = {t: tables(t) for t in head["tables"]}
    exact = stored.select("id", "vec") if stored is not None and "vec" in head["columns"] else None
    if exact is not None and others.get("instances") is not None:
        exact = exact.withColumnRenamed("id", "rep").join(others["instances"], "rep").select("id", "vec")
    return Index(parse(head["spec"]), head["d"], head["metric"], rows=stored, exact=exact, **others, **small)


def save(index: Index, path: str) -> None:
    """Write under a folder of any file system that Spark knows."""
    spark = index.rows.sparkSession
    rows = index.rows.write.mode("overwrite")
    (rows.partitionBy("list_no") if "list_no" in index.rows.columns else rows).parquet(f"{path}/rows")
    for name in ("edges", "instances"):
        if getattr(index, name) is not None:
            getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame(_head_rows(index), "place int, text string, data binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/spec")


def load(spark: SparkSession, path: str, skip_rows: bool = False) -> Index:
    """Read lazily: rows are scanned when searched, and only folders of probed lists.
    Nothing that is stored is run."""
    read = lambda name: None if skip_rows else spark.read.parquet(f"{path}/{name}")
    return _from_head(spark.read.parquet(f"{path}/spec").select("place", "text", "data").collect(), read)  # one row and small matrices


def index_to_bytes(index: Index, most_rows: int = 1_000_000) -> bytes:
    """A small index in one string."""
    spark = index.rows.sparkSession
    tables = {"spec": spark.createDataFrame(_head_rows(index), "place int, text string, data binary"), "rows": index.rows}
    tables |= {n: getattr(index, n) for n in ("edges", "instances") if getattr(index, n) is not None}
    return to_bytes(tables, most_rows)


def index_from_bytes(spark: SparkSession, data: bytes) -> Index:
    tables = from_bytes(spark, data)
    return _from_head(tables["spec"].select("place", "text", "data").collect(), tables.get)


def save_binary(index: BinaryIndex, path: str) -> None:
    """A binary index: its specification, number of bits and codes."""
    spark = index.rows.sparkSession
    index.rows.select("id", "code").write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(index.node.text, index.d)], "spec string, d int").coalesce(1).write.mode("overwrite").parquet(f"{path}/spec")


def load_binary(spark: SparkSession, path: str) -> BinaryIndex:
    r = spark.read.parquet(f"{path}/spec").first()
    return BinaryIndex(parse_binary(r.spec), r.d, spark.read.parquet(f"{path}/rows"))


def merge_on_disk(spark: SparkSession, trained: Index, parts: list[str], path: str) -> Index:
    """Rows of saved shards of the same specification in one folder."""
    out = None
    for p in parts:
        shard = load(spark, p)
        if str(shard.spec) != str(trained.spec):
            raise ValueError(f"cannot merge {shard.spec} into {trained.spec}")
        out = shard.rows if out is None else out.unionByName(shard.rows)
    merged = dataclasses.replace(trained, rows=out)
    save(merged, path)
    return load(spark, path)


def to_bytes(tables: dict[str, DataFrame], most_rows: int = 1_000_000) -> bytes:
    """Tables as one archive of Arrow files, for indexes of at most ``most_rows`` rows."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, df in tables.items():
            if df.count() > most_rows:
                raise ValueError(f"{name} has more than {most_rows} rows; save it as a folder")
            table = df.toArrow()
            sink = io.BytesIO()
            with pa.ipc.new_file(sink, table.schema) as w:
                w.write_table(table)
            z.writestr(f"{name}.arrow", sink.getvalue())
    return out.getvalue()


def from_bytes(spark: SparkSession, data: bytes) -> dict[str, DataFrame]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n[:-6]: spark.createDataFrame(pa.ipc.open_file(io.BytesIO(z.read(n))).read_all()) for n in z.namelist()}


def matrix_table(spark: SparkSession, x: np.ndarray) -> DataFrame:
    """(row, vec) of a small matrix."""
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row int, vec array<double>")


__all__ = ["from_bytes", "index_from_bytes", "index_to_bytes", "load", "load_binary", "matrix_table", "merge_on_disk", "save", "save_binary", "to_bytes"]
