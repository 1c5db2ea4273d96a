"""Vector files: .fvecs, .ivecs, .bvecs (an int32 length before each row) and .fbin (a
header of two int32, then rows of float32).

Rows have a fixed length, so a file is read in slices: each task seeks to its own range
of rows and reads it in blocks.  Files on stores that only Spark reads go through
``binaryRecords`` instead."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import matrix
from ..operators import knn

_ITEMS = {"fvecs": ("<f4", "array<float>"), "ivecs": ("<i4", "array<int>"), "bvecs": ("u1", "array<int>")}
#: Bytes of a task's slice.
SLICE = 64 << 20


def _head(spark: SparkSession, path: str, n: int) -> tuple[bytes, int]:
    """The first n bytes and the file's length, through Hadoop's file systems."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    stream = fs.open(p)
    try:
        return bytes(stream.read() & 0xFF for _ in range(n)), fs.getFileStatus(p).getLen()
    finally:
        stream.close()


def _open(path: str):
    if path.startswith("file:") or "://" not in path:
        return open("/" + path[5:].lstrip("/") if path.startswith("file:") else path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _vectors(raw: bytes, length: int, head: int, item: str) -> pa.ListArray:
    rows = np.frombuffer(raw, np.uint8).reshape(-1, length)[:, head:]
    x = np.ascontiguousarray(rows).view(item)
    kind = pa.float32() if item == "<f4" else pa.int32()
    flat = pa.array(x.reshape(-1).astype(kind.to_pandas_dtype()), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), flat)


def _rows(spark: SparkSession, path: str, n: int, skip: int, length: int, head: int, item: str, sql: str) -> DataFrame:
    """n rows of ``length`` bytes after ``skip`` bytes, without their first ``head``."""
    if path.split(":")[0] in ("viewfs", "dbfs", "wasbs", "abfss"):
        if skip:
            raise ValueError("a file with a header needs a store that can be read in slices")
        records = spark.sparkContext.binaryRecords(path, length).zipWithIndex().map(lambda x: (x[1], bytearray(x[0])))

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("id"), _vectors(b"".join(b.column("raw").to_pylist()), length, head, item)], ["id", "vec"])

        return records.toDF("id long, raw binary").mapInArrow(decode, f"id long, vec {sql}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(path) as f:
            for b in batches:
                ids = np.asarray(b.column("id"))
                if len(ids):  # a range of ids is contiguous
                    f.seek(skip + int(ids[0]) * length)
                    yield pa.RecordBatch.from_arrays([b.column("id"), _vectors(f.read(len(ids) * length), length, head, item)], ["id", "vec"])

    parts = max(1, -(-n * length // SLICE), min(n, spark.sparkContext.defaultParallelism))
    return spark.range(0, n, 1, parts).mapInArrow(read, f"id long, vec {sql}")


def read_vecs(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(id, vec): id is the row number in the file."""
    item, sql = _ITEMS[kind or path.rsplit(".", 1)[1]]
    head, size = _head(spark, path, 4)
    length = 4 + int.from_bytes(head, "little") * np.dtype(item).itemsize
    if size % length:
        raise ValueError(f"{path}: {size} bytes are no rows of {length}")
    return _rows(spark, path, size // length, 0, length, 4, item, sql)


def read_fbin(spark: SparkSession, path: str) -> DataFrame:
    head, _ = _head(spark, path, 8)
    n, d = (int(v) for v in np.frombuffer(head, "<i4"))
    return _rows(spark, path, n, 8, 4 * d, 0, "<f4", "array<float>")


def _folder(path: str):
    """(file system, path inside it) of a folder that executors share."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/") if path.startswith("file:") else path
    return fs.FileSystem.from_uri(path)


def write_vecs(df: DataFrame, path: str, kind: str | None = None) -> None:
    """One part file per partition in the order of id, whose concatenation is the table;
    ``path`` is a folder on a shared file system, read with ``read_vecs`` by part.  A part
    appears under its name at once, so a task that is run again leaves the same files."""
    kind = kind or "fvecs"
    item, _ = _ITEMS[kind]

    def run(batches):
        from pyspark import TaskContext

        store, folder = _folder(path)
        store.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        temp, n = f"{folder}/.{part:05d}-{uuid.uuid4().hex}", 0
        with store.open_output_stream(temp) as f:
            for b in batches:
                if not b.num_rows:
                    continue
                x = matrix(b.column("vec")).astype(item)
                heads = np.full((len(x), 1), x.shape[1], "<i4").view(np.uint8)
                f.write(np.concatenate((heads, np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)), 1).tobytes())
                n += len(x)
        if n:
            store.move(temp, f"{folder}/part-{part:05d}.{kind}")
        else:
            store.delete_file(temp)
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n])], ["part", "n"])

    df.select("id", "vec").repartitionByRange("id").sortWithinPartitions("id").mapInArrow(run, "part long, n long").collect()


def read_vecs_folder(spark: SparkSession, path: str, kind: str = "fvecs") -> DataFrame:
    """All parts written by ``write_vecs``; ids run on from part to part."""
    from pyarrow.fs import FileSelector

    store, folder = _folder(path)
    names = sorted(f.base_name for f in store.get_file_info(FileSelector(folder)) if f.base_name.endswith(kind) and not f.base_name.startswith("."))
    out, at = None, 0
    for name in names:
        part = read_vecs(spark, f"{path.rstrip('/')}/{name}", kind)
        n = part.count()
        part = part.withColumn("id", F.col("id") + F.lit(at))
        out, at = part if out is None else out.unionByName(part), at + n
    return out


class VectorSet:
    """Queries, training rows and a database with their ground truth.  ``blocks`` gives the
    database in ``parts`` pieces, or every piece of one worker (``rank`` of ``of``)."""

    def __init__(self, database: DataFrame, queries: DataFrame, train: DataFrame | None = None, metric: str = "l2"):
        self.database, self.queries, self.metric = database, queries, metric
        self.train = database if train is None else train

    def blocks(self, parts: int, rank: int = 0, of: int = 1) -> Iterator[DataFrame]:
        for i in range(rank, parts, of):
            yield self.database.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == i)

    def ground_truth(self, k: int, parts: int = 1) -> DataFrame:
        """Exact neighbours, block by block, merged."""
        found = [knn.knn(self.queries, block, k, self.metric) for block in self.blocks(parts)]
        return knn.merge_results(found, k, self.metric)


def synthetic(spark: SparkSession, n: int, d: int, seed: int = 1338, first: int = 0) -> DataFrame:
    """(id, vec): 10 Gaussian dimensions projected to d, scaled and put through a sine;
    each row depends on its id and the seed alone."""
    rng = np.random.default_rng(seed)
    project, scale = rng.random((10, d)), rng.random(d) * 4 + 0.1

    def run(batches):
        for b in batches:
            ids = np.asarray(b.column("id"))
            x = np.array([np.random.default_rng((seed, int(i))).standard_normal(10) for i in ids]).reshape(-1, 10)
            v = np.sin((x @ project) * scale).astype(np.float32)
            flat = pa.array(v.reshape(-1), pa.float32())
            vec = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, d, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column("id"), vec], ["id", "vec"])

    return spark.range(first, first + n).mapInArrow(run, "id long, vec array<float>")


def random_vectors(spark: SparkSession, n: int, d: int, kind: str = "normal", seed: int = 1) -> DataFrame:
    """(id, vec) of uniform [0, 1), normal, or integer (0 to 255) components; a row depends
    on its id and the seed alone."""
    draw = {
        "uniform": lambda r: r.random(d),
        "normal": lambda r: r.standard_normal(d),
        "integer": lambda r: r.integers(0, 256, d).astype(float),
    }[kind]

    def run(batches):
        for b in batches:
            x = np.array([draw(np.random.default_rng((seed, int(i)))) for i in b.column("id").to_pylist()], np.float32).reshape(-1, d)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, d, dtype=np.int32)), pa.array(x.reshape(-1), pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), vec], ["id", "vec"])

    return spark.range(n).mapInArrow(run, "id long, vec array<float>")
