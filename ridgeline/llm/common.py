"""Shared plumbing: the shared folder, durable intermediate tables, column names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most so many rows
#: (of a few dozen bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 400_000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; only where the
    session has none and all of it runs in one process (tests), a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        path = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="ridgeline-"))
    return path.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends
    here, and a lost executor costs only the tasks that read it."""
    spark = df.sparkSession
    path = new_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Internal column names that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_rl_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add under these names."""
    low = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low])


def other_fields(df: DataFrame, *names: str) -> list:
    """The fields of ``df`` but those of these names, whatever their case."""
    low = {n.lower() for n in names}
    return [f for f in df.schema.fields if f.name.lower() not in low]


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``df``, usually a stored table, was counted to have at most ``most`` rows."""
    return df.count() <= most


#: Rows of a key that meet their one row by a shuffle at least.
MEET_ROWS = 1000


def meet(rows: DataFrame, sums: DataFrame, keys: list[str], size: str, how: str) -> DataFrame:
    """``rows`` joined (inner or left) with ``sums``, a stored table of one row per key
    whose column ``size`` counts the key's rows.  Keys of very many rows are broadcast, at
    most BROADCAST_ROWS of them since sizes add up to the rows; the others shuffle."""
    total = sums.agg(F.sum(size)).first()[0] or 0
    limit = max(MEET_ROWS, total // BROADCAST_ROWS)
    heavy = sums.filter(F.col(size) > limit)
    if heavy.isEmpty():
        return rows.join(sums, keys, how)
    first = rows.join(F.broadcast(heavy), keys, "left")
    rest = first.filter(F.col(size).isNull()).select(*[f"`{c}`" for c in rows.columns]).join(sums.filter(F.col(size) <= limit), keys, how)
    return first.filter(F.col(size).isNotNull()).select(*[f"`{c}`" for c in rest.columns]).unionByName(rest)


#: Bits of a filter at most (16 MB), and bits for each key below that.
FILTER_BITS, KEY_BITS = 1 << 27, 16


def filter_bits(keys: int) -> int:
    return min(FILTER_BITS, max(1 << 15, 1 << (keys * KEY_BITS).bit_length()))


def make_filter(hashes: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap) of the column ``h``: at most bits / 32768 rows of 4 KB."""
    slot = F.pmod("h", F.lit(bits))
    rows = hashes.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
    return rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def passing(rows: DataFrame, h: Column, stored: DataFrame, bits: int) -> DataFrame:
    """``rows`` whose hash may be in a stored filter, which is broadcast: its size is
    bounded by ``FILTER_BITS``."""
    slot = F.pmod(h, F.lit(bits))
    bucket, bitmap = fresh(rows, "bucket", "bitmap")
    out = rows.join(F.broadcast(stored.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap))), F.bitmap_bucket_number(slot) == F.col(bucket))
    bit = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (bit % 8 + 1).cast("int"))
    return out.filter(byte.bitwiseAND(mask) != 0).drop(bucket, bitmap)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(column, n: int):
    """crc32 of a column as text, mod n; null counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n
