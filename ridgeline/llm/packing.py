"""Conflict-constrained best-fit packing of documents into bins of ``capacity`` tokens.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` and one end mark per text.  Texts above the
capacity are cut: whole bins of their own, and a rest that is packed like a document;
nothing is truncated.  Pieces are placed longest first.  Bins are kept ordered by
residual capacity and carry bitmaps of the sources they hold (one per level: a bin takes
at most ``max_per_source`` pieces of a source) and of duplicate clusters (at most one of
each).  The search starts at the first bin that is large enough and goes on, successor by
successor, to the first compatible one, which is the tightest; failing that a bin opens.

Packing is done in independent buckets of about ``bucket_tokens`` tokens, dealt by a
hash of stored row numbers: a third of all rows in one source or one cluster of copies
spreads over all buckets.  Texts are measured where they are read; only row numbers,
lengths, sources and clusters travel.  A bucket leaves at most its last few bins partly
filled because of its border.

Defined results: null text counts as empty (one token); a null source is a source of its
own; the default cluster is the text without blanks, null as empty; repeated rows are
packed each, never into one bin; identifiers take no part, so they may be null; texts of
any length are cut, never lost; ties go by row number; result names replace input columns
of the same name, whatever their case; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import documents, durable, fresh
from .textkernel import NOT_SPACE, pieces, utf8, word_spans

CAPACITY, MAX_PER_SOURCE, BUCKET_TOKENS = 2048, 2, 1 << 19


class Bins:
    """Open bins in the order of their residual capacity, with bitmaps."""

    def __init__(self, capacity: int, n_sources: int, n_clusters: int, levels: int):
        self.capacity, self.levels = capacity, levels
        self.residual, self.number = np.zeros(0, np.int64), np.zeros(0, np.int64)  # in order
        self.sources = [np.zeros((16, n_sources // 64 + 1), np.uint64) for _ in range(levels)]
        self.clusters = np.zeros((16, n_clusters // 64 + 1), np.uint64)
        self.count = 0

    def _grow(self) -> None:
        self.sources = [np.concatenate((s, np.zeros_like(s))) for s in self.sources]
        self.clusters = np.concatenate((self.clusters, np.zeros_like(self.clusters)))

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of a piece; cluster -1: it has no copy here."""
        word, bit = source >> 6, np.uint64(1 << (source & 63))
        at = int(np.searchsorted(self.residual, size))
        full = self.sources[self.levels - 1]
        found, step = -1, 64
        while at < len(self.number):
            near = self.number[at : at + step]
            ok = (full[near, word] & bit) == 0
            if cluster >= 0:
                ok &= (self.clusters[near, cluster >> 6] & np.uint64(1 << (cluster & 63))) == 0
            if ok.any():
                found = at + int(ok.argmax())
                break
            at, step = at + step, step * 4
        if found >= 0:
            b, left = int(self.number[found]), int(self.residual[found])
            self._move(found, left - size)
        else:
            b, left = self.count, self.capacity
            self.count += 1
            if b >= len(self.clusters):
                self._grow()
            to = int(np.searchsorted(self.residual, left - size))
            self.residual = np.insert(self.residual, to, left - size)
            self.number = np.insert(self.number, to, b)
        for s in self.sources:  # the first level without the source
            if not s[b, word] & bit:
                s[b, word] |= bit
                break
        if cluster >= 0:
            self.clusters[b, cluster >> 6] |= np.uint64(1 << (cluster & 63))
        return b, self.capacity - left

    def _move(self, at: int, residual: int) -> None:
        """The bin at a place in the order gets a smaller residual."""
        b = self.number[at]
        to = int(np.searchsorted(self.residual[:at], residual))
        self.residual[to + 1 : at + 1] = self.residual[to:at]
        self.number[to + 1 : at + 1] = self.number[to:at]
        self.residual[to], self.number[to] = residual, b


def pack(sizes, sources, clusters, capacity: int, max_per_source: int):
    """Pieces of a bucket in their given order: arrays (row, chunk, start, tokens, bin, offset)."""
    sizes = np.asarray(sizes, np.int64)
    _, source = np.unique(np.asarray(sources), return_inverse=True)
    _, cluster, times = np.unique(np.asarray(clusters), return_inverse=True, return_counts=True)
    several = np.flatnonzero(times > 1)  # others conflict with nothing
    number = np.full(len(times), -1, np.int64)
    number[several] = np.arange(len(several))
    cluster = number[cluster]
    bins = Bins(capacity, int(source.max(initial=-1)) + 1, len(several), max_per_source)
    whole, rest = sizes // capacity, sizes % capacity
    out = []
    order = np.argsort(-rest, kind="stable")
    for i in order[rest[order] > 0].tolist():
        b, offset = bins.place(int(rest[i]), int(source[i]), int(cluster[i]))
        out.append((i, int(whole[i]), int(whole[i]) * capacity, int(rest[i]), b, offset))
    b = bins.count
    for i in np.flatnonzero(whole).tolist():
        for k in range(int(whole[i])):
            out.append((i, k, k * capacity, capacity, b, 0))
            b += 1
    return np.array(out, np.int64).reshape(-1, 6).T


def _measure(batches: Iterator[pa.RecordBatch], keep: list[str], added: list[str], text_col: str, by_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8(batch.column(text_col))
        n, cluster = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for a, b, data, at in pieces(raw, offsets):
            n[a:b] = np.diff(word_spans(data, at, NOT_SPACE)[2]) + 1
            if by_text:
                for i in range(b - a):
                    text = data[at[i] : at[i + 1]]
                    digest = hashlib.blake2b(text[NOT_SPACE[text]].tobytes(), digest_size=8).digest()
                    cluster[a + i] = int.from_bytes(digest, "little", signed=True)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(n), pa.array(cluster)], [*keep, *added])


RESULT = ["chunk", "start_token", "n_tokens", "bin_id", "bin_offset"]


def best_fit_pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    max_per_source: int = MAX_PER_SOURCE,
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
    bucket_tokens: int = BUCKET_TOKENS,
) -> DataFrame:
    """One row per piece: the columns of ``docs`` but the text, and chunk, start_token,
    n_tokens (the piece's span in its text), bin_id and bin_offset."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULT])
    names = [c for c in docs.columns if c != text_col]
    fields = [docs.schema[c] for c in names]
    tokens, cluster, row, bucket, source = fresh(docs, "tokens", "cluster", "row", "bucket", "source")
    schema = StructType([*fields, StructField(tokens, LongType()), StructField(cluster, LongType())])
    sized = docs.mapInArrow(lambda it: _measure(it, names, [tokens, cluster], text_col, cluster_col is None), schema)
    group = F.col(cluster) if cluster_col is None else F.xxhash64(F.col(f"`{cluster_col}`").cast("string"))
    sized = sized.select(
        *[F.col(f"`{c}`") for c in names],
        F.col(tokens),
        group.alias(cluster),
        F.coalesce(F.xxhash64(F.col(f"`{source_col}`").cast("string")), F.lit(0)).alias(source),
        F.monotonically_increasing_id().alias(row),
    )
    sized = durable(sized, "lengths")  # fixes the row numbers
    total = sized.agg(F.sum(tokens)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_tokens))
    dealt = sized.withColumn(bucket, F.pmod(F.xxhash64(row), F.lit(buckets)).cast("int"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(row)
        cols = [np.asarray(table.column(c).combine_chunks()) for c in (tokens, source, cluster)]
        i, chunk, start, n, b, offset = pack(*cols, capacity, max_per_source)
        taken = table.select(names).take(pa.array(i))
        extra = [chunk, start, n, b + (key[0].as_py() << 32), offset]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        for name, values, kind in zip(RESULT, extra, kinds, strict=True):
            taken = taken.append_column(name, pa.array(values, kind))
        return taken

    out = StructType([*fields, *(StructField(n, IntegerType() if n in ("n_tokens", "bin_offset") else LongType()) for n in RESULT)])
    return dealt.groupBy(bucket).applyInArrow(run, out)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(documents(spark, sf_dir).select("doc_id", "source", "text"))
