"""Language-model scoring with an interpolated modified Kneser-Ney model of any order.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, then one end
token per text; contexts are padded with a begin mark, which is never scored.

Counting runs in Spark over all training texts.  Each task counts its n-grams of 64-bit
word hashes in NumPy and sends them, combined, to ``cells``: hash ranges of the context,
or of the last word for the few very common contexts, so that no cell has to hold all
n-grams of one hot context (which they are is found on a bounded sample of documents and
affects the layout alone, never a count).  A cell is merged in one task and stored as
sorted arrays: n-gram hashes with counts, and context hashes with their total and how many
words followed once, twice or more often.  The n-grams of the next lower order are counted
from the different ones of the higher (continuation counts), cell by cell in the same way,
down to single words.  The number of cells follows the size of the text, so a cell, and
with it the memory of a task, does not grow.  The files lie in the shared folder, written
under a temporary name and renamed, so a repeated task leaves the same file.

Scoring maps over all texts; workers memory-map the files and look up sorted hashes.
    p_n(w | h) = (c - D(c)) / C + (D1 n1 + D2 n2 + D3 n3) / C * p_{n-1}(w | h')
with c the count of the n-gram, C and n1 to n3 those of its context h, and h' the context
without its first word; lower orders use continuation counts, and below single words is
1 / (V + 1), which is what an unseen word gets.  The discounts D1, D2, D3+ come from the
counts of counts at each order.

The order is a parameter, two in the registered query: see the README for what three costs.

Defined results: null text counts as empty; an empty text has one token, its end; texts of
any length count whole; with nothing to learn from, N = V = 0 and every token has
probability 1; repeated rows count and score each time; a null identifier is an empty one
where identifiers choose the training texts; nothing depends on ties or on the order of
rows; an empty table gives an empty result; result names replace input columns of the same
name, whatever their case.
"""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import documents, new_dir, other_fields, remainder
from .textkernel import LOWER, NOT_SPACE, loads, mix, pieces, span_hashes, utf8, word_spans

BEGIN, END = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
ORDER, FLUSH = 2, 3_000_000
#: Layout only: documents of the sample at most; contexts above HOT_SHARE of its tokens are
#: split; a cell is made for about so many tokens, and a task merges so many cells.
SAMPLE_DOCS, HOT_SHARE, CELL_TOKENS, TASK_CELLS = 20_000, 0.004, 1 << 19, 4
_P = np.uint64(0x9E3779B97F4A7C15)


# --- files ----------------------------------------------------------------------------


def _store(path: str):
    """(filesystem, path) for a folder that is no local one, else (None, local path)."""
    if path.startswith("file:"):
        return None, "/" + path[5:].lstrip("/")
    if "://" not in path:
        return None, path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _narrow(a: np.ndarray) -> np.ndarray:
    """Counts in four bytes where they fit, else in eight."""
    return a.astype("<u4" if not len(a) or int(a.max()) < 1 << 32 else "<u8")


def _save(path: str, arrays: list[np.ndarray]) -> None:
    """Length, item sizes and the arrays, one after the other, under a name that appears at
    once."""
    fs, local = _store(path)
    head = struct.pack(f"<{len(arrays) + 2}q", len(arrays[0]), len(arrays), *(a.itemsize for a in arrays))
    data = head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    temp = f"{local}.{uuid.uuid4().hex}"
    if fs is None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(temp, "wb") as f:
            f.write(data)
        os.replace(temp, local)
    else:
        fs.create_dir(os.path.dirname(local), recursive=True)
        with fs.open_output_stream(temp) as f:
            f.write(data)
        fs.move(temp, local)


def _map(path: str) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped; none if there is no such file.  A file in a
    store that cannot be mapped is first copied to an unnamed local file."""
    fs, local = _store(path)
    if fs is None:
        if not os.path.exists(local):
            return []
        f = open(local, "rb")  # noqa: SIM115 - closed below
    else:
        from pyarrow.fs import FileType

        if fs.get_file_info(local).type == FileType.NotFound:
            return []
        f = tempfile.TemporaryFile()  # noqa: SIM115 - closed below
        with fs.open_input_stream(local) as s:
            while block := s.read(1 << 22):
                f.write(block)
        f.flush()
        f.seek(0)
    with f:
        n, k = struct.unpack("<2q", f.read(16))
        sizes = struct.unpack(f"<{k}q", f.read(8 * k))
        if not n:
            return []
        whole, out, at = np.memmap(f, np.uint8, "r"), [], 16 + 8 * k
    for size in sizes:
        out.append(whole[at : at + n * size].view(f"<u{size}"))
        at += n * size
    return out


# --- counting -------------------------------------------------------------------------


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes (words, then END) of lower-cased texts, and n+1 offsets by text."""
    starts, ends, word_at = word_spans(data, at, NOT_SPACE)
    n = len(at) - 1
    out = np.full(len(starts) + n, END, np.uint64)
    if len(starts):
        out[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(word_at))] = span_hashes(loads(data), starts, ends - starts)
    return out, word_at + np.arange(n + 1)


def grams(toks: np.ndarray, at: np.ndarray, order: int, begin) -> list[np.ndarray]:
    """Columns of the n-gram that ends at each token, first word first; ``begin`` before a
    text's first token."""
    place = np.arange(len(toks)) - np.repeat(at[:-1], np.diff(at))
    out = []
    for back in range(order - 1, 0, -1):
        column = np.empty_like(toks)
        column[back:] = toks[: len(toks) - back]
        column[place < back] = begin
        out.append(column)
    return [*out, toks]


def context_hash(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of the words of a context; of a single word, its own."""
    h = columns[0]
    for c in columns[1:]:
        h = mix(h * _P + c)
    return h


def gram_hash(context: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(context * _P + w)


@dataclass(frozen=True)
class Layout:
    """Cells and word ranges, both powers of two, and the split contexts of each order."""

    path: str
    order: int
    cell_bits: int
    word_bits: int
    hot: dict[int, tuple[int, ...]]

    def is_hot(self, order: int, context: np.ndarray) -> np.ndarray:
        hot = np.array(self.hot.get(order, ()), np.uint64)  # sorted
        if not len(hot):
            return np.zeros(len(context), bool)
        return hot[np.minimum(np.searchsorted(hot, context), len(hot) - 1)] == context

    def cells(self, order: int, context: np.ndarray, w: np.ndarray) -> np.ndarray:
        if order == 1:
            return (w >> np.uint64(64 - self.word_bits)).astype(np.int32)
        return (np.where(self.is_hot(order, context), w, context) >> np.uint64(64 - self.cell_bits)).astype(np.int32)

    def file(self, kind: str, order: int, cell: int) -> str:
        return f"{self.path}/{kind}{order}/{cell:08d}"


def _blobs(columns: list[np.ndarray], values: list[np.ndarray], layout: Layout) -> Iterator[tuple[int, bytes]]:
    """(cell, blob) of different n-grams with their values, rows of one context together."""
    order = len(columns)
    if not len(columns[-1]):
        return
    context = context_hash(columns[:-1]) if order > 1 else columns[0]
    cell = layout.cells(order, context, columns[-1])
    by = np.argsort(cell, kind="stable")
    cell, columns, values = cell[by], [c[by] for c in columns], [v[by] for v in values]
    cuts = np.append(np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))), len(cell))
    for a, b in zip(cuts, cuts[1:], strict=False):
        new = np.zeros(b - a, bool)
        new[0] = True
        for c in columns[:-1]:
            new[1:] |= c[a + 1 : b] != c[a : b - 1]
        run = np.flatnonzero(new) if order > 1 else np.zeros(0, np.int64)
        runs = np.diff(np.append(run, b - a)).astype(np.uint32) if order > 1 else np.zeros(0, np.uint32)
        narrow = [_narrow(v[a:b]) for v in values]
        head = struct.pack(f"<{2 + len(values)}q", len(run), b - a, *(v.itemsize for v in narrow))
        parts = [c[a:b][run].tobytes() for c in columns[:-1]] + [columns[-1][a:b].tobytes(), runs.tobytes()] + [v.tobytes() for v in narrow]
        yield int(cell[a]), head + b"".join(parts)


def _open_blob(blob: bytes, order: int, n_values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns and values of a blob."""
    nv, n, *sizes = struct.unpack_from(f"<{2 + n_values}q", blob)
    at, columns = 8 * (2 + n_values), []
    for _ in range(order - 1):
        columns.append(np.frombuffer(blob, np.uint64, nv, at))
        at += 8 * nv
    last = np.frombuffer(blob, np.uint64, n, at)
    at += 8 * n
    runs = np.frombuffer(blob, np.uint32, nv, at)
    at += 4 * nv
    values = []
    for size in sizes:
        values.append(np.frombuffer(blob[at : at + n * size], f"<u{size}").astype(np.int64))
        at += n * size
    return [np.repeat(c, runs) for c in columns] + [last], values


def _combine(tok: list[np.ndarray], at: list[np.ndarray], layout: Layout) -> Iterator[tuple[int, bytes]]:
    """Blobs of the different n-grams of texts: token hashes and offsets by piece."""
    toks = np.concatenate(tok)
    starts, size = [], 0
    for a in at:
        starts.append(a[:-1] + size)
        size += int(a[-1])
    offsets = np.append(np.concatenate(starts), size)
    words, ids = np.unique(np.append(toks, BEGIN), return_inverse=True)
    ids = ids.astype(np.int64)
    columns = grams(ids[:-1], offsets, layout.order, ids[-1])
    code, prefix = columns[0], []  # numbers of the prefixes so far, and what each stands for
    for c in columns[1:-1]:
        pairs, number = np.unique(code * len(words) + c, return_inverse=True)
        prefix.append(pairs)
        code = number.astype(np.int64)
    code = code * len(words) + columns[-1]
    code.sort()
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    count = np.diff(np.append(first, len(code)))
    lead, last = np.divmod(code[first], len(words))
    out = [last]
    for pairs in reversed(prefix):
        lead, c = np.divmod(pairs[lead], len(words))
        out.append(c)
    out.append(lead)
    yield from _blobs([words[c] for c in reversed(out)], [count], layout)


def _in_batches(rows: Iterator[tuple[int, bytes]], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int32()), pa.array([r[1] for r in held], pa.binary())], ["k", "blob"])

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size > most:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def _count(batches: Iterator[pa.RecordBatch], layout: Layout, flush: int) -> Iterator[pa.RecordBatch]:
    def rows():
        tok, ats, size = [], [], 0
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for _, _, data, at in pieces(raw, offsets):
                toks, tok_at = tokens(LOWER[data], at)
                tok.append(toks)
                ats.append(tok_at)
                size += len(toks)
                if size >= flush:
                    yield from _combine(tok, ats, layout)
                    tok, ats, size = [], [], 0
        if size:
            yield from _combine(tok, ats, layout)

    yield from _in_batches(rows())


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(key, blobs) from rows sorted by key."""
    key, blobs = None, []
    for batch in batches:
        for k, blob in zip(batch.column("k").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if k != key and blobs:
                yield key, blobs
                blobs = []
            key = k
            blobs.append(blob)
    if blobs:
        yield key, blobs


def _sums(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sorted different keys and the sums of each value by key."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return [keys[first], *(np.add.reduceat(v[order], first) for v in values)]


# Rows with a negative key -order carry what the driver needs of an order: counts of counts
# and the sums of split contexts.  They pass through the lower orders.


def _summary(of_counts: np.ndarray, sums: list[np.ndarray]) -> bytes:
    return struct.pack("<q", len(sums[0])) + of_counts.astype(np.int64).tobytes() + b"".join(np.ascontiguousarray(x).astype("<u8").tobytes() for x in sums)


def _add_summaries(blobs: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    of_counts, parts = np.zeros(4, np.int64), []
    for blob in blobs:
        (n,) = struct.unpack_from("<q", blob)
        of_counts = of_counts + np.frombuffer(blob, np.int64, 4, 8)
        parts.append([np.frombuffer(blob, np.uint64, n, 40 + 8 * n * k) for k in range(5)])
    sums = _sums(np.concatenate([p[0] for p in parts]), *(np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(1, 5)))
    return of_counts, sums


def _merge_cells(batches: Iterator[pa.RecordBatch], layout: Layout, order: int) -> Iterator[pa.RecordBatch]:
    """Write each cell's files; give the n-grams of the next lower order, counted by cell.
    Values: the count at this order, and of the top order (which gives word counts)."""
    top = order == layout.order

    def rows():
        of_counts, hot = np.zeros(4, np.int64), []
        for cell, blobs in _groups(batches):
            if cell < 0:
                yield cell, _summary(*_add_summaries(blobs))
                continue
            opened = [_open_blob(b, order, 1 if top else 2) for b in blobs]
            columns = [np.concatenate([c[i] for c, _ in opened]) for i in range(order)]
            values = [np.concatenate([v[i] for _, v in opened]) for i in range(1 if top else 2)]
            del opened
            context = context_hash(columns[:-1])
            key = gram_hash(context, columns[-1])
            by = np.argsort(key)
            key = key[by]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            values = [np.add.reduceat(v[by], first) for v in values]
            by, key = by[first], key[first]
            columns, context, c = [x[by] for x in columns], context[by], values[0]
            _save(layout.file("grams", order, cell), [key, _narrow(c)])
            of_counts += np.bincount(np.minimum(c, 5), minlength=6)[1:5]
            sums = _sums(context, c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64))
            split = layout.is_hot(order, sums[0])
            _save(layout.file("contexts", order, cell), [sums[0][~split], *(_narrow(x[~split]) for x in sums[1:])])
            if split.any():
                hot.append([x[split] for x in sums])
            # the next lower order: different n-grams here, and their top counts
            low = columns[1:]
            code = context_hash(low)
            by = np.argsort(code, kind="stable")
            code = code[by]
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            low = [x[by][first] for x in low]
            more, times = np.add.reduceat(values[-1][by], first), np.diff(np.append(first, len(code)))
            if order > 2:  # rows of one context together
                by = np.argsort(context_hash(low[:-1]), kind="stable")
                low, times, more = [x[by] for x in low], times[by], more[by]
            yield from _blobs(low, [times, more], layout)
        sums = [np.concatenate([h[k] for h in hot]) for k in range(5)] if hot else [np.zeros(0, np.uint64)] * 5
        yield -order, _summary(of_counts, sums)

    yield from _in_batches(rows())


def _merge_words(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """Write each word range's file; give summaries and one row of totals per range."""

    def rows():
        for part, blobs in _groups(batches):
            if part < 0:
                yield part, _summary(*_add_summaries(blobs))
                continue
            opened = [_open_blob(b, 1, 2) for b in blobs]
            words, before, count = _sums(np.concatenate([c[0] for c, _ in opened]), *(np.concatenate([v[i] for _, v in opened]) for i in range(2)))
            _save(layout.file("words", 1, part), [words, _narrow(count), _narrow(before)])
            of = np.bincount(np.minimum(before, 5), minlength=6)[1:5]
            yield part, struct.pack("<7q", int(count.sum()), len(words), int(before.sum()), *of.tolist())

    yield from _in_batches(rows())


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts 1 to 4; a level without some of them gets
    the values at their limits, between 0 and the count."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [k - (k + 1) * y * b / a if a else k * y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1))


@dataclass(frozen=True)
class Model:
    layout: Layout
    tokens: int
    words: int
    pairs: int
    discounts: dict[int, tuple[float, float, float]]  # by order
    ones: tuple[int, int, int]  # words with 1, 2, more different words before them
    hot: dict[int, list[np.ndarray]]  # by order: split contexts, total, followed once, twice, more


def _sampled_layout(train: DataFrame, id_col: str, text_col: str, path: str, order: int) -> Layout:
    """Cells for the size of the text and contexts to be split, by a sample of at most about
    SAMPLE_DOCS documents: a matter of layout."""
    n = train.count()
    step = max(1, n // SAMPLE_DOCS)
    share = HOT_SHARE

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for _, _, data, at in pieces(raw, offsets):
                toks, tok_at = tokens(LOWER[data], at)
                columns = grams(toks, tok_at, order, BEGIN)
                for k in range(2, order + 1):
                    h, times = np.unique(context_hash(columns[order - k : order - 1]), return_counts=True)
                    top = times >= max(2, share * len(toks) / 4)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(top.sum(), k)), pa.array(h[top].view(np.int64)), pa.array(times[top])], ["k", "h", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([len(toks)])], ["k", "h", "n"])

    key = F.concat(F.lit("s"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    sample = train.filter(F.crc32(key.cast("binary")) % step == 0).select(F.col(f"`{text_col}`").alias("text"))
    counts = sample.mapInArrow(run, "k long, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))
    total = counts.groupBy().agg(F.max(F.when(F.col("k") == 0, F.col("n")))).first()[0] or 0
    rows = counts.filter((F.col("k") > 0) & (F.col("n") >= F.lit(share * total))).collect()  # at most 1 / HOT_SHARE rows by order
    begins = [np.full(1, BEGIN)] * (order - 1)
    hot = {k: {int(context_hash(begins[: k - 1])[0])} | {r.h % (1 << 64) for r in rows if r.k == k} for k in range(2, order + 1)}
    cells = max(4, int(total * step / CELL_TOKENS).bit_length())
    return Layout(path, order, cells, max(3, cells - 3), {k: tuple(sorted(v)) for k, v in hot.items()})


def fit(train: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, order: int = ORDER) -> Model:
    """Count and store the model of all texts of ``train``."""
    if order < 2:
        raise ValueError("the order is two at least")
    spark = train.sparkSession
    layout = _sampled_layout(train, id_col, text_col, path or new_dir(spark, "ngrams"), order)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (1 << layout.cell_bits) // TASK_CELLS)
    flush = FLUSH
    rows = train.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(lambda it: _count(it, layout, flush), "k int, blob binary")
    for k in range(order, 1, -1):
        rows = rows.repartition(parts, "k").sortWithinPartitions("k").mapInArrow(lambda it, k=k: _merge_cells(it, layout, k), "k int, blob binary")
    rows = rows.repartition(parts, "k").sortWithinPartitions("k").mapInArrow(lambda it: _merge_words(it, layout), "k int, blob binary")
    found = rows.collect()  # one small row per range of words and per order
    of_words, totals = np.zeros(4, np.int64), np.zeros(3, np.int64)
    for r in found:
        if r.k >= 0:
            values = struct.unpack("<7q", r.blob)
            totals += np.array(values[:3])
            of_words += np.array(values[3:])
    by_order = {k: _add_summaries([bytes(r.blob) for r in found if r.k == -k]) for k in range(2, order + 1) if any(r.k == -k for r in found)}
    empty = [np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))]
    found_discounts = {k: discounts((by_order[k][0] if k in by_order else np.zeros(4, int)).tolist()) for k in range(2, order + 1)}
    n, v, pairs = (int(x) for x in totals)
    ones = (int(of_words[0]), int(of_words[1]), v - int(of_words[0]) - int(of_words[1]))
    hot = {k: by_order[k][1] if k in by_order else empty for k in range(2, order + 1)}
    return Model(layout, n, v, pairs, {1: discounts(of_words.tolist()), **found_discounts}, ones, hot)


# --- scoring --------------------------------------------------------------------------


class Scorer:
    """Log probabilities from the mapped files; one per worker task."""

    def __init__(self, model: Model):
        self.m, self.files = model, {}

    def _look_up(self, kind: str, order: int, cell: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
        """(n, keys) values of sorted files; 0 where a key is in none."""
        out = np.zeros((n, len(keys)))
        by = np.argsort(cell, kind="stable")
        cell = cell[by]
        cuts = np.append(np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))), len(cell)) if len(cell) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            path = self.m.layout.file(kind, order, int(cell[a]))
            if path not in self.files:
                self.files[path] = _map(path)
            arrays = self.files[path]
            if not arrays:
                continue
            mine = keys[by[a:b]]
            at = np.minimum(np.searchsorted(arrays[0], mine), len(arrays[0]) - 1)
            there = arrays[0][at] == mine
            if there.any():
                for k in range(n):
                    out[k, by[a:b]] = np.where(there, arrays[k + 1][at], 0)
        return out

    def _contexts(self, order: int, context: np.ndarray) -> np.ndarray:
        """(4, n): total, followed once, twice, more."""
        layout, hot = self.m.layout, self.m.hot[order]
        different, back = np.unique(context, return_inverse=True)
        out = self._look_up("contexts", order, (different >> np.uint64(64 - layout.cell_bits)).astype(np.int32), different, 4)
        if len(hot[0]):
            at = np.minimum(np.searchsorted(hot[0], different), len(hot[0]) - 1)
            there = hot[0][at] == different
            for k in range(4):
                out[k] = np.where(there, hot[k + 1][at], out[k])
        return out[:, back]

    def score(self, toks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: known tokens, base score and model score."""
        m, layout = self.m, self.m.layout
        words, wi = np.unique(toks, return_inverse=True)
        count, before = self._look_up("words", 1, layout.cells(1, words, words), words, 2)
        p = np.full(len(words), 1.0 / (m.words + 1))
        if m.pairs:
            d1, d2, d3 = m.discounts[1]
            off = np.select([before >= 3, before == 2, before == 1], [d3, d2, d1], 0.0)
            p = (before - off) / m.pairs + (d1 * m.ones[0] + d2 * m.ones[1] + d3 * m.ones[2]) / m.pairs * p
        p = p[wi]
        columns = grams(toks, at, layout.order, BEGIN)
        for k in range(2, layout.order + 1):
            context = context_hash(columns[layout.order - k : -1])
            total, one, two, more = self._contexts(k, context)
            (c,) = self._look_up("grams", k, layout.cells(k, context, toks), gram_hash(context, toks), 1)
            d1, d2, d3 = m.discounts[k]
            off = np.select([c >= 3, c == 2, c == 1], [d3, d2, d1], 0.0)
            seen = np.maximum(total, 1)
            p = np.where(total > 0, (c - off) / seen + (d1 * one + d2 * two + d3 * more) / seen * p, p)
        base = np.log10((count + 1) / (m.tokens + m.words + 1))
        first = at[:-1]
        return np.add.reduceat((count[wi] > 0).astype(np.int64), first), np.add.reduceat(base[wi], first), np.add.reduceat(np.log10(p), first)


RESULT = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score (log10 of the
    text's probability; perplexity is 10 ** (-score / n_tokens))."""
    kinds = [LongType()] * 3 + [DoubleType()] * 2
    fields = other_fields(docs, *RESULT, *([] if keep_text else [text_col]))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            raw, offsets = utf8(batch.column(text_col))
            out = [np.zeros(batch.num_rows, np.int64) for _ in range(3)] + [np.zeros(batch.num_rows) for _ in range(2)]
            out[2][:] = model.tokens
            for a, b, data, at in pieces(raw, offsets, 4 << 20):
                toks, tok_at = tokens(LOWER[data], at)
                out[0][a:b] = np.diff(tok_at)
                out[1][a:b], out[3][a:b], out[4][a:b] = scorer.score(toks, tok_at)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(x) for x in out], names + RESULT)

    schema = StructType([*fields, *(StructField(n, k) for n, k in zip(RESULT, kinds, strict=True))])
    return docs.mapInArrow(run, schema)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = remainder(F.col("doc_id"), 7) == 2
    model = fit(docs.filter(~held))
    return score_texts(docs.select("doc_id", held.alias("held_out"), "text"), model, keep_text=False)
