"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased code points; anything that is no letter becomes one blank, so
n-grams know word borders.  n-grams of ``ORDERS`` characters are hashed into ``BUCKETS``
buckets.  Training counts buckets by language over all labelled training texts: each task
sums its own dense counts, which are merged by (language, block of buckets), so that what
is gathered is languages x buckets numbers, whatever the input.  The smoothed matrix of
log probabilities (languages x buckets doubles, checked against ``MAX_MATRIX``) is
broadcast, and batches of texts are scored in NumPy: a text's sparse bucket counts times
the matrix, summed by text.

Defined results: null texts and texts without a letter are ``und`` with score 0; if there
is nothing to learn from, every text is ``und``; equal scores go to the language first in
alphabetical order; null labels teach nothing; empty texts teach only the class prior,
texts of any length count whole, repeated rows count each time; identifiers take no part;
an empty table gives an empty result; the score is the posterior probability; result names
replace input columns of the same name, whatever their case.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, other_fields, remainder
from .textkernel import mix, pieces, utf8

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
ALPHA = 0.5
#: Cells of the broadcast matrix at most (languages x buckets): 512 MB of doubles.
MAX_MATRIX = 1 << 26
_BLOCK = 1 << 12
_PIECE = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)

_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """By code point: its lower-case letter, or 0 for anything that is no letter."""
    if not _table:
        out = np.zeros(sys.maxunicode + 1, np.uint32)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                out[i] = ord(c.lower()[0])
        _table.append(out)
    return _table[0]


def _grams(text_bytes: np.ndarray, offsets: np.ndarray, buckets: int):
    """For each order: bucket numbers and n+1 offsets by text; and the texts that have a letter."""
    table = _letters()
    chars = np.frombuffer(text_bytes.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((text_bytes & 0xC0) != 0x80)))
    at = lead[offsets]  # offsets in characters
    if len(chars) != at[-1]:  # bytes that are no UTF-8
        sizes = [len(text_bytes[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(offsets, offsets[1:], strict=False)]
        at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        chars = chars[: at[-1]]
    n = len(at) - 1
    # a blank before each text; one blank for each run of characters that are no letters
    low = np.zeros(len(chars) + n + 1, np.uint32)
    low[np.arange(len(chars)) + np.repeat(np.arange(1, n + 1), np.diff(at))] = table[chars]
    text_at = at + np.arange(n + 1)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 0) | (low[:-1] != 0)
    keep[text_at] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    low, text_at = low[keep].astype(np.uint64), kept[text_at]
    letters = np.concatenate(([0], np.cumsum(low != 0)))
    has = letters[text_at[1:]] > letters[text_at[:-1]]
    out, h = [], low
    for order in range(1, max(ORDERS) + 1):
        if order > 1:
            h = h[:-1] * _P + low[order - 1 :]
        if order in ORDERS:
            # grams begin in the text and may end on the blank of the next
            ids = (mix(h + np.uint64(order)) & np.uint64(buckets - 1)).astype(np.int64)
            lo = np.minimum(text_at[:-1], len(ids))
            hi = np.minimum(np.maximum(text_at[1:] + 2 - order, lo), len(ids))
            out.append((ids, lo, hi))
    return out, has


def _segment_sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums over [lo, hi)."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[hi] - total[lo]


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        raw, offsets = utf8(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), object)
        for a, b, data, at in pieces(raw, offsets, _PIECE):
            grams, _ = _grams(data, at, buckets)
            for lang in set(langs[a:b]):
                mine = langs[a:b] == lang
                texts[lang] = texts.get(lang, 0) + int(mine.sum())
                sums = counts.setdefault(lang, np.zeros(buckets, np.int64))
                for ids, lo, hi in grams:
                    flags = np.zeros(len(ids) + 1, np.int64)
                    np.add.at(flags, lo[mine], 1)
                    np.add.at(flags, hi[mine], -1)
                    # the blank between two texts belongs to both
                    sums += np.bincount(ids, np.cumsum(flags)[:-1], buckets).astype(np.int64)
    rows = [(lang, k // _BLOCK, texts[lang] if k == 0 else 0, sums[k : k + _BLOCK].tobytes()) for lang, sums in counts.items() for k in range(0, buckets, _BLOCK)]
    for k in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows[k : k + 64]], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.binary()))],
            ["lang", "block", "texts", "counts"],
        )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the blocks that meet in this task."""
    sums: dict[tuple, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            new = np.frombuffer(r["counts"], np.int64)
            old = sums.setdefault((r["lang"], r["block"]), [0, 0])
            old[0] += r["texts"]
            old[1] = old[1] + new
    if sums:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in sums], pa.string()),
                pa.array([k[1] for k in sums], pa.int32()),
                pa.array([v[0] for v in sums.values()], pa.int64()),
                pa.array([v[1].tobytes() for v in sums.values()], pa.binary()),
            ],
            ["lang", "block", "texts", "counts"],
        )


_SCHEMA = "lang string, block int, texts long, counts binary"


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, alpha: float = ALPHA):
    """(languages, log priors, log-probability matrix) from all rows of ``train`` with a label."""
    rows = train.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).filter("lang IS NOT NULL")
    parts = rows.mapInArrow(lambda it: _count(it, buckets), _SCHEMA)
    parts = parts.repartition("lang", "block").mapInArrow(_merge, _SCHEMA).collect()  # languages x buckets / _BLOCK rows
    langs = sorted({r.lang for r in parts})
    if len(langs) * buckets > MAX_MATRIX:
        raise ValueError(f"{len(langs)} languages x {buckets} buckets exceed MAX_MATRIX; use fewer buckets")
    counts, texts = np.zeros((len(langs), buckets)), np.zeros(len(langs))
    for r in parts:
        i = langs.index(r.lang)
        texts[i] += r.texts
        counts[i, r.block * _BLOCK : (r.block + 1) * _BLOCK] += np.frombuffer(r.counts, np.int64)
    if not langs:
        return [], np.zeros(0), np.zeros((0, buckets))
    probs = np.log(counts + alpha) - np.log(counts.sum(1, keepdims=True) + alpha * buckets)
    return langs, np.log(texts / texts.sum()), probs


def identify(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced."""
    langs, priors, matrix = model
    buckets = matrix.shape[1]
    shared = docs.sparkSession.sparkContext.broadcast((priors, matrix))
    fields = other_fields(docs, "lang_pred", "score")
    names = [f.name for f in fields]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        priors, matrix = shared.value
        for batch in batches:
            raw, offsets = utf8(batch.column(text_col))
            pred, best = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for a, b, data, at in pieces(raw, offsets, _PIECE) if len(priors) else ():
                grams, has = _grams(data, at, buckets)
                logp = np.repeat(priors[:, None], b - a, axis=1)
                for ids, lo, hi in grams:
                    for k, row in enumerate(matrix):
                        logp[k] += _segment_sums(row[ids], lo, hi)
                top = logp.argmax(0)
                post = 1.0 / np.exp(logp - logp.max(0)).sum(0)
                for i in np.flatnonzero(has):
                    pred[a + i], best[a + i] = langs[top[i]], post[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(pred, pa.string()), pa.array(best)], [*names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(score, schema)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit(docs.filter(remainder(F.col("doc_id"), 5) != 0))
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
