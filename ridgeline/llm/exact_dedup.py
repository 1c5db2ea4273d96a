"""Exact deduplication with a log-structured merge index of digests (DataFrame only).

A batch of rows is the memtable: ``flush`` sorts each task's rows by digest and writes
them as one run, a Parquet file whose digest column carries min/max statistics and a Bloom
filter, and writes the run's own filter beside it: a bitmap over hashed digests, in pieces
of 32 768 bits.  ``lookup`` finds the rows of older runs whose digests a batch meets; only
digests that pass a run's filter reach its rows.  ``compact`` merges runs and keeps, by
digest, the smallest keeper and the number of rows; it runs when ``FANOUT`` runs are held.
``exact_dedup`` may deal the rows of a call into several batches by a hash of the identifier;
groups come from what each flush found in its batch and, by lookup, in the runs before.

Hits (digests met more than once) are verified byte by byte: the texts of a digest's rows,
of the batch and of older keepers, must have equal least and greatest.  A filter over the
hit rows' raw text hashes, of at most ``FILTER_BITS`` bits whatever the corpus, is broadcast
and says which texts to normalise; texts of other rows never travel, and of a task only
two texts of a digest do.  Rows of a digest whose texts differ are regrouped by the text
itself over all batches, now and in every later batch.

A group of copies of any size is merged by partial aggregation before each shuffle; its
rows meet their keeper by a join whose very frequent keys are broadcast.

Defined results: null text counts as empty; empty texts form one group; texts of any
length count whole; of rows that tie, the smallest identifier stays; null identifiers sort
last; rows that repeat an identifier and text are one document, and all of them carry
``kept``; an empty table gives an empty result; extra columns pass through and may have
any names, except that result names replace them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable, few, filter_bits, fresh, make_filter, meet, new_dir, passing, without

#: Runs that are held before they are merged.
FANOUT = 8
#: Batches that the query deals its rows into, and its runs before they are merged: the
#: last batch looks into a merged run.
BATCHES, BATCH_FANOUT = 4, 3
BLANKS = " \t\n\x0b\x0c\r"


def squeeze(text: Column) -> Column:
    """Text without the characters [\\x20\\x09-\\x0D]; null as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestIndex:
    """Sorted digest runs under one folder: ``run-<n>`` with ``filter-<n>`` as flushed or
    merged.  Each is a folder of its own and is never edited, so a job that is retried or
    loses executors sees whole runs only.  A run has one row (digest, keep, group_size)
    per digest.  ``sources`` are the batches, from which texts of keepers are read again."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int | None = None):
        self.spark, self.path, self.fanout = spark, path or new_dir(spark, "digests"), fanout or FANOUT
        self.runs: list[tuple[str, int]] = []  # folder number and bits of its filter
        self.sources: list[DataFrame] = []
        self.unequal: DataFrame | None = None
        self.written = 0

    def _write(self, df: DataFrame) -> DataFrame:
        """Store rows sorted by digest as a run with its filter."""
        path = f"{self.path}/run-{self.written}"
        (
            df.sortWithinPartitions("digest")
            .write.option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .parquet(path)
        )
        run = self.spark.read.schema(df.schema).parquet(path)
        bits = filter_bits(run.count())
        make_filter(run.select(F.xxhash64("digest").alias("h")), bits).write.parquet(f"{self.path}/filter-{self.written}")
        self.runs.append((str(self.written), bits))
        self.written += 1
        return run

    def _read(self, number: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/run-{number}")

    def lookup(self, digests: DataFrame) -> DataFrame | None:
        """Rows of the held runs that have one of ``digests`` (one row per digest)."""
        out = None
        for number, bits in self.runs:
            asked = passing(digests.select("digest"), F.xxhash64("digest"), self.spark.read.parquet(f"{self.path}/filter-{number}"), bits)
            asked = durable(asked, "asked")
            found = self._read(number).join(F.broadcast(asked) if few(asked) else asked, "digest", "left_semi")
            out = found if out is None else out.unionByName(found)
        return out

    def flush(self, rows: DataFrame) -> DataFrame:
        """Write the digests of a batch (digest, keep, ...) as a run; gives, for each of
        them, the keeper and the number of rows over all batches so far."""
        own = rows.groupBy("digest").agg(F.min("keep").alias("keep"), F.count(F.lit(1)).alias("group_size"))
        own = durable(own, "memtable") if self.runs else own
        older = self.lookup(own)
        run = self._write(own)
        if older is None:
            return run
        merged = run.unionByName(older).groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"))
        merged = durable(merged, "merged")
        if len(self.runs) >= self.fanout:
            self.compact()
        return merged

    def compact(self) -> DataFrame:
        """Merge all runs into one."""
        rows = None
        for number, _ in self.runs:
            rows = self._read(number) if rows is None else rows.unionByName(self._read(number))
        self.runs = []
        return self._write(rows.groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size")))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = squeeze,
    digest: Callable[[Column], Column] = sha256,
    index: DigestIndex | None = None,
    batches: int = 1,
) -> DataFrame:
    """All rows of ``docs`` without the text, with keep_id, group_size, kept and digest.
    Of equal normalised texts the row of the longest original text in code points stays,
    then the smallest identifier.  With an ``index``, rows are also compared with those of
    the batches before, whose frames must still be readable.  ``batches``: in how many
    batches the rows are flushed; the result does not depend on it."""
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    docs = without(docs, "keep_id", "group_size", "kept", "digest")
    names = [c for c in docs.columns if c != text_col]
    raw, keep, rep, size, part = fresh(docs, "raw", "keep", "rep", "size", "part")
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    order = F.struct(
        (-F.char_length(F.coalesce(text, F.lit("")))).alias("o"), ident.isNull().alias("n"), ident.alias("id")
    )
    # texts are normalised and hashed once; what follows reads digests
    rows = docs.select(*[F.col(f"`{c}`") for c in names], digest(normalise(text)).alias("digest"), F.xxhash64(text).alias(raw), order.alias(keep), F.pmod(F.xxhash64(ident), F.lit(batches)).alias(part))
    rows = durable(rows, "digests")
    merged = None
    for b in range(batches):
        found = index.flush(rows.filter(F.col(part) == b).select("digest", F.col(keep).alias("keep"))).filter("group_size > 1")
        merged = found if merged is None else merged.unionByName(found)
    if batches > 1:  # the last batch that has a digest knows all of its rows
        merged = merged.groupBy("digest").agg(F.min("keep").alias("keep"), F.max("group_size").alias("group_size"))
    rows = rows.drop(part)
    index.sources.append(docs.select(text.alias("text"), order.alias("keep")))
    hits = durable(merged.select("digest", F.col("keep").alias(rep), F.col("group_size").alias(size)), "hits")
    marked = meet(rows, hits, ["digest"], size, "left")

    # byte verification
    hashes = durable(marked.filter(F.col(size).isNotNull()).select(F.col(raw).alias("h")).distinct(), "hashes")
    bits = filter_bits(hashes.count())
    near = durable(make_filter(hashes, bits), "filter")
    texts = passing(index.sources[-1], F.xxhash64("text"), near, bits).select("text")
    if len(index.sources) > 1:
        keepers = durable(hits.select(F.xxhash64(F.col(f"{rep}.id")).alias("h")).distinct(), "keepers")
        their_bits = filter_bits(keepers.count())
        theirs = durable(make_filter(keepers, their_bits), "filter")
        for source in index.sources[:-1]:
            texts = texts.unionByName(passing(source, F.xxhash64("keep.id"), theirs, their_bits).select("text"))
    norm = texts.select(normalise(F.col("text")).alias("norm")).select(digest(F.col("norm")).alias("digest"), "norm")
    unequal = norm.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).filter("lo <> hi").select("digest")
    if index.unequal is not None:
        unequal = unequal.unionByName(index.unequal).distinct()
    unequal = durable(unequal, "unequal")
    kept = [*[F.col(f"`{c}`") for c in names], F.col("digest")]
    if unequal.isEmpty():
        out = marked.select(*kept, F.coalesce(F.col(f"{rep}.id"), ident).alias("keep_id"), F.coalesce(size, F.lit(1).cast("long")).alias("group_size"))
    else:
        index.unequal = unequal
        bad = F.broadcast(unequal) if few(unequal) else unequal
        every = None
        for source in index.sources:
            part = source.select(normalise(F.col("text")).alias("norm"), "keep").withColumn("digest", digest(F.col("norm"))).join(bad, "digest", "left_semi")
            every = part if every is None else every.unionByName(part)
        by_text = every.groupBy("digest", "norm").agg(F.min("keep").alias("keep"), F.count(F.lit(1)).alias("n"))
        r, t, d, n, own = fresh(docs, "k", "norm", "digest", "n", "own")
        by_text = by_text.select(F.col("digest").alias(d), F.col("norm").alias(t), F.col("keep").alias(r), F.col("n").alias(n))
        doubtful = docs.withColumn(own, normalise(text)).withColumn("digest", digest(F.col(own))).join(bad, "digest", "left_semi")
        again = doubtful.join(by_text, (F.col("digest") == F.col(d)) & (F.col(own) == F.col(t)))
        again = again.select(*kept, F.col(f"{r}.id").alias("keep_id"), F.col(n).alias("group_size"))
        fine = marked.join(bad, "digest", "left_anti").select(*kept, F.coalesce(F.col(f"{rep}.id"), ident).alias("keep_id"), F.coalesce(size, F.lit(1).cast("long")).alias("group_size"))
        out = fine.unionByName(again)
    return out.withColumn("kept", ident.eqNullSafe(F.col("keep_id")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, fanout=BATCH_FANOUT)
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text"), index=index, batches=BATCHES).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
