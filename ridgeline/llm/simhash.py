"""SimHash near-deduplication with pivot distance tables.

Fingerprints: A-Z lower-cased, words split at ``[\\x20\\x09-\\x0D]+``, shingles of
``width`` words joined by blanks (repeats included), XXH64 of each (UTF-8, seed 42), and a
bit set where over half of the hashes have it.  Fingerprints link if at most ``radius``
bits differ; linked ones form components.

Pivot tables: the reference fingerprints come in groups, each group living on its own
block of bits.  A fingerprint's coordinates in a group are its Hamming distances to the
group's references; a difference of coordinates never exceeds the distance of the
fingerprints on that block.  With more groups than ``radius``, linked fingerprints have
distance 0, and so equal coordinates, in at least groups - radius groups: pairs meet in
the sorted runs of these coordinates.  In a run, pairs whose largest coordinate
difference over the full-width pivots exceeds the radius are discarded, and survivors
are verified by their exact distance.  No linked pair is lost, and pairs are not written:
a run gives only the edges of a spanning forest (breadth-first over what is not yet
reached, so a run of mutual copies costs its size, not its square).

Scale: copies collapse to one fingerprint before any pairing; each different fingerprint
is sent 35 times 16 bytes (7 groups, any 3 equal: 27 bits).  Beyond 16 million different
fingerprints there are 8 groups of which 4 are equal (70 keys of 32 bits), beyond a
billion 9 of which 5 are (126 keys of 36 bits), so runs of unrelated ones stay short.  A
key of more than RUN_ROWS fingerprints is cut into blocks, and every pair of blocks is
compared, so no link is lost and no task holds more than two blocks of a key.

Defined results: null and empty texts have no shingles and fingerprint zero, which links
like any other; fewer words than ``width``: the whole sequence is the one shingle; rows
that repeat an identifier are nodes of their own and share its component; null
identifiers take part but never name a component unless all are null; texts of any length
count whole; a bit set in exactly half of the hashes is 0; an empty table gives an empty
result; result names replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import documents, durable, few, without
from .components import components
from .textkernel import LOWER, NOT_SPACE, loads, mix, pieces, utf8, word_spans

WIDTH, RADIUS, SEED = 4, 4, 42

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of byte spans, all spans at once; ``words`` from ``loads()``."""
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        out = np.empty(len(starts), np.uint64)
        # spans by their number of whole 32-byte stripes and 8-byte lanes
        order = np.argsort(lengths >> 3, kind="stable")
        lanes = (lengths >> 3)[order]
        cuts = np.flatnonzero(np.diff(lanes)) + 1
        for part in np.split(order, cuts):
            if not len(part):
                continue
            at, size = starts[part].copy(), lengths[part]
            n = int(size[0] >> 3)
            if n >= 4:
                a, b, c, d = (np.full(len(part), v, np.uint64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1))
                for _ in range(n // 4):
                    a = _rot(a + words[at] * _P2, 31) * _P1
                    b = _rot(b + words[at + 8] * _P2, 31) * _P1
                    c = _rot(c + words[at + 16] * _P2, 31) * _P1
                    d = _rot(d + words[at + 24] * _P2, 31) * _P1
                    at += 32
                h = _rot(a, 1) + _rot(b, 7) + _rot(c, 12) + _rot(d, 18)
                for v in (a, b, c, d):
                    h = (h ^ (_rot(v * _P2, 31) * _P1)) * _P1 + _P4
            else:
                h = np.full(len(part), s + _P5, np.uint64)
            h += size.astype(np.uint64)
            for _ in range(n % 4):
                h = _rot(h ^ (_rot(words[at] * _P2, 31) * _P1), 27) * _P1 + _P4
                at += 8
            four = np.flatnonzero(size & 4)
            h[four] = _rot(h[four] ^ ((words[at[four]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            at[four] += 4
            rest = size & 3
            for k in range(3):
                left = np.flatnonzero(rest > k)
                h[left] = _rot(h[left] ^ ((words[at[left] + k] & np.uint64(0xFF)) * _P5), 11) * _P1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[part] = h ^ (h >> np.uint64(32))
        return out


def _majority(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits set in over half of the hashes of each segment at[i]:at[i+1]; 0 if it is empty."""
    n = np.diff(at)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    lanes = np.uint64(0x0001000100010001)
    # segments in chunks below 2**16, so that four 16-bit counters share a word
    big = 60_000
    cuts = np.concatenate([np.arange(at[i], at[i + 1], big) for i in some]) if n.max() > big else at[:-1][some]
    owner = np.searchsorted(at[:-1][some], cuts, side="right") - 1
    half = n[some]
    for shift in range(16):
        sums = np.add.reduceat((h >> np.uint64(shift)) & lanes, cuts)
        for lane in range(4):
            count = ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64)
            if len(cuts) > len(some):
                count = np.bincount(owner, count, len(some)).astype(np.int64)
            out[some] |= (2 * count > half).astype(np.uint64) << np.uint64(shift + 16 * lane)
    return out


def shingles(column, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, shingle hashes, offsets by row) of pieces of an Arrow
    string column."""
    raw, offsets = utf8(column)
    for a, b, data, at in pieces(raw, offsets):
        data = LOWER[data]
        starts, ends, word_at = word_spans(data, at, NOT_SPACE)
        if not len(starts):
            yield a, b, np.zeros(0, np.uint64), np.zeros(b - a + 1, np.int64)
            continue
        # the words again, with exactly one blank between them
        size = ends - starts
        new_starts = np.concatenate(([0], np.cumsum(size + 1)))
        text = np.full(new_starts[-1], 0x20, np.uint8)
        text[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[NOT_SPACE[data]]
        n_words = np.diff(word_at)
        n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
        shingle_at = np.concatenate(([0], np.cumsum(n)))
        first = np.arange(shingle_at[-1]) + np.repeat(word_at[:-1] - shingle_at[:-1], n)
        last = first + np.repeat(np.minimum(n_words, width), n) - 1
        begin = new_starts[first]
        yield a, b, xxh64(loads(text), begin, new_starts[last + 1] - 1 - begin), shingle_at


def fingerprints(column, width: int = WIDTH) -> np.ndarray:
    """Fingerprints of an Arrow string column."""
    out = np.zeros(len(column), np.uint64)
    for a, b, h, at in shingles(column, width):
        out[a:b] = _majority(h, at)
    return out


# --- pivot tables ---------------------------------------------------------------------

GROUPS = 7
FULL = 12  # full-width references of the discarding table
#: Fingerprints of a key that are compared in one piece; one in SAMPLE is looked at for keys above it.
RUN_ROWS, SAMPLE = 8192, 16


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class PivotTable:
    """References: for each group, one per bit of its block (the bit's own pattern) and the
    empty pattern; and FULL seeded full-width patterns.  The distances to a group's
    references determine the block, so equal coordinates are as selective as can be."""

    def __init__(self, groups: int = GROUPS, full: int = FULL, seed: int = 7):
        edges = [64 * i // groups for i in range(groups + 1)]
        self.masks = [np.uint64(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
        self.references = [[np.uint64(0), *(np.uint64(1 << k) for k in range(a, b))] for a, b in zip(edges, edges[1:], strict=False)]
        self.full = mix(np.arange(1, full + 1, dtype=np.uint64) * np.uint64(seed) + np.uint64(seed))

    def group_keys(self, f: np.ndarray) -> np.ndarray:
        """Per group, one number for the coordinates: (groups, n)."""
        out = []
        for mask, references in zip(self.masks, self.references, strict=True):
            key = np.zeros(len(f), np.uint64)
            for r in references:
                key = mix(key + _popcount((f ^ r) & mask))
            out.append(key)
        return np.array(out)

    def coordinates(self, f: np.ndarray) -> np.ndarray:
        """Distances to the full-width references: (n, full) small integers."""
        return _popcount(f[:, None] ^ self.full[None, :]).astype(np.int16)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch], radius: int, groups: int) -> Iterator[pa.RecordBatch]:
    table = PivotTable(groups)
    for batch in batches:
        f = np.asarray(batch.column("f")).view(np.uint64)
        for a in range(0, len(f), 20_000):
            part = f[a : a + 20_000]
            keys = table.group_keys(part)
            for i, chosen in enumerate(combinations(range(groups), groups - radius)):
                key = np.full(len(part), i + 1, np.uint64)
                for g in chosen:
                    key = mix(key + keys[g])
                yield pa.RecordBatch.from_arrays([pa.array(_signed(key)), pa.array(_signed(part))], ["key", "f"])


def run_edges(f: np.ndarray, radius: int, table: PivotTable) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the link graph of different fingerprints: breadth first, each
    node compared once with what no component has reached yet."""
    left = np.arange(len(f))
    coords = table.coordinates(f)
    us, vs = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = left
            for p in range(coords.shape[1]):  # discard by coordinate difference
                near = near[np.abs(coords[near, p] - coords[i, p]) <= radius]
                if not len(near):
                    break
            near = near[_popcount(f[near] ^ f[i]) <= radius]  # verify
            if len(near):
                us.append(np.full(len(near), i))
                vs.append(near)
                queue.extend(near)
                left = left[~np.isin(left, near, assume_unique=True)]
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(us), np.concatenate(vs)


def _run_batches(batches: Iterator[pa.RecordBatch], radius: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Edges from rows sorted by (key, f); a run that crosses batches is carried over."""
    table = PivotTable(groups)
    held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def edges(k: np.ndarray, f: np.ndarray):
        us, vs = [], []
        same = np.flatnonzero(k[1:] == k[:-1])
        if len(same):
            cut = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))
            size = np.diff(cut)
            two = cut[:-1][size == 2]
            if len(two):  # most runs: a single pair
                a, b = f[two], f[two + 1]
                ok = np.ones(len(two), bool)
                for pivot in table.full:
                    ok &= np.abs(_popcount(a ^ pivot).astype(np.int16) - _popcount(b ^ pivot).astype(np.int16)) <= radius
                ok[ok] = _popcount(a[ok] ^ b[ok]) <= radius
                us.append(a[ok])
                vs.append(b[ok])
            for at, n in zip(cut[:-1][size > 2], size[size > 2], strict=True):
                run = f[at : at + n]
                i, j = run_edges(run, radius, table)
                us.append(run[i])
                vs.append(run[j])
        u = np.concatenate(us) if us else np.zeros(0, np.uint64)
        v = np.concatenate(vs) if vs else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(_signed(u)), pa.array(_signed(v))], ["u", "v"])

    for batch in batches:
        k = np.concatenate((held_k, np.asarray(batch.column("key"))))
        f = np.concatenate((held_f, np.asarray(batch.column("f")).view(np.uint64)))
        if not len(k):
            continue
        at = int(np.searchsorted(k, k[-1]))
        yield edges(k[:at], f[:at])
        held_k, held_f = k[at:], f[at:]
    if len(held_k):
        yield edges(held_k, held_f)


def groups_for(n: int, radius: int = RADIUS) -> int:
    """Groups for n different fingerprints: more groups make more and longer keys (27, 32
    or 36 bits for the usual radius), so that runs stay short; no choice loses a link."""
    return radius + (3 if n < 1 << 24 else 4 if n < 1 << 30 else 5)


def link_fingerprints(different: DataFrame, radius: int = RADIUS, groups: int | None = None) -> DataFrame:
    """Spanning edges (u, v) among different fingerprints ``f`` (long)."""
    groups = groups or groups_for(different.count(), radius)
    keys = lambda df: df.select("f").mapInArrow(lambda it: _keys(it, radius, groups), "key long, f long")
    # Keys of very many fingerprints, by a sample: blocks of them, each pair of blocks a run
    # of its own.  Which keys are cut changes the layout alone.
    counts = keys(different.filter(F.pmod(F.xxhash64("f"), F.lit(SAMPLE)) == 0)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.filter(F.col("n") * SAMPLE > RUN_ROWS).select("key", F.ceil(F.col("n") * SAMPLE / RUN_ROWS).cast("int").alias("blocks"))
    hot = durable(hot, "hot")
    keyed = keys(different)
    if not hot.isEmpty():
        cut = keyed.join(F.broadcast(hot) if few(hot) else hot, "key", "left")
        block = F.coalesce(F.pmod(F.xxhash64("f"), "blocks").cast("int"), F.lit(0))
        cut = cut.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        run = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
        keyed = cut.select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(run).alias("key"), "f")
    parts = int(different.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(parts, "key").sortWithinPartitions("key", "f")
    return dealt.mapInArrow(lambda it: _run_batches(it, radius, groups), "u long, v long")


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, keep_text: bool = True
) -> DataFrame:
    """``docs`` with fingerprint (long), component (its smallest fingerprint) and
    component_id, the smallest identifier reachable."""
    docs = without(docs, "fingerprint", "component", "component_id")
    names = [c for c in docs.columns if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _signed(fingerprints(batch.column(text_col), width))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(f)], [*names, "fingerprint"])

    schema = StructType([*(docs.schema[n] for n in names), StructField("fingerprint", LongType(), False)])
    prints = durable(docs.mapInArrow(run, schema), "fingerprints")
    ident = F.col(f"`{id_col}`")
    different = durable(prints.groupBy(F.col("fingerprint").alias("f")).agg(F.min(ident).alias("least")), "different")
    found = components(link_fingerprints(different, radius))
    # the smallest identifier by component, then by fingerprint
    labelled = different.join(found.withColumnRenamed("node", "f"), "f", "left").withColumn("component", F.coalesce("component", "f"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = labelled.join(least, "component").select(
        F.col("f").alias("fingerprint"), "component", "component_id"
    )
    return prints.join(by_print, "fingerprint").select(*[f"`{n}`" for n in names], "fingerprint", "component", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
