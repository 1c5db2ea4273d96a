"""Sharding over fixed virtual slots (DataFrame only).

Every row is hashed into one of ``n_slots`` virtual slots; bytes and rows are summed per
slot, and a versioned table maps slots to shards.  Rows never move between slots: adding
a shard writes a new version of the map in which some slots belong to the new shard and
no slot moves between old ones.

The law is ``bytes``: shards hold nearly equal bytes.  The map is found by placing slots,
heaviest first, on the lightest shard; it works on one row per slot, at most ``n_slots``
rows whatever the input, which is also what bounds the broadcast map.  A row's position
in its shard is the count of rows in the shard's earlier slots plus its rank in its slot,
so no window spans more than one slot.

Defined results: null text has size 1; equal texts are not kept together, since slots
hash the identifier and text (a group may hold a third of the rows); null identifiers are
hashed by their text alone; repeated rows share a slot and get different positions; an
empty table gives an empty result and a map of empty slots; result names replace input
columns of the same name.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, durable, fresh, new_dir, without

N_SLOTS = 8192


class SlotMap:
    """The versions of a slot-to-shard map: ``version=<n>`` folders of (slot, shard)."""

    def __init__(self, spark: SparkSession, n_slots: int = N_SLOTS, path: str | None = None):
        self.spark, self.n_slots, self.path = spark, n_slots, path or new_dir(spark, "slot-map")
        self.version, self.shards = 0, 0

    def _save(self, placed: dict[int, int], shards: int) -> DataFrame:
        self.version, self.shards = self.version + 1, shards
        rows = [(s, placed[s]) for s in range(self.n_slots)]
        self.spark.createDataFrame(rows, "slot int, shard int").coalesce(1).write.parquet(
            f"{self.path}/version={self.version}"
        )
        return self.load()

    def load(self, version: int | None = None) -> DataFrame:
        return self.spark.read.schema("slot int, shard int").parquet(f"{self.path}/version={version or self.version}")

    def build(self, weights: dict[int, int], shards: int) -> DataFrame:
        """Heaviest slot first onto the lightest shard; ties by number."""
        heap, placed = [(0, k) for k in range(shards)], {}
        for slot in sorted(range(self.n_slots), key=lambda s: (-weights.get(s, 0), s)):
            load, k = heapq.heappop(heap)
            placed[slot] = k
            heapq.heappush(heap, (load + weights.get(slot, 0), k))
        return self._save(placed, shards)

    def add_shard(self, weights: dict[int, int]) -> DataFrame:
        """A new version with one more shard, which takes slots from the fullest shards
        until it holds its even share; all other slots stay where they are."""
        placed = {r.slot: r.shard for r in self.load().collect()}  # n_slots rows
        new, total = self.shards, sum(weights.values())
        loads, own = [0] * (new + 1), [[] for _ in range(new)]
        for slot, k in placed.items():
            loads[k] += weights.get(slot, 0)
            own[k].append(slot)
        for slots in own:
            slots.sort(key=lambda s: (weights.get(s, 0), -s))
        share = total / (new + 1)
        full = [(-load, k) for k, load in enumerate(loads[:new])]
        heapq.heapify(full)
        while full:
            load, k = heapq.heappop(full)
            fits = [s for s in own[k] if 0 < weights.get(s, 0) <= share - loads[new]]
            if not fits or -load <= share:
                continue
            slot = fits[-1]
            own[k].remove(slot)
            placed[slot] = new
            loads[new] += weights[slot]
            heapq.heappush(full, (load + weights[slot], k))
        return self._save(placed, new + 1)


def slot_of(key, n_slots: int = N_SLOTS):
    """Virtual slot of a text key: the first 32 bits of its MD5, modulo n_slots."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % n_slots).cast("int")


def assign_shards(
    rows: DataFrame,
    key: str,
    size: str,
    shards: int = 8,
    n_slots: int = N_SLOTS,
    slot_map: SlotMap | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """``rows`` with virtual_slot, shard and slot, the position in the shard from 0.
    ``key`` is a text column, ``size`` a byte count; ``order`` breaks ties in a slot."""
    spark = rows.sparkSession
    rows = without(rows, "virtual_slot", "shard", "slot")
    slot_map = slot_map or SlotMap(spark, n_slots)
    slotted = rows.withColumn("virtual_slot", slot_of(F.col(f"`{key}`"), slot_map.n_slots))
    sums = slotted.groupBy("virtual_slot").agg(F.sum(f"`{size}`").alias("b"), F.count(F.lit(1)).alias("n"))
    sums = {r[0]: (r[1], r[2]) for r in sums.collect()}  # at most n_slots rows
    mapped = slot_map.build({s: b for s, (b, _) in sums.items()}, shards)
    # rows in the shard's earlier slots; the table has n_slots rows
    (first,) = fresh(rows, "first")
    counts = spark.createDataFrame([(s, n) for s, (_, n) in sums.items()], "slot int, n long")
    starts = mapped.join(F.broadcast(counts), "slot", "left").select(
        F.col("slot").alias("virtual_slot"),
        "shard",
        (F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy("shard").orderBy("slot").rowsBetween(W.unboundedPreceding, -1))).alias(first),
    )
    rank = F.row_number().over(W.partitionBy("virtual_slot").orderBy(*[F.col(f"`{c}`") for c in order or [key]]))
    return (
        slotted.join(F.broadcast(starts), "virtual_slot")
        .withColumn("slot", F.coalesce(F.col(first), F.lit(0)) + rank - 1)
        .drop(first)
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("string"), F.md5(text)).alias("key"),
    )
    rows = durable(rows, "sizes")  # the texts are read once
    return assign_shards(rows, "key", "size", 8, order=["doc_id", "text_crc32", "size"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


#: CRC-32 byte by byte from its table; slots placed heaviest first on the lightest shard.
OP2_SQL = f"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce(range(0, 9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) ORDER BY n) AS crc
  FROM range(0, 256) r(n)),
b AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 8))::BIGINT % {N_SLOTS} AS virtual_slot
  FROM documents),
d AS (
  SELECT doc_id, size, virtual_slot,
    xor(list_reduce(bytes, lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM b, t),
s AS (SELECT virtual_slot, sum(size)::BIGINT AS w, row_number() OVER (ORDER BY sum(size) DESC, virtual_slot) AS n FROM d GROUP BY virtual_slot),
p AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS virtual_slot, NULL::INT AS shard, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS loads
  UNION ALL
  SELECT s.n, s.virtual_slot, (list_position(loads, list_min(loads)) - 1)::INT,
    list_transform(loads, lambda l, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN l + s.w ELSE l END)
  FROM p JOIN s ON s.n = p.n + 1)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id, text_crc32, size) - 1 AS slot,
  NULL::INT AS grown_shard, virtual_slot::INT AS virtual_slot
FROM d JOIN p USING (virtual_slot)
"""
