"""Mixing sources to target weights by Poisson replication (DataFrame only).

A source of mass m (rows or bytes) whose target share of the mixture is w gets the mean
repetition rate ``w * total / m``.  Each document draws its number of copies by inverting
the Poisson distribution at a uniform number hashed from its identifier and the seed, is
exploded by that count, and the copies are put into a global order by hash: the hash is
uniform, so equal ranges of it balance evenly whatever the sources are, a source with a
third of all rows is no hot partition, and no sample has to be read to find the ranges.

The masses are one row per source, found by partial aggregation, and joined back by a
broadcast if they were counted to be few, so that texts are shuffled once, by hash.

Defined results: a null source is a source of its own; sources without a target weight
have weight 0 and leave (none by default: equal weights); null text counts as empty and
has mass 1; texts of any length count whole; rows without an identifier draw by their text;
repeated rows draw the same count; copies of one rank in the order go by nothing; an empty
table gives an empty result; result names replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable, few, fresh, without

SEED = 17
_UNIT = float(1 << 52)


def uniform(key, salt: str):
    """A number in (0, 1) from the first 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(salt), key).cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(_UNIT)


def poisson_cdf(rate):
    """Cumulative probabilities of counts 0.. up to where the tail is below 1e-15."""
    most = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    step = lambda s, k: F.struct(
        (s["p"] * rate / k).alias("p"),
        (s["c"] + s["p"] * rate / k).alias("c"),
        F.concat(s["all"], F.array(s["c"] + s["p"] * rate / k)).alias("all"),
    )
    first = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), most), first, step, lambda s: s["all"])


#: Sources up to which their rates are broadcast: a few hundred numbers each at most.
BROADCAST_SOURCES = 20_000
#: Above this mean rate exp(-rate) loses its digits; the rest is whole copies.
_LARGEST = 200.0


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    total: float | None = None,
    mass: str = "bytes",
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Each row of ``docs`` repeated ``n_copies`` times, with n_copies, copy (from 1) and
    shuffle_key, in the global order of shuffle_key.  ``weights``: relative target share
    by source, None: equal.  ``total``: mass of the mixture, None: that of the input."""
    docs = without(docs, "copy", "n_copies", "shuffle_key")
    m, w, rate, cdf, sid = fresh(docs, "mass", "weight", "rate", "cdf", "sid")
    source = F.col(f"`{source_col}`").cast("string")
    # a null identifier: a hash of the text, after a blank that no number begins with
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit(" "), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))))
    one = F.lit(1) if mass == "rows" else F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) + 1
    sums = docs.groupBy(source.alias(sid)).agg(F.sum(one.cast("double")).alias(m))
    if weights is None:
        sums = sums.withColumn(w, F.lit(1.0))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], f"`{w}k` string, `{w}` double")
        sums = sums.join(table, F.col(sid).eqNullSafe(F.col(f"{w}k")), "left").drop(f"{w}k").fillna(0.0, [w])
    all_w, all_m = sums.agg(F.sum(w), F.sum(m)).first()  # one row
    scale = (all_m if total is None else float(total)) / all_w if all_w else 0.0
    sums = sums.select(sid, (F.col(w) * F.lit(scale) / F.col(m)).alias(rate))
    # whole copies of a rate above _LARGEST, and a Poisson draw for the rest
    whole = F.floor(F.greatest(F.col(rate) - F.lit(_LARGEST), F.lit(0.0)))
    sums = sums.select(sid, rate, whole.alias(w), poisson_cdf(F.col(rate) - whole).alias(cdf))
    sums = durable(sums, "rates")
    u = uniform(key, f"{seed}:")
    drawn = (
        docs.join(F.broadcast(sums) if few(sums, BROADCAST_SOURCES) else sums, source.eqNullSafe(F.col(sid)))
        .withColumn("n_copies", (F.col(w) + F.size(F.filter(cdf, lambda c: c <= u))).cast("int"))
        .filter("n_copies > 0")
        .drop(sid, rate, w, cdf)
    )
    out = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    order = F.md5(F.concat(F.lit(f"{seed}/"), key, F.lit("/"), F.col("copy").cast("string")).cast("binary"))
    out = out.withColumn("shuffle_key", F.substring(order, 1, 16))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (part,) = fresh(out, "part")
    first = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long")
    out = out.withColumn(part, F.floor(first * parts / F.lit(1 << 32)).cast("int"))
    return out.repartitionById(parts, part).sortWithinPartitions("shuffle_key").drop(part)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir).select("doc_id", "source", "text")).select(
        "doc_id", "source", "n_copies", "copy", "shuffle_key", "text"
    )


OP5_SQL = f"""
WITH m AS (SELECT source, sum(strlen(coalesce(text, '')) + 1)::DOUBLE AS mass FROM documents GROUP BY source),
r AS (SELECT source, 1.0 / count(*) OVER () * sum(mass) OVER () / mass AS rate FROM m),
p AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS c
      FROM r, range(0, 400) t(k) WHERE k <= ceil(rate + 10 * sqrt(rate) + 20)),
c AS (SELECT source, list(c ORDER BY k) AS cdf FROM p GROUP BY source),
d AS (SELECT doc_id, d.source, text,
        len(list_filter(cdf, lambda c: c <= (('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE))::INT AS n_copies
      FROM documents d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, source, n_copies, copy::INT AS copy,
       substr(md5('{SEED}/' || doc_id || '/' || copy), 1, 16) AS shuffle_key, text
FROM d, LATERAL (SELECT unnest(range(1, n_copies + 1)) AS copy)
"""
