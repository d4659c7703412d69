"""Mixing sources to target weights by Poisson replication.

Every source has a target rate: how often a document of it shall occur on average. A document's
number of copies is the inverse of the Poisson distribution of that mean at a uniform number hashed
from its id, its text and a seed, so any run, retried task or subset gives the same copies. Copies are
dealt out by another hash and sorted by it in each partition: a global shuffle. The hash is uniform, so
no pass over the data is needed to find the partitions' bounds.

Nulls: a null source is a source of its own; a null text has no bytes and hashes like an empty one.
Rows without an id draw for themselves: their place in the table as it is read joins the hash. Rows that
share an id draw by their texts; exact repeats of id and text are one document and are repeated alike. A
source of no bytes, or of weight 0, goes. An empty table stays empty. Columns of the input other than
those used are kept; the added ones replace any of their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

SEED = 20
#: Weights are sizes to this power, so that a source of a third of the bytes does not rule the mixture.
TEMPERATURE = 0.5
#: A Poisson number of a larger mean is the sum of several of equal means, which keeps exp(-mean) exact.
MEAN = 256.0
#: Numbers of the sources' distribution functions that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_NUMBERS = 4_000_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, from the md5 of parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def cdf(mean: Column) -> Column:
    """Poisson's distribution function at 0, 1, 2 and so on, until what is left is below 2**-52."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    zero = F.exp(-mean)
    start = F.struct(zero.alias("p"), F.array(zero).alias("c"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), F.array_append(s["c"], F.element_at(s["c"], -1) + p).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["c"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(mix_source, mix_rate, mix_parts, mix_cdf): a row for each source. Weights None: sizes to the power temperature."""
    size = F.octet_length(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).cast("long")
    by = docs.groupBy(F.col("source").alias("mix_source")).agg(F.sum(size).alias("mix_bytes")).where("mix_bytes > 0")
    if weights is None:
        weight = F.pow(F.col("mix_bytes").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("mix_source") == name, F.lit(float(w))).otherwise(weight)
    by = kept(by.withColumn("mix_weight", weight).where("mix_weight > 0"))
    total = by.agg(F.sum(F.col("mix_weight").cast("decimal(38,12)")).cast("double").alias("weight"), F.sum("mix_bytes").alias("bytes")).first()
    out = by.withColumn("mix_rate", F.col("mix_weight") / F.lit(total["weight"]) * F.lit(total["bytes"]) / F.col("mix_bytes"))
    out = out.withColumn("mix_parts", F.greatest(F.ceil(F.col("mix_rate") / MEAN), F.lit(1)).cast("int"))
    return out.select("mix_source", "mix_rate", "mix_parts", cdf(F.col("mix_rate") / F.col("mix_parts")).alias("mix_cdf"))


def row_key(doc_id: Column, text: Column) -> Column:
    """What a row's draws are hashed from: id and text, and for rows without an id their place."""
    place = F.when(doc_id.isNull(), F.concat(F.lit("null "), F.monotonically_increasing_id().cast("string"))).otherwise(doc_id.cast("string"))
    return F.md5(F.concat_ws(":", place, F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))).cast("binary"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """Each document as often as its Poisson number says, dealt out and sorted by mix_key.

    Adds mix_rate, mix_copies, mix_copy (from 1) and mix_key (32 hex digits).
    """
    own = docs.drop("mix_rate", "mix_copies", "mix_copy", "mix_key")
    by = kept(rates(docs, weights, temperature))
    numbers = by.agg(F.sum(F.size("mix_cdf"))).first()[0] or 0
    side = F.broadcast(by) if numbers <= BROADCAST_NUMBERS else by
    drawn = lambda j: F.size(F.filter("mix_cdf", lambda c: c <= uniform(F.col("mix_row"), F.lit(seed), j)))
    copies = F.when(F.col("mix_parts") == 1, drawn(F.lit(0))).otherwise(F.aggregate(F.sequence(F.lit(0), F.col("mix_parts") - 1), F.lit(0), lambda n, j: n + drawn(j)))
    told = own.withColumn("mix_row", row_key(F.col("doc_id"), F.col("text")))
    out = told.join(side, told["source"].eqNullSafe(by["mix_source"])).withColumn("mix_copies", copies).where("mix_copies > 0")
    out = out.select(*own.columns, "mix_row", "mix_rate", "mix_copies", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy"))
    key = F.md5(F.concat_ws(":", F.lit("order"), F.col("mix_row"), F.lit(seed).cast("string"), F.col("mix_copy").cast("string")).cast("binary"))
    return out.withColumn("mix_key", key).drop("mix_row").repartition("mix_key").sortWithinPartitions("mix_key")
