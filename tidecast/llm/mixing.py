"""Mix sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the bytes to put out,
divided by the bytes it has.  Each document's count is the inverse of the
Poisson distribution of that mean at a uniform number hashed from its id, so
it depends on nothing but seed, id and rate.  Documents are repeated by their
counts and dealt out by a hash of id and copy.

Only DataFrame functions: no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.storage import written_table

PART_RATE = 16.0            # larger means are sums of parts of at most this mean
BROADCAST_SOURCES = 10_000  # a source's row has at most a few hundred numbers


def _uniform(*parts: Column) -> Column:
    """52 bits of an MD5 digest, in [0, 1)."""
    digest = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return F.conv(digest, 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """``source, rate``: mean repetitions that give each source its share of ``epochs`` times all bytes.

    Without ``weights`` all sources weigh the same; with them, unnamed sources
    weigh nothing.  A source without a byte has rate 0.  A null source is a
    source of its own.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("_bytes"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        weight = F.coalesce(known[F.col("source")], F.lit(0.0))
    sizes = written_table(sizes.withColumn("_weight", F.when(F.col("_bytes") > 0, weight).otherwise(0.0)), "source-sizes")
    total = sizes.agg(F.sum("_bytes"), F.sum("_weight")).first()
    everything, all_weights = float(total[0] or 0), float(total[1] or 0)
    rate = F.when((F.col("_bytes") > 0) & (F.lit(all_weights) > 0),
                  F.col("_weight") / F.lit(all_weights or 1.0) * F.lit(everything * epochs) / F.col("_bytes"))
    return sizes.select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def _distribution(rates: DataFrame) -> DataFrame:
    """Per source the number of parts, and the distribution function of one part."""
    parts = F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int")
    mean = F.col("rate") / F.col("_parts")
    last = (F.col("_mean") + 10 * F.sqrt("_mean") + 20).cast("int")
    start = F.struct(F.exp(-F.col("_mean")).alias("term"), F.array(F.exp(-F.col("_mean"))).alias("cdf"))

    def grow(acc: Column, k: Column) -> Column:
        term = acc["term"] * F.col("_mean") / k
        return F.struct(term.alias("term"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + term)).alias("cdf"))

    return rates.withColumn("_parts", parts).withColumn("_mean", mean).withColumn(
        "_cdf", F.aggregate(F.sequence(F.lit(1), last), start, grow)["cdf"]).select(
        F.col("source").alias("_source"), "_parts", "_cdf")


def _mixed(docs: DataFrame, weights: dict[str, float] | None, epochs: float, seed: str) -> DataFrame:
    """``_row`` (a struct of all columns), ``_copies``, ``_copy`` and ``_place`` of each copy."""
    rates = written_table(_distribution(source_rates(docs, weights, epochs)), "source-rates")
    few = rates.count() <= BROADCAST_SOURCES
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = docs.select(F.col("source").alias("_of"), key.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    drawn = F.aggregate(
        F.sequence(F.lit(0), F.col("_parts") - 1), F.lit(0),
        lambda acc, part: acc + F.size(F.filter("_cdf", lambda c: c <= _uniform(F.lit(seed), F.col("_key"), part.cast("string")))))
    counted = rows.join(F.broadcast(rates) if few else rates, F.col("_of").eqNullSafe(F.col("_source"))).select(
        "_row", "_key", drawn.alias("_copies"))
    copies = counted.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    place = F.conv(F.substring(F.md5(F.concat_ws(
        "|", F.lit(seed), F.lit("place"), F.col("_key"), F.col("_copy").cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")
    return copies.select("_row", "_copies", "_copy", place.alias("_place")).repartition("_place").sortWithinPartitions("_place")


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = "0") -> DataFrame:
    """The rows of ``docs``, columns as they are, repeated to the target weights.

    Rows come in random order: dealt to partitions by a hash of id and copy and
    sorted by it there.  A row without an id takes its text's digest instead;
    repeated rows have equal counts.  Null texts weigh nothing but are repeated
    like others of their source.  An empty table stays empty.
    """
    return _mixed(docs, weights, epochs, seed).select("_row.*")


def mixture_counts(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = "0") -> DataFrame:
    """``doc_id, source, text, n_copies, copy, place`` of each row of the mixture."""
    return _mixed(docs, weights, epochs, seed).select(
        "_row.doc_id", "_row.source", "_row.text", F.col("_copies").alias("n_copies"), F.col("_copy").alias("copy"), F.col("_place").alias("place"))
