"""Operator 1: mixing sources to target weights by Poisson replication.

A source of size z (characters) that should make up the part w of a mixture of size T
is repeated at the mean rate r = T * w / z. Each document is repeated a Poisson(r)
number of times: a uniform number, taken from a hash of seed and doc_id, is looked up
in the distribution function. A rate above ``PIECE`` is a sum of equal pieces, each
with a hash of its own, so that no term underflows. Documents are then exploded by
their counts and dealt over the cluster by a hash of seed, doc_id and copy, by which
each partition is also sorted: the order (shard, shuffle_key) is a uniform shuffle.

Sizes are a partial aggregate, so a source with a third of all rows is one row a task.
The rates (a row a source) are broadcast if they are measured to be under
``BROADCAST_BYTES``; else they are joined on source and one of ``SALTS`` salts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name

PIECE = 16.0
BROADCAST_BYTES = 8_000_000
SALTS = 32
_HEX = 13  # hexadecimal digits of a hash that make a uniform number


def _hash(digits: int, *parts: Column) -> Column:
    """The first hexadecimal digits of an MD5, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, digits), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, size, rate, pieces, cdf) of ``docs (source, text)``; cdf is the distribution
    function of one piece, up to where it reaches 1 within 1e-15.

    ``weights`` are relative; a source without one gets 0, and None weighs all sources
    alike. A null source is a source. The mixture has ``epochs`` times the corpus's size."""
    sizes = docs.groupBy("source").agg(F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "name string, weight double")
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
        weighed = weighed.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    weighed = checkpointed(weighed)
    total = weighed.where("size > 0").agg(F.sum("weight").alias("weight"), F.sum("size").alias("size")).first()
    rate = F.lit(0.0)
    if total["weight"]:
        share = float(epochs) * float(total["size"]) * F.col("weight") / total["weight"]
        rate = F.when(F.col("size") > 0, share / F.col("size")).otherwise(0.0)
    out = weighed.withColumn("rate", rate).withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE).cast("int")))
    step = (
        "aggregate(sequence(1, 120), struct(exp(-rate / pieces) as p, array(exp(-rate / pieces)) as cdf), "
        "(s, k) -> struct(s.p * (rate / pieces) / k as p, concat(s.cdf, array(element_at(s.cdf, -1) + s.p * (rate / pieces) / k)) as cdf), "
        "s -> s.cdf)"
    )
    return out.select("source", "size", "rate", "pieces", F.expr(step).alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """The mixture: the columns of ``docs (doc_id, source, text, ...)`` with ``copy`` (0, 1, ...),
    ``shard`` and ``shuffle_key`` (underscores are added to names that ``docs`` has).

    Rows with one doc_id share their draw; a null doc_id draws as the text "null". Empty
    and null texts have size 0 and are drawn at their source's rate; a source of size 0
    has rate 0. An empty table gives none. A very long text is moved once a copy."""
    taken = list(docs.columns)

    def free(name: str) -> str:
        taken.append(free_name(name, taken))
        return taken[-1]

    copy, shard, key = (free(n) for n in ("copy", "shard", "shuffle_key"))
    source, pieces, cdf, salt, mine, uniform, number = (free(f"__{n}") for n in ("source", "pieces", "cdf", "salt", "mine", "uniform", "number"))
    by_source = checkpointed(rates(docs, weights, epochs).select(F.col("source").alias(source), F.col("pieces").alias(pieces), F.col("cdf").alias(cdf)))
    row_bytes = 16 + 8 * 121
    measured = by_source.agg(F.sum(F.octet_length(F.coalesce(source, F.lit(""))) + row_bytes)).first()[0] or 0
    same = F.col("source").eqNullSafe(F.col(source))
    if measured <= BROADCAST_BYTES:
        rated = docs.join(F.broadcast(by_source), same)
    else:
        salted = by_source.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn(mine, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        rated = dealt.join(salted, same & (F.col(mine) == F.col(salt)))
    who = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draws = F.transform(
        F.sequence(F.lit(1), F.col(pieces)),
        lambda k: _hash(_HEX, F.lit(str(seed)), who, k.cast("string")) / F.lit(float(16**_HEX)),
    )
    rated = rated.withColumn(uniform, draws)
    count = F.aggregate(uniform, F.lit(0), lambda n, u: n + F.size(F.filter(cdf, lambda c: c <= u)))
    copies = (
        rated.withColumn(number, count).where(F.col(number) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(number) - 1)))
        .withColumn(key, _hash(15, F.lit(f"order:{seed}"), who, F.col(copy).cast("string")))
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col(key) / F.lit(float(16**15)) * parts).cast("int")
    return (
        copies.select(*(F.col(f"`{c}`") for c in docs.columns), copy, part.alias(shard), key)
        .repartitionById(parts, shard).sortWithinPartitions(key)
    )
