"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import save

#: Where a mean rate is above this, the Poisson table would be long; the number is then the sum of independent draws of equal mean, which is Poisson
#: too.
LARGEST_MEAN = 16.0
#: Terms of the inverse: at a mean of 16 the chance beyond 64 is below 1e-17.
TERMS = 64


def uniform(key: Column, seed: int) -> Column:
    """48 bits of md5 of the seed and the key, as a fraction in (0, 1)."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def poisson_table(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... copies."""
    factorial = F.array(*[F.lit(float(math.factorial(k))) for k in range(TERMS)])
    steps = F.transform(factorial, lambda f, k: F.exp(-mean) * F.pow(mean, k.cast("double")) / f)
    return F.transform(F.sequence(F.lit(1), F.lit(TERMS)), lambda n: F.aggregate(F.slice(steps, F.lit(1), n), F.lit(0.0), lambda acc, p: acc + p))


def rates(docs: DataFrame, weights: Mapping[str, float] | None, total: float | None = None) -> DataFrame:
    """source, n, mean: the mean number of copies of each source's documents.

    weights: the wanted share of each source; a source that it does not name gets none of the mix. None: every source gets
    the same share. Shares are divided by their sum over the sources present. total: documents wanted, by default as many as
    there are. Counts are summed within tasks first.
    """
    counts = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(1.0)
    if weights is not None:
        table = docs.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "source string, weight double")
        counts, weight = counts.join(table, "source", "left"), F.coalesce(F.col("weight"), F.lit(0.0))
    counts = counts.withColumn("weight", weight)
    n, weights_sum = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    wanted = float(n if total is None else total)
    mean = F.lit(wanted) * F.col("weight") / F.lit(float(weights_sum)) / F.col("n") if weights_sum else F.lit(0.0)
    return counts.select("source", "n", mean.alias("mean"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, total: float | None = None, seed: int = 17) -> DataFrame:
    """The columns of docs, and _copy (from 0) and _key (its place in the shuffled order), a row for each copy.

    A document's number of copies is Poisson with its source's mean, found by inverting the distribution at a hash of its
    doc_id (above LARGEST_MEAN, by adding such draws, each at a hash of its own), so equal runs mix alike; rows with equal doc_id get as many copies.
    A null source counts as the source '', a null
    doc_id as ''. Columns of docs named _copy or _key are replaced. The copies are shuffled globally: dealt out and sorted within each part by a hash
    of doc_id, copy and seed, so that part
    after part is a random order; ties go by doc_id and copy. An empty table gives an empty mix.

    Rates are a written table, whose size Spark knows before it plans: while that is under its broadcast threshold no text moves by source; where
    there are more sources it shuffles, and adaptive execution splits a source with a third of all rows.
    """
    names = [c for c in docs.columns if c not in ("_copy", "_key")]
    draws = F.greatest(F.lit(1), F.ceil(F.col("mean") / LARGEST_MEAN).cast("int"))
    table = rates(docs, weights, total).where("mean > 0").select("source", draws.alias("draws"), poisson_table(F.col("mean") / draws).alias("table"))
    table = save(table, "rates")
    key = F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*names).alias("row")).withColumn("source", F.coalesce(F.col("row.source"), F.lit(""))).join(table, "source")
    drawn = lambda u: F.size(F.filter("table", lambda p: p < u))
    again = F.transform(F.sequence(F.lit(2), F.col("draws")), lambda k: drawn(uniform(F.concat_ws("|", F.lit("draw"), k.cast("string"), key), seed)))
    more = F.when(F.col("draws") > 1, F.aggregate(again, F.lit(0), lambda total, n: total + n)).otherwise(0)
    rows = rows.withColumn("u", uniform(key, seed)).withColumn("n", drawn(F.col("u")) + more)
    copies = rows.where("n > 0").select("row", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("_copy"))
    copies = copies.select("row.*", "_copy", F.md5(F.concat_ws("|", F.lit(f"order {seed}"), key, F.col("_copy").cast("string"))).alias("_key"))
    return copies.repartition("_key").sortWithinPartitions("_key", "doc_id", "_copy")
