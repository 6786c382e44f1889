"""Mixing sources to target weights.

Words are summed per source (partial sums before the shuffle). The targets share a total by weight; no target goes
beyond `most` times its source's size, and what is cut off is shared anew by weight until no target is above. The end of
that sharing has a closed form: order the sources by the ratio of bound to weight; the sources before some point sit at
their bound, and the rest share what is left by weight. A document is emitted floor(rate) times, and once more if its
seeded hash, of id and text, falls below the fraction of the rate, so reruns and retried tasks agree.

Defined results: a null text has size 0; a null source is a source of its own, last in order; sources without words have
target 0 and rate 0; a null id or text is hashed as the empty string; rows alike in id and text are mixed alike, others that
share an id, or have none, each by itself. Empty
tables give empty results. Other columns, whatever their names, pass through `mix` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, written

#: Fixed values of the production mix: weights by the order of the sources, repeating; total over all sizes; bound on repetition.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
SEED = "mix-1"
#: The table of sources is broadcast up to so many rows (about 100 bytes each); beyond, Spark joins it by shuffling.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed_unit(seed: str, key: Column, text: Column) -> Column:
    """A number from [0, 1) with 52 bits of the SHA-256 of seed, key and text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target, rate: one row per source. sized: source, size.

    The windows run over one row per source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weighed = totals.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    summed = weighed.select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).alias("all_size"),
        F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("weights_left"),
    )
    level = (F.lit(share) * F.col("all_size") - F.lit(most) * F.col("before")) / F.col("weights_left")
    # The first source, in order, that a level leaves below its bound sets the level for itself and all after it.
    levelled = summed.withColumn("level", level).withColumn("own", F.when(F.col("level") * F.col("weight") < F.lit(most) * F.col("source_size"), F.col("level")))
    first = F.first("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    target = F.coalesce(F.least(first * F.col("weight"), F.lit(most) * F.col("source_size")), F.lit(most) * F.col("source_size"))
    out = levelled.select("source", "source_size", target.cast("double").alias("target"))
    return out.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(F.lit(0.0)))


def copies(rate: Column, unit: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(unit < rate - whole, 1).otherwise(0)).cast("long")


def small_or_joined(rates: DataFrame) -> DataFrame:
    """The table of sources, written once; marked for broadcast only after its rows have been counted."""
    kept = written(rates)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """id, size, source_size, target, copies for every document. The text is read once; sizes are kept as a narrow table."""
    sized = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hashed_unit(SEED, F.col(id_col), F.col(text_col)).alias("unit")))
    targets = small_or_joined(source_targets(sized, **how).withColumnRenamed("source", "of"))
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["of"]), "left")
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", copies(F.col("rate"), F.col("unit")).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents, each as often as the mix takes it, with the columns they came with.

    Each row's rate comes from its source alone, so the texts meet only the small table of sources and never a shuffle
    by document.
    """
    sized = written(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("size")))
    rates = small_or_joined(source_targets(sized, **how).select(F.struct("source", "rate").alias("__mix")))
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    joined = kept.join(rates, kept[f"__doc.`{source_col}`"].eqNullSafe(rates["__mix.source"]), "left")
    n = copies(F.col("__mix.rate"), hashed_unit(SEED, F.col(f"__doc.`{id_col}`"), F.col(f"__doc.`{text_col}`")))
    repeated = joined.select("__doc", F.explode(F.array_repeat(F.lit(0), n.cast("int"))).alias("__copy"))
    return repeated.select(*[F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])
