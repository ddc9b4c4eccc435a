"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import WORD, ordinal, whole
from evidentia.session import stage

#: The offset of a source is a multiple of this fraction, so that sums with whole numbers stay exact.
GRAIN = 1 << 20
#: A document above this share of its source's target is large.
LARGE = 0.01


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: weights repeat over the sources by code point, null last.

    The targets share the sum of all sizes by weight and stop at ``most`` times their source; what is above is shared
    again until none is. The level per unit of weight is found by repeated sums over the sources; the driver sees two
    numbers at a time, never the list of sources.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = ordinal(sizes, [F.col("source").asc_nulls_last()], "place")
    rows = rows.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))).drop("place")
    rows = stage(rows, "mix-sources")
    cap = F.col("source_size") * F.lit(float(most))
    total, weight = rows.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level, capped = ((total or 0.0) / weight if weight else 0.0), -1
    while weight:
        above = F.col("weight") * F.lit(level) > cap
        held, free, count = rows.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if count == capped or not free:
            break
        level, capped = (total - (held or 0.0)) / free, count
    return rows.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """Whole-number copies of each document, so that each source's words come near its target.

    Within a source every document expects target / source size copies. Documents stand in order of size, then id; the
    running sum of expected copies starts at one offset drawn per source from ``seed``, and a document is taken once
    for each whole number its stretch crosses. The order by size keeps the taken words near the target; so that one very
    long document more or less does not show, documents of over a hundredth of the target are drawn first and the rate
    of the others is set to what is then missing. The running sum comes from a global rank (`ordinal`), so a hot source is split
    over tasks like any other.

    A null text has size 0, a null source is a source of its own. Empty documents and sources whose sizes sum to 0 take
    nothing. Rows with the same id are ranked one after the other. Other columns are ignored; an empty table gives no
    rows. The same table gives the same rows.

    Columns: the id, source, size, source_size, target, copies, taken (copies times size).
    """
    size = F.size(F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))).cast("long")
    rows = stage(docs.select(F.col(key).alias("__id"), F.col(source).alias("source"), size.alias("size")), "mix-rows")
    ranked = ordinal(rows, [F.col("source").asc_nulls_last(), F.col("size"), F.xxhash64(F.lit(seed), "__id"), F.col("__id")])
    per = ranked.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("ordinal").alias("first"))
    per = source_targets(per, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("")), F.col("source").isNull()), F.lit(GRAIN)) / F.lit(float(GRAIN))
    per = stage(per.withColumns({"rate": rate, "offset": offset}).withColumnRenamed("source", "__source"), "mix-rates")
    at = F.col("ordinal") - F.col("first")

    def copies(rate) -> Column:
        crossed = F.floor(rate * (at + 1) + F.col("offset")) - F.floor(rate * at + F.col("offset"))
        return F.least(crossed, F.lit(most)).cast("long")

    large = F.col("size") > F.col("target") * F.lit(LARGE)
    out = ranked.join(per, F.col("source").eqNullSafe(F.col("__source")))
    # what the few large documents take by chance, the many others make up for
    left = out.groupBy("__source").agg(
        F.sum(F.when(large, copies(F.col("rate")) * F.col("size")).otherwise(0)).alias("taken"), F.sum(F.when(large, 0).otherwise(F.col("size"))).alias("rest")
    )
    left = stage(left.withColumnRenamed("__source", "__left"), "mix-large")
    per = per.join(left, F.col("__source").eqNullSafe(F.col("__left")))
    fair = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), (F.col("target") - F.col("taken")) / F.col("rest")))
    per = stage(per.withColumn("fair", F.when(F.col("rest") > 0, fair).otherwise(0.0)).drop("__left", "taken", "rest"), "mix-fair")
    out = ranked.join(per, F.col("source").eqNullSafe(F.col("__source")))
    taken = copies(F.when(large, F.col("rate")).otherwise(F.col("fair")))
    return out.select(F.col("__id").alias(key), "source", "size", "source_size", "target", taken.alias("copies"), (taken * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents that the mix takes, each as often as it is taken, with their own columns.

    Rows that share an id share its copies: the mix is drawn over one row per id, source and size.
    """
    copies = mix(docs, key, text, source).groupBy(F.col(key).alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"))
    copies = copies.agg(F.max("copies").alias("__copies")).filter("__copies > 0")
    size = F.size(F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0)))
    same = F.col(key).eqNullSafe(F.col("__id")) & F.col(source).eqNullSafe(F.col("__source")) & (size == F.col("__size"))
    out = docs.join(copies, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return out.select(*[out[c] for c in docs.columns])
