"""Operator 8: mixing sources to target weights with hash-threshold histograms.

Targets: all sources together keep the total size.  Sources, in code point order with
null last, weigh ``weights`` in turn; a target stops at ``cap`` times its source's size
and the excess is shared again by weight among the rest.

Selection: a source whose target is q whole copies and a remainder takes q copies of
every row, and one more of the rows whose key hash lies under the source's threshold.
The threshold comes from sums by source and hash bucket: the bucket in which the running
sum passes the remainder is the boundary, and only its rows are summed again by the next
hash bits, until it holds one hash value.  Nothing is sorted and the selected sets are
nested: a larger remainder only adds rows.  The row at the boundary is taken if that
brings the source nearer to its target, so a source misses it by half a row at most
(by half of all rows that share one id, if ids repeat).

Nulls: a null text has size 0; a null source is a source of its own; null ids hash alike.
Empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm._spark import cut

#: Bits of the hash, and bits by which a boundary bucket is refined each time.
BITS, STEP = 60, 10
#: Tables by source are broadcast up to this many sources; beyond it they are joined by shuffles.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Add each source's position in code point order, null last; sorted by ranges, not in one task."""
    ordered = sources.select("source", "source_size").orderBy(F.col("source").asc_nulls_last())
    pairs = ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    return sources.sparkSession.createDataFrame(pairs, f"source {sources.schema['source'].dataType.simpleString()}, source_size long, rank long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> DataFrame:
    """(source, source_size) -> also target.  Each round fixes the sources above their cap."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut(_ranked(sources).withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap)))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # size per unit of weight for those that stay below their cap
    while True:
        free = F.col("weight") * level < F.col("most")
        held, weight_left, capped = table.agg(
            F.sum(F.when(~free, F.col("most"))), F.sum(F.when(free, F.col("weight"))), F.count(F.when(~free, 1))
        ).first()
        new = (total - (held or 0.0)) / weight_left if weight_left else level
        if new <= level or not weight_left:
            break
        level = new
    return table.select("source", "source_size", F.least(F.col("weight") * level, "most").alias("target"))


def _sides(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _hashed(doc_id: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(8), doc_id), 64 - BITS)


def thresholds(docs: DataFrame, doc_id: str, text: str, source: str, weights: tuple[float, ...], cap: float) -> tuple[DataFrame, DataFrame, bool]:
    """(doc_id, source, size, hash) of all rows; source, source_size, target, whole, threshold; whether sources are few."""
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), docs[text].alias("text"))
    rows = rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), _hashed(F.col("doc_id")).alias("hash"))
    rows = cut(rows)
    shift = BITS - STEP
    sums = cut(rows.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("sum"), F.min("hash").alias("low"), F.max("hash").alias("high")))
    goal = targets(sums.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, cap)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0))
    goal = goal.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    goal = cut(goal)
    few = goal.count() <= BROADCAST_SOURCES

    # open: by source, the bucket in which the running sum passes the rest, and the sum before it
    open_ = goal.where("rest > 0").select("source", "rest", F.lit(0.0).alias("before"))
    done: DataFrame | None = None
    while True:
        running = F.sum("sum").over(Window.partitionBy("source").orderBy("bucket")) + F.col("before")
        seen = sums.alias("s").join(_sides(open_, few).alias("o"), F.col("s.source").eqNullSafe(F.col("o.source"))).select("s.source", "bucket", "sum", "low", "high", "rest", "before")
        seen = seen.withColumn("upto", running).where("upto >= rest")
        first = seen.groupBy("source").agg(F.min_by(F.struct("bucket", "sum", "low", "high", "rest", (F.col("upto") - F.col("sum")).alias("start")), "bucket").alias("b")).select("source", "b.*")
        first = cut(first)
        single = first.where("low = high").select("source", F.expr("CASE WHEN start + sum - rest <= rest - start THEN high + 1 ELSE low END").alias("threshold"))
        done = single if done is None else done.unionByName(single)
        open_ = first.where("low < high").select("source", "rest", F.col("start").alias("before"), F.col("bucket").alias("within"))
        if open_.isEmpty():
            break
        last, shift = shift, max(0, shift - STEP)
        inside = rows.alias("r").join(_sides(open_, few).alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.shiftright(F.col("r.hash"), last) == F.col("o.within")))
        sums = cut(inside.groupBy("r.source", F.shiftright("r.hash", shift).alias("bucket")).agg(F.sum("r.size").alias("sum"), F.min("r.hash").alias("low"), F.max("r.hash").alias("high")))
        open_ = open_.drop("within")

    limits = goal.alias("g").join(_sides(cut(done), few).alias("d"), F.col("g.source").eqNullSafe(F.col("d.source")), "left").select("g.*", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    return rows, cut(limits), few


def _copies() -> Column:
    return (F.col("whole") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)).cast("int")


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken (size * copies)."""
    rows, limits, few = thresholds(docs, doc_id, text, source, weights, cap)
    full = rows.alias("r").join(_sides(limits, few).alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    return full.select("r.doc_id", "r.source", "size", "source_size", "target", _copies().alias("copies"), (F.col("size") * _copies()).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken; texts aren't shuffled."""
    _, limits, few = thresholds(docs, doc_id, text, source, weights, cap)
    limits = limits.select(F.col("source").alias("_source"), "whole", "threshold")
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _hashed(docs[doc_id]).alias("hash"), docs[source].alias("_key"))
    joined = row.join(_sides(limits, few), F.col("_key").eqNullSafe(F.col("_source")))
    copied = joined.withColumn("_copies", _copies()).where("_copies > 0").select("row", F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy"))
    return copied.select("row.*")
