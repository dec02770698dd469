"""Ordered-sequence operators over a call relation (session, ord, item, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.session import cut

MOST_ITEMS, LEAST_SESSIONS, LOOP_RUN = 5, 3, 3


def by_session(*order: str) -> Window:
    return Window.partitionBy("session").orderBy(*order)


def ngrams(calls: DataFrame, most: int = MOST_ITEMS, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """All windows of 2..most neighbouring calls, one row each with the columns of its first call.

    One sort by session; windows that are one item repeated are left out (F15).
    """
    ahead = [F.lead("item", i).over(by_session(*order)).alias(f"_l{i}") for i in range(1, most)]
    wide = calls.select("*", *ahead)
    grams = F.array(*[F.when(F.col(f"_l{n - 1}").isNotNull(), F.array("item", *[f"_l{i}" for i in range(1, n)])) for n in range(2, most + 1)])
    out = wide.select(*calls.columns, F.explode(F.array_compact(grams)).alias("gram"))
    return out.where(F.size(F.array_distinct("gram")) > 1)


def support(grams: DataFrame, least_sessions: int = LEAST_SESSIONS) -> DataFrame:
    """(gram, sessions, occurrences) of grams that enough sessions have."""
    return grams.groupBy("gram").agg(F.count_distinct("session").alias("sessions"), F.count("*").alias("occurrences")).where(F.col("sessions") >= least_sessions)


def closed(frequent: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """Drop a gram inside a kept, longer one that has at least 0.8 of its sessions.

    Only kept grams suppress and equal lengths never do, so the lengths go down level by
    level; each level is an equi-join on the sub-windows of what is kept so far.
    """
    frequent = cut(frequent)
    kept = cut(frequent.where(F.size("gram") == most))
    for n in range(most - 1, 1, -1):
        inside = kept.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("gram") - n + 1), lambda i: F.slice("gram", i, n))).alias("gram"), F.col("sessions").alias("longer"))
        inside = inside.groupBy("gram").agg(F.max("longer").alias("longer"))
        level = frequent.where(F.size("gram") == n)
        alive = level.join(inside, "gram", "left").where(F.col("longer").isNull() | (F.col("sessions") > F.col("longer") * 1.25)).select(*frequent.columns)
        kept = cut(kept.unionByName(alive))
    return kept


def runs(calls: DataFrame, least: int = LOOP_RUN, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Maximal runs of one item, with the columns of their first call and ``run``, their length."""
    numbered = calls.select("*", F.row_number().over(by_session(*order)).alias("_n"), F.row_number().over(Window.partitionBy("session", "item").orderBy(*order)).alias("_m"))
    others = [c for c in calls.columns if c not in ("session", "item")]
    grouped = numbered.groupBy("session", "item", (F.col("_n") - F.col("_m")).alias("_island")).agg(F.count("*").alias("run"), F.min(F.struct("_n", *others)).alias("_first"))
    return grouped.where(F.col("run") >= least).select("session", "item", *[F.col(f"_first.{c}").alias(c) for c in others], "run")


def next_after_error(events: DataFrame, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(err, fix) for each call whose neighbour before it is an error; a later error replaces an earlier one.

    events: kind 'use' with item, or 'err' with item = the tool that failed.
    """
    w = by_session(*order)
    seen = events.select("*", F.lag("kind").over(w).alias("_k"), F.lag("item").over(w).alias("err"))
    return seen.where("kind = 'use' and _k = 'err'").select(*[c for c in events.columns if c not in ("kind", "item")], "err", F.col("item").alias("fix"))


def last_before(value: Column, *keys: str, order: tuple[str, ...] = ("ord",)) -> Column:
    """As-of lookup without a join: the last non-null value up to here for the same keys."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def first_so_far(value: Column, *keys: str, order: tuple[str, ...] = ("ord",)) -> Column:
    """The first non-null value up to here; a value that comes later does not count."""
    return F.first(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def first_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key; pruned before the shuffle, so a hot key is no large group."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")
