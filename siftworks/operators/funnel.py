"""Counts over one classified frame: what dropped, why, and where from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import drop_param

#: The share of all that came in from which on a filter is said to take too much.
OVER = 0.40


def drop_by_param(df: DataFrame, reason: str = "drop_reason") -> DataFrame:
    return df.where(F.col(reason).isNotNull()).groupBy(drop_param(F.col(reason)).alias("param")).agg(F.count(F.lit(1)).alias("n"))


def funnel(df: DataFrame, reason: str = "drop_reason") -> DataFrame:
    """One row: funnel_in, new, dropped, link_dead."""
    dead = F.col(reason).isin("stale", "unverified_blocked")
    return df.agg(F.count(F.lit(1)).alias("funnel_in"), F.count_if(F.col(reason).isNull()).alias("new"), F.count_if(F.col(reason).isNotNull()).alias("dropped"), F.count_if(F.coalesce(dead, F.lit(False))).alias("link_dead"))


def over_constraint(df: DataFrame, reason: str = "drop_reason", least: float = OVER) -> DataFrame:
    """Filters that take at least that share of all that came in, the heaviest first."""
    total = df.agg(F.count(F.lit(1)).alias("funnel_in"))  # one row
    counts = drop_by_param(df, reason).crossJoin(F.broadcast(total))
    return counts.withColumn("share", F.col("n") / F.col("funnel_in")).where(F.col("share") >= least).orderBy(F.desc("n"), "param")


def source_stats(df: DataFrame, sources: DataFrame, source: str = "source") -> DataFrame:
    """A row for each known source, with raw rows (0 if it brought none). If sources has fetches and answered (how many were
    tried, and how many came back well), also http_ok (one answer at least) and source_down (none, though tried)."""
    out = sources.join(df.groupBy(source).agg(F.count(F.lit(1)).alias("raw")), source, "left").withColumn("raw", F.coalesce("raw", F.lit(0).cast("long")))
    if not {"fetches", "answered"} <= set(sources.columns):
        return out
    return out.withColumn("http_ok", F.col("answered") > 0).withColumn("source_down", (F.col("raw") == 0) & (F.col("fetches") > 0))


def flag_counts(df: DataFrame, names: list[str], flags: str = "flags") -> DataFrame:
    # With explode Spark would ask for non-empty arrays first, and so make the flags twice.
    return df.select(F.explode_outer(flags).alias("flag")).where(F.col("flag").isin(names)).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
