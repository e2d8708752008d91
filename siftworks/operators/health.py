"""Source health over run telemetry: outages, collapses of yield, and sources that never brought anything.

Input: one row for each run and platform (run_at, platform, raw, source_down, http_ok). Only the trailing runs count, so
each platform's history is a bounded group and plain aggregates do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANK = {"SYSTEMIC": 0, "SELECTOR_SUSPECT": 1, "DOWN_STREAK": 2, "YIELD_COLLAPSE": 3, "NEVER_PRODUCED": 4}


@dataclass(frozen=True)
class Thresholds:
    window: int = 6
    down_streak: int = 4
    collapse: float = 0.15
    min_baseline: float = 3
    never_runs: int = 4
    systemic_share: float = 0.7
    systemic_boards: int = 4


def flatten_ledger(ledger: DataFrame, column: str = "ledger") -> DataFrame:
    """map<day, map<label, record>> to rows of run_at, platform, raw, source_down, http_ok. Keys that are no dates are counter
    blocks. A record without statistics gets them from its lists: covered sources reached, downed ones hard-down."""
    days = ledger.select(F.explode(column).alias("day", "labels")).where(F.col("day").rlike(r"^\d{4}-\d\d-\d\d$"))
    runs = days.select("day", F.explode("labels").alias("label", "r"))
    usual = F.concat("day", F.when(F.col("label") == "PM", "T12:00:00").otherwise("T00:00:00"))
    at = runs.withColumn("run_at", F.to_timestamp(F.replace(F.left(F.coalesce("r.ran_at", usual), F.lit(19)), F.lit("T"), F.lit(" "))))
    legacy = F.map_from_entries(
        F.concat(
            F.transform(F.coalesce("r.platforms_covered", F.expr("CAST(array() AS array<string>)")), lambda p: F.struct(p.alias("key"), F.struct(F.lit(None).cast("long").alias("raw"), F.lit(False).alias("source_down"), F.lit(True).alias("http_ok")).alias("value"))),
            F.transform(F.coalesce(F.array_except("r.sources_down", F.coalesce("r.platforms_covered", F.expr("CAST(array() AS array<string>)"))), F.expr("CAST(array() AS array<string>)")), lambda p: F.struct(p.alias("key"), F.struct(F.lit(None).cast("long").alias("raw"), F.lit(True).alias("source_down"), F.lit(False).alias("http_ok")).alias("value"))),
        )
    )
    return at.select("run_at", F.explode(F.coalesce("r.platform_stats", legacy)).alias("platform", "s")).select("run_at", "platform", "s.raw", "s.source_down", "s.http_ok")


def trailing(stats: DataFrame, window: int) -> DataFrame:
    """stats of the last `window` runs (all if it is 0 or less), with pos: 1 for the latest."""
    runs = stats.select("run_at").distinct()
    if window > 0:
        few = runs.orderBy(F.desc("run_at")).limit(window)
        return stats.join(F.broadcast(few.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("run_at"))))), "run_at")
    # Without a window all runs count: a row for each scan ever made, numbered in one task but not broadcast.
    return stats.join(runs.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("run_at")))), "run_at")


def per_platform(stats: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """One row a platform: latest raw, source_down and http_ok, prior_median, down_streak, appearances, most_raw, ever_ok."""
    rows = trailing(stats, t.window)
    hard = F.col("source_down") & ~F.col("http_ok")
    n = rows.agg(F.max("pos").alias("runs"))  # one row
    # A run in which the platform is missing ends its streak as well: the first position that is not hard-down counts.
    last = lambda c: F.max(F.when(F.col("pos") == 1, F.col(c)))
    by = rows.groupBy("platform").agg(
        F.count_if(F.col("pos") == 1).alias("present"), last("raw").alias("raw"), last("source_down").alias("source_down"), last("http_ok").alias("http_ok"),
        F.percentile(F.when((F.col("pos") > 1) & (F.col("raw") > 0) & ~F.col("source_down"), F.col("raw")), 0.5).alias("prior_median"),
        F.collect_set(F.when(hard, F.col("pos"))).alias("_down"), F.count(F.lit(1)).alias("appearances"), F.max(F.coalesce("raw", F.lit(0))).alias("most_raw"), F.max("http_ok").alias("ever_ok"),
    )
    by = by.crossJoin(F.broadcast(n))
    return by.withColumn("down_streak", F.coalesce(F.array_min(F.array_except(F.sequence(F.lit(1), "runs"), "_down")) - 1, F.col("runs"))).drop("_down", "runs")


def systemic(platforms: DataFrame, t: Thresholds = Thresholds(), active: list[str] | None = None) -> DataFrame:
    """One row: present, zero, systemic."""
    there = platforms.where("present > 0")
    if active is not None:
        there = there.where(F.col("platform").isin(active))
    zero = F.coalesce(F.col("source_down"), F.lit(False)) | (F.col("raw") == 0)
    return there.agg(F.count(F.lit(1)).alias("present"), F.count_if(F.coalesce(zero, F.lit(False))).alias("zero")).withColumn("systemic", (F.col("present") >= t.systemic_boards) & (F.col("zero") >= t.systemic_share * F.col("present")))


def findings(stats: DataFrame, t: Thresholds = Thresholds(), active: list[str] | None = None) -> DataFrame:
    """platform, flag, by severity. SYSTEMIC (platform '*') hides the findings about single outages."""
    platforms = per_platform(stats, t)
    whole = systemic(platforms, t, active)
    enough = F.col("prior_median") >= t.min_baseline
    flag = (
        F.when(~F.col("systemic") & (F.col("present") > 0) & F.col("http_ok") & (F.col("raw") == 0) & enough, "SELECTOR_SUSPECT")
        .when(~F.col("systemic") & (F.col("present") > 0) & (F.col("down_streak") >= t.down_streak), "DOWN_STREAK")
        .when(~F.col("systemic") & (F.col("raw") > 0) & ~F.col("source_down") & enough & (F.col("raw") < t.collapse * F.col("prior_median")), "YIELD_COLLAPSE")
    )
    known = F.col("platform").isin(active) if active is not None else F.lit(True)
    never = known & (F.col("appearances") >= t.never_runs) & (F.col("most_raw") == 0) & F.col("ever_ok")
    rows = platforms.crossJoin(F.broadcast(whole.select("systemic"))).select("platform", F.coalesce(flag, F.when(never, "NEVER_PRODUCED")).alias("flag")).where("flag IS NOT NULL")
    rows = rows.union(whole.where("systemic").select(F.lit("*"), F.lit("SYSTEMIC")))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("flag"))
    return rows.orderBy(rank, "platform")


def finding_counts(found: DataFrame) -> DataFrame:
    """flag, n: how many findings there are of each kind, the gravest first."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("flag"))
    return found.groupBy("flag").agg(F.count(F.lit(1)).alias("n")).orderBy(rank)


def due_review(runs: DataFrame, acks: DataFrame, due: int) -> DataFrame:
    """One row: sessions since the last acknowledged run, and whether a review is due."""
    last = acks.agg(F.max("run_at").alias("_ack"))
    return runs.crossJoin(F.broadcast(last)).agg(F.count_if(F.col("_ack").isNull() | (F.col("run_at") > F.col("_ack"))).alias("since")).withColumn("due", F.col("since") >= due)


def gap_hours(previous, now):
    """Hours since the last run, never negative; 24 without one."""
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(previous.cast("timestamp"))) / F.lit(3_600_000_000.0)
    return F.when(previous.isNull(), F.lit(24.0)).otherwise(F.greatest(hours, F.lit(0.0)))


def pages_for_gap(hours, per_hour: int = 100, safety: float = 1.5, per_page: int = 20, least: int = 50, most: int = 1300):
    """How many pages of a newest-first feed cover a gap."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.floor(hours * per_hour * safety) / per_page))).cast("int")
