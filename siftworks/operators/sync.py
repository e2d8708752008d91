"""What an external table needs: which rows to create, refresh or leave, how they are written, and checks afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons by status.
REASONS = {"dropped": "Filtered Out", "shortlisted": "Shortlisted", "applied": "Applied", "passed": "User Declined", "unverified_blocked": "Unverified/Blocked"}
OTHER_REASON = "Filtered Out"


def actions(records: DataFrame, external: DataFrame, key: str, resolved: Column) -> DataFrame:
    """records with action: create without a row there, skip_resolved where a person has decided, refresh otherwise."""
    there = external.groupBy(key).agg(F.max(resolved.cast("int")).alias("_resolved"))
    return records.join(there, key, "left").withColumn("action", F.when(F.col("_resolved").isNull(), "create").when(F.col("_resolved") == 1, "skip_resolved").otherwise("refresh")).drop("_resolved")


def properties(df: DataFrame, status: str = "status", archetype: str = "archetype", allowed: list[str] = (), most_chars: int = 1990, texts: list[str] = ()) -> DataFrame:
    """df with reason, an archetype only if it is allowed, and texts within the length that the table takes."""
    reason = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), F.col(status)), F.lit(OTHER_REASON))
    out = df.withColumn("reason", reason)
    if archetype in df.columns:
        out = out.withColumn(archetype, F.when(F.col(archetype).isin(list(allowed)), F.col(archetype)))
    for c in texts:
        out = out.withColumn(c, F.left(F.col(c), F.lit(most_chars)))
    return out


def missing_options(needed: DataFrame, have: DataFrame, option: str = "option") -> DataFrame:
    return needed.select(option).distinct().join(have, option, "left_anti").orderBy(option)


def schema_gaps(have: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, type) frames to name, problem: missing property or wrong type."""
    both = wanted.select("name", F.col("type").alias("_w")).join(have.select("name", F.col("type").alias("_h")), "name", "left")
    return both.where(~F.col("_w").eqNullSafe(F.col("_h"))).select("name", F.when(F.col("_h").isNull(), "missing property").otherwise("wrong type").alias("problem"))


def option_gaps(have: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, option) frames to those that a property of the external table lacks."""
    return wanted.select("name", "option").distinct().join(have, ["name", "option"], "left_anti").orderBy("name", "option")


def written_wrong(sent: DataFrame, read: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows whose values are not there as they were sent."""
    a, b = sent.select(*keys, F.struct(*values).alias("_a")), read.select(*keys, F.struct(*values).alias("_b"))
    return a.join(b, keys, "left").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)


def candidate_file(df: DataFrame, most_chars: int = 1500) -> DataFrame:
    """Bodies cut for the candidates' file, with the name under which the whole body is kept."""
    return df.withColumn("jd_cache", F.when(F.coalesce("jd_text", F.lit("")) != "", F.left(F.sha2("url", 256), F.lit(16)))).withColumn("jd_text", F.left("jd_text", F.lit(most_chars)))


def evidence(df: DataFrame) -> DataFrame:
    """Rows for the log of fetches: a hash and the length of what was read, the status as text."""
    return df.select("url", F.col("status").cast("string").alias("status"), F.when(F.coalesce("body", F.lit("")) != "", F.left(F.sha2("body", 256), F.lit(16))).alias("content_hash"), F.length(F.coalesce("body", F.lit(""))).alias("bytes"), "verdict", "via", "ts")


def digest(runs: DataFrame) -> DataFrame:
    return runs.select(F.format_string("in %d | new %d | dropped %d | dead links %d", "funnel_in", "new", "dropped", "link_dead").alias("line"))


def export_pending(acted: DataFrame, path: str) -> None:
    """Without access to the external table: what would be created or refreshed, as JSON lines in a folder, in place of the last export."""
    acted.where(F.col("action").isin("create", "refresh")).write.mode("overwrite").json(path)
