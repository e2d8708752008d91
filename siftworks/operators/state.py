"""Keyed state in batches: re-checks, picks by priority, merges of logs and ledgers, comparison of versions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import generic_term_ok


def _sure(verdict: Column) -> Column:
    """Whether a check told anything; any other verdict, and none, leaves a posting unverified."""
    return F.coalesce(verdict.isin("stale", "live"), F.lit(False))


def sweep_states(checks: DataFrame, key: str, order: list[str], verdict: str = "verdict") -> DataFrame:
    """checks with streak (neither stale nor live, so often in a row up to here) and escalated (exactly the second in a row)."""
    by_key, sure = Window.partitionBy(key).orderBy(*order), _sure(F.col(verdict))
    rows = checks.withColumn("_island", F.sum(sure.cast("int")).over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.sum((~sure).cast("int")).over(Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("streak", F.when(sure, 0).otherwise(n).cast("long")).withColumn("escalated", F.col("streak") == 2).drop("_island")


def sweep_update(state: DataFrame, checks: DataFrame, now, key: str = "url_key") -> DataFrame:
    """The next state from the last one and one row a key that was checked (verdict null: the check told nothing): last_checked,
    unverifiable_streak, action."""
    both = state.join(checks.withColumn("_checked", F.lit(True)), key, "full_outer")
    sure, more = _sure(F.col("verdict")), F.coalesce("unverifiable_streak", F.lit(0)) + 1
    streak = F.when(F.col("_checked").isNull(), F.col("unverifiable_streak")).when(sure, 0).otherwise(more)
    action = F.when(F.col("verdict") == "stale", "drop").when(F.col("_checked") & ~sure & (more == 2), "escalate")
    return both.select(key, F.when(F.col("_checked"), now).otherwise(F.col("last_checked")).alias("last_checked"), streak.cast("int").alias("unverifiable_streak"), action.alias("action"))


def sweep_counters(states: DataFrame) -> DataFrame:
    """One row over checked rows: checked, stale, live, unverifiable, escalated."""
    return states.agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(F.col("verdict") == "stale").alias("stale"), F.count_if(F.col("verdict") == "live").alias("live"),
        F.count_if(~_sure(F.col("verdict"))).alias("unverifiable"), F.count_if("escalated").alias("escalated"),
    )


def sweep_run(records: DataFrame, state: DataFrame, verdicts: DataFrame, now, key: str = "url_key", hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """One sweep over the records in its scope: (the next state of all keys, counters). Keys that were checked within the last hours are
    deferred and keep their state. counters, one row: scope, checked, deferred, stale, live, unverifiable, escalated."""
    scope = due(records.select(key).distinct(), state, key, now, hours)
    checks = scope.where(~F.col("deferred")).select(key).join(verdicts.groupBy(key).agg(F.min("verdict").alias("verdict")), key, "left")
    after = sweep_update(state, checks, now, key)
    done = checks.join(after.select(key, (F.coalesce("action", F.lit("")) == "escalate").alias("escalated")), key)
    return after, scope.agg(F.count(F.lit(1)).alias("scope"), F.count_if("deferred").alias("deferred")).crossJoin(F.broadcast(sweep_counters(done)))  # single rows


def due(records: DataFrame, state: DataFrame, key: str, now, hours: int = 24) -> DataFrame:
    """records with deferred: checked within the last hours (strictly); never checked or unreadable is due."""
    return records.join(state, key, "left").withColumn("deferred", F.coalesce(F.col("last_checked") > now - F.make_interval(hours=F.lit(hours)), F.lit(False)))


def best_reason(rows: DataFrame, key: str, reason: str, order: str, priority: dict[str, int]) -> DataFrame:
    """One row a key: the reason of the highest priority, the first of equal ones."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col(reason)), F.lit(0))
    return rows.groupBy(key).agg(F.max_by(reason, F.struct(rank, -F.col(order))).alias(reason))


def resolutions(external: DataFrame, log: DataFrame, key: str, reason: str, order: str, priority: dict[str, int], targets: dict[str, str], status: str = "status", live: str = "shortlisted") -> DataFrame:
    """What a decision made elsewhere does to the log's current records: one row a key of external with a reason that settles it,
    target, and outcome (unmatched: not in the log; already: no longer live there; resolved: takes the target)."""
    best = best_reason(external, key, reason, order, priority)
    best = best.withColumn("target", F.element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col(reason))).where("target IS NOT NULL")
    outcome = F.when(F.col("_here").isNull(), "unmatched").when(F.col("_status").eqNullSafe(live), "resolved").otherwise("already")
    return best.join(log.select(key, F.col(status).alias("_status"), F.lit(True).alias("_here")), key, "left").select(key, reason, "target", outcome.alias("outcome"))


def reconcile_counts(external: DataFrame, log: DataFrame, key: str, status: str, wanted: str) -> DataFrame:
    """One row: unmatched, already, backfilled, over external keys against the log's current records."""
    have = log.groupBy(key).agg(F.max(F.when(F.col(status) == wanted, 1).otherwise(0)).alias("_have"))
    return external.join(have, key, "left").agg(F.count_if(F.col("_have").isNull()).alias("unmatched"), F.count_if(F.col("_have") == 1).alias("already"), F.count_if(F.col("_have") == 0).alias("backfilled"))


def union_lines(theirs: DataFrame, ours: DataFrame, line: str = "line", order: str = "ord") -> DataFrame:
    """Distinct lines, theirs first, each at its first place; blank lines go."""
    both = theirs.select(line, F.struct(F.lit(0).alias("side"), F.col(order).alias("ord")).alias("at")).union(ours.select(line, F.struct(F.lit(1), F.col(order))))
    return both.where(F.trim(F.col(line)) != "").groupBy(line).agg(F.min("at").alias("at")).select(line, F.col("at.side").alias("side"), F.col("at.ord").alias(order))


def merge_ledgers(ours: DataFrame, theirs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of both; where both have a key, ours."""
    a = ours.select(*keys, F.struct(*values).alias("_a"))
    b = theirs.select(*keys, F.struct(*values).alias("_b"))
    return a.join(b, keys, "full_outer").select(*keys, F.coalesce("_a", "_b").alias("_v")).select(*keys, "_v.*")


def overwritten(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The rows of new that old lacks or has otherwise: what a migration writes over plain state."""
    a = old.select(*keys, F.struct(*values).alias("_a"))
    return new.join(a, keys, "left").where(F.col("_a").isNull() | ~F.struct(*values).eqNullSafe(F.col("_a"))).select(*new.columns)


def merge_counters(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The recompute block alone takes the larger of each; other blocks are merged as days are."""
    return ours.union(theirs).agg(F.max("last").alias("last"), F.max("sessions").alias("sessions"))


def frame_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose rows differ: change is added, removed or changed, and fields are the names that differ."""
    a, b = old.select(*keys, F.struct(*values).alias("_a")), new.select(*keys, F.struct(*values).alias("_b"))
    both = a.join(b, keys, "full_outer")
    fields = F.filter(F.array(*(F.when(~F.col(f"_a.{v}").eqNullSafe(F.col(f"_b.{v}")), F.lit(v)) for v in values)), lambda x: x.isNotNull())
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, change.alias("change"), F.when(change == "changed", fields).otherwise(F.expr("CAST(array() AS array<string>)")).alias("fields"))


def flat_values(df: DataFrame, keys: list[str], doc: str, depth: int = 8, named_by: str = "id") -> DataFrame:
    """keys, path, value: the values of a JSON column, one row each. Objects are opened level by level, and lists of objects too, whose
    elements are named by their field `named_by` where they have one (platforms[7].tier) and else by their place; other lists are
    values as wholes. What lies deeper than `depth` is one value. Null, empty texts, lists and objects, false, and what is not
    there are alike: they have no row. Text that is no JSON is the value of an empty path."""
    parsed = F.try_parse_json(F.col(doc))
    level, out = df.select(*keys, F.lit("").alias("path"), F.coalesce(parsed, F.when(F.col(doc).isNotNull(), F.col(doc)).cast("variant")).alias("_v")), None
    for left in reversed(range(depth)):
        kind = F.schema_of_variant("_v")
        # An empty object or list opens to nothing, as it should.
        opens = kind.startswith("OBJECT") | kind.startswith("ARRAY<OBJECT") if left else F.lit(False)
        text = F.coalesce(F.try_variant_get("_v", "$", "string"), F.to_json("_v"))
        leaves = level.where(~opens).select(*keys, "path", text.alias("value")).where("value IS NOT NULL AND value NOT IN ('', '[]', '{}', 'false', 'null')")
        out = leaves if out is None else out.unionByName(leaves)
        if left:
            name = F.coalesce(F.try_variant_get("value", f"$.{named_by}", "string"), F.col("pos").cast("string"))
            step = F.when(F.col("key").isNotNull(), F.concat(F.when(F.col("path") == "", "").otherwise("."), "key")).otherwise(F.concat(F.lit("["), name, F.lit("]")))
            opened = level.where(opens).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer()))
            level = opened.select(*keys, F.concat("path", step).alias("path"), F.col("value").alias("_v"))
    return out


def nested_diff(old: DataFrame, new: DataFrame, keys: list[str], doc: str, accepted: dict[str, str] | None = None, depth: int = 8, named_by: str = "id") -> DataFrame:
    """keys, path, old, new, note: where two versions of JSON documents differ, value by value (flat_values). accepted: patterns that a
    whole path fits, with why the difference is as it should be; a row without a note is a problem. Of paths that a document holds
    twice the greater value counts. Documents are opened where they are read; their values meet by keys and path."""
    side = lambda df, name: flat_values(df, keys, doc, depth, named_by).groupBy(*keys, "path").agg(F.max("value").alias(name))
    both = side(old, "old").join(side(new, "new"), [*keys, "path"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    notes = [F.when(F.col("path").rlike(f"^(?:{pattern})$"), F.lit(note)) for pattern, note in (accepted or {}).items()]
    return both.withColumn("note", F.coalesce(*notes, F.lit(None).cast("string")))


def parity(diffs: DataFrame) -> DataFrame:
    """One row: accepted, problems, and whether there is parity."""
    return diffs.agg(F.count("note").alias("accepted"), F.count_if(F.col("note").isNull()).alias("problems")).withColumn("parity", F.col("problems") == 0)


def merge_suggestions(kept: DataFrame, rows: DataFrame) -> DataFrame:
    """The kept table (kind, value, frequency, sources, first_seen, last_seen) with new rows (kind, value, source, day) merged in: frequencies
    add up, sources unite, the first and the last day stand. Two merges give what one merge of both parts does."""
    parts = kept.select("kind", "value", "frequency", "sources", "first_seen", "last_seen").unionByName(upsert_suggestions(rows))
    united = F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources"))))
    return parts.groupBy("kind", "value").agg(F.sum("frequency").alias("frequency"), united.alias("sources"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


SUGGESTION_PARTS = 64


def save_suggestions(rows: DataFrame, path: str, parts: int = SUGGESTION_PARTS) -> int:
    """Merge rows into the table kept at path, in hash partitions (part=...), of which only those that rows touch are read and written
    anew, by dynamic partition overwrite. Returns how many those were. `parts` is fixed when the table is made."""
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64("kind", "value"), F.lit(parts)).cast("int").alias("part")
    new = rows.select("kind", F.lower("value").alias("value"), "source", "day")
    touched = sorted(r[0] for r in new.select(part).distinct().collect())  # `parts` numbers at most
    if not touched:
        return 0
    try:
        kept = spark.read.parquet(path).where(F.col("part").isin(touched)).drop("part")
    except AnalysisException:
        kept = upsert_suggestions(new.limit(0))
    merged = merge_suggestions(kept, new).withColumn("part", F.pmod(F.xxhash64("kind", "value"), F.lit(parts)).cast("int"))
    # Spark doesn't write over what it reads: the new partitions are written aside first.
    aside = f"{path.rstrip('/')}_merging"
    merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(aside)
    spark.read.parquet(aside).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return len(touched)


def upsert_suggestions(rows: DataFrame) -> DataFrame:
    """rows (kind, value, source, day) to kind, value, frequency, sources, first_seen, last_seen; values meet in lower case."""
    return rows.groupBy("kind", F.lower("value").alias("value")).agg(F.count(F.lit(1)).alias("frequency"), F.array_sort(F.collect_set("source")).alias("sources"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))


#: What a suggestion may hold.
SUGGESTION_KEYS = ("kind", "value", "sources", "first_seen", "last_seen", "frequency")
SUGGESTION_KINDS = ("keyword_core", "keyword_expanded", "archetype")


def suggestion_errors(entry: Column) -> Column:
    """The errors of a suggestion that is given as JSON: keys that are not allowed, and values of the wrong kind or form. None: an empty array."""
    v, fields = F.try_parse_json(entry), F.map_keys(F.from_json(entry, "map<string,string>"))
    get = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    kind = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    has = lambda name: F.coalesce(F.array_contains(fields, name), F.lit(False))
    is_a = lambda name, *types: F.coalesce(kind(name).isin(*types), F.lit(False))
    sources = F.try_variant_get(v, "$.sources", "array<string>")
    kebab = F.forall(sources, lambda x: F.coalesce(x.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False)))
    unknown = F.array_sort(F.array_except(fields, F.array(*map(F.lit, SUGGESTION_KEYS))))
    day = lambda name: F.when(get(name).isNotNull() & ~get(name).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(f"{name} must be YYYY-MM-DD"))
    errors = F.array(
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown keys: "), F.array_join(unknown, ", "))),
        F.when(~F.coalesce(get("kind").isin(*SUGGESTION_KINDS), F.lit(False)), F.lit("kind must be one of " + ", ".join(SUGGESTION_KINDS))),
        F.when(~(is_a("value", "STRING") & generic_term_ok(get("value"))), F.lit("value must be a short generic term")),
        F.when(has("sources") & ~(is_a("sources", "ARRAY<STRING>", "ARRAY<VOID>") & F.coalesce(kebab, F.lit(False))), F.lit("sources must be a list of kebab-case names")),
        F.when(has("frequency") & ~(is_a("frequency", "BIGINT") & F.coalesce(F.try_variant_get(v, "$.frequency", "long") >= 1, F.lit(False))), F.lit("frequency must be a positive integer")),
        day("first_seen"), day("last_seen"),
    )
    return F.when(F.coalesce(kind_of_object(v), F.lit(False)), F.filter(errors, lambda x: x.isNotNull())).otherwise(F.array(F.lit("not a mapping")))


def kind_of_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def merge_across_sources(df: DataFrame, key: str, source: str, order: str, payload: list[str]) -> DataFrame:
    """One row a key: the first record's payload, all sources, and whether there are two or more."""
    out = df.groupBy(key).agg(F.min_by(F.struct(*payload), F.col(order)).alias("_p"), F.array_sort(F.collect_set(source)).alias("sources"))
    return out.select(key, "_p.*", "sources", (F.size("sources") >= 2).alias("confirmed"))


def clone_groups(df: DataFrame, company: str, family: str, place: str) -> DataFrame:
    """Companies with one role family in two or more places."""
    return df.groupBy(company, family).agg(F.countDistinct(place).alias("places"), F.count(F.lit(1)).alias("n")).where("places >= 2")


def rates(df: DataFrame, by: str, hit, of) -> DataFrame:
    return df.groupBy(by).agg(F.count_if(hit).alias("hits"), F.count_if(of).alias("total")).withColumn("rate", F.when(F.col("total") > 0, F.col("hits") / F.col("total")))
