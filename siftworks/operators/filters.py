"""Ordered filters that give each candidate one drop reason, and flags to those that stay."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text

#: Patterns that drop, patterns that flag, and the closed list of places.
AUTO_DROP = {
    "us_only": r"(?i)\b(US[- ]only|United States only|must (be located|reside) in the (US|United States)|authorized to work in the (US|U\.S\.)|E-?Verify|W-?2\b)",
    "clearance": r"(?i)\b(security clearance|TS/SCI|secret clearance|public trust)\b",
    "travel": r"(?i)\b(travel (up to |approximately |~)?\d{1,3}\s?%|\d{1,3}\s?% travel|occasional travel|willingness to travel|travel (is |will be )?(required|expected)|travel as needed)\b",
    "grind_culture": r"(?i)\b(996|70[- ]hour|60\+? ?hours?/?week|work hard,? play hard|hustle culture)\b",
}
FLAGS = {
    "timezone": r"(?i)\b(EST|EDT|PST|PDT|CST|CDT|MST|Eastern Time|Pacific Time|Mountain Time|Central Time|[0-9]{1,2}\s?(am|pm)\s?(ET|EST|PT|PST|CT|CST|MT))\b",
    "eu_citizenship": r"(?i)\b(EU (citizenship|citizen|passport)|European Union citizenship|EU work permit required)\b",
    "latam_payroll": r"(?i)\b(LATAM|Latin America)\b.{0,80}\b(payroll|contract|entity|salary in local currency)\b",
}
COUNTRIES = (
    "Austria", "Belgium", "Bulgaria", "Croatia", "Cyprus", "Czech", "Denmark", "Estonia", "Finland", "France", "Germany", "Greece", "Hungary", "Ireland", "Italy", "Latvia", "Lithuania",
    "Luxembourg", "Malta", "Netherlands", "Poland", "Portugal", "Romania", "Slovakia", "Slovenia", "Spain", "Sweden", "Norway", "Switzerland", "Iceland", "UK", "United Kingdom",
)
#: Texts, in lower case, of which one at least is in whatever a pattern matches: a plain search that saves most runs of the pattern.
GATES = {
    "us_only": ("us only", "us-only", "states only", "in the us", "in the united states", "authorized to work", "verify", "w2", "w-2"),
    "clearance": ("clearance", "ts/sci", "public trust"),
    "travel": ("travel",),
    "grind_culture": ("996", "70 hour", "70-hour", "hourweek", "hoursweek", "hour/week", "hours/week", "work hard", "hustle culture"),
    "eu_citizenship": ("eu citizen", "eu passport", "european union citizenship", "eu work permit"),
    "latam_payroll": ("latam", "latin america"),
}
OPEN_ENDED = ("and more", "worldwide", "among others", "not limited to", "etc")


@dataclass(frozen=True)
class Rules:
    title_drop: dict[str, str] = field(default_factory=dict)
    auto_drop: dict[str, str] = field(default_factory=lambda: dict(AUTO_DROP))
    flags: dict[str, str] = field(default_factory=lambda: dict(FLAGS))
    countries: tuple[str, ...] = COUNTRIES
    open_ended: tuple[str, ...] = OPEN_ENDED
    must_include: tuple[str, ...] = ()
    closed_list: bool = True


def unicode(pattern: str) -> str:
    """Word boundaries and blanks over all letters, not ASCII's alone."""
    return "(?U)" + pattern


def keyword_match(title: Column, keywords: list[str]) -> Column:
    """The first keyword, in their order, that the title holds; null if none does."""
    low = F.lower(text(title))
    return F.coalesce(*(F.when(low.contains(k.lower()), F.lit(k)) for k in keywords)) if keywords else F.lit(None).cast("string")


def posted_time(posted: Column) -> Column:
    """ISO text by its first 19 characters, whatever its offset; mail dates by their first 25. Null if it can't be read."""
    p = text(posted)
    iso = F.coalesce(*(F.try_to_timestamp(F.replace(F.left(p, F.lit(19)), F.lit("T"), F.lit(" ")), F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")))
    mail = F.try_to_timestamp(F.regexp_replace(F.trim(F.left(p, F.lit(25))), r"^\w{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss"))
    return F.when(p.rlike(r"^\d{4}-\d{2}-\d{2}"), iso).when(p.rlike(r"^\w{3}, "), mail)


def fresh(posted: Column, cutoff: Column) -> Column:
    """At or after the cutoff; undated and unreadable rows stay."""
    return F.coalesce(posted_time(posted) >= cutoff, F.lit(True))


def folded(c: Column) -> Column:
    """Lower case, also for the letters that match an ASCII letter when case is ignored."""
    return F.lower(F.translate(c, "\u017f\u212a\u0130\u0131", "skii"))


def hit(hay: Column, name: str, pattern: str, low: Column | None = None) -> Column:
    found = hay.rlike(unicode(pattern))
    if low is None or pattern not in (AUTO_DROP.get(name), FLAGS.get(name)) or name not in GATES:
        return found
    gate = F.lit(False)
    for part in GATES[name]:
        gate = gate | low.contains(part)
    return F.when(gate, found).otherwise(F.lit(False))


def first_hit(hay: Column, patterns: dict[str, str], low: Column | None = None) -> Column:
    return F.coalesce(*(F.when(hit(hay, name, p, low), F.lit(name)) for name, p in patterns.items())) if patterns else F.lit(None).cast("string")


def all_hits(hay: Column, patterns: dict[str, str], low: Column | None = None) -> Column:
    if not patterns:
        return F.expr("CAST(array() AS array<string>)")
    return F.filter(F.array(*(F.when(hit(hay, name, p, low), F.lit(name)) for name, p in patterns.items())), lambda x: x.isNotNull())


def closed_list(hay: Column, rules: Rules) -> Column:
    """At least four countries, and neither an open end nor a wanted place."""
    if not rules.countries:
        return F.lit(False)
    # All countries in one pass; longer names first, so that none hides in another.
    names = "|".join(rf"\Q{c}\E" for c in sorted(rules.countries, key=len, reverse=True))
    first = "".join(sorted({re.escape(c[0]) for c in rules.countries}))
    found = F.size(F.array_distinct(F.regexp_extract_all(hay, F.lit(rf"(?U)\b(?=[{first}])({names})\b"), F.lit(1))))
    low = F.lower(hay)
    excused = F.lit(False)
    for m in (*rules.open_ended, *rules.must_include):
        excused = excused | low.contains(m.lower())
    return F.when(found >= 4, ~excused).otherwise(F.lit(False))


def hard_filter(df: DataFrame, rules: Rules, title: str = "title", place: str = "loc", pay: str = "salary", body: str = "jd_text") -> DataFrame:
    """df with drop_reason (null if the row stays) and flags (empty if it goes). The title is looked at first. Columns of df named
    drop_reason or flags are replaced."""
    hay = F.concat_ws(" ", *(text(F.col(c)) for c in (title, place, pay, body)))
    kept = [c for c in df.columns if c not in ("drop_reason", "flags")]
    # The row beside the text, so that no column of df can clash with the text's two forms.
    rows = df.select(F.struct(*kept).alias("row"), hay.alias("hay")).withColumn("low", folded(F.col("hay")))
    by_pattern = F.coalesce(first_hit(F.col(f"row.{title}"), rules.title_drop), first_hit(F.col("hay"), rules.auto_drop, F.col("low")))
    named = F.concat(F.lit("auto-drop: "), by_pattern)
    if rules.closed_list:
        named = F.coalesce(named, F.when(closed_list(F.col("hay"), rules), F.lit("auto-drop: closed_location_list (closed list, candidate location absent)")))
    # Of an array of one, so that no condition on the reason is moved below it, where every pattern would run again, and the text be
    # built anew for each.
    rows = rows.select("row", "hay", "low", F.explode(F.array(named)).alias("drop_reason"))
    none = F.expr("CAST(array() AS array<string>)")
    flags = F.when(F.col("drop_reason").isNull() | F.col("drop_reason").contains("closed_location_list"), all_hits(F.col("hay"), rules.flags, F.col("low"))).otherwise(none)
    return rows.withColumn("flags", flags).select("row.*", "drop_reason", "flags")


def drop_param(reason: Column) -> Column:
    """The name of the filter in a reason."""
    named = F.regexp_extract(reason, r"auto-drop:\s*([a-z0-9_]+)", 1)
    return F.when(reason.isNotNull(), F.when(named != "", named).otherwise(F.trim(F.split(reason, ":", 2)[0])))


#: The filters that look at flags, in their order.
ELIGIBILITY = (("work_arrangement", "work_arrangement_mismatch"), ("employment_mismatch", "employment_off_target"), ("language_mismatch", "non_target_language"))


def eligibility_drop(flags: Column, modes: dict[str, str]) -> Column:
    """After annotation: work arrangement, then employment, then language, each only in the mode `drop`."""
    return F.coalesce(F.lit(None).cast("string"), *(F.when(F.array_contains(flags, flag), F.lit(mode)) for mode, flag in ELIGIBILITY if modes.get(mode) == "drop"))


def liveness_drop(verdict: Column, body: Column, tripwire: Column) -> Column:
    return F.when(tripwire, None).when(verdict == "stale", "stale").when((verdict == "unverifiable_direct") & (text(body) == ""), "unverified_blocked")


def read_cap(df: DataFrame, order: list[Column], cap: int, body: str = "jd_text", tripwire: Column | None = None, wanted: Column | None = None) -> DataFrame:
    """df with jd_status: from_enumeration for long bodies, card_only for tripwire rows, to_read for the first `cap` of the rest
    in order, deferred beyond. The cap is the feature: reads are dear. The first `cap` are found by a top-k, within partitions
    first; all other rows are compared with the last of them. Of rows that tie with the last one, all are read: an order
    that tells rows apart makes the cap exact. Rows that are not wanted, if that is given, have no status and take no place."""
    kind = F.when(F.length(text(F.col(body))) > 400, "from_enumeration")
    if tripwire is not None:
        kind = kind.when(tripwire, "card_only")
    asks = kind.isNull() if wanted is None else kind.isNull() & wanted
    wanting = df.where(asks).select(F.struct(*order).alias("_o"))
    last = wanting.orderBy("_o").limit(max(cap, 0)).agg(F.max("_o").alias("_last"))  # one row
    status = F.coalesce(kind, F.when(F.struct(*order) <= F.col("_last"), "to_read").otherwise("deferred"))
    return df.crossJoin(F.broadcast(last)).withColumn("jd_status", status if wanted is None else F.when(wanted, status)).drop("_last")


def half_rotation(df: DataFrame, order: list[Column]) -> DataFrame:
    """AM for the first half of a small dimension table (sources), PM for the rest."""
    return df.withColumn("half", F.when(F.ntile(2).over(Window.orderBy(*order)) == 1, "AM").otherwise("PM"))
