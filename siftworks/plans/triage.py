"""The whole triage as one lazy frame: every candidate once, with the reason why it goes or what is to know if it stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import detect, detectors, salary
from ..functions.text import make_key, norm_company, norm_url, resolve_source_url, role_family, text
from ..operators import filters
from ..operators.funnel import OVER
from ..operators.history import company_history, run_drops, two_tier_new
from .config import Profile


def triage(cands: DataFrame, seen: DataFrame | None, profile: Profile, now: Column, reads: DataFrame | None = None, verdicts: DataFrame | None = None, read_order: list[Column] | None = None) -> DataFrame:
    """cands with url_key, company_key, key, keyword_matched, jd_status, drop_reason, flags, the history and the annotations.

    The cheap filters come first: title, freshness and history narrow what the patterns over whole bodies see. seen: the log's
    current records (url_key, key, company_key; for the history also family, status, seq, and with place, role, locdom and reason,
    as ordered_records gives them, what is noted of a company is in the log's order and with what this run drops). reads: bodies fetched in full (url,
    body, html), of which only those within the cap count. verdicts: what link checks found (url, verdict); a row without one
    can't be verified. Without reads or verdicts that step is left out."""
    profile.check()
    rows = cands.withColumn("keyword_matched", filters.keyword_match(F.col("title"), list(profile.keywords))).where("keyword_matched IS NOT NULL")
    if not profile.full_sweep:
        rows = rows.where(filters.fresh(F.col("posted_at"), now - F.make_interval(hours=F.lit(profile.freshness_hours))))
    rows = rows.withColumn("url_key", norm_url(F.col("url"))).withColumn("company_key", norm_company(F.col("company"))).withColumn("key", make_key(F.col("company"), F.col("title"), F.col("loc")))
    if seen is not None:
        rows = two_tier_new(rows, seen)
    rows = filters.hard_filter(rows, profile.rules())
    tripwire = F.lit(False) if profile.exempt_platform is None else F.coalesce(F.col("platform") == profile.exempt_platform, F.lit(False))
    rows = read_bodies(rows, reads, profile.read_cap, tripwire, read_order or [F.col("platform"), F.col("url")])
    if verdicts is not None:
        rows = check_links(rows, verdicts, tripwire)
    if seen is not None and {"family", "status", "seq"} <= set(seen.columns):
        payload = tuple(c for c in ("role", "locdom", "status", "reason") if c in seen.columns)
        order = "place" if "place" in seen.columns else "seq"
        drops = run_drops(rows, seq=seen.schema["seq"].dataType.simpleString()) if order == "place" else None
        rows = company_history(rows.withColumn("family", role_family(F.col("title"))), seen, order=order, payload=payload, also=drops)
    return annotate(rows, profile, now)


def read_bodies(rows: DataFrame, reads: DataFrame | None, cap: int, tripwire: Column, order: list[Column]) -> DataFrame:
    """jd_status: from_enumeration, card_only, fetched, fetch_failed or deferred; rows that are dropped have none. A fetched body
    replaces a short one, and an address of a tracking system in its page is the posting's source unless it is the posting's own."""
    gone = F.col("drop_reason").isNotNull()
    if reads is None:
        status = F.when(gone, None).when(F.length(text(F.col("jd_text"))) > 400, "from_enumeration").when(tripwire, "card_only").otherwise("deferred")
        return rows.withColumn("jd_status", status).withColumn("source_url", F.when(~gone, resolve_source_url(F.col("jd_text"))))
    rows = filters.read_cap(rows, order, cap, "jd_text", tripwire, wanted=~gone)
    pages = reads.groupBy(F.col("url").alias("_url")).agg(F.min(F.struct("body", "html")).alias("_p"))
    rows = rows.join(pages, (F.col("url") == F.col("_url")) & (F.col("jd_status") == "to_read"), "left")
    asked, got = F.coalesce(F.col("jd_status") == "to_read", F.lit(False)), text(F.col("_p.body")) != ""
    source = resolve_source_url(F.col("_p.html"))
    return rows.select(
        *(c for c in rows.columns if c not in ("_url", "_p", "jd_text", "jd_status", "source_url")),
        F.when(asked & got, F.col("_p.body")).otherwise(F.col("jd_text")).alias("jd_text"),
        F.when(asked, F.when(got, "fetched").otherwise("fetch_failed")).otherwise(F.col("jd_status")).alias("jd_status"),
        F.when(asked & got & (norm_url(source) != norm_url(F.col("url"))), source).alias("source_url"),
    )


def check_links(rows: DataFrame, verdicts: DataFrame, tripwire: Column) -> DataFrame:
    """link_status, and the drop of postings that are gone or that can be neither read nor verified. The source's address decides
    where there is one."""
    checked = verdicts.groupBy(F.col("url").alias("_checked")).agg(F.min("verdict").alias("_verdict"))
    rows = rows.join(checked, F.coalesce("source_url", "url") == F.col("_checked"), "left")
    verdict = F.coalesce("_verdict", F.lit("unverifiable_direct"))
    dead = F.when(F.col("drop_reason").isNull(), filters.liveness_drop(verdict, F.col("jd_text"), tripwire))
    status = F.when(tripwire, "tripwire card").when(verdict == "live", "live").otherwise("unverified")
    rows = rows.withColumn("_dead", dead).withColumn("link_status", F.when(F.col("drop_reason").isNull() & F.col("_dead").isNull(), status))
    return rows.withColumn("drop_reason", F.coalesce("drop_reason", "_dead")).drop("_dead", "_verdict", "_checked")


def annotate(rows: DataFrame, profile: Profile, now: Column) -> DataFrame:
    """Notes and flags for the rows that stay; rows that were dropped cost nothing here and have none."""
    title, place, body = F.col("title"), F.col("loc"), F.col("jd_text")
    stays = F.col("drop_reason").isNull()
    both = F.concat_ws(" ", title, body)
    accept = [] if "any" in profile.employment else list(profile.employment)
    note = {
        "seniority_detected": detect.detect_seniority(title),
        "employment_detected": detect.detect_employment(both),
        "work_arrangement_detected": detect.detect_work_arrangement(place, body),
        "salary_parsed": salary.parse(F.concat_ws(" ", "salary", "jd_text")),
        "language_detected": detect.language_of(title, body, list(profile.languages)),
        "language_requirement": detect.stated_language_requirement(body, list(profile.languages)),
        "start_date_note": detect.start_date_passed(body, now),
    }
    note |= {f"note_{name}": detectors.build(name, title=title, place=place, body=body, pay=F.col("salary")) for name in profile.detectors}
    # Three selects in all: what is detected, what it means for this profile, what drops for it.
    found = rows.select(*(c for c in rows.columns if c not in note), *(F.when(stays, v).alias(k) for k, v in note.items()))
    off_place = F.lit(bool(profile.work_model)) & (F.size("work_arrangement_detected") > 0) & ~F.arrays_overlap("work_arrangement_detected", F.split(F.lit(" ".join(profile.work_model)), " "))
    more = [
        F.when(detect.missing_company(F.col("company")), F.lit("missing_company")),
        F.when(F.col("language_detected").isNotNull() & ~F.col("language_detected").isin(list(profile.languages)), F.lit("non_target_language")),
        F.when(F.col("language_requirement").isNotNull(), F.lit("stated_language_requirement")),
        F.when(F.col("start_date_note").isNotNull(), F.lit("start_date_passed")),
    ]
    if profile.bands:
        more.append(F.when(detect.seniority_off_target(F.col("seniority_detected"), list(profile.bands)), F.lit("seniority_off_target")))
    if accept:
        more.append(F.when(detect.employment_off_target(F.col("employment_detected"), accept), F.lit("employment_off_target")))
    if profile.modes.get("work_arrangement", "off") != "off":
        more.append(F.when(off_place, F.lit("work_arrangement_mismatch")))
    if "saturated" in rows.columns:
        more.append(F.when(F.col("saturated"), F.lit("applied_variant_saturation")))
    more += [F.when(detectors.flagged(F.col(f"note_{name}")), F.lit(name)) for name in profile.detectors if detectors.REGISTRY[name].flags]
    flags = F.array_sort(F.array_distinct(F.array_compact(F.concat("flags", F.array(*more)))))
    judged = found.select(*(c for c in found.columns if c not in ("flags", "salary_status")), F.when(stays, flags).otherwise(F.col("flags")).alias("flags"), F.when(stays, salary.assess(F.col("salary_parsed"), profile.floor)).alias("salary_status"))
    if not any(profile.modes.get(mode) == "drop" for mode, _ in filters.ELIGIBILITY):
        return judged
    # As in hard_filter, so that no condition on the reason makes all flags and notes again.
    reason = F.coalesce("drop_reason", filters.eligibility_drop(F.col("flags"), profile.modes))
    return judged.select(*(c for c in judged.columns if c != "drop_reason"), F.explode(F.array(reason)).alias("drop_reason"))


def run_record(rows: DataFrame, platforms: DataFrame, healed: DataFrame | None = None) -> DataFrame:
    """What a run leaves in the ledger, one row: the funnel, drops by filter, filters that took too much, and the platforms.
    platforms: a row for each that was asked (platform, raw, source_down, http_ok), a few dozen."""
    from ..operators.funnel import drop_by_param, funnel, over_constraint

    drops = drop_by_param(rows).agg(F.array_sort(F.collect_list(F.struct("param", "n"))).alias("drop_by_param"))
    nudges = over_constraint(rows).agg(F.array_sort(F.collect_list("param")).alias("drop_nudges"))
    stats = platforms.agg(
        F.array_sort(F.collect_list(F.when(~F.col("source_down"), F.col("platform")))).alias("platforms_covered"),
        F.array_sort(F.collect_list(F.when(F.col("source_down"), F.col("platform")))).alias("sources_down"),
        F.array_sort(F.collect_list(F.struct("platform", "raw", "source_down", "http_ok"))).alias("platform_stats"),
    )
    out = funnel(rows)
    for one in (drops, nudges, stats):  # single rows
        out = out.crossJoin(F.broadcast(one))
    return out


class RunCounters:
    """The same record, counted while the candidates are written, so that the triage runs once and not once for each count.
    asked: (platform, fetches, answered) of each platform that was asked, a few dozen. Every filter that the profile can have is
    counted by name, any other under `other`. `watch` has to be the last step before the write: a step between them that is done
    again after a lost executor would be counted again, while the tasks that write count once."""

    def __init__(self, profile: Profile, asked: list[tuple[str, int, int]]):
        rules = profile.rules()
        self.asked = asked
        self.params = list(dict.fromkeys([*rules.title_drop, *rules.auto_drop, "closed_location_list", "stale", "unverified_blocked", *profile.modes]))
        self.seen = Observation()

    def watch(self, rows: DataFrame) -> DataFrame:
        reason, param, platform = F.col("drop_reason"), F.col("_param"), F.col("platform")
        count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
        metrics = {"funnel_in": F.count(F.lit(1)), "new": count(reason.isNull()), "dropped": count(reason.isNotNull()), "link_dead": count(reason.isin("stale", "unverified_blocked"))}
        metrics |= {f"param {i}": count(param == name) for i, name in enumerate(self.params)} | {"other": count(~param.isin(self.params))}
        metrics |= {f"platform {i}": count(platform == name) for i, (name, _, _) in enumerate(self.asked)}
        return rows.withColumn("_param", filters.drop_param(reason)).observe(self.seen, *(c.alias(k) for k, c in metrics.items())).drop("_param")

    def record(self) -> dict:
        """After the write; it waits for it."""
        got = self.seen.get
        drops = {name: got[f"param {i}"] for i, name in enumerate(self.params)} | {"other": got["other"]}
        drops = {k: n for k, n in sorted(drops.items()) if n}
        stats = [{"platform": p, "raw": got[f"platform {i}"], "source_down": got[f"platform {i}"] == 0 and fetches > 0, "http_ok": answered > 0} for i, (p, fetches, answered) in enumerate(self.asked)]
        stats.sort(key=lambda s: s["platform"])
        return {
            **{k: got[k] for k in ("funnel_in", "new", "dropped", "link_dead")},
            "drop_by_param": [{"param": k, "n": n} for k, n in drops.items()],
            "drop_nudges": [k for k, n in drops.items() if n >= OVER * got["funnel_in"]],
            "platforms_covered": [s["platform"] for s in stats if not s["source_down"]],
            "sources_down": [s["platform"] for s in stats if s["source_down"]],
            "platform_stats": stats,
        }


def shortlist(scored: DataFrame, profile: Profile, score: str = "score") -> DataFrame:
    """Rows at or above the threshold, the best first; a row without a score isn't one."""
    return scored.where(F.col(score) >= profile.surface_threshold).orderBy(F.desc(score), "url")


def explain_plan(df: DataFrame) -> str:
    """The formatted physical plan as text."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
