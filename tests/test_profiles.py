"""Profiles: which filters they ask for, what is wrong with a configuration, and the whole triage under one."""

import copy
import re

import pytest
from pyspark.sql import functions as F

from siftworks.functions import text
from siftworks.operators import filters, funnel, health, history, sync
from siftworks.plans import config
from siftworks.plans.triage import run_record, shortlist, triage
from siftworks.sources import payloads

def now():
    return F.lit("2026-07-02").cast("timestamp")


def rules(**more):
    return config.Profile(keywords=("a",), **more).rules()


def test_filters_follow_the_profile():
    assert set(rules().auto_drop) == {"us_only", "clearance", "travel", "grind_culture"} and set(rules().flags) == {"eu_citizenship", "latam_payroll"}
    assert "us_only" not in rules(country="USA").auto_drop and "us_only" in rules(country="Poland").auto_drop
    assert set(rules(modes={"travel": "any", "clearance": "allow", "grind_culture": "allow"}).auto_drop) == {"us_only"}
    assert set(rules(modes={"travel": "occasional_ok"}).auto_drop) == {"us_only", "clearance", "grind_culture"}
    assert "timezone" in rules(latest_end_local="18:00").flags and "eu_citizenship" not in rules(citizenship=("MK", "DE")).flags
    assert "latam_payroll" not in rules(country="Brazil").flags and not rules(modes={"closed_location_list": "off"}).closed_list
    assert set(rules(hard_drop_terms=("Sports Betting",)).title_drop) == {"harddrop_sports_betting"} and "excl_sports_betting" in rules(hard_drop_terms=("Sports Betting",)).flags


@pytest.mark.parametrize("said, want", [("Salesforce administrator wanted", True), ("we use salesforce daily", False), ("deep SAP S/4 know-how", True), ("SAP consultant", True), ("sap certified", True), ("some sap", False)])
def test_a_tool_alone_is_no_lockin(said, want):
    pattern = rules(tool_lockin=("Salesforce", "SAP S/4")).flags["tool_lockin"]
    assert bool(re.search(pattern, said)) is want


@pytest.mark.parametrize("body, want", [
    ("see https://boards.greenhouse.io/acme/jobs/1).", "https://boards.greenhouse.io/acme/jobs/1"), ("<a href='https://job-boards.eu.greenhouse.io/a/1'>", "https://job-boards.eu.greenhouse.io/a/1"),
    ('"https://jobs.lever.co/x/y"', "https://jobs.lever.co/x/y"), ("https://apply.workable.com/a/j/1/, or", "https://apply.workable.com/a/j/1/"), ("https://acme-co.pinpointhq.com/jobs/1", "https://acme-co.pinpointhq.com/jobs/1"),
    ("https://jobs.ashbyhq.com/a/b", "https://jobs.ashbyhq.com/a/b"), ("https://www.greenhouse.io/about", None), ("https://acme.teamtailor.com/jobs/1", None), ("https://careers.smartrecruiters.com/a", None), ("http://x.boards.greenhouse.io/a", None), ("", None),
])
def test_source_url(spark, body, want):
    assert spark.createDataFrame([(body,)], "a string").select(text.resolve_source_url(F.col("a")).alias("r")).first().r == want


GOOD = {
    "schema_version": 1, "id": "me", "dry_run": True, "candidate": {"display_name": "N", "location": {"city": "Skopje", "country": "North Macedonia", "timezone": "Europe/Skopje"}, "location_match_terms": ["macedonia"], "citizenship": ["MK"],
    "eligibility": {"employment_models": ["full_time"], "needs_visa_sponsorship": False}}, "search": {"stream": "pm", "work_model": ["remote"], "keywords": {"core": ["project manager"], "expanded": ["scrum"]}, "archetypes": ["x"],
    "employment_type": {"accept": ["full_time"]}, "target_seniority": {"bands": ["senior"], "strict": False}, "languages": ["en", "de"]}, "compensation": {"floor": {"amount": 2500, "currency": "EUR", "basis": "net", "period": "month"}, "gross_net_ratio": 0.83},
    "hard_filters": {"travel": "any", "employment_mismatch": "drop", "timezone_window": {"latest_end_local": "18:30"}, "tool_lockin_drop": ["SAP"], "role_exclusion_terms": ["crypto"]}, "scoring": {"surface_threshold": 6.5},
    "platforms": {"tiers": {1: ["a"], 2: ["b"]}, "disabled": ["c"]}, "run": {"effort": "fast"}, "writeback": {"consent": True},
}
PLATFORMS = [config.Platform(n, ("pm",), active=n != "d") for n in "abcd"]


def test_a_good_configuration_becomes_a_profile():
    assert config.config_errors(GOOD, "me", PLATFORMS) == []
    p = config.Profile.of(GOOD)
    assert p.keywords == ("project manager", "scrum") and p.floor.canonical() == 3012.05 and p.surface_threshold == 6.5 and p.country == "North Macedonia"
    assert "travel" not in p.rules().auto_drop and {"timezone", "tool_lockin", "excl_crypto"} <= set(p.rules().flags)


@pytest.mark.parametrize("path, value, said", [
    ("schema_version", 2, "schema_version"), ("id", "you", "id"), ("other", 1, "unknown key other"), ("candidate.display_name", "", "display_name"), ("candidate.location.timezone", None, "timezone"), ("candidate.citizenship", [], "citizenship"),
    ("candidate.eligibility.employment_models", ["slave"], "employment_models"), ("candidate.eligibility.needs_visa_sponsorship", "no", "needs_visa"), ("search.work_model", ["moon"], "work_model"), ("search.keywords.core", [], "core"), ("search.keywords.expanded", None, "expanded"),
    ("search.target_seniority.bands", ["medior"], "bands"), ("search.target_seniority.x", 1, "unknown key x"), ("search.employment_type.accept", ["any", "b2b"], "any stands alone"), ("search.employment_type", None, "needs search.employment_type"), ("search.languages", ["xx"], "languages"),
    ("compensation.floor.amount", 0, "amount"), ("compensation.floor.currency", "XXX", "currency"), ("compensation.gross_net_ratio", None, "gross_net_ratio"), ("compensation.fte_fraction", 0, "fte_fraction"), ("run.effort", "slow", "effort"), ("run.effort_by_run_type", {"am": "x"}, "effort_by_run_type"),
    ("writeback.consent", "yes", "consent"), ("hard_filters.travel", "some", "travel"), ("hard_filters.language_mismatch", "off", "language_mismatch"), ("hard_filters.timezone_window.latest_end_local", "6pm", "HH:MM"), ("scoring.surface_threshold", 11, "surface_threshold"),
    ("platforms.tiers", {4: ["a"], 1: ["b"]}, "not 1, 2 or 3"), ("platforms.disabled", ["z", "c"], "z is not in the catalog"), ("platforms.tiers", {1: ["a"]}, "b: no tier"), ("platforms.tiers", {1: ["a", "b"], 2: ["a"]}, "several tiers"), ("dry_run", False, "data_source_id"),
])
def test_each_problem_is_told(path, value, said):
    bad = copy.deepcopy(GOOD)
    *up, last = path.split(".")
    at = bad
    for part in up:
        at = at[part]
    at[last] = value
    found = config.config_errors(bad, "me", PLATFORMS)
    assert any(said in e for e in found), found


def test_catalog_yaml_and_crossing(tmp_path):
    assert config.catalog_errors([{"slug": "a", "active": True, "tier_default": 1}]) == []
    found = config.catalog_errors([{"slug": "a", "active": True}, {"slug": "a", "status": "new"}, {}, {"slug": "b", "status": "unverified", "active": True, "tier_default": 2}])
    assert found == ["platform 3: no name", "a: named twice", "a: active without a tier", "a: status new", "b: active and not verified"]
    assert config.keyword_places(["x", "y"], ["p", "q"]) == [("x", "p"), ("x", "q"), ("y", "p"), ("y", "q")] and config.keyword_places(["x"], []) == [("x", "")]
    pytest.importorskip("yaml")
    good, bad = tmp_path / "a.yaml", tmp_path / "b.yaml"
    good.write_text("a: {b: 1}")
    bad.write_text("- a")
    assert config.read_yaml(str(good)) == {"a": {"b": 1}}
    for path in (str(bad), str(tmp_path / "none.yaml")):
        with pytest.raises(config.ConfigError):
            config.read_yaml(path)


def test_the_whole_triage(spark):
    long = "We look for a project manager. " * 20
    rows = [
        (1, "Project Manager", "A Ltd", "https://x/1", "short", "p"), (2, "Project Manager", "A Ltd", "https://x/2", long, "p"), (3, "Project Manager", "B", "https://x/3", "", "p"), (4, "Project Manager", "", "https://x/4", "card", "tripwire"),
        (5, "Project Manager", "C", "https://x/5", "You need a security clearance", "p"), (6, "Project Manager", "D", "https://x/6", "", "p"), (7, "Cook", "D", "https://x/7", "", "p"), (8, "Project Manager, x", "A Ltd", "https://x/8", "", "p"),
    ]
    df = spark.createDataFrame(rows, "doc_id int, title string, company string, url string, jd_text string, platform string").withColumns({"loc": F.lit("Berlin"), "posted_at": F.lit(None).cast("string"), "salary": F.lit("")})
    seen = spark.createDataFrame([(i, f"o/{i}", f"k{i}", "a", "project manager", "applied" if i < 3 else "passed") for i in range(10)] + [(20, "x/8", "k", "b", "f", "passed")], "seq long, url_key string, key string, company_key string, family string, status string")
    reads = spark.createDataFrame([("https://x/1", "body", "<a href=\"https://jobs.lever.co/a/1\">"), ("https://x/6", "late", "")], "url string, body string, html string")
    verdicts = spark.createDataFrame([("https://jobs.lever.co/a/1", "live"), ("https://x/2", "stale"), ("https://x/4", "stale")], "url string, verdict string")
    profile = config.Profile(keywords=("project",), read_cap=2, exempt_platform="tripwire")
    got = {r.doc_id: r for r in triage(df, seen, profile, now(), reads, verdicts).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert (got[1].jd_status, got[1].jd_text, got[1].source_url, got[1].link_status, got[1].drop_reason) == ("fetched", "body", "https://jobs.lever.co/a/1", "live", None)
    assert [p.status for p in got[1].prior] == ["applied"] * 3 + ["passed"] * 5 and got[1].applied_variants == 3 and "applied_variant_saturation" in got[1].flags
    assert got[2].drop_reason == "stale" and got[2].jd_status == "from_enumeration"
    assert got[3].jd_status == "fetch_failed" and got[3].drop_reason == "unverified_blocked" and not got[3].applied_variants
    assert (got[4].jd_status, got[4].link_status, got[4].drop_reason) == ("card_only", "tripwire card", None) and "missing_company" in got[4].flags
    assert got[5].drop_reason == "auto-drop: clearance" and got[5].jd_status is None
    assert got[6].jd_status == "deferred" and got[6].drop_reason == "unverified_blocked"
    platforms = spark.createDataFrame([("p", 7, False, True), ("q", 0, True, False)], "platform string, raw long, source_down boolean, http_ok boolean")
    r = run_record(triage(df, seen, profile, now(), reads, verdicts), platforms).first()
    assert (r.funnel_in, r.new, r.link_dead) == (6, 2, 3) and {(x.param, x.n) for x in r.drop_by_param} == {("stale", 1), ("unverified_blocked", 2), ("clearance", 1)}
    assert (r.platforms_covered, r.sources_down, r.drop_nudges) == (["p"], ["q"], [])


def test_without_history_reads_or_checks(spark):
    df = spark.createDataFrame([(1, "Project lead", "A", "https://x/1", None, "p", None, None, None)], "doc_id int, title string, company string, url string, jd_text string, platform string, loc string, posted_at string, salary string")
    got = triage(df, None, config.Profile(keywords=("project",)), now()).first()
    assert (got.drop_reason, got.jd_status, got.source_url) == (None, "deferred", None)


def test_ledger_counters_and_small_operators(spark):
    ledger = spark.createDataFrame([("2026-07-01", "AM", 1, "2026-07-01T08:00:00+00:00"), ("2026-07-01", "PM", 2, "garbage")], "day string, label string, new int, ran_at string")
    run = spark.createDataFrame([("2026-07-01", "PM", 9, "2026-07-01T15:00:00+00:00")], "day string, label string, new int, ran_at string")
    assert sorted((r.label, r.new) for r in history.upsert_runs(ledger, run).collect()) == [("AM", 1), ("PM", 9)]
    assert str(history.last_ran_at(history.upsert_runs(ledger, run)).first().ran_at) == "2026-07-01 15:00:00" and str(history.last_ran_at(ledger).first().ran_at) == "2026-07-01 08:00:00"
    counters = spark.createDataFrame([("recompute", "2026-06-01", 4, 5)], "name string, last string, sessions_since long, due_at_sessions long")
    assert sorted(map(tuple, history.bump_counters(counters, {"recompute": 9, "health_review": 6}, now()).collect())) == [("health_review", "2026-07-02", 1, 6), ("recompute", "2026-06-01", 5, 5)]
    new = history.new_records(spark.createDataFrame([("A Ltd", "PM", "x", None)], "company string, role string, locdom string, fit string"), now()).first()
    assert (new.fit, new.archetype, new.keyword_source, new.key, new.first_seen, new.synced_to_notion) == ("N/A", "", "PM", "a|pm|x", "2026-07-02", False)
    scored = spark.createDataFrame([("u1", 7.0), ("u2", 6.9), ("u3", 9.0), ("u4", None)], "url string, score double")
    assert [r.url for r in shortlist(scored, config.Profile(keywords=("a",))).collect()] == ["u3", "u1"]
    have = spark.createDataFrame([("Status", "New")], "name string, option string")
    wanted = spark.createDataFrame([("Status", "New"), ("Status", "Old"), ("Kind", "New"), ("Status", "Old")], "name string, option string")
    assert [tuple(r) for r in sync.option_gaps(have, wanted).collect()] == [("Kind", "New"), ("Status", "Old")]
    found = spark.createDataFrame([("a", "DOWN_STREAK"), ("b", "DOWN_STREAK"), ("*", "SYSTEMIC")], "platform string, flag string")
    assert [tuple(r) for r in health.finding_counts(found).collect()] == [("SYSTEMIC", 1), ("DOWN_STREAK", 2)]
    sources = spark.createDataFrame([("a", 3, 2), ("b", 3, 0), ("c", 0, 0)], "source string, fetches int, answered int")
    got = {r.source: tuple(r[3:]) for r in funnel.source_stats(spark.createDataFrame([("a",), ("a",)], "source string"), sources).collect()}
    assert got == {"a": (2, True, False), "b": (0, False, True), "c": (0, False, False)}
    states = spark.createDataFrame([('{"n": 3}',), ("{oops",), (None,)], "s string").select(payloads.read_state(F.col("s"), "n int").alias("r")).collect()
    assert [r.r.n for r in states] == [3, None, None]


def test_pages_until_a_stop(spark):
    page = lambda cursor, n: '{"data": [], "meta": {"next": {"cursor": %s, "itemsCount": %s}}}' % (cursor, n)
    rows = [("a", 0, page('"x"', 20)), ("a", 1, page('"y"', 0)), ("a", 2, page('"z"', 20)), ("b", 0, page("null", 20)), ("b", 1, "{}"), ("c", 0, page('"x"', 5)), ("c", 1, page('"x"', 5)), ("c", 2, page('"x"', 5))]
    df = spark.createDataFrame(rows, "platform string, page int, payload string")
    assert sorted((r.platform, r.page) for r in payloads.pages_by_cursor(df, most=2).collect()) == [("a", 0), ("a", 1), ("b", 0), ("c", 0), ("c", 1)]
    listed = [("s", p, u) for p, urls in enumerate((["a", "b"], ["b", "c"], ["c", "a"], ["d"])) for u in urls] + [("t", 0, "x"), ("t", 2, "y")]
    pages = spark.createDataFrame(listed, "source string, page int, url string")
    assert sorted({(r.source, r.page) for r in payloads.pages_until_dry(pages, "source", "page", "url").collect()}) == [("s", 0), ("s", 1), ("t", 0)]
    assert {r.page for r in payloads.pages_until_dry(pages, "source", "page", "url", most=1).collect()} == {0}


def test_pay_in_words_lexicons_exports_and_migrations(spark, tmp_path):
    from siftworks.functions import salary
    from siftworks.operators import state

    floor = salary.Floor(2500, "EUR", "month", "net", 0.83)
    said = ["pays 5000 EUR per month", "3000 EUR gross a month", "up to 500 EUR per month", "4000 EUR", "nothing"]
    df = spark.createDataFrame([(x,) for x in said], "a string").select(salary.parse(F.col("a")).alias("p"))
    got = [tuple(r.r) for r in df.select(salary.explained(F.col("p"), floor).alias("r")).collect()]
    assert got[0] == ("clears", "range max ≈ 5,000 EUR gross/month vs floor 3,012 (parsed 5,000 EUR gross/month)")
    assert got[1][0] == "borderline" and got[1][1].endswith(" — borderline, verify") and got[2][0] == "below_floor" and got[2][1].endswith(" — verify before dropping")
    assert "[period inferred]" in got[3][1] and got[4] == ("unparseable", "no parseable salary; apply estimation heuristics")
    assert config.seniority_lexicon({"Lead": "lead", "sr": "senior"}, {"SR": "staff"}) == {"lead": "lead", "sr": "staff"}
    with pytest.raises(config.ConfigError):
        config.seniority_lexicon({"x": "chief"})
    acted = spark.createDataFrame([("u1", "create"), ("u2", "skip_resolved"), ("u3", "refresh")], "url string, action string")
    for _ in range(2):
        sync.export_pending(acted, str(tmp_path / "pending"))
    assert sorted(r.url for r in spark.read.json(str(tmp_path / "pending")).collect()) == ["u1", "u3"]
    old, new = (spark.createDataFrame(x, "k string, v int") for x in ([("a", 1), ("b", 2), ("c", None)], [("a", 1), ("b", 3), ("c", None), ("d", None)]))
    assert sorted(r.k for r in state.overwritten(old, new, ["k"], ["v"]).collect()) == ["b", "d"]


def test_gates_lose_no_match(spark):
    """Each pattern with its plain search before it finds what it finds without."""
    said = ["US only", "us-only team", "must reside in the United States", "authorized to work in the U.S.", "EVerify", "W2", "busonly", "TS/SCI", "public trust", "travel as needed", "25% travel", "996", "60 hours/week", "60+ hourweek",
            "work hard, play hard", "work hard play hard", "EU passport", "EU work permit required", "Latin America based payroll", "LATAM contract", "hu\u017ftle culture", "\u212aelvin", "United \u017ftates only", "securıty clearance", "TRAVEL REQUİRED"]
    df = spark.createDataFrame([(s,) for s in said], "hay string").withColumn("low", filters.folded(F.col("hay")))
    every = filters.AUTO_DROP | filters.FLAGS
    with_gate = df.select(filters.all_hits(F.col("hay"), every, F.col("low")).alias("x")).collect()
    without = df.select(filters.all_hits(F.col("hay"), every).alias("x")).collect()
    assert with_gate == without and {n for r in without for n in r.x} >= set(filters.GATES)


def test_the_read_cap_is_the_configurations():
    assert config.Profile.of(GOOD).read_cap == 60
    assert config.Profile.of(GOOD | {"caps": {"max_full_reads_per_run": 0}}).read_cap == 0
    assert config.Profile.of(GOOD | {"caps": {"max_full_reads_per_run": 15}}).read_cap == 15
