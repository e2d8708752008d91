"""Operators on small rows with known results."""

import json

import pytest
from pyspark.sql import functions as F

from siftworks.functions import detect, salary, text
from siftworks.operators import filters, health, history, state
from siftworks.plans import config
from siftworks.plans.triage import explain_plan, triage
from siftworks.sources import payloads


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("fn, given, want", [
    (text.norm_url, "https://www.Example.com/Job", "example.com/job"), (text.norm_url, "https://x.com/job/?utm=x", "x.com/job"), (text.norm_url, None, ""),
    (text.norm_company, "Foo Group Ltd", "foo"), (text.norm_company, "Acme, Inc.", "acme"), (text.norm_company, "Acme Sp. z o.o. Sp. k.", "acme"), (text.norm_company, "Group", ""), (text.norm_company, "Tesco", "tesco"),
    (text.role_family, "Delivery Manager - Belgrade", "delivery manager"), (text.role_family, "Project Manager, Senior", "project manager"),
    (text.slug_title, "https://a.b/c/blurb-role-xyz789", "blurb role xyz789"), (text.tidy, " a  b\n", "a b"), (text.host, "https://A.b/c", "a.b"),
    (detect.detect_seniority, "Tech Lead", "lead"), (detect.detect_seniority, "Gardener", None), (detect.title_language, "Größe", "de"), (detect.title_language, "plain", None),
    (salary.num, "3.500", 3500.0), (salary.num, "3.5", 3.5), (salary.num, "65k", 65000.0), (salary.num, "12 000", None),
])
def test_scalar(spark, fn, given, want):
    assert one(spark, fn(F.col("a")), a=given) == want


def test_long_titles_give_way_to_the_address(spark):
    assert one(spark, text.pick_title(F.col("a"), F.lit("https://x.y/blurb-role-xyz789")), a="x" * 200) == "blurb role xyz789"
    r = one(spark, text.caption_title_company(F.col("a"), F.lit("https://x.y/z")), a="ClickGUARD Inc. - GTM Engineer - Demand Generation (remote job)")
    assert (r.title, r.company) == ("GTM Engineer - Demand Generation", "ClickGUARD Inc.")


def test_match_windows_equal_slices(spark):
    t = "ab 12 cd 345\n6 ef 7"
    got = one(spark, text.match_windows(F.col("a"), r"\d+", 4, 3), a=t)
    import re

    assert [(m.match, m.start, m.window) for m in got] == [(m[0], m.start(), t[max(0, m.start() - 4) : m.end() + 3]) for m in re.finditer(r"\d+", t)]


@pytest.mark.parametrize("body, want", [("The candidate needs Polish C1 and English B2.", ("proficiency", "polish")), ("Polish is a nice to have.", None), ("CV in German please", ("apply_in", "german")), ("Fluent English required", None), (None, None)])
def test_stated_language(spark, body, want):
    r = one(spark, detect.stated_language_requirement(F.col("a"), ["en"]), a=body)
    assert (r and (r.kind, r.language)) == want


def test_detectors(spark):
    assert one(spark, detect.detect_employment(F.col("a")), a="Full-time B2B contract role") == ["full_time", "contract", "b2b"]
    assert one(spark, detect.detect_work_arrangement(F.col("a"), F.col("b")), a="Kraków (hybrid)", b="we are fully remote") == ["hybrid"]
    assert one(spark, detect.start_date_passed(F.col("a"), F.lit("2026-07-01").cast("date")), a="Project start: 06.2025") == "2025-06"
    assert one(spark, detect.start_date_passed(F.col("a"), F.lit("2026-07-01").cast("date")), a="Project start: 09.2026") is None
    assert one(spark, detect.detect_language(F.col("a")), a="the and for with you are our will this that " * 6) == "en"
    assert one(spark, detect.detect_language(F.col("a")), a="się jest oraz dla lub jako że praca zespół nasz " * 6) == "pl"
    assert one(spark, detect.detect_language(F.col("a")), a="the and") is None


@pytest.mark.parametrize("said, status", [("12 000 - 18 000 PLN net/month B2B", "clears"), ("12 000 zł / month", "unparseable"), ("3000 EUR gross per month", "borderline"), (None, "unparseable"), ("1000 EUR a month", "below_floor")])
def test_salary(spark, said, status):
    floor = salary.Floor(2500, "EUR", "month", "net", 0.83)
    assert floor.canonical() == 3012.05
    got = spark.createDataFrame([(said,)], "a string").select(salary.parse(F.col("a")).alias("p")).select("p", salary.assess(F.col("p"), floor).alias("s")).first()
    if said and said.startswith("12 000 -"):
        assert (got.p.amount_max, got.p.currency, got.p.basis, got.p.period) == (18000.0, "PLN", "net", None)  # "net" stands before the period
    assert got.s == status


@pytest.mark.parametrize("posted, fresh", [(None, True), ("2026-07-21T08:00:00+02:00", True), ("Tue, 21 Jul 2026 08:08:04 +0000", True), ("soon", True), ("2026-07-20", False), ("Mon, 20 Jul 2026 08:08:04 +0000", False), ("2026-07-21", False)])
def test_fresh(spark, posted, fresh):
    assert one(spark, filters.fresh(F.col("a"), F.lit("2026-07-21 08:00:00").cast("timestamp")), a=posted) is fresh


STRICT = health.Thresholds(window=8, down_streak=3, collapse=0.25, min_baseline=6, never_runs=4)


@pytest.mark.parametrize("runs, want", [(["20", "20", "20", "e"], "SELECTOR_SUSPECT"), (["3", "2", "e"], None), (["d", "d", "d"], "DOWN_STREAK"), (["5", "d", "d"], None), (["40", "38", "42", "3"], "YIELD_COLLAPSE"), (["40", "38", "42", "30"], None), (["0", "0", "0", "0"], "NEVER_PRODUCED")])
def test_health(spark, runs, want):
    rows = [(f"2026-01-{i + 1:02d} 00:00:00", "p", 0 if r in "de" else int(r), r == "d", r != "d") for i, r in enumerate(runs)]
    df = spark.createDataFrame(rows, "run_at string, platform string, raw long, source_down boolean, http_ok boolean").withColumn("run_at", F.col("run_at").cast("timestamp"))
    assert [r.flag for r in health.findings(df, STRICT, ["p"]).collect()] == ([want] if want else [])


def test_systemic_hides_single_outages(spark):
    rows = [(f"2026-01-{i + 1:02d} 00:00:00", f"p{b}", 0 if i == 3 else 10, i == 3, i != 3) for i in range(4) for b in range(5)]
    df = spark.createDataFrame(rows, "run_at string, platform string, raw long, source_down boolean, http_ok boolean").withColumn("run_at", F.col("run_at").cast("timestamp"))
    assert [tuple(r) for r in health.findings(df, STRICT).collect()] == [("*", "SYSTEMIC")]


def test_pages_for_gap(spark):
    rows = spark.createDataFrame([(0.0,), (5.0,), (200.0,), (-5.0,), (20.0,)], "h double").select(health.pages_for_gap(F.col("h")).alias("p")).collect()
    assert [r.p for r in rows] == [50, 50, 1300, 50, 150]


def test_current_records_and_two_tiers(spark):
    log = spark.createDataFrame([(1, "u1", "k1"), (2, "u2", "k1"), (3, "u1", "k2"), (4, "", "k3"), (5, None, "k3")], "seq long, url_key string, key string")
    assert sorted(r.seq for r in history.current_records(log).collect()) == [2, 3, 5]
    cands = spark.createDataFrame([("u1", "zz", "c"), ("u9", "k2", "c"), ("u9", "k2", ""), ("u8", "k8", "c")], "url_key string, key string, company_key string")
    new = history.two_tier_new(cands, log.withColumn("company_key", F.lit("c")))
    assert sorted(r.url_key for r in new.collect()) == ["u8", "u9"]
    assert "NestedLoop" not in explain_plan(new)
    with pytest.raises(Exception, match="unknown status"):
        history.checked(spark.createDataFrame([("odd",)], "status string")).collect()


def test_picks_and_merges_do_not_depend_on_order(spark):
    for rows in ([("u", "Filtered Out", 1), ("u", "User Declined", 2)], [("u", "User Declined", 1), ("u", "Filtered Out", 2)]):
        assert state.best_reason(spark.createDataFrame(rows, "url string, reason string, ord int"), "url", "reason", "ord", {"User Declined": 3, "Filtered Out": 0}).first().reason == "User Declined"
    side = lambda lines: spark.createDataFrame(list(enumerate(lines)), "ord int, line string")
    merged = state.union_lines(side(["a", "c", " "]), side(["a", "b"])).orderBy("side", "ord").collect()
    assert [r.line for r in merged] == ["a", "c", "b"]


def test_config():
    assert config.deep_merge({"a": {"b": 1, "c": [1]}, "d": 1}, {"a": {"c": [2]}, "d": None}) == {"a": {"b": 1, "c": [2]}, "d": None}
    assert config.choose_region({}, ["eu"]) is None and config.choose_region({"us": "1", "eu": "2"}, ["eu"]) == "eu"
    # Worldwide has to be accepted as well as declared; without a match the first that is declared is taken.
    assert config.choose_region({"us": "1", "worldwide": "2"}, ["eu"]) == "us" and config.choose_region({"worldwide": "1", "eu": "2"}, ["eu"]) == "eu"
    assert config.choose_region({"us": "1", "worldwide": "2"}, ["eu", "worldwide"]) == "worldwide" and config.choose_region({"us": "1"}, ["eu"]) == "us"
    assert config.choose_region({"us": "1", "worldwide": "2"}, []) is None
    with pytest.raises(config.ConfigError):
        config.Profile(keywords=("a",), bands=("chief",)).check()
    p = config.Platform("x", ("pm",), ("https://x/{category}",), {"pm": ["a", "b"]})
    assert config.resolve_platforms([p], "pm", []) == [("x", "https://x/a"), ("x", "https://x/b")]


def test_sources(spark):
    rows = [
        (0, "remotive", "0", json.dumps({"jobs": [{"title": " PM ", "company_name": "A", "url": "u", "description": "<p>x</p> y"}]})),
        (1, "remoteok", "0", json.dumps([{"legal": "notice"}, {"position": "P", "url": "u", "salary_min": 1, "salary_max": 2}, {"position": "Q", "url": "u"}])),
        (2, "lever", "acme", json.dumps([{"text": "T", "hostedUrl": "h", "createdAt": 1700000000000}])),
        (3, "rss", "0", "<rss><item><title>Co: Role: x</title><link>l</link><category>c</category></item><item><title>Only</title><link>m</link></item></rss>"),
        (4, "broken", "0", "not json"),
        (5, "sitemap", "0", "<url><loc>https://d/x-y</loc><image:caption>Co - Job (remote job)</image:caption></url>"),
        (6, "cards", "0", '<ul><li class="r"><a href="https://l/1?x=y"></a><h3 class="card__title">T</h3><h4 class="card__subtitle">C</h4><span class="card__location">L</span></li></ul>'),
    ]
    df = spark.createDataFrame(rows, "platform_ord int, platform string, page string, payload string")
    kinds = {"remotive": "remotive", "remoteok": "remoteok", "lever": "lever", "rss": "rss", "broken": "greenhouse", "sitemap": "sitemap", "cards": "guest_cards"}
    cands, status = payloads.parse_all(df, kinds)
    got = sorted((r.platform, r.title, r.company, r.url) for r in cands.collect())
    assert got == [("cards", "T", "C", "https://l/1"), ("lever", "T", "acme", "h"), ("remoteok", "Q", "", "u"), ("remotive", "PM", "A", "u"), ("rss", "Only", "", "m"), ("rss", "Role: x", "Co", "l"), ("sitemap", "Job", "Co", "https://d/x-y")]
    assert {r.platform for r in status.where("source_down").collect()} == {"broken"}


def test_triage_gives_one_reason(spark):
    rows = [(1, "Project Manager", "A Ltd", "Berlin", "https://x/1", "W-2 only in the US"), (2, "Project Manager", "B", "Berlin (hybrid)", "https://x/2", "fine EST hours"), (3, "Cook", "C", "", "https://x/3", "")]
    df = spark.createDataFrame(rows, "doc_id int, title string, company string, loc string, url string, jd_text string").withColumns({"posted_at": F.lit(None).cast("string"), "salary": F.lit("")})
    got = {r.doc_id: r for r in triage(df, None, config.Profile(keywords=("project",), work_model=("remote",), modes={"work_arrangement": "drop"}, latest_end_local="18:00"), F.lit("2026-01-01").cast("timestamp")).collect()}
    assert set(got) == {1, 2} and got[1].drop_reason == "auto-drop: us_only" and got[2].drop_reason == "work_arrangement"
    assert got[2].flags == ["timezone", "work_arrangement_mismatch"]


def test_listings_take_links_of_any_element_by_platform(spark):
    html = """<link href="/jobs/style"><h2 href="/publicjobs/company/big-co/jobs/lead-role/">Lead <b>Role</b></h2>
<a href="/publicjobs/company/big-co/jobs/other-role?x=1"><img></a><a class="x" href="/publicjobs/company/big-co/jobs/other-role">Other role, senior</a>
<a href="/publicjobs/company/big-co/jobs/gone#top">Gone</a><a href="https://www.site.example/publicjobs/company/a/jobs/b-c?ref=1">View b</a><a href="/about">About us</a>"""
    nodesk = '<a href="/remote-jobs/one-two/">One two</a><a href="https://nodesk.co/remote-jobs/a-b-c-d/">Alpha</a>'
    rows = [(0, "remote-rocketship-europe", "1", html), (1, "nodesk", "1", nodesk), (2, "other", "1", html)]
    got = payloads.harvest(spark.createDataFrame(rows, "platform_ord int, platform string, page string, payload string")).orderBy("platform_ord", "row_ord").collect()
    base = "https://www.remoterocketship.com/publicjobs/company/big-co/jobs/"
    assert [(r.title, r.company, r.url) for r in got] == [
        ("Lead Role", "big co", base + "lead-role/"), ("Other role, senior", "big co", base + "other-role"), ("Gone", "big co", base + "gone#top"),
        ("b c", "a", "https://www.site.example/publicjobs/company/a/jobs/b-c?ref=1"), ("Alpha", "", "https://nodesk.co/remote-jobs/a-b-c-d/"),
    ]


def test_jobs_embedded_in_a_careers_page(spark):
    jobs = [
        {"id": 7, "attributes": {"ashby_id": "ab-1", "job_title": "Data Lead", "x": [{"location": "Paris"}, {"location": "Remote"}], "ashby_updated_at": "2026-07-01", "compensation_tier_summary": "10k", "slug": "/careers/position/?jid=1"}},
        {"id": 8, "attributes": {"ashby_id": "ab-2", "SEO": {"title": "Chef | " + "Big " * 30}, "slug": "/careers/position/?jid=2"}},
        {"id": 9, "attributes": {"ashby_id": "ab-3", "slug": "/careers/position/?jid=3"}},
    ]
    page = "<html>" + json.dumps(json.dumps(jobs, separators=(",", ":"))) + "</html>"
    got = payloads.ashby(spark.createDataFrame([(0, "d", "1", page)], "platform_ord int, platform string, page string, payload string"), "Big").orderBy("url").collect()
    at = "https://www.deel.com/careers/position/?jid="
    assert [(r.title, r.company, r.loc, r.url, r.posted_at, r.salary) for r in got] == [("Data Lead", "Big", "Paris, Remote", at + "1", "2026-07-01", "10k"), ("Chef", "Big", "", at + "2", None, None)]


@pytest.mark.parametrize("entry, want", [
    ({"kind": "archetype", "value": "Technical PM", "sources": ["a-b", "c"], "frequency": 2, "first_seen": "2026-07-01"}, []),
    ({"kind": "archetype", "value": "c++"}, []), ({"kind": "archetype", "value": "c++", "sources": [], "last_seen": None}, []),
    ({"kind": "job", "value": "me@x.y", "sources": ["A b"], "frequency": 0, "last_seen": "soon", "name": "x"}, ["unknown", "kind", "value", "sources", "frequency", "last_seen"]),
    ({"value": 5, "sources": "x", "frequency": "2"}, ["kind", "value", "sources", "frequency"]), ([1], ["not"]), ("x", ["not"]), (None, ["not"]),
])
def test_suggestion_errors(spark, entry, want):
    assert [x.split()[0] for x in one(spark, state.suggestion_errors(F.col("a")), a=json.dumps(entry))] == want


@pytest.mark.parametrize("term, want", [("Next.js", True), (" ci/cd ", True), ("a_b", False), (".net", False), ("x" * 40, False), ("www.x", False), ("", False), (None, False)])
def test_generic_terms(spark, term, want):
    assert one(spark, text.generic_term_ok(F.col("a")), a=term) is want
