"""What is dear is in a plan once, whatever is asked of its result."""

import pytest
from pyspark.sql import functions as F

from siftworks.functions import detect, salary, text
from siftworks.operators import filters, funnel
from siftworks.plans.config import Profile
from siftworks.plans.triage import triage

RULES = filters.Rules(auto_drop={"odd": "zyxw", "other": "wxyz"}, flags={"seen": "tsrq", "also": "[q]rst"})
SCHEMA = "id int, title string, loc string, salary string, jd_text string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def filtered(spark):
    bodies = ["a zyxw", "tsrq tsrq", "tsrq qrst", None, "wxyz zyxw tsrq", "none"]
    return filters.hard_filter(spark.createDataFrame([(i, "t", None, "", b) for i, b in enumerate(bodies)], SCHEMA), RULES)


@pytest.mark.parametrize("ask", [
    lambda df: df.where("drop_reason IS NULL"), lambda df: df.where("drop_reason IS NOT NULL").select("id"), lambda df: df.where(F.col("drop_reason").contains("odd")).select("flags"), funnel.drop_by_param, funnel.over_constraint,
])
def test_a_condition_on_the_reason_runs_no_pattern_twice(spark, ask):
    once = plan(ask(filtered(spark))).count("zyxw")
    assert once == (2 if ask is funnel.over_constraint else 1)  # which is over two aggregates of the frame


def test_rows_of_the_filter_are_all_there(spark):
    got = {r.id: (r.drop_reason, r.flags) for r in filtered(spark).collect()}
    assert got == {0: ("auto-drop: odd", []), 1: (None, ["seen"]), 2: (None, ["seen", "also"]), 3: (None, []), 4: ("auto-drop: odd", []), 5: (None, [])}
    assert [tuple(r) for r in funnel.drop_by_param(filtered(spark)).collect()] == [("odd", 2)]
    none = filters.hard_filter(filtered(spark), filters.Rules(auto_drop={}, flags={}, closed_list=False))
    assert {(r.drop_reason, len(r.flags)) for r in none.collect()} == {(None, 0)} and none.count() == 6


def test_flags_are_counted_in_one_pass(spark):
    counts = funnel.flag_counts(filtered(spark), ["seen", "also", "never"])
    assert plan(counts).count("tsrq") == 1
    assert sorted(tuple(r) for r in counts.collect()) == [("also", 1), ("seen", 2)]
    some = spark.createDataFrame([(["seen", "x", "seen"],), (None,), ([],)], "flags array<string>")
    assert [tuple(r) for r in funnel.flag_counts(some, ["seen"]).collect()] == [("seen", 2)]


@pytest.mark.parametrize("modes", [{}, {"language_mismatch": "drop", "employment_mismatch": "drop"}])
def test_a_condition_on_the_triage_makes_nothing_twice(spark, modes):
    rows = [(1, "Lead", "A", "https://x/1", "Wir suchen und " * 40, "p"), (2, "Lead", "A", "https://x/2", "We are looking for you and the team " * 40, "p"), (3, "Lead", "A", "https://x/3", "W-2", "p")]
    df = spark.createDataFrame(rows, "id int, title string, company string, url string, jd_text string, platform string").withColumns({"loc": F.lit(""), "posted_at": F.lit(None).cast("string"), "salary": F.lit("")})
    kept = triage(df, None, Profile(keywords=("lead",), modes=modes), F.lit("2026-07-01").cast("timestamp")).where("drop_reason IS NULL")
    assert plan(kept).count("work hard,? play") == 1 and plan(kept).count("obowiązki") == 2  # a language's words, and those of all
    assert {r.id for r in kept.collect()} == ({2} if modes else {1, 2})


def test_letters_of_a_language_are_sought_among_no_others(spark):
    bodies = ["die Größe und der Wert " * 20, "the plain text of the team and you " * 20, "żółć i się oraz dla lub praca " * 20, None, "", "\u0130 über " * 60]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, b string")
    got = df.select("id", detect.detect_language(F.col("b")).alias("x"))
    assert {r.id: r.x for r in got.collect()} == {0: "de", 1: "en", 2: "pl", 3: None, 4: None, 5: None}


@pytest.mark.parametrize("body, want", [("Fluent Polish is required", "polish"), ("unpolish required, native", None), ("(fluent german)", "german"), ("éfrench required", None), ("fluent\u00a0Dutch", "dutch")])
def test_names_of_languages_begin_words(spark, body, want):
    got = spark.createDataFrame([(body,)], "b string").select(detect.stated_language_requirement(F.col("b"), ["en"]).alias("x")).first().x
    assert (got and got.language) == want


def test_a_mention_of_pay_is_read_in_one_pass(spark):
    said = ["3 000 or 40k and 5 - 7k EUR a month net", "12.500 - 9 GBP per year", "1 2 3", "$4/hour or €5.5/hour", "", None, "3\x02000 PLN"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "id int, t string").select("id", salary.parse(F.col("t")).alias("p"))
    assert plan(df).count("annum|annually") == 1
    got = {r.id: r.p and tuple(r.p) for r in df.collect()}
    assert got == {
        0: (5.0, 7000.0, "EUR", "month", True, "net"), 1: (9.0, 12500.0, "GBP", "year", True, "gross"), 2: None, 3: (5.5, 5.5, "EUR", "hour", True, "gross"), 4: None, 5: None, 6: (3000.0, 3000.0, "PLN", None, False, "gross"),
    }


def test_windows_with_groups(spark):
    got = spark.createDataFrame([("a1b22 c3",)], "t string").select(text.match_windows(F.col("t"), r"([a-z])(\d)(\d)?", 1, 1, groups=3, keep=lambda m: m["groups"][0] != "c").alias("w")).first().w
    assert [tuple(w) for w in got] == [("a1", 0, "a1b", ["a", "1", ""]), ("b22", 2, "1b22 ", ["b", "2", "2"])]
