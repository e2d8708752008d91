"""Registered detectors in the triage, and counters gathered while its rows are written."""

import pytest
from pyspark.sql import functions as F

from siftworks.functions import detect, detectors
from siftworks.plans.config import ConfigError, Profile
from siftworks.plans.triage import RunCounters, run_record, triage

SCHEMA = "doc_id int, title string, company string, url string, jd_text string, platform string, loc string, posted_at string, salary string"
NOW = "2026-07-01"


def frame(spark, bodies):
    return spark.createDataFrame([(i, "Project lead", "A", f"https://x/{i}", body, "p", None, None, None) for i, body in enumerate(bodies)], SCHEMA)


def test_a_registered_detector_notes_and_flags(spark):
    detectors.register_detector("body_size", lambda body: F.length(body), flags=False)
    detectors.register_detector("led", lambda title, body: F.concat(title, body).contains("lead"), parts=("title", "body"))
    detectors.register_detector("marks", lambda body: F.regexp_extract_all(body, F.lit("(!)")))
    detectors.register_sql_detector(spark, "first_word", "CASE WHEN body LIKE 'We %' THEN 'we' END")
    profile = Profile(keywords=("project",), detectors=("body_size", "led", "marks", "first_word"))
    got = {r.doc_id: r for r in triage(frame(spark, ["We ask!", "", None, "secret clearance"]), None, profile, F.lit(NOW).cast("timestamp")).collect()}
    assert (got[0].note_body_size, got[0].note_led, got[0].note_marks, got[0].note_first_word) == (7, True, ["!"], "we")
    assert got[0].flags == ["first_word", "led", "marks"] and got[1].flags == ["led"]
    assert got[2].note_led is None and got[2].flags == []
    assert got[3].drop_reason == "auto-drop: clearance" and got[3].note_body_size is None and got[3].flags == []
    assert spark.sql("SELECT first_word('We all') AS a, first_word('You') AS b").first() == ("we", None)


def test_names_of_detectors_are_checked(spark):
    for name, parts in (("Upper", ("body",)), ("a b", ("body",)), ("fine", ("html",))):
        with pytest.raises(ValueError):
            detectors.register_detector(name, lambda c: c, parts)
    with pytest.raises(ConfigError, match="not registered"):
        Profile(keywords=("a",), detectors=("never_registered",)).check()


def test_counters_are_those_of_the_record(spark, tmp_path):
    rows = frame(spark, ["secret clearance", "work hard, play hard", "secret clearance", "fine", "W2 only", "fine"]).withColumn("platform", F.when(F.col("doc_id") < 2, "p").when(F.col("doc_id") < 5, "q"))
    profile = Profile(keywords=("project",))
    counters = RunCounters(profile, [("q", 3, 1), ("p", 1, 1), ("r", 2, 0), ("s", 0, 0)])
    counters.watch(triage(rows, None, profile, F.lit(NOW).cast("timestamp"))).write.parquet(str(tmp_path / "out"))
    got = counters.record()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert "_param" not in out.columns and out.count() == 6
    platforms = spark.createDataFrame([("q", 3, False, True), ("p", 2, False, True), ("r", 0, True, False), ("s", 0, False, False)], "platform string, raw long, source_down boolean, http_ok boolean")
    assert got == run_record(out, platforms).first().asDict(recursive=True)
    assert got["dropped"] == 4 and got["platforms_covered"] == ["p", "q", "s"]
    # A reason that the profile does not know is counted too, and an empty run has a record.
    other = RunCounters(profile, [])
    other.watch(out.withColumn("drop_reason", F.lit("by hand: x"))).write.format("noop").mode("overwrite").save()
    assert other.record()["drop_by_param"] == [{"param": "other", "n": 6}] and other.record()["drop_nudges"] == ["other"]
    none = RunCounters(profile, [("p", 1, 0)])
    none.watch(out.where("false")).write.format("noop").mode("overwrite").save()
    assert none.record()["funnel_in"] == 0 and none.record()["sources_down"] == ["p"]


def test_languages_are_named_in_one_pass(spark):
    texts = ["Fluent in Czech and German needed", "German is a plus. " + "x" * 60 + " Fluent Dutch is required", "fluent polishes", "native English", "Fluent Spanish; French a plus", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.r for r in df.select("i", detect.stated_language_requirement(F.col("t"), ["en"]).alias("r")).orderBy("i").collect()]
    assert [r and r.language for r in got] == ["german", "dutch", None, None, None, None, None]
