from pyspark.sql import functions as F
from siftworks.operators import history, state


def test_two_saves_equal_one_over_the_union(spark, tmp_path):
    schema = "kind string, value string, source string, day string"
    one = [("keyword_core", w, f"s{i % 3}", f"2024-01-{1 + i % 9:02}") for i, w in enumerate("Spark spark Scala sql SQL Python".split() * 3)]
    two = [("keyword_core", "spark", "s9", "2024-02-01"), ("archetype", "data lead", "s1", "2024-02-02")]
    path = str(tmp_path / "kept")
    assert state.save_suggestions(spark.createDataFrame(one, schema), path) >= 2
    rest = {f: (tmp_path / "kept" / f).stat().st_mtime_ns for f in (x.name for x in (tmp_path / "kept").iterdir()) if f.startswith("part=")}
    touched = state.save_suggestions(spark.createDataFrame(two, schema), path)
    assert 1 <= touched <= 2 and state.save_suggestions(spark.createDataFrame([], schema), path) == 0
    want = {tuple(map(str, r)) for r in state.upsert_suggestions(spark.createDataFrame(one + two, schema)).collect()}
    cols = ["kind", "value", "frequency", "sources", "first_seen", "last_seen"]
    assert {tuple(map(str, r)) for r in spark.read.parquet(path).select(*cols).collect()} == want and rest


def test_records_stand_where_they_first_came_and_drops_follow(spark):
    log = [("u1", "k1", 1, "dropped"), ("u2", "k2", 2, "applied"), ("u1", "k3", 3, "passed"), ("", "k4", 4, "dropped")]
    seen = history.ordered_records(spark.createDataFrame([(*r, "acme", "lead") for r in log], "url_key string, key string, seq long, status string, company_key string, family string"))
    assert [r.seq for r in seen.orderBy("place").collect()] == [3, 2, 1, 4]  # u1's last, u2's last, then what only keys name
    rows = spark.createDataFrame([("u7", "acme", "lead", "p", "auto-drop: travel"), ("u8", "acme", "lead", "p", "stale"), ("u9", "acme", "lead", "p", None)], "url_key string, company_key string, title string, platform string, drop_reason string").withColumn("loc", F.lit(""))
    drops = history.run_drops(rows, seq="bigint")
    seen = seen.withColumns({"role": F.col("key"), "locdom": F.lit(""), "reason": F.lit("")})
    out = history.company_history(rows.withColumn("family", F.lit("lead")), seen, order="place", payload=("status", "reason"), also=drops)
    prior = {r.url_key: [tuple(p) for p in r.prior] for r in out.collect()}
    assert prior["u9"] == [("passed", ""), ("applied", ""), ("dropped", "Filtered Out"), ("dropped", "Stale/Expired"), ("dropped", ""), ("dropped", "")]
    assert len(prior["u7"]) == 5
