import json
import os
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F
from siftworks.operators import sync
from siftworks.sources import captured, payloads, pushes

DAYS = ("2024-01-01", "2024-01-02")


def put(root, platform, day, board, *pages):
    folder = root / platform / day / quote(board, safe="")
    os.makedirs(folder, exist_ok=True)
    for i, page in enumerate(pages):
        (folder / f"{i}.txt").write_bytes(page if isinstance(page, bytes) else page.encode())


def jobs(*names, **more):
    return json.dumps({"jobs": [{"title": n, "companyName": "Acme", "guid": f"https://x.example/{n}", "locationRestrictions": []} for n in names]} | more)


@pytest.fixture
def store(tmp_path):
    cards = lambda *slugs: "".join(f'<a href="/offer/{s}">A job named {s}</a>' for s in slugs)
    more = lambda n, cursor, items: json.dumps({"data": [{"title": f"t{n}", "slug": f"s{n}", "city": "X"}], "meta": {"next": {"cursor": cursor, "itemsCount": items}}})
    for day in DAYS:
        put(tmp_path, "himalayas", day, "all", jobs("one", "two"), jobs("three"), jobs(), jobs("never read"))
        put(tmp_path, "justjoin", day, "category 1/a", more(0, 20, 5), more(1, 40, 5), more(2, None, 5), more(3, 60, 5))
        put(tmp_path, "justjoin", day, "category 2", more(0, 20, 0), more(1, 40, 5))
        put(tmp_path, "workable", day, "acme", json.dumps({"results": [], "nextPage": "t"}), json.dumps({"results": []}), json.dumps({"results": [], "nextPage": "t"}))
        put(tmp_path, "jobgether", day, "pm", cards("aaaaaaaaaa1", "aaaaaaaaaa2"), cards("aaaaaaaaaa2", "aaaaaaaaaa3"), cards("aaaaaaaaaa1"), cards("aaaaaaaaaa9"))
    put(tmp_path, "himalayas", DAYS[0], "bad bytes", jobs("fine"), b"\xff\xfe\xff")
    put(tmp_path, "himalayas", DAYS[0], "no json", "<html>")
    return tmp_path


RULES = {"himalayas": ["offset", 24], "justjoin": "cursor", "workable": "token", "jobgether": ["new_links", r"/offer/[\w-]{10,}"]}


def test_boards_are_read_up_to_their_stop_rules(spark, store):
    rows = captured.read_captured(spark, str(store), RULES)
    got = {(r.platform, r.board): r.pages for r in rows.where("day = '2024-01-02' AND error IS NULL").groupBy("platform", "board").agg(F.count(F.lit(1)).alias("pages")).collect()}
    assert got == {("himalayas", "all"): 3, ("justjoin", "category 1/a"): 3, ("justjoin", "category 2"): 1, ("workable", "acme"): 2, ("jobgether", "pm"): 3}
    # what can't be read is told and leaves the others whole
    status = {r.board: (r.pages, r.note) for r in captured.board_status(rows.where("day = '2024-01-01' AND platform = 'himalayas'")).collect()}
    assert status["all"] == (3, None) and status["bad bytes"][0] == 1 and status["bad bytes"][1].startswith("partial: UnicodeDecodeError") and status["no json"][0] == 0


def test_filters_choose_folders(spark, store):
    read = lambda **of: captured.read_captured(spark, str(store), RULES, **of)
    assert read().rdd.getNumPartitions() == 12
    assert read(platforms=["justjoin"], days=(DAYS[1], None)).rdd.getNumPartitions() == 2
    assert read(platforms=["workable", "jobgether"], days=(None, DAYS[0])).where("page = 0").select("platform").distinct().count() == 2
    assert read(platforms=["nowhere"]).count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert read(pushdown=True).where("platform = 'justjoin' AND day >= '2024-01-02'").rdd.getNumPartitions() == 2
        assert read(pushdown=True).where("platform IN ('workable', 'jobgether') AND day < '2024-01-02' AND page = 0").rdd.getNumPartitions() == 2
        assert read(pushdown=True).where("platform = 'nowhere'").count() == 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_captured_pages_parse_to_candidates(spark, store):
    pages = captured.read_captured(spark, str(store), RULES, days=(DAYS[1], DAYS[1])).where("payload IS NOT NULL")
    frame = pages.select(F.lit(0).alias("platform_ord"), "platform", F.concat_ws(" ", "board", "page").alias("page"), "payload")
    out, status = payloads.parse_all(frame, {"himalayas": "himalayas", "justjoin": "justjoin", "workable": "workable", "jobgether": "listing"})
    assert {r.title for r in out.where("platform = 'himalayas'").collect()} == {"one", "two", "three"}
    assert {r.url.rsplit("/", 1)[1] for r in out.where("platform = 'jobgether'").collect()} == {f"aaaaaaaaaa{i}" for i in (1, 2, 3)}
    assert {r.platform: r.source_down for r in status.collect()} == {"himalayas": False, "justjoin": False, "workable": True, "jobgether": False}


def test_pages_per_gap():
    assert [captured.pages_for_gap(h) for h in (0, 6, 24, 98, 1000)] == [50, 50, 180, 735, 1300]


def test_stream_reads_each_page_once(spark, tmp_path):
    store, seen = tmp_path / "store", set()

    def batch():
        query = captured.stream_captured(spark, str(store)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        assert query.awaitTermination(120)
        rows = sorted((r.board, r.page, r.payload) for r in spark.read.schema(captured.SCHEMA).parquet(str(tmp_path / "out")).collect())
        assert len(rows) == len(set(rows))
        return rows

    put(store, "p", DAYS[0], "a", "a0", "a1")
    assert batch() == [("a", 0, "a0"), ("a", 1, "a1")]
    put(store, "p", DAYS[0], "a", "a0", "a1", "a2")
    put(store, "p", DAYS[0], "b", "b0")
    (store / "p" / DAYS[0] / "b" / "2.txt").write_text("b2")  # waits for the page before it
    assert batch() == [("a", 0, "a0"), ("a", 1, "a1"), ("a", 2, "a2"), ("b", 0, "b0")]
    (store / "p" / DAYS[0] / "b" / "1.txt").write_text("b1")
    assert batch()[-3:] == [("b", 0, "b0"), ("b", 1, "b1"), ("b", 2, "b2")]


def test_capture_is_whole_or_nothing(spark, tmp_path):
    pages = spark.range(40).selectExpr("'p' AS platform", "'2024-01-01' AS day", "concat('b/', id % 3) AS board", "CAST(id DIV 3 AS INT) AS page", "concat('x', id) AS payload")
    captured.write_captured(pages, str(tmp_path / "s"))
    back = captured.read_captured(spark, str(tmp_path / "s"))
    assert {tuple(r) for r in back.drop("error").collect()} == {tuple(r) for r in pages.collect()}
    with pytest.raises(Exception, match="broken"):
        captured.write_captured(pages.withColumn("payload", F.when(F.col("page") == 12, F.raise_error(F.lit("broken"))).otherwise("new")), str(tmp_path / "s"))
    assert not [f for f in os.listdir(tmp_path / "s") if f.startswith("_")] and back.where("payload = 'new'").count() == 0


def records(spark, n=60):
    return spark.range(n).selectExpr("concat('u', id) AS url", "concat('role ', id) AS role", "CASE WHEN id % 4 = 0 THEN NULL ELSE id END AS pay")


def test_pushes_are_told_once(spark, tmp_path):
    path, external = str(tmp_path / "push"), spark.createDataFrame([("u1", True), ("u2", False)], "url string, resolved boolean")
    acted = sync.actions(records(spark), external, "url", F.col("resolved"))
    first = pushes.push_pending(acted, path, ["role", "pay"])
    assert (first["created"], first["refreshed"], first["skipped"]) == (58, 1, 1)
    told = {r.url: json.loads(r.properties) for r in pushes.pushed(spark, path).collect()}
    assert len(told) == 59 and told["u4"] == {"role": "role 4", "pay": None} and "u1" not in told
    again = pushes.push_pending(acted, path, ["role", "pay"])
    assert (again["created"], again["refreshed"], again["files"]) == (0, 0, []) and len(os.listdir(path)) == 1
    changed = pushes.push_pending(acted.withColumn("role", F.when(F.col("url") == "u7", "new").otherwise(F.col("role"))), path, ["role", "pay"])
    assert (changed["created"], changed["refreshed"]) == (1, 0) and pushes.pushed(spark, path).count() == 60


def test_a_failing_push_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "push")
    acted = records(spark).repartition(6).withColumn("action", F.lit("create")).withColumn("role", F.when(F.col("url") == "u33", F.raise_error(F.lit("broken"))).otherwise(F.col("role")))
    with pytest.raises(Exception, match="broken"):
        pushes.push_pending(acted, path, ["role"])
    assert not os.path.exists(path) or os.listdir(path) == []
    assert pushes.pushed(spark, path).count() == 0
    assert pushes.push_pending(records(spark).where("false").withColumn("action", F.lit("create")), path, ["role"])["files"] == []
