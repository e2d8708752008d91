"""The repository validator: each rule with a case that holds and one that does not."""

from siftworks.plans import validate

SKILL = "---\nname: {}\ndescription: {}\nmetadata:\n  version: {}\n---\nText"


def found(df):
    return {(r.section, r.rule): (r.checked, r.breaches, r["first"]) for r in df.collect()}


def test_each_rule(spark):
    rows = [
        ("document", "a", '{"x": 1}'), ("document", "b", "{"), ("document", "c", None),
        ("line", "l1", "[1]"), ("line", "l2", "nothing"),
        ("platform", "p1", '{"slug":"a","active":true,"tier_default":1,"status":"verified"}'), ("platform", "p2", '{"slug":"a","active":false}'), ("platform", "p3", '{"active":true,"tier_default":7}'),
        ("platform", "p4", '{"slug":"d","status":"new"}'), ("platform", "p5", '{"slug":"e","status":"unverified","active":true,"tier_default":2}'), ("platform", "p6", '{"slug":"a"}'),
        ("skill", "s1", SKILL.format("job-run", "Does it", 1)), ("skill", "s2", SKILL.format("Job Run", "", "")), ("skill", "s3", "no head"), ("skill", "s4", SKILL.format("a", "x" * 1025, 2)),
        ("suggestion", "g1", '{"kind":"archetype","value":"C++ / .net","frequency":2}'), ("suggestion", "g2", '{"kind":"person","value":"a@b","frequency":0,"phone":"1"}'), ("suggestion", "g3", '{"kind":"keyword_core","value":"www.x"}'), ("suggestion", "g4", "no entry"),
        ("ledger", "r1", '{"date":"2026-07-01","label":"AM"}'), ("ledger", "r2", '{"date":"2026-07-01","label":"PM"}'), ("ledger", "r3", '{"date":"2026-07-01","label":"AM"}'),
        ("binding", "b1", "Plain. Version 2026-07-01."), ("binding", "b2", " "), ("binding", "b3", "me@site.example, +48 123 456 789, 12 Long Street"), ("binding", None, ""),
        ("unknown", "u", "x"), (None, "n", "x"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "section string, place string, text string, breaches int")
    got = found(validate.validate(df))
    assert got == {
        ("document", "json"): (3, 2, "b"), ("line", "json"): (2, 1, "l2"),
        ("platform", "slug"): (6, 1, "p3"), ("platform", "slug once"): (6, 2, "p1"), ("platform", "active has a tier"): (6, 1, "p3"), ("platform", "status"): (6, 1, "p4"), ("platform", "unverified is not active"): (6, 1, "p5"),
        ("skill", "frontmatter"): (4, 1, "s3"), ("skill", "name"): (4, 2, "s2"), ("skill", "description"): (4, 3, "s2"), ("skill", "version"): (4, 2, "s2"),
        ("suggestion", "keys"): (4, 2, "g2"), ("suggestion", "kind"): (4, 2, "g2"), ("suggestion", "value"): (4, 3, "g2"), ("suggestion", "frequency"): (4, 1, "g2"),
        ("ledger", "run once"): (3, 1, "r1"),
        ("binding", "not empty"): (4, 2, ""), ("binding", "no email"): (4, 1, "b3"), ("binding", "no phone"): (4, 1, "b3"), ("binding", "no street_address"): (4, 1, "b3"),
    }
    assert validate.validate(df.where("false")).count() == 0


def test_examples_are_bounded_and_rules_are_given(spark):
    df = spark.range(1000).selectExpr("'t' AS section", "id AS place", "CAST(id % 10 AS STRING) AS text")
    rules = (validate.Rule("t", "even", "CAST(text AS INT) % 2 = 0"), validate.Rule("t", "unknown", "NULL"), validate.Rule("t", "once", once="text"))
    got = {r.rule: r for r in validate.validate(df, rules).collect()}
    assert (got["even"].breaches, got["unknown"].breaches, got["once"].breaches) == (500, 1000, 990)
    assert 1 <= len(got["even"].examples) <= 4 and all(int(x) % 2 for x in got["even"].examples) and got["even"]["first"] == min(got["even"].examples) == "1"
    assert found(validate.validate(df, rules[2:])) == {("t", "once"): (1000, 990, "0")}


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a":\n1}')
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\n  \n{"b"\n')
    rows = validate.texts(spark, str(tmp_path / "a.json"), "document").unionByName(validate.lines(spark, str(tmp_path / "log.jsonl")))
    got = found(validate.validate(rows))
    assert got["document", "json"] == (1, 0, None) and got["line", "json"][:2] == (2, 1) and got["line", "json"][2].startswith("log.jsonl:")
