"""What a repository of catalogs, states and texts must hold: conditions by section, checked in one aggregate over one frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of suggestions, what a suggested term may look like and what it may not hold, texts that tell of a person.
KINDS = ("keyword_core", "keyword_expanded", "archetype")
ENTRY_KEYS = ("kind", "value", "sources", "first_seen", "last_seen", "frequency")
TERM = r"(?i)^[a-z0-9][a-z0-9 .+#/&-]{0,38}$"
ADDRESS = r"[@]|https?://|\bwww\."
KEBAB = r"^[a-z0-9]+(-[a-z0-9]+)*$"
PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(?:\+\d[\d\s()./-]{7,}\d)|(?:\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b)",
    "street_address": r"(?i)\b\d{1,5}\s+\w+(?:\s+\w+){0,3}\s+(?:Street|Avenue|Boulevard|Lane|Drive)\b",
}


@dataclass(frozen=True)
class Rule:
    """holds: an SQL condition over `text`, of which null is a breach. once: an SQL expression whose value no two rows of the section share."""

    section: str
    name: str
    holds: str = "true"
    once: str | None = None


def field(name: str) -> str:
    return f"get_json_object(text, '$.{name}')"


def listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_HEAD = r"regexp_extract(text, r'(?s)^---\n(.*?)\n---\n', 1)"
_IN_HEAD = lambda key: rf"trim(regexp_extract({_HEAD}, r'(?m)^\s*{key}:[ \t]*(.*)$', 1))"

#: A row is a whole text (document, skill, binding), a line (line) or an entry as JSON (platform, suggestion, ledger).
RULES = (
    Rule("document", "json", "try_parse_json(text) IS NOT NULL"),
    Rule("line", "json", "try_parse_json(text) IS NOT NULL"),
    Rule("platform", "slug", f"{field('slug')} <> ''"),
    Rule("platform", "slug once", once=field("slug")),
    Rule("platform", "active has a tier", f"coalesce({field('active')}, 'false') <> 'true' OR {field('tier_default')} IN ('1', '2', '3')"),
    Rule("platform", "status", f"coalesce({field('status')}, 'verified') IN ('verified', 'unverified')"),
    Rule("platform", "unverified is not active", f"NOT (coalesce({field('status')}, '') = 'unverified' AND coalesce({field('active')}, '') = 'true')"),
    Rule("skill", "frontmatter", rf"text RLIKE r'(?s)^---\n(.*?)\n---\n'"),
    Rule("skill", "name", f"{_IN_HEAD('name')} RLIKE r'{KEBAB}'"),
    Rule("skill", "description", f"length({_IN_HEAD('description')}) BETWEEN 1 AND 1024"),
    Rule("skill", "version", f"{_IN_HEAD('version')} <> ''"),
    Rule("suggestion", "keys", f"size(array_except(json_object_keys(text), array({listed(ENTRY_KEYS)}))) = 0"),
    Rule("suggestion", "kind", f"{field('kind')} IN ({listed(KINDS)})"),
    Rule("suggestion", "value", f"trim({field('value')}) RLIKE r'{TERM}' AND NOT {field('value')} RLIKE r'{ADDRESS}'"),
    Rule("suggestion", "frequency", f"coalesce(try_cast(coalesce({field('frequency')}, '1') AS INT) >= 1, false)"),
    Rule("ledger", "run once", once=f"concat_ws('|', {field('date')}, {field('label')})"),
    Rule("binding", "not empty", "trim(text) <> ''"),
    *(Rule("binding", f"no {name}", f"NOT text RLIKE r'{pattern}'") for name, pattern in PERSONAL.items()),
)


def validate(rows: DataFrame, rules: tuple[Rule, ...] = RULES, samples: int = 4) -> DataFrame:
    """rows (section, place, text) to section, rule, checked, breaches, first (the smallest place of a breach) and examples (up to
    `samples` places of breaches, each the smallest of a share of the places by hash). A row for each rule of each section that has rows;
    sections without rules, and rows of none, bring nothing. Columns beside the three are not looked at.

    All conditions are counted in one aggregate, with partial counts before the shuffle. Rules on values that come once share one
    more, by (rule, value), so that a value of many rows is counted before it moves."""
    rows = rows.select("section", F.col("place").cast("string").alias("place"), F.col("text").cast("string").alias("text"))
    plain, once = [r for r in rules if r.once is None], [r for r in rules if r.once is not None]
    share = F.pmod(F.xxhash64("place"), F.lit(samples))
    metrics = []
    for i, r in enumerate(plain):
        broken = (F.col("section") == r.section) & ~F.coalesce(F.expr(r.holds), F.lit(False))
        at = F.when(broken, F.coalesce("place", F.lit("")))
        metrics += [F.count_if(broken).alias(f"n{i}"), F.min(at).alias(f"f{i}"), F.array_compact(F.array(*(F.min(F.when(share == k, at)) for k in range(samples)))).alias(f"x{i}")]
    told = lambda r, i: F.when(F.col("section") == r.section, F.struct(F.lit(r.name).alias("rule"), F.col(f"n{i}").alias("breaches"), F.col(f"f{i}").alias("first"), F.array_sort(f"x{i}").alias("examples")))
    counts = rows.groupBy("section").agg(F.count(F.lit(1)).alias("checked"), *metrics)
    out = counts.select("section", "checked", F.inline(F.array_compact(F.array(*(told(r, i) for i, r in enumerate(plain)))))) if plain else None
    if once:
        each = F.array_compact(F.array(*(F.when(F.col("section") == r.section, F.struct(F.lit(r.name).alias("rule"), F.expr(r.once).alias("value"))) for r in once)))
        values = rows.select("section", "place", F.inline(each)).groupBy("section", "rule", "value").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("place", F.lit(""))).alias("at"))
        # Of a value that comes more than once each row but the first is a breach; what has no value can't be told apart and is none.
        again = F.col("value").isNotNull() & (F.col("n") > 1)
        place = F.when(again, F.col("at"))
        some = F.array_compact(F.array(*(F.min(F.when(F.pmod(F.xxhash64("at"), F.lit(samples)) == k, place)) for k in range(samples))))
        found = values.groupBy("section", "rule").agg(F.sum("n").alias("checked"), F.sum(F.when(again, F.col("n") - 1).otherwise(0)).alias("breaches"), F.min(place).alias("first"), F.array_sort(some).alias("examples"))
        out = found if out is None else out.unionByName(found)
    return out.select("section", "rule", "checked", "breaches", "first", "examples")


def texts(spark: SparkSession, path: str, section: str) -> DataFrame:
    """Whole files as rows of a section; place is the file's name. A path that has no files is an error, as with any read."""
    return spark.read.text(path, wholetext=True).select(F.lit(section).alias("section"), F.col("_metadata.file_name").alias("place"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str, section: str = "line") -> DataFrame:
    """Lines that aren't blank as rows of a section; place is the file's name and the line's digest, since lines have no numbers in a split file."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.lit(section).alias("section"), F.concat_ws(":", F.col("_metadata.file_name"), F.left(F.sha2("value", 256), F.lit(12))).alias("place"), F.col("value").alias("text"))


def entries(rows: DataFrame, section: str, place: str) -> DataFrame:
    """Rows of a table as entries of a section, as JSON without what is null."""
    return rows.select(F.lit(section).alias("section"), F.col(place).cast("string").alias("place"), F.to_json(F.struct(*(c for c in rows.columns if c != place))).alias("text"))
