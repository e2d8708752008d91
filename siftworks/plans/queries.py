"""A query for each operator over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import detect, detectors, markup, salary, text
from ..operators import filters, funnel, health, history, state, sync
from ..sources import payloads
from . import triage as triage_plan
from . import validate
from .config import Profile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- pieces of SQL that several checks share -------------------------------------------------------------------------

def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_norm(c: str) -> str:
    return rf"lower(trim(regexp_replace(coalesce({c}, ''), '[\s\x{{00a0}}\x{{0085}}]+', ' ', 'g')))"


def sql_url(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '^https?://(www\.)?', ''), '[?#].*$', ''), '/+$', '')"


def sql_word(p: str) -> str:
    """A pattern between word boundaries of all letters, which this dialect counts for ASCII alone."""
    return rf"(^|[^\p{{L}}\p{{M}}\p{{N}}_])(?:{p})($|[^\p{{L}}\p{{M}}\p{{N}}_])"


def sql_patterns(patterns: dict[str, str]) -> dict[str, str]:
    return {k: q("(?i)" + sql_word(p.removeprefix("(?i)").removeprefix(r"\b").removesuffix(r"\b"))) for k, p in patterns.items()}


SQL_DROP = sql_patterns(filters.AUTO_DROP)
# A boundary behind a sign asks for a letter, digit or underscore after it.
_LETTER, _BEFORE = r"[\p{L}\p{M}\p{N}_]", r"(^|[^\p{L}\p{M}\p{N}_])"
_BY_SHARE = r"travel (up to |approximately |~)?\d{1,3}\s?%"
_TRAVEL = filters.AUTO_DROP["travel"].removeprefix(r"(?i)\b").removesuffix(r"\b").replace(_BY_SHARE + "|", "")
SQL_DROP["travel"] = q(f"(?i){sql_word(_TRAVEL)}|{_BEFORE}{_BY_SHARE}{_LETTER}")
# Of us_only the last alternative alone ends in a boundary.
_US = filters.AUTO_DROP["us_only"].removeprefix(r"(?i)\b").replace(r"W-?2\b", r"W-?2($|[^\p{L}\p{M}\p{N}_])")
SQL_DROP["us_only"] = q(f"(?i){_BEFORE}{_US}")
SQL_FLAG = sql_patterns(filters.FLAGS)
#: What postings say beside their text, by id: every filter and flag has its cases, and near misses of them.
PHRASES = (
    "Must be located in the US.", "You hold a TS/SCI clearance.", "Travel up to 25% of the time.", "We know no hustle culture.", "Core hours 9am EST.", "An EU passport is wanted.",
    "A LATAM team with payroll in local currency.", "Remote in Austria, Belgium, France, Germany, Spain.", "Remote in Austria, Belgium, France, Germany and more.", "Open to Poland, Austria and Belgium.",
    "Authorized to work in the U.S. and EU citizenship.", "W2 only, 20% travel", "70-hour weeks; security clearance", "Busonly, Usually, thus-only", "Apply at https://jobs.lever.co/acme/42.", "Poland, United Kingdom, UK, Norway; Pacific Time",
)
EVERY = 37
SQL_PHRASE = f"coalesce(' ' || ([{', '.join(map(q, PHRASES))}])[CAST(doc_id % {EVERY} AS INT) + 1], '')"
SQL_HAY = f"concat_ws(' ', array_to_string(list_slice(string_split(text, ' '), 1, 8), ' '), '', '', text || {SQL_PHRASE})"
SQL_COUNTRIES = " + ".join(f"CASE WHEN regexp_matches(hay, {q(sql_word(c))}) THEN 1 ELSE 0 END" for c in filters.COUNTRIES)
SQL_CLOSED = f"(({SQL_COUNTRIES}) >= 4 AND NOT ({' OR '.join(f'contains(lower(hay), {q(m)})' for m in filters.OPEN_ENDED)}))"
SQL_REASON = f"CASE {' '.join(f'WHEN regexp_matches(hay, {p}) THEN {q('auto-drop: ' + k)}' for k, p in SQL_DROP.items())} WHEN {SQL_CLOSED} THEN 'auto-drop: closed_location_list (closed list, candidate location absent)' END"
SQL_FLAGS = f"array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(hay, {p}) THEN {q(k)} END' for k, p in SQL_FLAG.items())}], lambda x: x IS NOT NULL), ',')"
SQL_FILTERED = f"""SELECT *, CASE WHEN drop_reason IS NULL OR contains(drop_reason, 'closed_location_list') THEN all_flags ELSE '' END AS flags
FROM (SELECT *, {SQL_REASON} AS drop_reason, {SQL_FLAGS} AS all_flags FROM (SELECT *, {SQL_HAY} AS hay FROM documents))"""
SQL_PARAM = r"regexp_extract(drop_reason, 'auto-drop:\s*([a-z0-9_]+)', 1)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as postings: the first words are the title, the source is the platform and company."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id"), F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("title"), F.col("source").alias("company"), F.lit("").alias("loc"),
        F.concat(F.lit("https://www.site.example/doc/"), F.col("doc_id"), F.lit("/?utm=x")).alias("url"), F.col("source").alias("platform"), F.lit(None).cast("string").alias("posted_at"),
        F.lit("").alias("salary"), F.col("text").alias("jd_text"), F.col("lang"), F.col("source"),
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidates whose bodies also say one of PHRASES, for some ids."""
    said = F.get(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % EVERY).cast("int"))
    return candidates(spark, sf_dir).withColumn("jd_text", F.concat("jd_text", F.coalesce(F.concat(F.lit(" "), said), F.lit(""))))


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.hard_filter(postings(spark, sf_dir), filters.Rules())


# --- text ------------------------------------------------------------------------------------------------------------

@query(f"SELECT {sql_url('url')} AS url_key, count(*) AS n FROM pages GROUP BY 1")
def norm_url_distinct(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(text.norm_url(F.col("url")).alias("url_key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lower(regexp_extract(regexp_replace(url, '^https?://', ''), '^([^/]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def url_hosts(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(text.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


SUFFIXES = ("", " Ltd", " Group Ltd", ", Inc.", " Sp. z o.o. Sp. k.", " GmbH", " S.A.", "  Holdings  PLC.")
_COMPANY = "CASE s_suppkey % 8 " + " ".join(f"WHEN {i} THEN 'Acme {chr(65 + i)}' || '{s}'" for i, s in enumerate(SUFFIXES)) + " END"
_FORM = r"(gmbh|ltd|inc|llc|s\.?a\.?|plc|group|holdings?|limited|sp\.?\s*z\s*o\.?\s*o\.?|sp\.?\s*[kj]\.?)\.?$"
_step = lambda c: rf"trim(regexp_replace({c}, '\b{_FORM}', ''), ' ,.')"


@query(f"SELECT s_suppkey, {_step(_step(_step(sql_norm(_COMPANY))))} AS company_key FROM supplier")
def company_norm(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", text.norm_company(F.expr(_COMPANY)).alias("company_key"))


@query(r"SELECT p_partkey, trim(split_part(regexp_replace(lower(p_name || CASE p_partkey % 4 WHEN 0 THEN ' - ' WHEN 1 THEN ', ' WHEN 2 THEN ' (' ELSE ' ' END || p_brand), '\s[-–—|(/]|,', chr(1)), chr(1), 1)) AS family FROM part")
def role_family(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.role_family(F.expr("p_name || CASE p_partkey % 4 WHEN 0 THEN ' - ' WHEN 1 THEN ', ' WHEN 2 THEN ' (' ELSE ' ' END || p_brand")).alias("family"))


#: Links by the residue of a page's id: of tracking systems, and others that look like them.
LINKS = (
    "see https://boards.greenhouse.io/acme/jobs/{}).", "<a href='https://job-boards.eu.greenhouse.io/a/{}'>", '"https://jobs.lever.co/x/y-{}"', "https://apply.workable.com/a/j/{}/, or", "https://acme-co.pinpointhq.com/jobs/{}",
    "https://jobs.ashbyhq.com/a/{} x", "https://www.greenhouse.io/about/{}", "https://acme.teamtailor.com/jobs/{}", "https://careers.smartrecruiters.com/{}", "",
)
_LINKED = "replace(CASE page_id % 10 " + " ".join(f"WHEN {i} THEN {q(x)}" for i, x in enumerate(LINKS)) + " END, '{}', CAST(page_id AS STRING))"
_LINKED_SPARK = "replace(CASE page_id % 10 " + " ".join(f"WHEN {i} THEN " + "'" + x.replace("'", "\\'") + "'" for i, x in enumerate(LINKS)) + " END, '{}', CAST(page_id AS STRING))"


@query(rf"""SELECT page_id, nullif(regexp_replace(regexp_extract(html || {_LINKED}, {q(text.ATS_URL)}), '[\"''>).,]+$', ''), '') AS source_url FROM pages""")
def source_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.resolve_source_url(F.concat("html", F.expr(_LINKED_SPARK))).alias("source_url"))


@query("SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug, left(sha256(s_name), 16) AS hash FROM supplier")
def slug_and_hash(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", text.slugify(F.col("s_name")).alias("slug"), text.content_hash(F.col("s_name")).alias("hash"))


_STRIP = "html"
for _tag in ("script", "style", "noscript", "nav", "footer", "header"):
    _STRIP = rf"regexp_replace({_STRIP}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>', ' ', 'g')"
_VISIBLE = rf"trim(regexp_replace(regexp_replace({_STRIP}, '<[^>]+>', ' ', 'g'), '[\s\x{{00a0}}\x{{0085}}]+', ' ', 'g'))"


@query(f"SELECT page_id, length({_VISIBLE}) AS n, sha256({_VISIBLE}) AS hash FROM pages")
def visible_text(spark, sf_dir):
    v = text.visible_text(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", v.alias("v")).select("page_id", F.length("v").cast("long").alias("n"), F.sha2("v", 256).alias("hash"))


@query(f"SELECT page_id, length(v) AS n, sha256(v) AS hash FROM (SELECT page_id, replace(replace(replace(replace({_VISIBLE}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&') AS v FROM (SELECT page_id, regexp_replace(html, '(?is)<head\\b[^>]*>.*?</head\\s*>', ' ', 'g') AS html FROM pages))")
def visible_text_by_tree(spark, sf_dir):
    v = markup.visible_text_by_tree(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", v.alias("v")).select("page_id", F.length("v").cast("long").alias("n"), F.sha2("v", 256).alias("hash"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/')[-1], '\b[0-9a-f]{6,}\b', '', 'g'), '[-_]+', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM pages")
def slug_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.slug_title(F.col("url")).alias("title"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS n_email,
 len(regexp_extract_all(text, '(?:\\+\\d[\\d\\s()./-]{7,}\\d)|(?:\\b\\d{3}[-.\\s]\\d{3}[-.\\s]\\d{4}\\b)')) AS n_phone FROM documents""")
def pii_hits(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", text.pii_hits(F.col("text")).alias("h"))
    n = lambda k: F.size(F.filter("h", lambda x: x.startswith(f"{k}: "))).cast("long")
    return d.select("doc_id", n("email").alias("n_email"), n("phone").alias("n_phone"))


_LINKS = r"""
WITH a AS (SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS a FROM (SELECT page_id, regexp_extract_all(html, '(?s)<a\b[^>]*?href="[^"]+"[^>]*>.*?</a>') AS l FROM pages)),
b AS (SELECT page_id, pos, regexp_extract(a, 'href="([^"]+)"', 1) AS href, trim(regexp_replace(regexp_replace(regexp_extract(a, '(?s)^<a\b[^>]*>(.*)</a>$', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM a),
c AS (SELECT page_id, pos, label, regexp_replace(regexp_replace(href, '\?.*$', ''), '^https?://[^/]+', '') AS path FROM b),
d AS (SELECT page_id, pos, 'https://site.example' || path AS url, label,
  trim(regexp_replace(regexp_replace(regexp_replace(string_split(regexp_replace('https://site.example' || path, '/+$', ''), '/')[-1], '\b[0-9a-f]{6,}\b', '', 'g'), '[-_]+', ' ', 'g'), '\s+', ' ', 'g')) AS slug
  FROM c WHERE regexp_matches(path, '^/[^/]+$')),
e AS (SELECT *, CASE WHEN length(label) > 3 AND length(label) < 160 AND NOT regexp_matches(label, '(?i)^(view|apply|read|see) ') THEN label ELSE slug END AS title FROM d)
SELECT page_id, url, title FROM e QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY title = slug, pos) = 1
"""


@query(_LINKS)
def link_harvest(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("platform_ord"), F.lit("pages").alias("platform"), F.lit(0).alias("page"), F.col("html").alias("payload"))
    return payloads.link_harvest(p, r"/[^/]+", "https://site.example").select(F.col("platform_ord").alias("page_id"), "url", "title")


@query(_LINKS)
def link_harvest_by_tree(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("platform_ord"), F.lit("pages").alias("platform"), F.lit(0).alias("page"), F.col("html").alias("payload"))
    return payloads.link_harvest(p, r"/[^/]+", "https://site.example", by_tree=True).select(F.col("platform_ord").alias("page_id"), "url", "title")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


# --- captured payloads -----------------------------------------------------------------------------------------------

#: Parts as postings of a dozen sources: for each kind of payload what wraps its items, an item as Spark SQL over a part, and the
#: candidate (title, company, loc, url, posted_at, salary, jd_text) that it must become, as SQL over the same part.
_URL = "'https://site.example/' || p_partkey"
_KEY, _DAY = "CAST(p_partkey AS STRING)", "'2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS STRING), 2, '0') || 'T08:30:00'"
_UNIX = "(1704096000 + p_partkey * 60)"
_J = lambda **f: "to_json(named_struct(" + ", ".join(f"'{k}', {v}" for k, v in f.items()) + "))"
_PLAIN_DAY = "'2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') || 'T08:30:00'"
_FROM_UNIX = "strftime(TIMESTAMP '2024-01-01 08:00:00' + p_partkey * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%S')"  # and +00:00
SOURCES = {
    "remotive": ('{"jobs":[', ",", "]}", _J(title="p_name", company_name="p_brand", candidate_required_location="p_type", url=_URL, publication_date=_DAY, salary="concat(p_size, 'k EUR')", description="concat('<p>', p_type, '</p> <b>x</b>')"), ("p_name", "p_brand", "p_type", _URL, _PLAIN_DAY, "p_size || 'k EUR'", "p_type || ' x'")),
    "remoteok": ('[{"legal":"notice"},', ",", "]", _J(position="CASE WHEN p_partkey % 36 <> 1 THEN p_name END", company="p_brand", location="'Anywhere'", url=_URL, date=_DAY, salary_min="CASE WHEN p_size % 2 = 0 THEN p_size WHEN p_size % 3 = 0 THEN 0 END", salary_max="p_size + 10", description="p_type"), ("CASE WHEN p_partkey % 36 <> 1 THEN p_name END", "p_brand", "'Anywhere'", _URL, _PLAIN_DAY, "CASE WHEN p_size % 2 = 0 THEN p_size || '-' ELSE '' END || (p_size + 10)", "p_type")),
    "justjoin": ('{"data":[', ",", "]}", _J(title="p_name", companyName="p_brand", city="'Krakow'", workplaceType="CASE p_size % 2 WHEN 0 THEN 'remote' ELSE 'hybrid' END", slug="concat('job-', p_partkey)", publishedAt=_DAY, employmentTypes="CASE WHEN p_size % 5 = 0 THEN NULL ELSE array(named_struct('from', CAST(NULL AS INT), 'to', 0, 'currency', 'x', 'type', 'x'), named_struct('from', p_size * 100, 'to', CASE WHEN p_size % 3 > 0 THEN p_size * 200 END, 'currency', 'pln', 'type', 'b2b')) END"), ("p_name", "p_brand", "'Krakow (' || CASE p_size % 2 WHEN 0 THEN 'remote' ELSE 'hybrid' END || ')'", "'https://justjoin.it/job-offer/job-' || p_partkey", _PLAIN_DAY, "CASE WHEN p_size % 5 > 0 THEN (p_size * 100) || '-' || CASE WHEN p_size % 3 > 0 THEN CAST(p_size * 200 AS VARCHAR) ELSE 'None' END || ' pln (b2b)' END", "NULL")),
    "himalayas": ('{"jobs":[', ",", "]}", _J(title="p_name", companyName="p_brand", locationRestrictions="CASE WHEN p_size % 2 = 0 THEN array('A', 'B', 'C', 'D', 'E') ELSE CAST(array() AS ARRAY<STRING>) END", guid=f"CASE WHEN p_size % 3 > 0 THEN {_URL} END", companySlug="'co'", pubDate=_UNIX, minSalary="p_size", maxSalary="CASE WHEN p_size % 5 > 0 THEN p_size * 2 END", currency="'EUR'", salaryPeriod="'annual'", description="concat('<i>', p_type, '</i>')"), ("p_name", "p_brand", "CASE WHEN p_size % 2 = 0 THEN 'A, B, C, D' ELSE 'Worldwide' END", f"CASE WHEN p_size % 3 = 0 THEN 'https://himalayas.app/companies/co/jobs' ELSE {_URL} END", f"{_FROM_UNIX} || '+00:00'", "p_size || '-' || CASE WHEN p_size % 5 > 0 THEN CAST(p_size * 2 AS VARCHAR) ELSE 'None' END || ' EUR/annual'", "p_type")),
    "greenhouse": ('{"jobs":[', ",", "]}", _J(title="p_name", location="named_struct('name', p_type)", absolute_url=_URL, updated_at=_DAY, content="concat('&lt;p&gt;', p_type, ' &amp;amp; more&lt;/p&gt;')"), ("p_name", "page", "p_type", _URL, _PLAIN_DAY, "NULL", "'&lt;p&gt;' || p_type || ' &amp;amp; more&lt;/p&gt;'")),
    "lever": ("[", ",", "]", _J(text="p_name", categories="named_struct('location', p_type)", hostedUrl=_URL, createdAt=f"{_UNIX} * 1000", descriptionPlain="p_brand"), ("p_name", "page", "p_type", _URL, f"{_FROM_UNIX} || '+00:00'", "NULL", "p_brand")),
    "workable": ('{"results":[', ",", "]}", _J(title="p_name", shortcode=_KEY, location="named_struct('city', 'Paris', 'country', CASE WHEN p_size % 3 = 0 THEN '' ELSE 'France' END)", remote="p_size % 2 = 0", published=_DAY), ("p_name", "page", "'Paris' || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' France' END || CASE WHEN p_size % 2 = 0 THEN ' remote' ELSE '' END", "'https://apply.workable.com/' || page || '/j/' || p_partkey || '/'", _PLAIN_DAY, "NULL", "NULL")),
    "pinpoint": ('{"data":[', ",", "]}", _J(title="p_name", location="named_struct('name', CASE WHEN p_size % 2 = 0 THEN 'Skopje' END, 'city', 'Bitola')", workplace_type="CASE WHEN p_size % 3 = 0 THEN '' ELSE 'hybrid' END", url=_URL, description="concat('<p>', p_type, '</p>')", published_at=f"CASE WHEN p_size % 2 = 0 THEN {_DAY} END", created_at="'2023-12-31'"), ("p_name", "page", "CASE WHEN p_size % 2 = 0 THEN 'Skopje' ELSE 'Bitola' END || CASE WHEN p_size % 3 = 0 THEN ' ()' ELSE ' (hybrid)' END", _URL, f"CASE WHEN p_size % 2 = 0 THEN {_PLAIN_DAY} ELSE '2023-12-31' END", "NULL", "p_type")),
    "ashby": ('{"jobs":[', ",", "]}", _J(title="p_name", location="p_type", jobUrl=f"CASE WHEN p_size % 2 = 0 THEN '' ELSE {_URL} END", applyUrl=f"concat({_URL}, '/apply')", publishedAt=_DAY), ("p_name", "''", "p_type", f"{_URL} || CASE WHEN p_size % 2 = 0 THEN '/apply' ELSE '' END", _PLAIN_DAY, "NULL", "NULL")),
    "rss": ("<rss>", "\n", "</rss>", f"concat('<item><title>', CASE WHEN p_size % 2 = 0 THEN concat(p_brand, ': ') ELSE '' END, p_name, '</title><link>', {_URL}, '</link><region>', CASE WHEN p_size % 3 = 0 THEN '' ELSE 'EU' END, '</region><category>Any</category><pubDate>', {_DAY}, '</pubDate><description><![CDATA[<p>', p_type, '</p>]]></description></item>')", ("p_name", "CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END", "CASE WHEN p_size % 3 = 0 THEN 'Any' ELSE 'EU' END", _URL, _PLAIN_DAY, "NULL", "p_type")),
    "sitemap": ("<urlset>", "", "</urlset>", f"concat('<url><loc>', {_URL}, '</loc><lastmod>', {_DAY}, '</lastmod><image:caption>', p_brand, ' - ', p_name, ' (remote job)</image:caption></url>')", ("p_name", "p_brand", "''", _URL, _PLAIN_DAY, "NULL", "NULL")),
    "working_nomads": ("[", ",", "]", _J(title="p_name", company_name="p_brand", location="p_type", url=_URL, pub_date=_DAY, description="concat('<p>', p_type, '</p>')"), ("p_name", "p_brand", "p_type", _URL, _PLAIN_DAY, "NULL", "p_type")),
    "guest_cards": ("<ul>", "", "</ul>", f"""concat('<li class="card"><a class="x" href="', {_URL}, '?ref=a">go</a><h3 class="base-title">', p_name, '</h3><h4 class="subtitle"> ', p_brand, '</h4><span class="location">', p_type, '</span><time datetime="', {_DAY}, '"></time></li>')""", ("p_name", "p_brand", "p_type", _URL, _PLAIN_DAY, "NULL", "NULL")),
}
_COLUMNS = ("title", "company", "loc", "url", "posted_at", "salary", "jd_text")
_PAGE = "'board' || CAST(floor(p_partkey / 13) AS INT) % 4"


def captured(spark, sf_dir):
    """(platform_ord, platform, page, payload): four pages for each source, and one of each that can't be read."""
    names = list(SOURCES)
    out = None
    for i, (name, (head, between, tail, item, _)) in enumerate(SOURCES.items()):
        p = read(spark, sf_dir, "part").where(f"p_partkey % {len(names)} = {i}").select(F.expr(_PAGE).alias("page"), F.expr(item).alias("item"))
        pages = p.groupBy("page").agg(F.concat(F.lit(head), F.array_join(F.collect_list("item"), between), F.lit(tail)).alias("payload"))
        broken = spark.createDataFrame([("broken", "<<not this>>"), ("none", None)], "page string, payload string")
        rows = pages.unionByName(broken).select(F.lit(i).alias("platform_ord"), F.lit(name).alias("platform"), "page", "payload")
        out = rows if out is None else out.unionByName(rows)
    return out


def _expected(i: int, name: str) -> str:
    values = ", ".join(f"trim({v}) AS {c}" if c in ("title", "company", "loc", "url") else f"{v} AS {c}" for c, v in zip(_COLUMNS, SOURCES[name][4]))
    return f"SELECT '{name}' AS platform, {values} FROM (SELECT *, {_PAGE.replace('floor(p_partkey / 13)', 'p_partkey // 13')} AS page FROM part WHERE p_partkey % {len(SOURCES)} = {i})"


_EXPECTED = " UNION ALL ".join(_expected(i, name) for i, name in enumerate(SOURCES))


@query(f"SELECT * FROM ({_EXPECTED}) WHERE title IS NOT NULL")
def payload_candidates(spark, sf_dir):
    out, _ = payloads.parse_all(captured(spark, sf_dir), {name: name for name in SOURCES})
    return out.select("platform", *_COLUMNS)


@query(f"SELECT platform, count(title) AS raw, count(title) = 0 AS source_down FROM ({_EXPECTED} UNION ALL SELECT 'silent', NULL, NULL, NULL, NULL, NULL, NULL, NULL) GROUP BY 1")
def source_status(spark, sf_dir):
    silent = spark.createDataFrame([(99, "silent", "1", "{}")], "platform_ord int, platform string, page string, payload string")
    _, status = payloads.parse_all(captured(spark, sf_dir).unionByName(silent), {name: name for name in SOURCES} | {"silent": "remotive"})
    return status


# --- projection, filter ----------------------------------------------------------------------------------------------

KEYWORDS = ("ring", "red", "bolt", "small", "blue", "gear")


@query("SELECT p_partkey, keyword FROM (SELECT p_partkey, CASE " + " ".join(f"WHEN contains(lower(p_name), '{k}') THEN '{k}'" for k in KEYWORDS) + " END AS keyword FROM part) WHERE keyword IS NOT NULL")
def keyword_first_match(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", filters.keyword_match(F.col("p_name"), list(KEYWORDS)).alias("keyword")).where("keyword IS NOT NULL")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 7 = 1 OR o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'")
def freshness_filter(spark, sf_dir):
    posted = F.expr("CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'soon' WHEN 2 THEN date_format(o_orderdate, 'EEE, d MMM yyyy HH:mm:ss') || ' +0000' WHEN 3 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") || '+02:00' END")
    return read(spark, sf_dir, "orders").where(filters.fresh(posted, F.lit("1998-01-01 00:00:00").cast("timestamp"))).select("o_orderkey")


@query(f"SELECT doc_id, drop_reason, flags FROM ({SQL_FILTERED})")
def hard_filter_reason(spark, sf_dir):
    return filtered(spark, sf_dir).select("doc_id", "drop_reason", F.array_join("flags", ",").alias("flags"))


_PLACES = "array_to_string(list_slice(list_concat(['{c}'], ['{c}']), CAST(c_custkey % 32 AS INT) + 1, CAST(c_custkey % 32 + c_custkey % 7 AS INT)), ', ') || CASE WHEN c_custkey % 5 = 0 THEN ' and more' ELSE '' END".replace("{c}", "', '".join(filters.COUNTRIES))


@query(f"SELECT c_custkey, {SQL_CLOSED} AS closed FROM (SELECT c_custkey, {_PLACES} AS hay FROM customer)")
def closed_list(spark, sf_dir):
    countries = F.array(*map(F.lit, filters.COUNTRIES))
    places = F.concat(F.array_join(F.slice(F.concat(countries, countries), (F.col("c_custkey") % 32 + 1).cast("int"), (F.col("c_custkey") % 7).cast("int")), ", "), F.when(F.col("c_custkey") % 5 == 0, " and more").otherwise(""))
    return read(spark, sf_dir, "customer").select("c_custkey", filters.closed_list(places, filters.Rules()).alias("closed"))


@query(f"SELECT {SQL_PARAM} AS param, count(*) AS n FROM ({SQL_FILTERED}) WHERE drop_reason IS NOT NULL GROUP BY 1")
def drop_by_param(spark, sf_dir):
    return funnel.drop_by_param(filtered(spark, sf_dir))


@query(f"SELECT count(*) AS funnel_in, count_if(drop_reason IS NULL) AS \"new\", count_if(drop_reason IS NOT NULL) AS dropped, 0 AS link_dead FROM ({SQL_FILTERED})")
def funnel_counts(spark, sf_dir):
    return funnel.funnel(filtered(spark, sf_dir))


@query("SELECT event_type AS param, count(*) AS n, (SELECT count(*) FROM events) AS funnel_in, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY 1 HAVING share >= 0.2")
def over_constraint(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("auto-drop: "), "event_type").alias("drop_reason"))
    return funnel.over_constraint(e, least=0.2)


@query(f"SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ',')) AS flag FROM ({SQL_FILTERED}) WHERE flags <> '') GROUP BY 1")
def flag_counts(spark, sf_dir):
    return funnel.flag_counts(filtered(spark, sf_dir), list(filters.FLAGS))


@query("SELECT 'src' || i AS source, (SELECT count(*) FROM documents WHERE source = 'src' || i) AS raw FROM range(25) AS t(i)")
def source_stats(spark, sf_dir):
    sources = spark.range(25).select(F.concat(F.lit("src"), "id").alias("source"))
    return funnel.source_stats(read(spark, sf_dir, "documents"), sources)


@query("""SELECT doc_id, CASE WHEN length(text) > 400 THEN 'from_enumeration' WHEN row_number() OVER (PARTITION BY length(text) > 400 ORDER BY source, doc_id) <= 60 THEN 'to_read' ELSE 'deferred' END AS jd_status FROM documents""")
def read_cap(spark, sf_dir):
    return filters.read_cap(read(spark, sf_dir, "documents"), [F.col("source"), F.col("doc_id")], 60, "text").select("doc_id", "jd_status")


@query("SELECT n_nationkey, CASE WHEN ntile(2) OVER (ORDER BY n_nationkey) = 1 THEN 'AM' ELSE 'PM' END AS half FROM nation")
def half_rotation(spark, sf_dir):
    return filters.half_rotation(read(spark, sf_dir, "nation"), [F.col("n_nationkey")]).select("n_nationkey", "half")


# --- joins -----------------------------------------------------------------------------------------------------------

def keyed(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return c.withColumn("url_key", text.norm_url(F.col("url"))).withColumn("company_key", text.norm_company(F.col("company"))).withColumn("key", text.make_key(F.col("company"), F.col("title"), F.col("lang")))


def seen_log(spark, sf_dir):
    """What is labelled was seen before."""
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return keyed(spark, sf_dir).join(labels, "doc_id").withColumn("seq", F.col("doc_id"))


_KEYED = f"SELECT doc_id, lang, source, 'site.example/doc/' || doc_id AS url_key, lower(source) AS company_key, lower(source) || '|' || {sql_norm(chr(97) + 'rray_to_string(list_slice(string_split(text, chr(32)), 1, 8), chr(32))')} || '|' || lang AS key FROM documents"
_SEEN = f"SELECT k.*, l.quality, l.toxic FROM ({_KEYED}) k JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)"


@query(f"WITH k AS ({_KEYED}), s AS ({_SEEN}) SELECT doc_id FROM k WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.url_key = k.url_key) AND NOT EXISTS (SELECT 1 FROM s WHERE s.key = k.key)")
def two_tier_antijoin(spark, sf_dir):
    return history.two_tier_new(keyed(spark, sf_dir), seen_log(spark, sf_dir)).select("doc_id")


@query(f"""WITH k AS ({_KEYED}), s AS ({_SEEN}), u AS (SELECT url_key, max(doc_id) AS id FROM s GROUP BY 1), y AS (SELECT key, max(doc_id) AS id FROM s GROUP BY 1)
SELECT k.doc_id, coalesce(u.id, y.id) AS matched_id, CASE WHEN u.id IS NOT NULL THEN 'url' WHEN y.id IS NOT NULL THEN 'key' END AS matched_by FROM k LEFT JOIN u USING (url_key) LEFT JOIN y ON y.key = k.key""")
def two_tier_lookup(spark, sf_dir):
    seen = seen_log(spark, sf_dir).select("url_key", "key", "company_key", "seq", F.col("doc_id").alias("id"))
    return history.two_tier_lookup(keyed(spark, sf_dir), seen, ["id"]).select("doc_id", F.col("matched.id").alias("matched_id"), "matched_by")


def event_log(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("url_key"), F.concat_ws("|", "event_type", F.get_json_object("props", "$.k")).alias("key"), "event_type", "ts")


_CURRENT = """SELECT * FROM (SELECT event_id AS seq, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS u,
 row_number() OVER (PARTITION BY event_type || '|' || CAST(json_extract(props, '$.k') AS VARCHAR) ORDER BY event_id DESC) AS k FROM events) WHERE u = 1 OR k = 1"""


@query(f"SELECT seq, event_type FROM ({_CURRENT})")
def last_wins_current(spark, sf_dir):
    return history.current_records(event_log(spark, sf_dir)).select("seq", "event_type")


@query(f"SELECT seq FROM ({_CURRENT}) WHERE event_type NOT IN ('purchase', 'signup')")
def unsynced_view(spark, sf_dir):
    return history.current_records(event_log(spark, sf_dir)).where(~F.col("event_type").isin("purchase", "signup")).select("seq")


@query("""SELECT a.o_orderkey, coalesce(array_to_string(list_slice(list_sort(list(b.o_orderkey) FILTER (b.o_orderkey IS NOT NULL)), 1, 8), ','), '') AS prior
FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey GROUP BY 1""")
def prior_company_top8(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return history.prior_company(o, "o_custkey", "o_orderkey", "o_orderkey", []).select("o_orderkey", F.array_join(F.transform("prior", lambda p: p["o_orderkey"]), ",").alias("prior"))


@query("""WITH n AS (SELECT o_custkey, o_orderpriority, count_if(o_orderstatus = 'F') AS n FROM orders GROUP BY 1, 2)
SELECT o_orderkey, n - CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS applied_variants, n - CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END >= 2 AS saturated FROM orders JOIN n USING (o_custkey, o_orderpriority)""")
def applied_saturation(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "applied").otherwise("passed"))
    return history.saturation(o, "o_custkey", "o_orderpriority", "status", "o_orderkey").select("o_orderkey", "applied_variants", "saturated")


_PLACED = """SELECT event_id, min(tier) AS tier, min(CASE WHEN tier = t0 THEN first END) AS first FROM (SELECT *, min(tier) OVER (PARTITION BY event_id) AS t0 FROM (
 SELECT max(event_id) AS event_id, 0 AS tier, min(event_id) AS first FROM events GROUP BY user_id
 UNION ALL SELECT max(event_id), 1, min(event_id) FROM events GROUP BY event_type, CAST(json_extract(props, '$.k') AS VARCHAR))) GROUP BY 1"""


@query(f"""WITH r AS (SELECT e.event_id, e.user_id, e.event_type, row_number() OVER (PARTITION BY e.event_type ORDER BY p.tier, p.first) AS n FROM ({_PLACED}) p JOIN events e USING (event_id)),
c AS (SELECT event_id, user_id, event_type FROM events WHERE event_id % 50 = 0),
o AS (SELECT c.event_id, r.event_id AS id, row_number() OVER (PARTITION BY c.event_id ORDER BY r.n) AS n FROM c JOIN r ON r.event_type = c.event_type AND r.user_id <> c.user_id)
SELECT c.event_id, coalesce(string_agg(o.id::VARCHAR, ',' ORDER BY o.n) FILTER (o.n <= 8), '') AS prior FROM c LEFT JOIN o USING (event_id) GROUP BY 1""")
def prior_records(spark, sf_dir):
    """The first eight current records of the same company under other urls, in the order of the log."""
    log = event_log(spark, sf_dir).withColumns({"company_key": F.col("event_type"), "family": F.col("event_type"), "status": F.lit("dropped"), "id": F.col("seq").cast("string")})
    cands = log.where("seq % 50 = 0").select("url_key", "company_key", "family", F.col("seq").alias("event_id"))
    found = history.company_history(cands, history.ordered_records(log), order="place", payload=("id",))
    return found.select("event_id", F.coalesce(F.array_join(F.transform("prior", lambda p: p["id"]), ","), F.lit("")).alias("prior"))


MARKER_HOSTS = ("ththre.example.com", "example.net", "m.ththth.example.net.eu", "thther.example.org", "nowhere.example")


@query(f"""WITH h AS (SELECT DISTINCT lower(regexp_extract(regexp_replace(url, '^https?://', ''), '^([^/]*)', 1)) AS host FROM pages), m AS (SELECT unnest(['{"', '".join(MARKER_HOSTS)}']) AS marker_host)
SELECT host, marker_host FROM h JOIN m ON contains(host, marker_host) OR contains(marker_host, host)""")
def marker_theta_join(spark, sf_dir):
    """A short fixed list against the hosts of all pages: a nested loop over a broadcast of a few rows is the plan."""
    hosts = read(spark, sf_dir, "pages").select(text.host(F.col("url")).alias("host")).distinct()
    markers = spark.createDataFrame([(m,) for m in MARKER_HOSTS], "marker_host string")
    return hosts.join(F.broadcast(markers), F.col("host").contains(F.col("marker_host")) | F.col("marker_host").contains(F.col("host")))


# --- detectors -------------------------------------------------------------------------------------------------------

_SCORES = []
for _rank, (_lang, _line) in enumerate(detect.STOPWORDS.items()):
    _boost = f" + CASE WHEN regexp_matches(text, '[{detect.DIACRITICS[_lang]}]') THEN 0.01::DOUBLE ELSE 0::DOUBLE END" if _lang in detect.DIACRITICS else ""
    _SCORES.append(f"{{'score': len(list_filter(w, lambda x: x IN ({', '.join(map(q, _line.split()))})))::DOUBLE / len(w){_boost}, 'rank': {-_rank}, 'lang': '{_lang}'}}")
_DETECT = rf"SELECT doc_id, lang, CASE WHEN len(w) >= 50 AND top.score >= 0.02 THEN top.lang END AS detected FROM (SELECT doc_id, lang, w, list_max([{', '.join(_SCORES)}]) AS top FROM (SELECT doc_id, lang, text, regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM documents))"


@query(f"SELECT doc_id, detected FROM ({_DETECT})")
def language_detect(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", detect.detect_language(F.col("text")).alias("detected"))


@query(f"SELECT lang, coalesce(detected, '') AS detected, count(*) AS n FROM ({_DETECT}) GROUP BY 1, 2")
def language_confusion(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("lang", F.coalesce(detect.detect_language(F.col("text")), F.lit("")).alias("detected"))
    return d.groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, coalesce(CASE WHEN regexp_matches(lower(text), '[{detect.DIACRITICS['pl']}]') THEN 'pl' " + " ".join(f"WHEN regexp_matches(lower(text), '[{detect.DIACRITICS[x]}]') THEN '{x}'" for x in ("de", "fr", "es", "it", "pt")) + " END, '') AS by_letters FROM documents")
def title_language(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(detect.title_language(F.col("text")), F.lit("")).alias("by_letters"))


@query("""SELECT doc_id, CASE WHEN said IS NOT NULL AND said NOT IN ('en', 'pl') THEN said ELSE coalesce(by_title, said) END AS language FROM (SELECT doc_id, said,
 CASE WHEN regexp_matches(t, '[äöüß]') THEN 'de' WHEN regexp_matches(t, '[àâçéèêëîïôûùüÿœ]') THEN 'fr' WHEN regexp_matches(t, '[áíñóúü¿¡]') THEN 'es' WHEN regexp_matches(t, '[àèéìíòóù]') THEN 'it' WHEN regexp_matches(t, '[ãõáâàçéêíóôú]') THEN 'pt' END AS by_title
 FROM (SELECT doc_id, lower(array_to_string(list_slice(string_split(text, ' '), 1, 8), ' ')) AS t, CASE doc_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' END AS said FROM documents))""")
def title_language_fallback(spark, sf_dir):
    """Bodies in English, in French or too short, under titles of all languages, for who applies in English and Polish."""
    k = F.col("doc_id") % 4
    body = F.when(k == 0, F.repeat(F.lit("the team and the work of the company with you for this role "), 8)).when(k == 1, F.repeat(F.lit("nous avons une équipe pour vous avec les projets dans la ville et des "), 8)).otherwise(F.lit("short"))
    return candidates(spark, sf_dir).select("doc_id", detect.language_of(F.col("title"), body, ["en", "pl"]).alias("language"))


_STATED = "CASE c_custkey % 6 WHEN 0 THEN 'We need Polish C1 and English B2. ' || c_name WHEN 1 THEN 'Polish is a nice to have for ' || c_name WHEN 2 THEN 'Application must be submitted in German, ' || c_name WHEN 3 THEN 'Fluent English required' WHEN 4 THEN c_name || ' speaks French at lunch' ELSE 'Native Dutch, fluent Czech' END"


# The languages that occur, in the detector's order; a window of 45 characters on either side of a language's name.
_NAMED = [n for n in detect.LANGUAGES if n in ("polish", "german", "french", "dutch", "czech")]
_NEAR = {n: rf"regexp_extract(t, '(.{{0,45}}\b{n}\b.{{0,45}})', 1)" for n in _NAMED}


@query(rf"""SELECT c_custkey, CASE WHEN wall <> '' THEN 'apply_in:' || wall {" ".join(f"WHEN {w} <> '' AND NOT regexp_matches({w}, {q(detect.OPTIONAL)}) AND regexp_matches({w}, {q(detect.REQUIRED)}) THEN 'proficiency:{n}'" for n, w in _NEAR.items())} ELSE '' END AS stated
FROM (SELECT *, regexp_extract(t, {q(detect.APPLY_IN + "(" + "|".join(_NAMED) + ")")}, 1) AS wall FROM (SELECT c_custkey, lower({_STATED}) AS t FROM customer))""")
def stated_language(spark, sf_dir):
    r = detect.stated_language_requirement(F.expr(_STATED), ["en"])
    return read(spark, sf_dir, "customer").select("c_custkey", r.alias("r")).select("c_custkey", F.coalesce(F.concat_ws(":", "r.kind", "r.language"), F.lit("")).alias("stated"))


@query(r"""SELECT o_orderkey, CASE WHEN m < '2028-06' THEN CAST(CAST(left(m, 4) AS INT) - 30 AS VARCHAR) || right(m, 3) END AS passed FROM (SELECT o_orderkey, CASE
 WHEN regexp_matches(t, '\d{1,2}\.\d{4}') THEN regexp_extract(t, '(\d{1,2})\.(\d{4})', 2) || '-' || lpad(regexp_extract(t, '(\d{1,2})\.(\d{4})', 1), 2, '0')
 WHEN regexp_matches(t, '\d{4}-\d{2}') THEN regexp_extract(t, '(\d{4}-\d{2})', 1)
 ELSE regexp_extract(t, '[A-Z][a-z]+ (\d{4})', 1) || '-' || lpad(CAST(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(left(regexp_extract(t, '([A-Z][a-z]+) \d{4}', 1), 3))) AS VARCHAR), 2, '0') END AS m
 FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Project start: ' || strftime(d, '%m.%Y') WHEN 1 THEN 'we start in ' || strftime(d, '%B %Y') ELSE 'Expected start ' || strftime(d, '%Y-%m-%d') END AS t
 FROM (SELECT o_orderkey, o_orderdate + INTERVAL 360 MONTH AS d FROM orders)))""")
def start_date_passed(spark, sf_dir):
    # The orders are of the nineties; the detector takes years from 2000, so dates move on by 30 years and back.
    later = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'Project start: ' || date_format(add_months(o_orderdate, 360), 'MM.yyyy') WHEN 1 THEN 'we start in ' || date_format(add_months(o_orderdate, 360), 'MMMM yyyy') ELSE 'Expected start ' || date_format(add_months(o_orderdate, 360), 'yyyy-MM-dd') END")
    passed = detect.start_date_passed(later, F.lit("2028-06-15").cast("date"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(passed.isNotNull(), F.concat((F.left(passed, F.lit(4)).cast("int") - 30).cast("string"), F.substring(passed, 5, 3))).alias("passed"))


_OFFER = "CASE p_partkey % 5 WHEN 0 THEN 'Full-time B2B contract role' WHEN 1 THEN 'part time intern' WHEN 2 THEN 'Freelancer wanted' WHEN 3 THEN 'interim contractor, fixed term' ELSE p_name END"


_KINDS_SAID = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {q(p)}) THEN '{k}' END" for k, p in detect.EMPLOYMENT.items()) + "], lambda x: x IS NOT NULL), ',')"


@query(f"SELECT p_partkey, found, found <> '' AND NOT regexp_matches(found, '(^|,)b2b(,|$)') AS off_target FROM (SELECT p_partkey, {_KINDS_SAID} AS found FROM (SELECT p_partkey, lower({_OFFER}) AS t FROM part))")
def employment(spark, sf_dir):
    found = detect.detect_employment(F.expr(_OFFER))
    return read(spark, sf_dir, "part").select("p_partkey", found.alias("f")).select("p_partkey", F.array_join("f", ",").alias("found"), detect.employment_off_target(F.col("f"), ["b2b"]).alias("off_target"))


@query(f"""SELECT p_partkey, found <> '' AND (NOT regexp_matches(found, '(^|,)(part_time|full_time|b2b)(,|$)') OR (regexp_matches(found, '(^|,)full_time(,|$)') AND NOT regexp_matches(found, '(^|,)part_time(,|$)'))) AS off_target
FROM (SELECT p_partkey, {_KINDS_SAID} AS found FROM (SELECT p_partkey, lower({_OFFER}) AS t FROM part))""")
def employment_part_time(spark, sf_dir):
    """Where part time is sought, full time alone is off target, though full time itself is accepted too."""
    found = detect.detect_employment(F.expr(_OFFER))
    return read(spark, sf_dir, "part").select("p_partkey", detect.employment_off_target(found, ["part_time", "full_time", "b2b"]).alias("off_target"))


_WHERE = "CASE p_partkey % 5 WHEN 0 THEN 'Krakow (hybrid)' WHEN 1 THEN 'Warszawa (Office)' ELSE 'Berlin' END"
_HOW = "CASE p_partkey % 5 WHEN 0 THEN 'we are fully remote' WHEN 2 THEN '100% Remote team' WHEN 3 THEN 'remote, 3 days in the office' ELSE p_name END"
_MARKS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {q(p)}) THEN '{k}' END" for k, p in detect.ARRANGEMENT.items()) + "], lambda x: x IS NOT NULL), ',')"


@query(f"""SELECT p_partkey, CASE tag WHEN '' THEN {_MARKS} WHEN 'remote' THEN tag WHEN 'hybrid' THEN tag ELSE 'on_site' END AS found
FROM (SELECT p_partkey, regexp_extract(lower({_WHERE}), {q(detect.PLACE_TAG)}, 1) AS tag, lower({_WHERE}) || ' ' || lower({_HOW}) AS t FROM part)""")
def arrangement(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(detect.detect_work_arrangement(F.expr(_WHERE), F.expr(_HOW)), ",").alias("found"))


_TITLED = "CASE p_partkey % 6 WHEN 0 THEN 'Tech Lead ' WHEN 1 THEN 'Sr. ' WHEN 2 THEN 'Medior ' WHEN 3 THEN 'Head of ' WHEN 4 THEN 'Entry-level ' ELSE 'Leader ' END || p_name"
_TERMS = sorted(detect.SENIORITY, key=len, reverse=True)


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(t, {q(sql_word(x))}) THEN '{detect.SENIORITY[x]}'" for x in _TERMS) + f" END AS band FROM (SELECT p_partkey, lower({_TITLED}) AS t FROM part)")
def seniority(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", detect.detect_seniority(F.expr(_TITLED)).alias("band"))


_POSTING = r"(?i)\b(responsibilit|requirements?|qualifications?|what you.ll do|about (the|this) role|apply (now|for this)|we are looking for|job description)\b"
_BODY = r"html"
for _tag in ("script", "style", "noscript"):
    _BODY = rf"regexp_replace({_BODY}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>', ' ', 'g')"
_SAYS = "CASE page_id % 4 WHEN 0 THEN '<p>No longer accepting applications</p>' WHEN 1 THEN '<p>Job description</p>' WHEN 2 THEN '<script>apply now</script>' ELSE '' END"


@query(rf"""SELECT page_id, CASE WHEN regexp_matches(lower(body), '{"|".join(detect.EXPIRED)}') THEN 'stale' WHEN length(trim(body)) > 400 AND regexp_matches(body, '{_POSTING}') THEN 'live' ELSE 'none' END AS verdict
FROM (SELECT page_id, regexp_replace({_BODY}, '<[^>]+>', ' ', 'g') AS body FROM (SELECT page_id, {_SAYS} || html AS html FROM pages))""")
def body_verdict(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.coalesce(detect.body_verdict(F.concat(F.expr(_SAYS), F.col("html"))), F.lit("none")).alias("verdict"))


@query("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'unverifiable_direct' WHEN 1 THEN 'stale' WHEN 2 THEN 'stale' WHEN 3 THEN 'stale' WHEN 4 THEN 'live' WHEN 5 THEN 'live' WHEN 6 THEN 'unverifiable_direct' ELSE 'unverifiable_direct' END AS verdict FROM pages""")
def liveness_table(spark, sf_dir):
    k = F.col("page_id") % 8
    status = F.when(k == 0, None).when(k == 2, 404).when(k == 5, 403).when(k == 6, 403).when(k == 7, 500).otherwise(200)
    url = F.lit("https://jobs.example.com/board/posting-1234")
    final = F.when(k == 1, "https://elsewhere.example.org/x").when(k == 3, "https://jobs.example.com/jobs").otherwise(url)
    good = F.concat(F.lit("<p>Job description</p>"), F.repeat(F.lit("word "), 100))
    html, rendered = F.when(k == 4, good).otherwise(F.lit("")), F.when(k == 5, good).otherwise(F.lit(""))
    return read(spark, sf_dir, "pages").select("page_id", detect.liveness(url, status, final, html, rendered).alias("verdict"))


# --- pay -------------------------------------------------------------------------------------------------------------

FLOOR = salary.Floor(2500, "EUR", "month", "net", 0.83)
_PAY = "CASE c_custkey % 5 WHEN 0 THEN 'pays ' || CAST(1000 + c_custkey * 3 AS STRING) || ' - ' || CAST(2000 + c_custkey * 5 AS STRING) || ' EUR per month' WHEN 1 THEN CAST(10000 + c_custkey AS STRING) || ' PLN' WHEN 2 THEN '$' || CAST(20 + c_custkey % 90 AS STRING) || '/hour net' WHEN 3 THEN 'up to ' || CAST(40 + c_custkey % 70 AS STRING) || 'k GBP a year' ELSE 'pay by agreement' END"


@query("""
WITH p AS (SELECT c_custkey, c_custkey % 5 AS k,
  CASE c_custkey % 5 WHEN 0 THEN 2000 + c_custkey * 5 WHEN 1 THEN 10000 + c_custkey WHEN 2 THEN 20 + c_custkey % 90 WHEN 3 THEN (40 + c_custkey % 70) * 1000 END::DOUBLE AS amount,
  CASE c_custkey % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'PLN' WHEN 2 THEN 'USD' WHEN 3 THEN 'GBP' END AS currency FROM customer),
e AS (SELECT *, CASE k WHEN 0 THEN 'month' WHEN 2 THEN 'hour' WHEN 3 THEN 'year' WHEN 1 THEN CASE WHEN amount * 0.235::DOUBLE >= 30000 THEN 'year' WHEN amount * 0.235::DOUBLE >= 1200 THEN 'month' WHEN amount * 0.235::DOUBLE >= 150 THEN 'day' ELSE 'hour' END END AS period FROM p),
m AS (SELECT *, amount * CASE period WHEN 'hour' THEN 160::DOUBLE WHEN 'day' THEN 20::DOUBLE WHEN 'month' THEN 1::DOUBLE WHEN 'year' THEN 0.08333::DOUBLE END / CASE WHEN k = 2 THEN 0.83::DOUBLE ELSE 1::DOUBLE END
  * CASE currency WHEN 'EUR' THEN 1::DOUBLE WHEN 'PLN' THEN 0.235::DOUBLE WHEN 'USD' THEN 0.92::DOUBLE WHEN 'GBP' THEN 1.17::DOUBLE END / 3012.05::DOUBLE AS share FROM e)
SELECT c_custkey, amount AS amount_max, currency, period, CASE WHEN share IS NULL THEN 'unparseable' WHEN share >= 1.1::DOUBLE THEN 'clears' WHEN share <= 0.9::DOUBLE THEN 'below_floor' ELSE 'borderline' END AS status FROM m
""")
def salary_assess(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", salary.parse(F.expr(_PAY)).alias("p"))
    period = F.coalesce("p.period", salary.infer_period(F.col("p.amount_max"), F.col("p.currency")))
    return c.select("c_custkey", F.col("p.amount_max").alias("amount_max"), F.col("p.currency").alias("currency"), period.alias("period"), salary.assess(F.col("p"), FLOOR).alias("status"))


# --- telemetry -------------------------------------------------------------------------------------------------------

def telemetry(spark, sf_dir):
    """A run a day, eight platforms for each kind of event. By platform: 0 brings nothing in the last run, though it answers; 1 is
    down in the last four; 2 brings one row in the last; 3 never brings any."""
    e = read(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("run_at"), "event_type", (F.col("user_id") % 8).alias("k"))
    runs = e.groupBy("run_at", F.concat_ws("-", "event_type", "k").alias("platform"), "k").agg(F.count(F.lit(1)).alias("raw"))
    back = F.datediff("last", "run_at")
    down = (F.col("k") == 1) & (back < 4)
    raw = F.when(down | (F.col("k") == 3) | ((F.col("k") == 0) & (back == 0)), 0).when((F.col("k") == 2) & (back == 0), 1).otherwise(F.col("raw"))
    return runs.crossJoin(F.broadcast(e.agg(F.max("run_at").alias("last")))).select("run_at", "platform", raw.alias("raw"), down.alias("source_down"), (~down).alias("http_ok"))


_TELEMETRY = """SELECT run_at, platform, CASE WHEN down OR k = 3 OR (k = 0 AND back = 0) THEN 0 WHEN k = 2 AND back = 0 THEN 1 ELSE raw END AS raw, down AS source_down, NOT down AS http_ok
 FROM (SELECT *, k = 1 AND back < 4 AS down FROM (SELECT date_trunc('day', ts) AS run_at, event_type || '-' || user_id % 8 AS platform, user_id % 8 AS k, count(*) AS raw,
 date_diff('day', date_trunc('day', ts), (SELECT max(date_trunc('day', ts)) FROM events)) AS back FROM events GROUP BY ALL))"""
_TRAIL = f"SELECT t.*, r.pos, (SELECT count(*) FROM (SELECT DISTINCT date_trunc('day', ts) FROM events ORDER BY 1 DESC LIMIT 12)) AS runs FROM ({_TELEMETRY}) t JOIN (SELECT run_at, row_number() OVER (ORDER BY run_at DESC) AS pos FROM (SELECT DISTINCT date_trunc('day', ts) AS run_at FROM events) QUALIFY pos <= 12) r ON t.run_at = r.run_at"
_PLATFORM = f"""SELECT platform, count_if(pos = 1) AS present, max(CASE WHEN pos = 1 THEN raw END) AS raw, median(CASE WHEN pos > 1 AND raw > 0 AND NOT source_down THEN raw END)::DOUBLE AS prior_median,
 coalesce(min(CASE WHEN NOT (source_down AND NOT http_ok) THEN pos END) - 1, max(runs)) AS down_streak, count(*) AS appearances, max(raw) AS most_raw,
 coalesce(bool_or(CASE WHEN pos = 1 THEN source_down END), false) AS source_down, coalesce(bool_or(CASE WHEN pos = 1 THEN http_ok END), false) AS http_ok, bool_or(http_ok) AS ever_ok FROM ({_TRAIL}) GROUP BY 1"""
T = health.Thresholds(window=12)


def sql_findings(active: str = "true") -> str:
    systemic = f"(SELECT count_if(present > 0) >= 4 AND count_if(present > 0 AND (source_down OR raw = 0)) >= 0.7::DOUBLE * count_if(present > 0) FROM ({_PLATFORM}) WHERE {active})"
    alone = f"NOT {systemic}"
    return f"""SELECT platform, flag FROM (SELECT platform, CASE WHEN {alone} AND present > 0 AND http_ok AND raw = 0 AND prior_median >= 3 THEN 'SELECTOR_SUSPECT' WHEN {alone} AND present > 0 AND down_streak >= 4 THEN 'DOWN_STREAK'
 WHEN {alone} AND raw > 0 AND NOT source_down AND prior_median >= 3 AND raw < 0.15::DOUBLE * prior_median THEN 'YIELD_COLLAPSE' WHEN ({active}) AND appearances >= 4 AND most_raw = 0 AND ever_ok THEN 'NEVER_PRODUCED' END AS flag FROM ({_PLATFORM})) p
 WHERE flag IS NOT NULL UNION ALL SELECT '*', 'SYSTEMIC' WHERE {systemic}"""


@query(f"SELECT platform, present, raw, prior_median, down_streak, appearances, most_raw FROM ({_PLATFORM})")
def health_platforms(spark, sf_dir):
    return health.per_platform(telemetry(spark, sf_dir), T).select("platform", "present", "raw", "prior_median", F.col("down_streak").cast("long").alias("down_streak"), "appearances", "most_raw")


@query(sql_findings())
def health_findings(spark, sf_dir):
    return health.findings(telemetry(spark, sf_dir), T)


_KINDS = ("click", "error", "purchase", "signup", "view")
_FEW = [f"{kind}-{k}" for kind in _KINDS for k in (0, 1, 3)]


@query(sql_findings("regexp_matches(platform, '-[013]$')"))
def health_systemic(spark, sf_dir):
    """Most of the platforms that count are without rows: single outages are not listed then."""
    return health.findings(telemetry(spark, sf_dir), T, _FEW)


@query(f"SELECT flag, count(*) AS n FROM ({sql_findings()}) GROUP BY 1")
def health_finding_counts(spark, sf_dir):
    return health.finding_counts(health.findings(telemetry(spark, sf_dir), T))


@query("""SELECT event_id, CASE WHEN prev IS NULL THEN 24::DOUBLE ELSE greatest(epoch_us(ts) - epoch_us(prev), 0) / 3600000000::DOUBLE END AS hours,
 greatest(50, least(1300, CAST(ceil(floor(CASE WHEN prev IS NULL THEN 24::DOUBLE ELSE greatest(epoch_us(ts) - epoch_us(prev), 0) / 3600000000::DOUBLE END * 100 * 1.5::DOUBLE) / 20) AS INT))) AS pages
FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)""")
def scan_gap(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("prev", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    h = health.gap_hours(F.col("prev"), F.col("ts"))
    return e.select("event_id", h.alias("hours"), health.pages_for_gap(h).alias("pages"))


@query("SELECT count_if(ts > (SELECT max(ts) FROM events WHERE event_type = 'purchase')) AS since, count_if(ts > (SELECT max(ts) FROM events WHERE event_type = 'purchase')) >= 5 AS due FROM events")
def review_due(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("ts").alias("run_at"), "event_type")
    return health.due_review(e, e.where("event_type = 'purchase'"), 5)


# --- state -----------------------------------------------------------------------------------------------------------

VERDICT = "CASE event_type WHEN 'error' THEN 'unverifiable' WHEN 'click' THEN 'stale' ELSE 'live' END"
_SWEEP = f"""SELECT event_id, verdict, CASE WHEN verdict = 'unverifiable' THEN row_number() OVER (PARTITION BY user_id, island, verdict ORDER BY ts, event_id) ELSE 0 END AS streak FROM
 (SELECT *, sum(CASE WHEN verdict <> 'unverifiable' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, {VERDICT} AS verdict FROM events))"""


def checks(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumn("verdict", F.expr(VERDICT))


@query(f"SELECT event_id, streak, streak = 2 AS escalated FROM ({_SWEEP})")
def sweep_state(spark, sf_dir):
    return state.sweep_states(checks(spark, sf_dir), "user_id", ["ts", "event_id"]).select("event_id", "streak", "escalated")


@query(f"SELECT count(*) AS checked, count_if(verdict = 'stale') AS stale, count_if(verdict = 'live') AS live, count_if(verdict = 'unverifiable') AS unverifiable, count_if(streak = 2) AS escalated FROM ({_SWEEP})")
def sweep_counters(spark, sf_dir):
    return state.sweep_counters(state.sweep_states(checks(spark, sf_dir), "user_id", ["ts", "event_id"]))


_STATUS = "CASE event_type WHEN 'error' THEN 500 WHEN 'click' THEN 404 ELSE 200 END"
_NAMED = _SWEEP.replace("'unverifiable'", "'unverifiable_direct'")


@query(f"SELECT event_id, verdict, streak, streak = 2 AS escalated FROM ({_NAMED})")
def sweep_of_liveness(spark, sf_dir):
    """Link checks judged by what a fetch brought, and their verdicts through the sweep."""
    url, good = F.lit("https://jobs.example.com/board/posting-1234"), F.concat(F.lit("<p>Job description</p>"), F.repeat(F.lit("word "), 100))
    judged = read(spark, sf_dir, "events").withColumn("verdict", detect.liveness(url, F.expr(_STATUS), url, good))
    return state.sweep_states(judged, "user_id", ["ts", "event_id"]).select("event_id", "verdict", "streak", "escalated")


_LAST = "TIMESTAMP '2024-01-20'"


@query(f"""WITH s AS (SELECT user_id, max(ts) AS m, count_if(event_type = 'error') % 3 AS streak FROM events WHERE ts < {_LAST} GROUP BY 1),
v AS (SELECT user_id, min(CASE event_type WHEN 'error' THEN 'unverifiable_direct' WHEN 'click' THEN 'stale' ELSE 'live' END) AS verdict FROM events WHERE ts >= {_LAST} GROUP BY 1),
d AS (SELECT c_custkey, coalesce(m > {_LAST} - INTERVAL 24 HOUR, false) AS deferred, coalesce(streak, 0) AS streak, verdict FROM customer LEFT JOIN s ON s.user_id = c_custkey LEFT JOIN v ON v.user_id = c_custkey)
SELECT count(*) AS scope, count_if(deferred) AS deferred, count_if(NOT deferred) AS checked, count_if(NOT deferred AND verdict = 'stale') AS stale, count_if(NOT deferred AND verdict = 'live') AS live,
count_if(NOT deferred AND coalesce(verdict, '') NOT IN ('stale', 'live')) AS unverifiable, count_if(NOT deferred AND coalesce(verdict, '') NOT IN ('stale', 'live') AND streak = 1) AS escalated FROM d""")
def sweep_run_counters(spark, sf_dir):
    """One sweep over all customers as records: who is due, what their checks told, who is escalated."""
    e, now = read(spark, sf_dir, "events").withColumnRenamed("user_id", "url_key"), F.lit("2024-01-20").cast("timestamp")
    before = e.where(F.col("ts") < now).groupBy("url_key").agg(F.max("ts").alias("last_checked"), (F.count_if(F.col("event_type") == "error") % 3).alias("unverifiable_streak"))
    verdicts = e.where(F.col("ts") >= now).select("url_key", F.expr("CASE event_type WHEN 'error' THEN 'unverifiable_direct' WHEN 'click' THEN 'stale' ELSE 'live' END AS verdict"))
    return state.sweep_run(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url_key")), before, verdicts, now)[1]


@query("SELECT c_custkey, coalesce(m > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR, false) AS deferred FROM customer LEFT JOIN (SELECT user_id, max(ts) AS m FROM events GROUP BY 1) e ON e.user_id = c_custkey")
def due_deferred(spark, sf_dir):
    last = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("last_checked"))
    return state.due(read(spark, sf_dir, "customer").select("c_custkey"), last, "c_custkey", F.lit("2024-01-30 12:00:00").cast("timestamp")).select("c_custkey", "deferred")


PRIORITY = {"purchase": 4, "signup": 3, "click": 2}


@query("SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 ELSE 0 END DESC, event_id) = 1")
def reason_priority(spark, sf_dir):
    return state.best_reason(read(spark, sf_dir, "events"), "user_id", "event_type", "event_id", PRIORITY)


TARGETS = {"1-URGENT": "applied", "2-HIGH": "passed", "3-MEDIUM": "dropped"}
RANKS = {"1-URGENT": 2, "2-HIGH": 4, "3-MEDIUM": 3, "5-LOW": 3}


@query("""WITH b AS (SELECT o_custkey AS custkey, o_orderpriority AS reason FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 3 ELSE 0 END DESC, o_orderkey) = 1)
SELECT custkey, reason, CASE reason WHEN '1-URGENT' THEN 'applied' WHEN '2-HIGH' THEN 'passed' ELSE 'dropped' END AS target, CASE WHEN c_custkey IS NULL THEN 'unmatched' WHEN c_mktsegment = 'BUILDING' THEN 'resolved' ELSE 'already' END AS outcome
FROM b LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) ON c_custkey = custkey WHERE reason IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def resolution_outcome(spark, sf_dir):
    external = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("reason"), "o_orderkey")
    log = read(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    return state.resolutions(external, log, "custkey", "reason", "o_orderkey", RANKS, TARGETS, "c_mktsegment", "BUILDING")


@query("SELECT count_if(s IS NULL) AS unmatched, count_if(s = 1) AS already, count_if(s = 0) AS backfilled FROM customer LEFT JOIN (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS s FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey")
def tracker_reconcile(spark, sf_dir):
    log = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return state.reconcile_counts(read(spark, sf_dir, "customer").select("c_custkey"), log, "c_custkey", "o_orderstatus", "F")


@query("SELECT line, CASE WHEN min(side) = 0 THEN 0 ELSE 1 END AS side, min(ord) FILTER (side = s0) AS ord FROM (SELECT *, min(side) OVER (PARTITION BY line) AS s0 FROM (SELECT o_orderpriority || '|' || o_custkey AS line, 0 AS side, o_orderkey AS ord FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT o_orderpriority || '|' || o_custkey, 1, o_orderkey FROM orders WHERE o_orderstatus <> 'F')) GROUP BY 1")
def log_union_distinct(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.concat_ws("|", "o_orderpriority", "o_custkey").alias("line"), F.col("o_orderkey").alias("ord"), "o_orderstatus")
    return state.union_lines(o.where("o_orderstatus <> 'O'"), o.where("o_orderstatus <> 'F'"))


@query("SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(a.v, b.v) AS v FROM (SELECT o_orderkey, 'ours ' || o_orderpriority AS v FROM orders WHERE o_orderstatus <> 'O') a FULL JOIN (SELECT o_orderkey, 'theirs ' || o_orderpriority AS v FROM orders WHERE o_orderstatus <> 'F') b ON a.o_orderkey = b.o_orderkey")
def ledger_merge(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    side = lambda name, status: o.where(F.col("o_orderstatus") != status).select("o_orderkey", F.concat(F.lit(f"{name} "), "o_orderpriority").alias("v"))
    return state.merge_ledgers(side("ours", "O"), side("theirs", "F"), ["o_orderkey"], ["v"])


@query("""SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN 'removed' ELSE 'changed' END AS change, CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 6 = 0 THEN 'p_brand,p_size' WHEN p_partkey % 3 = 0 THEN 'p_brand' ELSE 'p_size' END AS fields
FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 3 = 0 OR p_partkey % 2 = 0""")
def frame_diff(spark, sf_dir):
    old = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    new = old.where("p_partkey % 11 <> 0").withColumn("p_brand", F.when(F.col("p_partkey") % 3 == 0, "other").otherwise(F.col("p_brand"))).withColumn("p_size", F.when(F.col("p_partkey") % 2 == 0, None).otherwise(F.col("p_size")))
    return state.frame_diff(old, new, ["p_partkey"], ["p_brand", "p_size", "p_name"]).select("p_partkey", "change", F.array_join("fields", ",").alias("fields"))


_OLD_DOC = "to_json(named_struct('name', p_name, 'quirks', '', 'dims', named_struct('brand', p_brand, 'type', p_type), 'boards', array(named_struct('id', 1, 'tier', p_size, 'urls', array(p_type)), named_struct('id', 2, 'tier', 1, 'urls', array()))))"
_NEW_DOC = """to_json(named_struct('name', p_name, 'dims', named_struct('type', p_type, 'brand', IF(p_partkey % 3 = 0, 'other', p_brand)),
 'boards', IF(p_partkey % 5 = 0, array(named_struct('id', 1, 'tier', p_size, 'urls', array(p_type))), array(named_struct('id', 2, 'tier', 1, 'urls', array()), named_struct('id', 1, 'tier', IF(p_partkey % 4 = 0, 99, p_size), 'urls', array(p_type, 'more'))))))"""


@query("""SELECT p_partkey, 'dims.brand' AS path, p_brand AS old, 'other' AS new, NULL AS note FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'boards[1].tier', p_size::VARCHAR, '99', NULL FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 4 = 0
UNION ALL SELECT p_partkey, 'boards[1].urls', '["' || p_type || '"]', '["' || p_type || '","more"]', 'urls grow' FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, 'boards[2].' || k, v, NULL, 'board 2 has closed' FROM part, (VALUES ('id', '2'), ('tier', '1')) x(k, v) WHERE p_partkey % 5 = 0""")
def nested_diff(spark, sf_dir):
    """Two versions of nested documents, whose lists of boards are matched by id; some differences are as they should be."""
    p = read(spark, sf_dir, "part")
    old, new = p.select("p_partkey", F.expr(_OLD_DOC).alias("doc")), p.select("p_partkey", F.expr(_NEW_DOC).alias("doc"))
    return state.nested_diff(old, new, ["p_partkey"], "doc", {r"boards\[2\]\..*": "board 2 has closed", r"boards\[\d+\]\.urls": "urls grow"})


@query("SELECT count_if(p_partkey % 5 <> 0) + 2 * count_if(p_partkey % 5 = 0) AS accepted, count_if(p_partkey % 3 = 0) + count_if(p_partkey % 5 <> 0 AND p_partkey % 4 = 0) AS problems, false AS parity FROM part")
def nested_parity(spark, sf_dir):
    return state.parity(nested_diff(spark, sf_dir))


@query(r"""SELECT role AS kind, lower(w) AS value, count(*) AS frequency, array_to_string(list_sort(list(DISTINCT CAST(turn AS VARCHAR))), ',') AS sources, min(conv_id) AS first_seen, max(conv_id) AS last_seen
FROM (SELECT conv_id, turn, role, unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM conversations) GROUP BY 1, 2""")
def suggestion_merge(spark, sf_dir):
    """Words of some conversations merged into a table of those of the others: as if all had come at once."""
    words = read(spark, sf_dir, "conversations").select(F.col("role").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("value"), F.col("turn").cast("string").alias("source"), F.col("conv_id").alias("day"))
    late = F.col("day") % 3 == 0
    return state.merge_suggestions(state.upsert_suggestions(words.where(~late)), words.where(late)).withColumn("sources", F.array_join("sources", ","))


@query(r"""SELECT role AS kind, lower(w) AS value, count(*) AS frequency, array_to_string(list_sort(list(DISTINCT CAST(turn AS VARCHAR))), ',') AS sources, min(conv_id) AS first_seen, max(conv_id) AS last_seen
FROM (SELECT conv_id, turn, role, unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM conversations) GROUP BY 1, 2""")
def suggestion_upsert(spark, sf_dir):
    words = read(spark, sf_dir, "conversations").select(F.col("role").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("value"), F.col("turn").cast("string").alias("source"), F.col("conv_id").alias("day"))
    return state.upsert_suggestions(words).withColumn("sources", F.array_join("sources", ","))


# --- external table --------------------------------------------------------------------------------------------------

@query("""SELECT doc_id, CASE WHEN r IS NULL THEN 'create' WHEN r = 1 THEN 'skip_resolved' ELSE 'refresh' END AS action FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS r FROM labels GROUP BY 1) USING (doc_id)""")
def sync_action(spark, sf_dir):
    return sync.actions(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id", F.col("toxic") == 1).select("doc_id", "action")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Applied' WHEN 'O' THEN 'User Declined' ELSE 'Filtered Out' END AS reason, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS archetype FROM orders""")
def sync_properties(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "applied").when(F.col("o_orderstatus") == "O", "passed").otherwise("else").alias("status"), F.col("o_orderpriority").alias("archetype"))
    return sync.properties(o, allowed=["1-URGENT", "2-HIGH"]).select("o_orderkey", "reason", "archetype")


@query("SELECT DISTINCT p_brand AS option FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 3 AND p_type = 'ECONOMY')")
def missing_options(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return sync.missing_options(p.select(F.col("p_brand").alias("option")), p.where("p_size < 3 AND p_type = 'ECONOMY'").select(F.col("p_brand").alias("option")).distinct())


@query("SELECT 'Country' AS name, 'missing property' AS problem UNION ALL SELECT 'NATION_3', 'wrong type'")
def schema_gaps(spark, sf_dir):
    have = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("text").alias("type"))
    wanted = spark.createDataFrame([("Country", "select"), ("NATION_3", "select"), ("NATION_4", "text")], "name string, type string")
    return sync.schema_gaps(have, wanted)


@query("SELECT p_partkey FROM part WHERE p_partkey % 13 = 0 OR p_partkey % 17 = 0")
def written_wrong(spark, sf_dir):
    sent = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    back = sent.where("p_partkey % 13 <> 0").withColumn("p_name", F.when(F.col("p_partkey") % 17 == 0, None).otherwise(F.col("p_name")))
    return sync.written_wrong(sent, back, ["p_partkey"], ["p_name"])


@query("SELECT doc_id, left(text, 1500) AS jd_text, left(sha256('https://www.site.example/doc/' || doc_id || '/?utm=x'), 16) AS jd_cache FROM documents")
def candidate_file(spark, sf_dir):
    return sync.candidate_file(candidates(spark, sf_dir)).select("doc_id", "jd_text", "jd_cache")


# --- what judgement asks for -----------------------------------------------------------------------------------------

@query("SELECT sha256(text) AS key, min(doc_id) AS doc_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(DISTINCT source) >= 2 AS confirmed FROM documents GROUP BY 1")
def cross_source_merge(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key"), "doc_id", "source")
    return state.merge_across_sources(d, "key", "source", "doc_id", ["doc_id"]).withColumn("sources", F.array_join("sources", ","))


@query("SELECT o_custkey, o_orderpriority, count(DISTINCT o_orderstatus) AS places, count(*) AS n FROM orders GROUP BY 1, 2 HAVING places >= 2")
def clone_groups(spark, sf_dir):
    return state.clone_groups(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderstatus")


@query("SELECT source, count_if(toxic = 0) AS hits, count_if(toxic IS NOT NULL) AS total, CASE WHEN count_if(toxic IS NOT NULL) > 0 THEN count_if(toxic = 0) / count_if(toxic IS NOT NULL) END AS rate FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id) GROUP BY 1")
def conversion_by_source(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return state.rates(read(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left"), "source", F.col("toxic") == 0, F.col("toxic").isNotNull())


@query("SELECT event_type AS keyword, user_id % 5 AS status, count(*) AS n FROM events GROUP BY 1, 2")
def keyword_outcomes(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("keyword"), (F.col("user_id") % 5).alias("status")).agg(F.count(F.lit(1)).alias("n"))


# --- the whole -------------------------------------------------------------------------------------------------------

TITLE_WORDS = ("the", "and", "der", "die", "que", "les", "est")
TRIAGE_PROFILE = Profile(keywords=TITLE_WORDS, latest_end_local="18:00")
_TITLE = "lower(array_to_string(list_slice(string_split(text, ' '), 1, 8), ' '))"


_NEW = f"""WITH k AS ({_KEYED}), s AS ({_SEEN}), f AS ({SQL_FILTERED}), t AS (SELECT f.*, k.company_key, CASE
 WHEN drop_reason IS NOT NULL THEN {SQL_PARAM} WHEN doc_id % {EVERY} = {PHRASES.index("Apply at https://jobs.lever.co/acme/42.")} OR doc_id % 11 = 0 THEN 'stale' ELSE '' END AS param FROM f JOIN k USING (doc_id)
WHERE ({" OR ".join(f"contains({_TITLE}, '{w}')" for w in TITLE_WORDS)}) AND k.url_key NOT IN (SELECT url_key FROM s)
 AND lower(f.source) || '|' || {sql_norm(chr(97) + 'rray_to_string(list_slice(string_split(f.text, chr(32)), 1, 8), chr(32))')} || '|' NOT IN (SELECT regexp_replace(key, '[a-z]*$', '') FROM s))"""


def triaged(spark, sf_dir):
    """Candidates through title, history, patterns, the read cap, link checks and prior history. A link is gone for every
    eleventh id, and for what is said to be posted at one address."""
    seen = seen_log(spark, sf_dir).withColumn("key", text.make_key(F.col("company"), F.col("title"), F.col("loc")))
    seen = seen.withColumns({"family": text.role_family(F.col("title")), "status": F.when(F.col("toxic") == 0, "applied").otherwise("dropped")})
    rows = postings(spark, sf_dir)
    gone = rows.where("doc_id % 11 = 0").select("url", F.lit("stale").alias("verdict"))
    other = spark.createDataFrame([("https://jobs.lever.co/acme/42", "stale")], "url string, verdict string")
    return triage_plan.triage(rows, seen, TRIAGE_PROFILE, F.lit("2024-01-01").cast("timestamp"), verdicts=gone.unionByName(other))


@query(_NEW + " SELECT source AS platform, param, count(*) AS n FROM t GROUP BY 1, 2")
def triage_funnel(spark, sf_dir):
    """The flagship: candidates through the whole triage, counted by platform and filter."""
    rows = triaged(spark, sf_dir)
    return rows.groupBy("platform", F.coalesce(filters.drop_param(F.col("drop_reason")), F.lit("")).alias("param")).agg(F.count(F.lit(1)).alias("n"))


@query(_NEW + """, c AS (SELECT company_key, list_slice(list(doc_id ORDER BY doc_id), 1, 8) AS ids, count(*) AS n FROM s WHERE company_key <> '' GROUP BY 1)
 SELECT doc_id, coalesce(len(ids), 0) AS n_prior, CASE WHEN param <> '' THEN NULL WHEN length(text) + length(phrase) > 400 THEN 'from_enumeration' ELSE 'deferred' END AS jd_status,
 CASE WHEN param <> '' THEN NULL ELSE 'unverified' END AS link_status FROM (SELECT *, """ + SQL_PHRASE + """ AS phrase FROM t) LEFT JOIN c USING (company_key) WHERE param IN ('', 'stale')""")
def triage_history(spark, sf_dir):
    """What the triage knows of the postings that no pattern drops: records of the company, how the body was had, the link."""
    rows = triaged(spark, sf_dir).where("drop_reason IS NULL OR drop_reason = 'stale'")
    status = F.when(F.col("drop_reason").isNull(), F.col("jd_status"))
    return rows.select("doc_id", F.coalesce(F.size("prior"), F.lit(0)).cast("long").alias("n_prior"), status.alias("jd_status"), "link_status")


@query(_NEW + """, n AS (SELECT param, count(*) AS n FROM t WHERE param <> '' GROUP BY 1) SELECT (SELECT count(*) FROM t) AS funnel_in, (SELECT count(*) FROM t WHERE param = '') AS new,
 (SELECT count(*) FROM t WHERE param <> '') AS dropped, (SELECT count(*) FROM t WHERE param = 'stale') AS link_dead, coalesce((SELECT string_agg(param || ':' || n, ',' ORDER BY param) FROM n), '') AS drops,
 coalesce((SELECT string_agg(param, ',' ORDER BY param) FROM n WHERE n >= 0.4 * (SELECT count(*) FROM t)), '') AS nudges, (SELECT count(*) FROM t WHERE source = 'web') AS web""")
def run_counters(spark, sf_dir):
    """The run's record, gathered while the candidates are written once (here to no place)."""
    counters = triage_plan.RunCounters(TRIAGE_PROFILE, [("web", 1, 1), ("nowhere", 2, 0)])
    counters.watch(triaged(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    r = counters.record()
    row = (*(r[k] for k in ("funnel_in", "new", "dropped", "link_dead")), ",".join(f"{d['param']}:{d['n']}" for d in r["drop_by_param"]), ",".join(r["drop_nudges"]), next(s["raw"] for s in r["platform_stats"] if s["platform"] == "web"))
    return spark.createDataFrame([row], "funnel_in long, new long, dropped long, link_dead long, drops string, nudges string, web long")


_READ_CAP = 25
_OPEN = f"""WITH f AS ({SQL_FILTERED}), o AS (SELECT f.*, 'https://www.site.example/doc/' || doc_id || '/?utm=x' AS url FROM f WHERE drop_reason IS NULL AND ({" OR ".join(f"contains({_TITLE}, '{w}')" for w in TITLE_WORDS)}))"""


@query(_OPEN + f""", w AS (SELECT doc_id, row_number() OVER (ORDER BY source, url) AS nr FROM o WHERE length(text || {SQL_PHRASE}) <= 400)
 SELECT doc_id, CASE WHEN nr IS NULL THEN 'from_enumeration' WHEN nr > {_READ_CAP} THEN 'deferred' WHEN doc_id % 3 = 0 THEN 'fetched' ELSE 'fetch_failed' END AS jd_status,
 CASE WHEN nr <= {_READ_CAP} AND doc_id % 3 = 0 THEN 'A page of ' || doc_id ELSE text || {SQL_PHRASE} END AS jd_text, CASE WHEN nr <= {_READ_CAP} AND doc_id % 3 = 0 THEN 'https://jobs.lever.co/acme/' || doc_id END AS source_url
 FROM o LEFT JOIN w USING (doc_id)""")
def triage_reads(spark, sf_dir):
    """The triage with bodies read in full: short bodies up to the cap are asked for, a third of them come, with their sources."""
    rows = postings(spark, sf_dir)
    page = F.concat(F.lit('<a href="https://jobs.lever.co/acme/'), F.col("doc_id").cast("string"), F.lit('">source</a>'))
    reads = rows.where("doc_id % 3 = 0").select("url", F.concat(F.lit("A page of "), F.col("doc_id").cast("string")).alias("body"), page.alias("html"))
    profile = Profile(keywords=TITLE_WORDS, latest_end_local="18:00", read_cap=_READ_CAP)
    out = triage_plan.triage(rows, None, profile, F.lit("2024-01-01").cast("timestamp"), reads=reads)
    return out.where("drop_reason IS NULL").select("doc_id", "jd_status", "jd_text", "source_url")


@query(_OPEN + f""" SELECT doc_id, CASE WHEN length(body) > 3000 THEN 'long' END AS note_long_body, coalesce(length(body) > 3000, false) AS long_body,
 len(regexp_extract_all(body, '[0-9]{{4}}')) AS note_years, false AS years, nullif(regexp_extract(body, '[Pp]assport|clearance'), '') AS note_papers, regexp_matches(body, '[Pp]assport|clearance') AS papers
 FROM (SELECT *, text || {SQL_PHRASE} AS body FROM o)""")
def registered_detectors(spark, sf_dir):
    """Detectors that a user registers, from Columns and from SQL: notes, and flags beside the built-in ones."""
    detectors.register_detector("long_body", lambda body: F.when(F.length(body) > 3000, "long"))
    detectors.register_detector("years", lambda body: F.regexp_count(body, F.lit("[0-9]{4}")).cast("long"), flags=False)
    detectors.register_sql_detector(spark, "papers", "nullif(regexp_extract(body, '[Pp]assport|clearance', 0), '')")
    names = ("long_body", "years", "papers")
    profile = Profile(keywords=TITLE_WORDS, latest_end_local="18:00", detectors=names)
    out = triage_plan.triage(postings(spark, sf_dir), None, profile, F.lit("2024-01-01").cast("timestamp")).where("drop_reason IS NULL")
    return out.select("doc_id", *(f"note_{n}" for n in names), *(F.array_contains("flags", n).alias(n) for n in names))


_EMAIL, _PHONE, _STREET = (q(p) for p in validate.PERSONAL.values())


def _breach(section: str, rule: str, table: str, place: str, broken: str) -> str:
    return f"SELECT {q(section)} AS section, {q(rule)} AS rule, count(*) AS checked, count(*) FILTER (WHERE {broken}) AS breaches, min(CAST({place} AS VARCHAR)) FILTER (WHERE {broken}) AS first FROM {table}"


_PLATFORMS = "(SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_brand || '-' || p_partkey // 2 END AS slug, p_size % 3 = 0 AS active, p_size % 5 AS tier, CASE p_size % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' WHEN 2 THEN 'odd' END AS status FROM part)"


@query(" UNION ALL ".join([
    _breach("binding", "not empty", "documents", "doc_id", "coalesce(trim(text), '') = ''"),
    _breach("binding", "no email", "documents", "doc_id", f"regexp_matches(coalesce(text, '@'), {_EMAIL})"),
    _breach("binding", "no phone", "documents", "doc_id", f"regexp_matches(text, {_PHONE})"),
    _breach("binding", "no street_address", "documents", "doc_id", f"regexp_matches(text, {_STREET})"),
    _breach("platform", "slug", _PLATFORMS, "p_partkey", "slug IS NULL"),
    _breach("platform", "active has a tier", _PLATFORMS, "p_partkey", "active AND tier NOT IN (1, 2, 3)"),
    _breach("platform", "status", _PLATFORMS, "p_partkey", "status = 'odd'"),
    _breach("platform", "unverified is not active", _PLATFORMS, "p_partkey", "coalesce(status, '') = 'unverified' AND active"),
    f"SELECT 'platform', 'slug once', sum(n)::BIGINT, coalesce(sum(n - 1) FILTER (WHERE n > 1 AND slug IS NOT NULL), 0)::BIGINT, min(spot) FILTER (WHERE n > 1 AND slug IS NOT NULL) FROM (SELECT slug, count(*) AS n, min(CAST(p_partkey AS VARCHAR)) AS spot FROM {_PLATFORMS} GROUP BY 1)",
    _breach("suggestion", "keys", "supplier", "s_suppkey", "s_suppkey % 6 = 0"),
    _breach("suggestion", "kind", "supplier", "s_suppkey", "s_suppkey % 4 = 3"),
    _breach("suggestion", "value", "supplier", "s_suppkey", "s_suppkey % 5 = 0"),
    _breach("suggestion", "frequency", "supplier", "s_suppkey", "s_suppkey % 7 = 0"),
]))
def repository_rules(spark, sf_dir):
    """Texts, platforms and suggestions against what a repository must hold, all sections in one frame."""
    texts = read(spark, sf_dir, "documents").select(F.lit("binding").alias("section"), F.col("doc_id").cast("string").alias("place"), "text")
    part = read(spark, sf_dir, "part")
    size = F.col("p_size")
    platforms = part.select(
        "p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.concat_ws("-", "p_brand", F.floor(F.col("p_partkey") / 2).cast("string"))).alias("slug"),
        (size % 3 == 0).alias("active"), (size % 5).alias("tier_default"), F.when(size % 4 == 0, "verified").when(size % 4 == 1, "unverified").when(size % 4 == 2, "odd").alias("status"),
    )
    key = F.col("s_suppkey")
    suggested = read(spark, sf_dir, "supplier").select(
        "s_suppkey", F.get(F.array(*map(F.lit, (*validate.KINDS, "person"))), (key % 4).cast("int")).alias("kind"), F.when(key % 5 == 0, "a@b.example").otherwise(F.concat(F.lit("Term "), key.cast("string"))).alias("value"),
        F.when(key % 7 == 0, 0).when(key % 7 == 1, 3).alias("frequency"), F.when(key % 6 == 0, F.col("s_name")).alias("phone"),
    )
    rows = texts.unionByName(validate.entries(platforms, "platform", "p_partkey")).unionByName(validate.entries(suggested, "suggestion", "s_suppkey"))
    return validate.validate(rows).drop("examples")
