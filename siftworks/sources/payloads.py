"""Captured payloads to candidates. A payload row is (platform_ord, platform, page, payload); every parser returns CANDIDATE.

One frame of payloads may hold any sources: parse_all splits it by platform, and rows that can't be read bring nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import links_by_tree
from ..functions.text import caption_title_company, pick_title, slug_title, strip, text, text_of, unescape

CANDIDATE = ("platform_ord", "row_ord", "title", "company", "loc", "url", "platform", "posted_at", "salary", "jd_text")


def _candidates(rows: DataFrame, title: Column, company: Column, loc: Column, url: Column, posted: Column | None = None, salary: Column | None = None, body: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    opt = lambda c: none if c is None else F.nullif(c.cast("string"), F.lit(""))
    return rows.select("platform_ord", F.struct("page", "pos").alias("row_ord"), strip(text(title)).alias("title"), strip(text(company)).alias("company"), strip(text(loc)).alias("loc"), strip(text(url)).alias("url"), "platform", opt(posted).alias("posted_at"), opt(salary).alias("salary"), opt(body).alias("jd_text"))


def _json(payloads: DataFrame, schema: str, items: str) -> DataFrame:
    return payloads.withColumn("_p", F.from_json("payload", schema)).select("platform_ord", "platform", "page", F.col("_p").alias("whole"), F.posexplode(items).alias("pos", "j"))


def first_per_url(df: DataFrame, keep_last: bool = False) -> DataFrame:
    """One row a platform and url: the first, or with keep_last the last."""
    pick = F.max_by if keep_last else F.min_by
    rest = [c for c in df.columns if c not in ("platform", "url")]
    return df.groupBy("platform", "url").agg(pick(F.struct(*rest), F.col("row_ord")).alias("_r")).select("platform", "url", "_r.*").select(*df.columns)


def given(c: Column) -> Column:
    """Whether a JSON value, taken as text, is there and neither empty nor zero."""
    return ~text(c).isin("", "0", "0.0", "false")


def said(c: Column) -> Column:
    """A JSON value as it is written into a text: None where it is missing."""
    return F.coalesce(c, F.lit("None"))


def utc(seconds: Column) -> Column:
    """Seconds since 1970 as an ISO time with its offset, and with microseconds if there is a fraction."""
    t = F.timestamp_seconds(seconds)
    fraction = F.when(F.date_format(t, "SSSSSS") != "000000", F.date_format(t, ".SSSSSS")).otherwise(F.lit(""))
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def remotive(p: DataFrame) -> DataFrame:
    j = _json(p, "jobs array<struct<title:string,company_name:string,candidate_required_location:string,url:string,publication_date:string,salary:string,description:string>>", "_p.jobs")
    return _candidates(j, F.col("j.title"), F.col("j.company_name"), F.col("j.candidate_required_location"), F.col("j.url"), F.col("j.publication_date"), F.col("j.salary"), text_of(F.col("j.description")))


def remoteok(p: DataFrame) -> DataFrame:
    """An array whose first element is a notice; rows without a position go; the later of equal urls stays."""
    j = _json(p, "array<struct<position:string,company:string,location:string,url:string,date:string,salary_min:string,salary_max:string,description:string>>", "_p").where(F.coalesce("j.position", F.lit("")) != "")
    ends = [F.when(given(F.col(f"j.{c}")), F.col(f"j.{c}")).otherwise(F.lit("")) for c in ("salary_min", "salary_max")]
    pay = F.regexp_replace(F.concat(ends[0], F.lit("-"), ends[1]), "^-+|-+$", "")
    return first_per_url(_candidates(j, F.col("j.position"), F.col("j.company"), F.col("j.location"), F.col("j.url"), F.col("j.date"), pay, text_of(F.col("j.description"))), keep_last=True)


def justjoin(p: DataFrame, base: str = "https://justjoin.it/job-offer/") -> DataFrame:
    """The first of each slug; place with its kind; the pay of the first employment type that has one."""
    j = _json(p, "data array<struct<title:string,companyName:string,city:string,workplaceType:string,slug:string,publishedAt:string,employmentTypes:array<struct<`from`:string,`to`:string,currency:string,type:string>>>>", "_p.data")
    place = F.concat(text(F.col("j.city")), F.lit(" ("), text(F.col("j.workplaceType")), F.lit(")"))
    paid = F.get(F.filter("j.employmentTypes", lambda e: given(e["from"]) | given(e["to"])), F.lit(0))
    pay = F.when(paid.isNotNull(), F.concat(said(paid["from"]), F.lit("-"), said(paid["to"]), F.lit(" "), text(paid["currency"]), F.lit(" ("), text(paid["type"]), F.lit(")")))
    return first_per_url(_candidates(j, F.col("j.title"), F.col("j.companyName"), place, F.concat(F.lit(base), F.col("j.slug")), F.col("j.publishedAt"), pay))


def pages_by_cursor(p: DataFrame, most: int = 60) -> DataFrame:
    """Pages of a feed that names the next one, in the order of their numbers: up to the first that names none or says that the
    next one is empty, and `most` at most."""
    following = F.from_json("payload", "meta struct<next: struct<cursor: string, itemsCount: int>>")["meta"]["next"]
    ends = following.isNull() | following["cursor"].isNull() | (F.coalesce(following["itemsCount"], F.lit(0)) == 0)
    last = p.where(ends).groupBy("platform").agg(F.min(F.col("page").cast("int")).alias("_last"))
    number = F.col("page").cast("int")
    return p.join(F.broadcast(last), "platform", "left").where((number < most) & (F.col("_last").isNull() | (number <= F.col("_last")))).select(*p.columns)


def himalayas(p: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Rows that hold a wanted phrase in title or categories; four places at most; times in epoch seconds."""
    j = _json(p, "jobs array<struct<title:string,companyName:string,companySlug:string,locationRestrictions:array<string>,guid:string,pubDate:string,minSalary:string,maxSalary:string,currency:string,salaryPeriod:string,description:string,categories:array<string>,parentCategories:array<string>>>", "_p.jobs")
    hay = F.lower(F.concat_ws(" ", "j.title", "j.categories", "j.parentCategories"))
    if wanted:
        j = j.where(F.exists(F.array(*(F.lit(w.lower()) for w in wanted)), lambda w: hay.contains(w)))
    place = F.when(F.size("j.locationRestrictions") > 0, F.array_join(F.slice("j.locationRestrictions", 1, 4), ", ")).otherwise("Worldwide")
    posted = F.coalesce(utc(F.col("j.pubDate").try_cast("decimal(20,6)")), F.col("j.pubDate"))
    pay = F.when(given(F.col("j.minSalary")) | given(F.col("j.maxSalary")), F.concat(said(F.col("j.minSalary")), F.lit("-"), said(F.col("j.maxSalary")), F.lit(" "), text(F.col("j.currency")), F.lit("/"), text(F.col("j.salaryPeriod"))))
    url = F.when(given(F.col("j.guid")), F.col("j.guid")).otherwise(F.concat(F.lit("https://himalayas.app/companies/"), said(F.col("j.companySlug")), F.lit("/jobs")))
    return _candidates(j, F.col("j.title"), F.col("j.companyName"), place, url, posted, pay, F.left(text_of(F.col("j.description")), F.lit(5000)))


def greenhouse(p: DataFrame) -> DataFrame:
    """The page names the board, which is the company."""
    j = _json(p, "jobs array<struct<title:string,location:struct<name:string>,absolute_url:string,updated_at:string,content:string>>", "_p.jobs")
    return _candidates(j, F.col("j.title"), F.col("page"), F.col("j.location.name"), F.col("j.absolute_url"), F.col("j.updated_at"), None, text_of(F.col("j.content")))


def lever(p: DataFrame) -> DataFrame:
    j = _json(p, "array<struct<text:string,categories:struct<location:string>,hostedUrl:string,createdAt:string,descriptionPlain:string>>", "_p")
    return _candidates(j, F.col("j.text"), F.col("page"), F.col("j.categories.location"), F.col("j.hostedUrl"), F.coalesce(utc(F.col("j.createdAt").try_cast("decimal(20,3)") / 1000), F.col("j.createdAt")), None, F.col("j.descriptionPlain"))


def workable(p: DataFrame) -> DataFrame:
    j = _json(p, "results array<struct<title:string,shortcode:string,location:struct<city:string,country:string>,remote:boolean,published:string>>", "_p.results")
    parts = F.array(F.col("j.location.city"), F.col("j.location.country"), F.when(F.col("j.remote"), F.lit("remote")))
    place = F.array_join(F.filter(parts, lambda x: text(x) != ""), " ")
    return _candidates(j, F.col("j.title"), F.col("page"), place, F.concat(F.lit("https://apply.workable.com/"), F.col("page"), F.lit("/j/"), F.col("j.shortcode"), F.lit("/")), F.col("j.published"))


def pinpoint(p: DataFrame) -> DataFrame:
    """A place may be an object or text."""
    j = _json(p, "data array<struct<title:string,location:string,workplace_type:string,url:string,description:string,published_at:string,created_at:string>>", "_p.data")
    whole = F.col("j.location")
    named = F.coalesce(F.nullif(F.get_json_object(whole, "$.name"), F.lit("")), F.get_json_object(whole, "$.city"), F.lit(""))
    place = F.concat(F.when(whole.startswith("{"), named).otherwise(text(whole)), F.lit(" ("), text(F.col("j.workplace_type")), F.lit(")"))
    return _candidates(j, F.col("j.title"), F.col("page"), place, F.col("j.url"), F.coalesce(F.nullif("j.published_at", F.lit("")), F.col("j.created_at")), None, text_of(F.col("j.description")))


def ashby(p: DataFrame, company: str = "", site: str = "https://www.deel.com") -> DataFrame:
    """The job board's JSON; where a payload has none, the job objects that a careers page holds as escaped JSON. A job
    whose titles all have over 90 characters goes by the one for search engines up to a bar; one without a title is left out."""
    j = _json(p, "jobs array<struct<title:string,location:string,jobUrl:string,applyUrl:string,publishedAt:string>>", "_p.jobs")
    good = _candidates(j, F.col("j.title"), F.lit(company), F.col("j.location"), F.coalesce(F.nullif("j.jobUrl", F.lit("")), F.col("j.applyUrl")), F.col("j.publishedAt"))
    plain = F.replace(F.col("payload"), F.lit('\\"'), F.lit('"'))
    whole = r'\{"id":\d+,"attributes":\{"ashby_id":"[\w-]+"(.{0,4000}?"slug":"[^"\\]+)"'
    found = p.where(F.coalesce(F.size(F.from_json("payload", "jobs array<string>").getField("jobs")), F.lit(0)) <= 0).select("platform_ord", "platform", "page", F.posexplode(F.regexp_extract_all(plain, F.lit(whole), F.lit(1))).alias("pos", "j"))
    found = found.withColumns({"slug": F.regexp_extract("j", r'"slug":"([^"\\]+)$', 1), "job": F.regexp_replace("j", r'"slug":"[^"\\]+$', "")})
    own, seo = F.regexp_extract("job", r'"(?:job_title|title)":"([^"\\]{3,90})"', 1), F.regexp_extract("job", r'"SEO":\{"title":"([^"\\|]{3,90})', 1)
    one = lambda name: F.regexp_extract("job", rf'"{name}":"([^"\\]+)"', 1)
    places = F.array_join(F.slice(F.regexp_extract_all("job", F.lit(r'"location":"([^"\\]{2,60})"'), F.lit(1)), 1, 4), ", ")
    url = F.when(F.col("slug").rlike("^https?://"), F.col("slug")).otherwise(F.concat(F.lit(site), F.when(F.startswith("slug", F.lit("/")), F.lit("")).otherwise(F.lit("/")), F.col("slug")))
    embedded = _candidates(found, F.coalesce(F.nullif(own, F.lit("")), seo), F.lit(company), places, url, one("ashby_updated_at"), one("compensation_tier_summary"))
    return good.unionByName(embedded.where("title <> ''"))


def rss(p: DataFrame) -> DataFrame:
    """Items of a feed; "Company: Role" is cut at the first colon."""
    i = p.select("platform_ord", "platform", "page", F.posexplode(F.regexp_extract_all("payload", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("pos", "j"))
    tag = lambda name: F.trim(F.regexp_replace(F.regexp_extract("j", rf"(?s)<{name}>(.*?)</{name}>", 1), r"^<!\[CDATA\[|\]\]>$", ""))
    parts = F.split(tag("title"), ":", 2)
    has = (F.size(parts) == 2) & (F.get(parts, F.lit(1)) != "")
    return _candidates(i, F.when(has, parts[1]).otherwise(tag("title")), F.when(has, parts[0]).otherwise(F.lit("")), F.coalesce(F.nullif(tag("region"), F.lit("")), tag("category")), tag("link"), tag("pubDate"), None, F.left(text_of(tag("description")), F.lit(5000)))


def sitemap(p: DataFrame) -> DataFrame:
    i = p.select("platform_ord", "platform", "page", F.posexplode(F.regexp_extract_all("payload", F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))).alias("pos", "j"))
    tag = lambda name: F.trim(F.regexp_extract("j", rf"(?s)<{name}>(.*?)</{name}>", 1))
    i = i.withColumn("_tc", caption_title_company(tag("image:caption"), tag("loc")))
    return first_per_url(_candidates(i, F.col("_tc.title"), F.col("_tc.company"), F.lit(""), tag("loc"), tag("lastmod")))


def guest_cards(p: DataFrame) -> DataFrame:
    """Cards of a result list, one for each list element."""
    i = p.select("platform_ord", "platform", "page", F.posexplode(F.filter(F.split("payload", r"(?=<li\b)"), lambda x: x.contains("<li"))).alias("pos", "j"))
    part = lambda cls: text_of(F.regexp_extract("j", rf'(?s)class="[^"]*{cls}[^"]*"[^>]*>(.*?)</', 1))
    url = F.regexp_replace(F.regexp_extract("j", r'href="([^"?]+)', 1), r"\?.*$", "")
    rows = _candidates(i, part("title"), part("subtitle"), part("location"), url, F.regexp_extract("j", r'datetime="([^"]+)"', 1))
    return first_per_url(rows.where((F.col("url") != "") & (F.col("title") != "")))


def working_nomads(p: DataFrame) -> DataFrame:
    j = _json(p, "array<struct<title:string,company_name:string,location:string,url:string,pub_date:string,description:string>>", "_p")
    return _candidates(j, F.col("j.title"), F.col("j.company_name"), F.col("j.location"), F.col("j.url"), F.col("j.pub_date"), None, text_of(F.col("j.description")))


class Listing(NamedTuple):
    """href: what the whole path of a posting's link fits; company: the number of the path's part, from 1, that names the company."""

    href: str
    base: str
    company: int | None = None
    least_hyphens: int = 0


#: How the listing pages of these boards address their postings.
LISTINGS = {
    "himalayas": Listing(r"/companies/[^/]+/jobs/[^/]+/?", "https://himalayas.app", company=2),
    "working-nomads": Listing(r"/jobs/[\w-]+", "https://www.workingnomads.com"),
    "jobgether": Listing(r"/offer/[\w-]{10,}", "https://jobgether.com"),
    "arc": Listing(r"/remote-jobs/(?:details|j)/[\w-]+", "https://arc.dev"),
    "remote-rocketship-worldwide": Listing(r"/publicjobs/company/[^/]+/jobs/[^/]+/?", "https://www.remoterocketship.com", company=3),
    "remote-rocketship-europe": Listing(r"/publicjobs/company/[^/]+/jobs/[^/]+/?", "https://www.remoterocketship.com", company=3),
    "wttj": Listing(r"/en/companies/[^/]+/jobs/[^/]+", "https://www.welcometothejungle.com", company=3),
    "nodesk": Listing(r"/remote-jobs/[a-z0-9-]+/?", "https://nodesk.co", least_hyphens=3),
    "justremote": Listing(r"[a-z]+(?:-[a-z]+)*-jobs/[\w-]+", "https://justremote.co", least_hyphens=2),
    "landing-jobs": Listing(r"(?:https://landing\.jobs)?/at/[^/]+/[\w-]+", "https://landing.jobs", company=2),
    "crossover": Listing(r"/jobs/\d+/[\w-]+/[\w-]+", "https://www.crossover.com", company=3),
    "ai-jobs-net": Listing(r"/job/[a-z0-9-]+-\d{4,}/?", "https://ai-jobs.net"),
    "icrunchdata": Listing(r"/jobs/[a-z0-9-]+", "https://icrunchdata.com", least_hyphens=1),
    "dribbble": Listing(r"/jobs/\d+-[\w-]+", "https://dribbble.com"),
    "problogger": Listing(r"/jobs/job/[a-z0-9-]+/?", "https://problogger.com"),
}

#: The opening tag of any element with an address, and the text up to its end, which stays open to further matches.
_LINK = r'(?s)(<([a-zA-Z][a-zA-Z0-9]*)\b[^<>]*?\bhref="[^"]+"[^<>]*>)(?:(?=(.*?)</\2>)|)'


def harvest(p: DataFrame, listings: dict[str, Listing] = LISTINGS, by_tree: bool = False) -> DataFrame:
    """Links of pages by the listing of their platform, in one pass for all of them: elements of any kind whose path (or address
    without its query) fits, absolute, each url once, by the element's text if one can be a title and else by its address.
    Pages of platforms without a listing bring nothing. by_tree: links are taken from the element tree (markup.links_by_tree), which
    is right for any markup and runs Python, in place of patterns."""
    per = {k: i for i, k in enumerate(listings)}

    def of(value: Callable[[Listing], Column]) -> Column:
        whens = None
        for k in per:
            whens = F.when(F.col("platform") == k, value(listings[k])) if whens is None else whens.when(F.col("platform") == k, value(listings[k]))
        return F.lit(None) if whens is None else whens

    found = lambda group: F.regexp_extract_all("payload", F.lit(_LINK), F.lit(group))
    pages = p.where(F.col("platform").isin(*per))
    if by_tree:
        links = pages.select("platform_ord", "platform", "page", F.posexplode(links_by_tree(F.col("payload"))).alias("pos", "a"))
        raw = F.col("a.href")
    else:
        links = pages.select("platform_ord", "platform", "page", F.posexplode(F.arrays_zip(found(1).alias("tag"), found(3).alias("label"))).alias("pos", "a"))
        raw = F.regexp_extract("a.tag", r'\bhref="([^"]+)"', 1)
    links = links.withColumn("_raw", raw).withColumn("_whole", F.regexp_replace("_raw", r"(?s)\?.*$", "")).withColumn("_path", F.regexp_replace("_whole", r"^https?://[^/]+", ""))
    last = F.element_at(F.split(F.regexp_replace("_path", "/+$", ""), "/"), -1)
    hyphens = F.length(last) - F.length(F.replace(last, F.lit("-"), F.lit("")))
    fits = of(lambda x: F.col("_path").rlike(f"^(?:{x.href})$") | F.col("_whole").rlike(f"^(?:{x.href})$"))
    links = links.where(fits & (hyphens >= of(lambda x: F.lit(x.least_hyphens))))
    joined = F.concat(of(lambda x: F.lit(x.base.rstrip("/"))), F.when(F.startswith("_path", F.lit("/")), F.col("_path")).otherwise(F.concat(F.lit("/"), F.col("_path"))))
    links = links.withColumn("_url", F.when(F.startswith("_raw", F.lit("http")), F.col("_raw")).otherwise(joined))
    part = F.get(F.array_remove(F.split("_path", "/"), ""), of(lambda x: F.lit(-1 if x.company is None else x.company - 1)))
    company = F.replace(F.coalesce(part, F.lit("")), F.lit("-"), F.lit(" "))
    title, slug = pick_title(F.col("a.label"), F.col("_url")), slug_title(F.col("_url"))
    rows = links.select("platform_ord", "platform", "page", "pos", title.alias("t"), slug.alias("s"), company.alias("c"), F.col("_url").alias("u"))
    best = rows.groupBy("platform_ord", "platform", "u").agg(F.min(F.struct((F.col("t") == F.col("s")).alias("slug_only"), "page", "pos", "t", "c")).alias("b"), F.min(F.struct("page", "pos")).alias("first"))
    best = best.select("platform_ord", "platform", F.col("first.page").alias("page"), F.col("first.pos").alias("pos"), "b", "u")
    return _candidates(best, F.col("b.t"), F.col("b.c"), F.lit(""), F.col("u"))


def link_harvest(p: DataFrame, href: str, base: str, company: int | None = None, least_hyphens: int = 0, by_tree: bool = False) -> DataFrame:
    """harvest() of one listing for pages of any platform."""
    name = F.col("platform").alias("_p")
    one = harvest(p.select(F.struct("platform_ord", name).alias("platform_ord"), F.lit("").alias("platform"), "page", "payload"), {"": Listing(href, base, company, least_hyphens)}, by_tree)
    return one.withColumns({"platform": F.col("platform_ord._p"), "platform_ord": F.col("platform_ord.platform_ord")})


def pages_until_dry(pages: DataFrame, source: str, page: str, url: str, most: int = 40) -> DataFrame:
    """Rows of a paged listing up to the page that brought nothing new, and of `most` pages."""
    firsts = pages.groupBy(source, url).agg(F.min(page).alias(page))
    fresh = firsts.groupBy(source, page).agg(F.count(F.lit(1)).alias("fresh"))
    order = Window.partitionBy(source).orderBy(page)
    # A page without new urls is missing here: the pages read are those without a gap from 0 on.
    read = fresh.withColumn("_n", F.row_number().over(order) - 1).where((F.col("_n") == F.col(page)) & (F.col(page) < most)).select(source, page)
    return pages.join(read, [source, page], "left_semi")


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "remotive": remotive, "remoteok": remoteok, "justjoin": justjoin, "himalayas": himalayas, "greenhouse": greenhouse, "lever": lever, "workable": workable, "pinpoint": pinpoint,
    "ashby": ashby, "rss": rss, "sitemap": sitemap, "guest_cards": guest_cards, "working_nomads": working_nomads, "listing": harvest,
}


def register(name: str, parser: Callable[[DataFrame], DataFrame]) -> None:
    PARSERS[name] = parser


def parse_all(payloads: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """payloads by platform, kinds: platform to parser. Candidates, and source_status (platform, raw, source_down): a platform
    that brings no rows is down; nothing that can't be read fails the job."""
    out = None
    # One scan for each kind of payload, not for each platform.
    for kind in dict.fromkeys(kinds.values()):
        rows = PARSERS[kind](payloads.where(F.col("platform").isin([p for p, k in kinds.items() if k == kind]))).withColumn("row_ord", F.to_json("row_ord"))
        out = rows if out is None else out.unionByName(rows)
    raw = out.groupBy("platform").agg(F.count(F.lit(1)).alias("raw"))
    status = payloads.select("platform").distinct().join(raw, "platform", "left").select("platform", F.coalesce("raw", F.lit(0).cast("long")).alias("raw"), F.col("raw").isNull().alias("source_down"))
    return out, status


def read_state(column: Column, schema: str) -> Column:
    """A JSON column as a struct; what is missing or can't be read is an empty one, never an error."""
    read = F.from_json(column, schema, {"mode": "PERMISSIVE"})
    return F.coalesce(read, F.from_json(F.lit("{}"), schema))


def read_jsonl(spark, path: str, schema: str) -> DataFrame:
    """Lines of JSON with their place: bad lines are kept in _corrupt_record, blank ones skipped. seq orders the lines within
    a file, which is all that a line log needs; later files follow earlier ones by name."""
    lines = spark.read.text(path, wholetext=False).where(F.trim("value") != "").select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("seq"))
    parsed = lines.withColumn("_r", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.select("seq", "_r.*")
