"""Text normalisation as Columns. Empty and null text mean the same everywhere: absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"(?U)\s+"
#: Legal forms that end a company name.
LEGAL_FORMS = (
    r"gmbh", r"ltd", r"inc", r"llc", r"s\.?a\.?", r"s\.?r\.?l\.?", r"d\.?o\.?o\.?", r"b\.?v\.?", r"a\.?g\.?",
    r"sp\.?\s*z\s*o\.?\s*o\.?", r"sp\.?\s*[kj]\.?", r"corp(?:oration)?", r"co", r"plc", r"limited", r"group", r"holdings?",
)
#: What personal data looks like.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(?:\+\d[\d\s()./-]{7,}\d)|(?:\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b)",
    "street_address": r"(?i)\b\d{1,5}\s+\w+(?:\s+\w+){0,3}\s+(?:Street|Avenue|Boulevard|Lane|Drive)\b",
}
#: Addresses of postings at applicant-tracking hosts.
ATS_URL = "|".join((
    r"https?://(?:boards|job-boards)(?:\.eu)?\.greenhouse\.io/[^\s\"']+",
    r"https?://jobs\.lever\.co/[^\s\"']+",
    r"https?://apply\.workable\.com/[^\s\"']+",
    r"https?://[\w-]+\.pinpointhq\.com/[^\s\"']+",
    r"https?://jobs\.ashbyhq\.com/[^\s\"']+",
))


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column, chars: str = r"(?U)\s") -> Column:
    return F.regexp_replace(c, f"^{chars}+|{chars}+$", "")


def tidy(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text(c), BLANK, " "))


def norm(c: Column) -> Column:
    return F.lower(tidy(c))


def norm_company(c: Column) -> Column:
    """Lower case, without stacked legal forms at the end and without blanks, commas and dots at both ends. A name of legal
    forms alone becomes empty."""
    forms = "|".join(LEGAL_FORMS)
    tail = rf"(?iU)(?:(?:^|[ ,.]+|(?<=\W))(?:{forms})\.?)+$"
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(norm(c), r"[ ,.]+$", "."), tail, ""), r"^[ ,.]+|[ ,.]+$", "")


def norm_url(c: Column, keep_params: bool = False) -> Column:
    """Without scheme, www., query, fragment and closing slashes, in lower case."""
    u = F.regexp_replace(F.lower(strip(text(c))), r"^https?://(www\.)?", "")
    return F.regexp_replace(F.regexp_replace(u, r"#.*$" if keep_params else r"[?#].*$", ""), r"/+$", "")


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(text(c), r"^https?://", ""), r"^([^/]*)", 1))


def make_key(company: Column, role: Column, place: Column) -> Column:
    return F.concat_ws("|", norm_company(company), norm(role), norm(place))


def role_family(c: Column) -> Column:
    """A role without what follows a dash, bar, bracket, slash or comma."""
    return F.trim(F.split(norm(c), r"\s[-–—|(/]|,", 2)[0])


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def text_of(c: Column) -> Column:
    """Markup to text: tags become blanks."""
    return tidy(F.regexp_replace(text(c), r"<[^>]+>", " "))


def visible_text(c: Column, drop: tuple[str, ...] = ("script", "style", "noscript", "nav", "footer", "header")) -> Column:
    """Text without the named elements and their content, and without tags."""
    for tag in drop:
        c = F.regexp_replace(text(c), rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return text_of(c)


def visible_body(c: Column) -> Column:
    """As visible_text, for the check whether a posting is live: navigation stays, blanks stay."""
    for tag in ("script", "style", "noscript"):
        c = F.regexp_replace(text(c), rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return F.regexp_replace(c, r"<[^>]+>", " ")


def slug_title(url: Column) -> Column:
    """The last part of a path as words, without hexadecimal ids."""
    last = F.element_at(F.split(F.regexp_replace(F.regexp_replace(text(url), r"[?#].*$", ""), r"/+$", ""), "/"), -1)
    return tidy(F.regexp_replace(F.regexp_replace(last, r"\b[0-9a-f]{6,}\b", ""), r"[-_]+", " "))


def pick_title(anchor: Column, url: Column) -> Column:
    """The link's text if it can be a title, else the words of its address."""
    t = text_of(anchor)
    fits = (F.length(t) > 3) & (F.length(t) < 160) & ~t.rlike(r"(?i)^(view|apply|read|see) ")
    return F.when(fits, t).otherwise(slug_title(url))


def caption_title_company(caption: Column, url: Column) -> Column:
    """struct(title, company) of "company - title (remote job)"."""
    c = tidy(F.regexp_replace(unescape(text(caption)), r"(?i)\s*\(remote job\)\s*$", ""))
    parts = F.split(c, " - ", 2)
    return F.when(F.size(parts) == 2, F.struct(F.trim(parts[1]).alias("title"), F.trim(parts[0]).alias("company"))).otherwise(F.struct(slug_title(url).alias("title"), F.lit("").alias("company")))


def unescape(c: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def resolve_source_url(body: Column) -> Column:
    """The first address of an applicant-tracking host, without trailing punctuation; null if none."""
    found = F.regexp_extract(text(body), f"(?U)({ATS_URL})", 1)
    # Few bodies name any of the hosts, and a plain search costs less than the pattern.
    hosts = text(body).rlike(r"greenhouse\.io/|lever\.co/|workable\.com/|pinpointhq\.com/|ashbyhq\.com/")
    return F.when(hosts, F.nullif(F.regexp_replace(found, r"[\\\"'>).,]+$", ""), F.lit("")))


def content_hash(c: Column, digits: int = 16) -> Column:
    return F.left(F.sha2(text(c), 256), F.lit(digits))


def pii_hits(c: Column) -> Column:
    """array<string> of "kind: match" over the whole text, kind by kind."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text(c), F.lit(pattern), F.lit(0)), lambda m: F.concat(F.lit(f"{kind}: "), F.trim(m)))

    return F.concat(*(of(kind, p) for kind, p in PII.items()))


def generic_term_ok(c: Column) -> Column:
    """1 to 39 ASCII letters, digits, spaces and signs of technical terms, the first a letter or digit, and neither an address nor a link."""
    return strip(text(c)).rlike(r"^[A-Za-z0-9][A-Za-z0-9 .+#/&-]{0,38}$") & ~text(c).rlike(r"@|https?://|\bwww\.")


def push_rejected(c: Column) -> Column:
    return F.lower(text(c)).contains("rejected")


def bound(value: Column, then) -> Column:
    """then(value), with the value made once: within functions of arrays Spark makes an expression anew wherever it stands."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def match_windows(c: Column, pattern: str, before: int, after: int, groups: int = 0, keep=None) -> Column:
    """array<struct<match, start, window, groups>>: each match, the text from `before` to `after` characters around it, and what the
    first `groups` groups hold of it, empty where they hold nothing. keep: which matches (struct<match, start, groups>) to look at."""
    marked = "\x01$1\x02" + "".join(f"${k + 2}\x02" for k in range(groups))

    # Each piece but the first is a match, a mark, the groups with a mark each, and the text up to the next match.
    def found(pieces: Column) -> Column:
        return F.aggregate(
            F.slice(pieces, 2, F.size(pieces)),
            F.struct(F.length(pieces[0]).alias("at"), F.expr("CAST(array() AS array<struct<match: string, start: int, groups: array<string>>>)").alias("found")),
            lambda acc, piece: bound(F.split(piece, "\x02"), lambda p: F.struct((acc["at"] + F.length(p[0]) + F.length(p[groups + 1])).alias("at"), F.concat(acc["found"], F.array(F.struct(p[0].alias("match"), acc["at"].cast("int").alias("start"), F.slice(p, 2, groups).alias("groups")))).alias("found"))),
            lambda acc: acc["found"],
        )

    def windows(clean: Column) -> Column:
        all_found = bound(F.split(F.regexp_replace(clean, f"({pattern})", marked), "\x01"), found)
        cut = lambda m: clean.substr(F.greatest(m["start"] - before, F.lit(0)) + 1, F.length(m["match"]) + after + F.least(m["start"], F.lit(before)))
        return F.transform(all_found if keep is None else F.filter(all_found, keep), lambda m: F.struct(m["match"].alias("match"), m["start"].alias("start"), cut(m).alias("window"), m["groups"].alias("groups")))

    return bound(F.translate(text(c), "\x01\x02", ""), windows)
