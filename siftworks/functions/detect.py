"""Detectors over titles and bodies as Columns. They note and flag; what drops is decided by the filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import match_windows, norm_company, text, visible_body

#: Function words by language, in the order in which ties are decided.
STOPWORDS = {
    "en": "the and for with you are our will this that have from your about who what would should must team work experience they their been were which while when has",
    "pl": "się jest oraz dla lub jako że praca doświadczenie umiejętności zespół wymagania stanowisko obowiązki mile widziane znajomość firmy poszukujemy nasz",
    "de": "und der die das mit für sie wir ist auf von den dem ein eine im zu als werden unsere deine erfahrung kenntnisse aufgaben",
    "es": "de la que el en los una para con por las del al se su como más experiencia conocimientos equipo trabajo empresa",
    "fr": "le la les des une pour avec vous nous est dans que qui sur au aux votre notre expérience compétences équipe entreprise",
    "it": "di che il la le per con una del gli nel come più sono nostro esperienza competenze squadra azienda lavoro",
    "nl": "de het een van en met voor zijn wij je onze aan door bij ervaring kennis team werk bedrijf",
    "pt": "de que os para com uma por das dos como mais são nossa experiência conhecimentos equipa empresa trabalho",
}
#: Letters that speak for a language.
DIACRITICS = {"pl": "ąćęłńóśźż", "de": "äöüß", "fr": "àâçéèêëîïôûùüÿœ", "es": "áíñóúü¿¡", "it": "àèéìíòóù", "pt": "ãõáâàçéêíóôú"}
#: Languages by name.
LANGUAGES = {
    "polish": "pl", "german": "de", "french": "fr", "spanish": "es", "italian": "it", "dutch": "nl", "portuguese": "pt", "english": "en", "czech": "cs",
    "slovak": "sk", "slovenian": "sl", "hungarian": "hu", "romanian": "ro", "bulgarian": "bg", "croatian": "hr", "serbian": "sr", "ukrainian": "uk",
    "russian": "ru", "greek": "el", "turkish": "tr", "swedish": "sv", "norwegian": "no", "danish": "da", "finnish": "fi", "estonian": "et",
    "latvian": "lv", "lithuanian": "lt",
}
#: Wording that makes a language a requirement, an option, or the language to apply in.
REQUIRED = r"(c1|c2|fluent|fluency|fluently|native|proficien\w*|mother[\s-]?tongue|command of|upper[\s-]?intermediate|speaking|must speak|required|mandatory)"
OPTIONAL = r"(nice to have|a plus|advantage|asset|welcome|optional|beneficial|preferred|desirable|bonus|not required|not mandatory|would be nice|is a plus)"
APPLY_IN = r"(?:appl(?:y|ication|ications|ying)|cv|resume|résumé|cover\s+letter|correspondence)[^.\n]{0,30}\bin\s+"
#: Wording before a start date.
START = r"(?i)(?:start(?:ing|s)?|kick[- ]?off|target start|expected start|planned start|project start|earliest start|commencement|commenc\w*)"
#: Bands by title term.
SENIORITY = {
    "intern": "intern", "internship": "intern", "trainee": "intern", "working student": "intern", "apprentice": "intern",
    "junior": "junior", "jr": "junior", "graduate": "junior", "entry level": "junior", "entry-level": "junior", "associate": "junior",
    "mid": "mid", "mid level": "mid", "mid-level": "mid", "midlevel": "mid", "medior": "mid", "intermediate": "mid", "regular": "mid",
    "senior": "senior", "sr": "senior", "staff": "staff", "principal": "principal", "distinguished": "principal",
    "lead": "lead", "team lead": "lead", "tech lead": "lead", "technical lead": "lead",
    "manager": "manager", "head of": "manager", "director": "manager", "vp of engineering": "manager",
}
#: Marks of employment kinds and of work arrangements.
EMPLOYMENT = {
    "part_time": r"\bpart[\s-]?time\b",
    "full_time": r"\bfull[\s-]?time\b",
    "contract": r"\b(contract(or)?|fixed[\s-]term|temporary|interim)\b",
    "b2b": r"\bb2b\b",
    "freelance": r"\bfreelanc\w*\b",
    "internship": r"\b(intern(ship)?|trainee|working student|apprentice)\b",
}
ARRANGEMENT = {
    "remote": r"\b(fully[\s-]?remote|remote[\s-]?first|100%\s*remote|remote)\b",
    "hybrid": r"\bhybrid\b",
    "on_site": r"\b(on[\s-]?site|in[\s-]?office|from the office|stationary)\b|\b\d+\s*days?\b[^.]{0,20}\b(office|on[\s-]?site|onsite)\b",
}
PLACE_TAG = r"\((remote|hybrid|on[\s-]?site|onsite|stationary|office)\)"
#: What a page of a closed posting says, and what one of an open posting does.
EXPIRED = ("no longer accepting applications", "this position has been filled", "job is no longer available", "this job has expired", "offer expired", "posting has closed", "this vacancy is now closed")
POSTING = r"(?i)\b(responsibilit|requirements?|qualifications?|what you.ll do|about (the|this) role|apply (now|for this)|we are looking for|job description)\b"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _compact(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _one_of(words: list[str]):
    return lambda x: x.isin(words)


def detect_language(c: Column, least_words: int = 50, least_share: float = 0.02) -> Column:
    """The language whose function words have the largest share, ties in table order; null for short or unclear text."""
    words = F.regexp_extract_all(F.lower(text(c)), F.lit(r"(\p{L}+)"), F.lit(1))
    any_language = sorted({word for line in STOPWORDS.values() for word in line.split()})
    marks = F.regexp_replace(text(c), r"\p{ASCII}+", "")  # among which the letters of DIACRITICS are sought, and not in the whole text six times
    # One pass over all words leaves the function words, which the languages then count among.

    def best(p: Column) -> Column:
        scores, n, w = [], p["n"], p["w"]
        for rank, (lang, line) in enumerate(STOPWORDS.items()):
            share = F.size(F.filter(w, _one_of(line.split()))) / F.greatest(n, F.lit(1))
            if lang in DIACRITICS:
                share = share + F.when(p["marks"].rlike(f"[{DIACRITICS[lang]}]"), 0.01).otherwise(0.0)
            scores.append(F.struct(share.alias("score"), F.lit(-rank).alias("rank"), F.lit(lang).alias("lang")))
        top = F.array_max(F.array(*scores))
        return F.get(F.transform(F.array(top), lambda t: F.when((n >= least_words) & (t["score"] >= least_share), t["lang"])), F.lit(0))

    return F.get(F.transform(F.array(words), lambda all_words: F.get(F.transform(F.array(F.struct(F.size(all_words).alias("n"), F.filter(all_words, _one_of(any_language)).alias("w"), marks.alias("marks"))), best), F.lit(0))), F.lit(0))


def language_flag(c: Column, targets: list[str]) -> Column:
    lang = detect_language(c)
    return F.when(lang.isNotNull() & ~lang.isin(targets), F.lit("non_target_language"))


def title_language(title: Column, targets: list[str] = ()) -> Column:
    """By letters alone, for titles too short for words: the first language with such a letter that is none of the targets."""
    others = [x for x in ("pl", "de", "fr", "es", "it", "pt") if x not in targets]
    return F.coalesce(*(F.when(F.lower(text(title)).rlike(f"[{DIACRITICS[x]}]"), F.lit(x)) for x in others), F.lit(None).cast("string"))


def language_of(title: Column, body: Column, targets: list[str]) -> Column:
    """The body's language if it is out of the targets; else what the title's letters tell of a language out of them; else the body's."""
    said = detect_language(body)
    return F.get(F.transform(F.array(said), lambda x: F.when(x.isin(list(targets)), F.coalesce(title_language(title, targets), x)).otherwise(F.coalesce(x, title_language(title, targets)))), F.lit(0))


def stated_language_requirement(c: Column, targets: list[str]) -> Column:
    """struct(kind, language): an application in a language out of the targets, or a required skill in one; null if neither.
    A language said to be optional near its name is none."""
    low = F.lower(text(c))
    names = [n for n, code in LANGUAGES.items() if code not in targets]
    walls = F.regexp_extract_all(low, F.lit(rf"(?U){APPLY_IN}({'|'.join(LANGUAGES)})\b"), F.lit(1))
    wall = F.get(F.filter(walls, lambda n: n.isin(names)), F.lit(0))
    need = F.lit(None).cast("string")
    if names:
        # All names in one pass, and only over texts that have one at all; of those that are required the first of the table counts.
        near = F.filter(match_windows(low, rf"(?U)\b(?:{'|'.join(names)})\b", 45, 45), lambda m: ~m["window"].rlike(OPTIONAL) & m["window"].rlike(REQUIRED))
        required = F.transform(near, lambda m: m["match"])
        need = F.when(low.rlike(rf"(?<![a-z])(?:{'|'.join(names)})"), F.get(F.array_intersect(F.split(F.lit(" ".join(names)), " "), required), F.lit(0)))
    return F.when(wall.isNotNull(), F.struct(F.lit("apply_in").alias("kind"), wall.alias("language"))).when(need.isNotNull(), F.struct(F.lit("proficiency").alias("kind"), need.alias("language")))


def start_date_passed(c: Column, today: Column) -> Column:
    """'YYYY-MM' of the first start month before this one, after wording of a start; null if none."""
    windows = F.regexp_extract_all(text(c), F.lit(rf"{START}(?=((?s).{{0,45}}))"), F.lit(1))
    two = lambda x: F.lpad(x, 2, "0")

    def month(w: Column) -> Column:
        num, iso, mon = (lambda k: F.regexp_extract(w, r"(\d{1,2})[./](\d{4})", k)), (lambda k: F.regexp_extract(w, r"(\d{4})-(\d{2})", k)), (lambda k: F.regexp_extract(w, rf"(?i)({'|'.join(MONTHS)})[a-z]*\s+(\d{{4}})", k))
        named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(mon(1))).cast("string")
        found = _compact([F.when(num(1) != "", F.concat_ws("-", num(2), two(num(1)))), F.when(iso(1) != "", F.concat_ws("-", iso(1), iso(2))), F.when(mon(1) != "", F.concat_ws("-", mon(2), two(named)))])
        ok = F.filter(found, lambda m: m.between("2000-01", "2100-12") & F.substring(m, 6, 2).between("01", "12") & (m < F.date_format(today, "yyyy-MM")))
        return F.get(ok, F.lit(0))

    return F.get(F.filter(F.transform(windows, month), lambda m: m.isNotNull()), F.lit(0))


def detect_seniority(title: Column, lexicon: dict[str, str] | None = None) -> Column:
    """The band of the longest term in the title."""
    low = F.lower(text(title))
    lexicon = lexicon or SENIORITY
    return F.coalesce(*(F.when(low.rlike(rf"(?U)\b\Q{term}\E\b"), F.lit(lexicon[term])) for term in sorted(lexicon, key=len, reverse=True)))


def detect_employment(c: Column) -> Column:
    low = F.lower(text(c))
    return _compact([F.when(low.rlike(f"(?U){p}"), F.lit(k)) for k, p in EMPLOYMENT.items()])


def employment_off_target(found: Column, accept: list[str]) -> Column:
    """Stated kinds and none of them accepted; or full time without part time where part time is accepted, whatever else is."""
    none = (F.size(found) > 0) & ~F.arrays_overlap(found, F.array(*map(F.lit, accept)))
    guard = F.lit("part_time" in accept) & F.array_contains(found, "full_time") & ~F.array_contains(found, "part_time")
    return none | guard


def detect_work_arrangement(place: Column, body: Column) -> Column:
    """A tag in the place decides; without one the marks in place and body do."""
    tag = F.regexp_extract(F.lower(text(place)), PLACE_TAG, 1)
    hay = F.concat_ws(" ", F.lower(text(place)), F.lower(text(body)))
    mapped = F.when(tag.isin("remote", "hybrid"), tag).when(tag.isin("onsite", "on-site", "on site", "stationary", "office"), "on_site").otherwise(tag)
    return F.when(tag != "", F.array(mapped)).otherwise(_compact([F.when(hay.rlike(f"(?U){p}"), F.lit(k)) for k, p in ARRANGEMENT.items()]))


def missing_company(c: Column) -> Column:
    return norm_company(c) == ""


def seniority_off_target(band: Column, bands: list[str]) -> Column:
    return F.coalesce(~band.isin(bands), F.lit(False))


def body_verdict(html: Column, markers: Column | None = None) -> Column:
    """stale if a mark of a closed posting is there; live if there is enough text that reads as a posting; else null."""
    body = visible_body(html)
    low = F.lower(body)
    stale = low.rlike("|".join(rf"\Q{m}\E" for m in EXPIRED))
    if markers is not None:
        stale = stale | F.exists(F.coalesce(markers, F.expr("CAST(array() AS array<string>)")), lambda m: low.contains(F.lower(m)))
    return F.when(stale, "stale").when((F.length(F.trim(body)) > 400) & body.rlike(POSTING), "live")


def liveness(url: Column, status: Column, final_url: Column, html: Column, rendered: Column | None = None, exempt_host: str | None = None, markers: Column | None = None) -> Column:
    """live, stale or unverifiable_direct, from what a fetch brought; a null status stands for a failed fetch."""
    from .text import host

    moved = text(final_url) != text(url)
    own = F.lit(False) if exempt_host is None else host(url).contains(exempt_host)
    path = F.regexp_replace(F.regexp_replace(text(final_url), r"^https?://[^/]+", ""), r"/+$", "")
    to_root = (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) <= 1) & (F.length(path) < 30)
    again = F.coalesce(body_verdict(rendered, markers), F.lit("unverifiable_direct")) if rendered is not None else F.lit("unverifiable_direct")
    return (
        F.when(status.isNull(), "unverifiable_direct")
        .when(moved & (host(final_url) != host(url)) & ~own, "stale")
        .when(status.isin(404, 410), "stale")
        .when((status == 200) & moved & ~own & to_root, "stale")
        .when(status == 200, F.coalesce(body_verdict(html, markers), again))
        .when(status.isin(401, 403, 406, 429, 503), again)
        .otherwise("unverifiable_direct")
    )
