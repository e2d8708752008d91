"""Configuration on the driver: reading, merging, strict checks, choice of platforms and regions, and the rules they compile to."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from ..functions.detectors import REGISTRY
from ..functions.salary import Floor
from ..operators.filters import FLAGS, AUTO_DROP, Rules

#: What may be said in a configuration.
WORK_MODELS = ("remote", "hybrid", "on_site")
BANDS = ("intern", "junior", "mid", "senior", "staff", "principal", "lead", "manager")
EMPLOYMENT_TYPES = ("full_time", "part_time", "contract", "b2b", "freelance", "internship", "any")
EMPLOYMENT_MODELS = ("b2b_contractor", "full_time", "part_time", "freelance")
EFFORTS = ("fast", "mid", "high")
LANGUAGE_CODES = ("en", "pl", "de", "es", "fr", "it", "nl", "pt")
SECTIONS = (
    "schema_version", "id", "template", "dry_run", "candidate", "search", "compensation", "hard_filters", "filter_notes", "scoring",
    "platforms", "sweep", "output", "schedule", "run", "writeback",
)
FILTER_MODES = {
    "travel": ("none", "occasional_ok", "any"),
    "clearance": ("drop", "allow"),
    "grind_culture": ("drop", "allow"),
    "closed_location_list": ("drop_if_absent", "off"),
    "work_arrangement": ("off", "flag", "drop"),
    "employment_mismatch": ("flag", "drop"),
    "language_mismatch": ("flag", "drop"),
}
#: Countries and citizenships that filters depend on.
US_NAMES = ("united states", "usa", "us", "united states of america")
EU_CITIZENSHIPS = (
    "AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE", "IT", "LV", "LT", "LU", "MT", "NL", "PL", "PT", "RO",
    "SK", "SI", "ES", "SE", "IS", "LI", "NO", "CH",
)
LATAM_COUNTRIES = (
    "Argentina", "Bolivia", "Brazil", "Chile", "Colombia", "Costa Rica", "Cuba", "Dominican Republic", "Ecuador", "El Salvador", "Guatemala",
    "Honduras", "Mexico", "Nicaragua", "Panama", "Paraguay", "Peru", "Uruguay", "Venezuela",
)
#: Words after a tool's first word that make a posting one about the tool alone; months' worth of each floor period.
TOOL_ROLES = ("administrator", "consultant", "architect", "certification", "certified")
CURRENCIES = ("EUR", "USD", "GBP", "CHF", "PLN", "CZK", "SEK", "NOK", "DKK", "CAD", "AUD", "MXN", "BRL")
PERIODS = ("hour", "day", "month", "year")


class ConfigError(ValueError):
    """All problems of a configuration, one a line."""


def deep_merge(base: dict, over: dict) -> dict:
    """over laid on base: mappings merge, lists and values replace, an explicit None replaces too."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def resolve_extends(name: str, configs: dict[str, dict]) -> dict:
    """A configuration over the chain that it extends; lists named `rejected` add up."""
    chain, seen = [], set()
    while name:
        if name in seen or name not in configs:
            raise ConfigError(f"extends: {name} is {'repeated' if name in seen else 'unknown'}")
        seen.add(name)
        chain.append(configs[name])
        name = configs[name].get("extends")
    out: dict = {}
    for c in reversed(chain):
        rejected = [*out.get("rejected", []), *c.get("rejected", [])]
        out = deep_merge(out, {k: v for k, v in c.items() if k != "extends"})
        if rejected:
            out["rejected"] = list(dict.fromkeys(rejected))
    return out


def read_yaml(path: str) -> dict:
    """A mapping from a YAML file, read through the session's file system. Needs PyYAML, which is asked for only here."""
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("reading YAML needs PyYAML") from e
    try:
        with open(path, encoding="utf-8") as f:
            found = yaml.safe_load(f)
    except FileNotFoundError as e:
        raise ConfigError(f"{path}: no such file") from e
    except yaml.YAMLError as e:
        raise ConfigError(f"{path}: no valid YAML: {e}") from e
    if not isinstance(found, dict):
        raise ConfigError(f"{path}: no mapping")
    return found


def choose_region(declared: dict[str, str], accepted: list[str]) -> str | None:
    """worldwide where it is both declared and accepted, then the first accepted one that is declared, then the first declared.
    Without a preference none is chosen, and a platform's general addresses stay."""
    if not declared or not accepted:
        return None
    if "worldwide" in accepted and "worldwide" in declared:
        return "worldwide"
    return next((r for r in accepted if r in declared), next(iter(declared)))


@dataclass(frozen=True)
class Platform:
    name: str
    streams: tuple[str, ...]
    urls: tuple[str, ...] = ()
    categories: dict[str, Any] = field(default_factory=dict)
    region_urls: dict[str, str] = field(default_factory=dict)
    tier: int = 9
    order: int = 99
    active: bool = True


def resolve_platforms(platforms: list[Platform], stream: str, accepted_regions: list[str], disabled: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(platform, url) in the order of tiers. A category is a slug or several; region addresses come before general ones."""
    out = []
    for p in sorted((p for p in platforms if p.active and p.name not in disabled and stream in p.streams), key=lambda p: (p.tier, p.order)):
        region = choose_region(p.region_urls, accepted_regions)
        bases = [p.region_urls[region]] if region else list(p.urls)
        slugs = p.categories.get(stream, "")
        for base in bases:
            out += [(p.name, base.replace("{category}", s)) for s in ([slugs] if isinstance(slugs, str) else slugs)]
    return out


def coverage_errors(platforms: list[Platform], tiers: dict[str, list[str]], stream: str, disabled: tuple[str, ...] = ()) -> list[str]:
    """Active platforms of a stream without a tier, and platforms in more than one."""
    placed = [n for names in tiers.values() for n in names]
    missing = [p.name for p in platforms if p.active and stream in p.streams and p.name not in placed and p.name not in disabled]
    return [f"{n}: no tier" for n in missing] + [f"{n}: in several tiers" for n in dict.fromkeys(placed) if placed.count(n) > 1]


def seniority_lexicon(base: dict[str, str], *templates: dict[str, str]) -> dict[str, str]:
    """Bands by title term, in lower case; later ones win. Terms that name no band are a problem."""
    out = {str(k).lower(): v for table in (base, *templates) for k, v in table.items()}
    if wrong := [f"seniority: {k} is {v}" for k, v in out.items() if v not in BANDS]:
        raise ConfigError("\n".join(wrong))
    return out


def keyword_places(keywords: list[str], places: list[str]) -> list[tuple[str, str]]:
    """Each keyword with each place, keyword by keyword: the addresses that a search by cards asks for. Both are short lists of
    the configuration, so this is no join of tables."""
    return [(k, p) for k in keywords for p in (places or [""])]


class Checks:
    """Problems of a nested mapping, each named by its path."""

    def __init__(self, config: dict):
        self.config, self.wrong = config, []

    def at(self, path: str) -> Any:
        value: Any = self.config
        for part in path.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        return value

    def need(self, path: str, ok, what: str) -> None:
        if not ok(self.at(path)):
            self.wrong.append(f"{path}: {what}")

    def may(self, path: str, ok, what: str) -> None:
        if self.at(path) is not None:
            self.need(path, ok, what)

    def keys(self, path: str, allowed: tuple[str, ...]) -> None:
        value = self.at(path) if path else self.config
        if value is None:
            return
        if not isinstance(value, dict):
            self.wrong.append(f"{path}: a mapping")
        else:
            self.wrong += [f"{path or 'top level'}: unknown key {k}" for k in value if k not in allowed]


def _listed(allowed: tuple[str, ...] | None = None, empty: bool = False):
    return lambda v: isinstance(v, list) and (empty or bool(v)) and (allowed is None or all(x in allowed for x in v))


def _one(allowed: tuple) -> Any:
    return lambda v: v in allowed


def _number(low: float, high: float, above: bool = False):
    return lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and (low < v if above else low <= v) and v <= high


def _text(v: Any) -> bool:
    return isinstance(v, str) and bool(v)


def _flag(v: Any) -> bool:
    return isinstance(v, bool)


def config_errors(config: dict, name: str, platforms: list[Platform]) -> list[str]:
    """All problems of a merged configuration; empty if it can be used."""
    c = Checks(config)
    c.keys("", SECTIONS)
    c.need("schema_version", _one((1,)), "1")
    c.need("id", _one((name,)), f"the configuration's own name, {name}")
    for path in ("candidate.display_name", "candidate.location.city", "candidate.location.country", "candidate.location.timezone", "search.stream"):
        c.need(path, _text, "a text")
    for path in ("candidate.location_match_terms", "candidate.citizenship", "search.keywords.core", "search.archetypes"):
        c.need(path, _listed(), "a list that isn't empty")
    c.need("search.keywords.expanded", _listed(empty=True), "a list")
    c.need("candidate.eligibility.employment_models", _listed(EMPLOYMENT_MODELS), f"some of {', '.join(EMPLOYMENT_MODELS)}")
    c.need("candidate.eligibility.needs_visa_sponsorship", _flag, "true or false")
    c.need("search.work_model", _listed(WORK_MODELS), f"some of {', '.join(WORK_MODELS)}")
    for path in ("search.subvariant", "search.subvariant_secondary"):
        c.may(path, lambda v: isinstance(v, str), "a text")
    if c.at("search.target_seniority") is not None:
        c.keys("search.target_seniority", ("bands", "strict"))
        c.need("search.target_seniority.bands", _listed(BANDS), f"some of {', '.join(BANDS)}")
        c.may("search.target_seniority.strict", _flag, "true or false")
    if c.at("search.employment_type") is not None:
        c.keys("search.employment_type", ("accept",))
        c.need("search.employment_type.accept", _listed(EMPLOYMENT_TYPES), f"some of {', '.join(EMPLOYMENT_TYPES)}")
        c.need("search.employment_type.accept", lambda v: not isinstance(v, list) or "any" not in v or len(set(v)) == 1, "any stands alone")
    c.may("search.languages", _listed(LANGUAGE_CODES), f"some of {', '.join(LANGUAGE_CODES)}")
    if c.at("compensation.floor") is not None:
        c.need("compensation.floor.amount", _number(0, float("inf"), above=True), "above 0")
        c.need("compensation.floor.currency", _one(CURRENCIES), f"one of {', '.join(CURRENCIES)}")
        c.need("compensation.floor.basis", _one(("gross", "net")), "gross or net")
        c.need("compensation.floor.period", _one(PERIODS), f"one of {', '.join(PERIODS)}")
        c.need("compensation.gross_net_ratio", _number(0.3, 1.0), "0.3 to 1, as there is a floor")
    else:
        c.may("compensation.gross_net_ratio", _number(0.3, 1.0), "0.3 to 1")
    c.may("compensation.fte_fraction", _number(0, 1, above=True), "above 0, to 1")
    c.keys("run", ("effort", "effort_by_run_type"))
    c.may("run.effort", _one(EFFORTS), f"one of {', '.join(EFFORTS)}")
    c.may("run.effort_by_run_type", lambda v: isinstance(v, dict) and all(x in EFFORTS for x in v.values()), f"a mapping to {', '.join(EFFORTS)}")
    c.keys("writeback", ("consent",))
    c.may("writeback.consent", _flag, "true or false")
    for key, allowed in FILTER_MODES.items():
        if key in (c.at("hard_filters") or {}):
            c.need(f"hard_filters.{key}", _one(allowed), f"one of {', '.join(allowed)}")
    if c.at("hard_filters.employment_mismatch") and not c.at("search.employment_type"):
        c.wrong.append("hard_filters.employment_mismatch: needs search.employment_type")
    c.may("hard_filters.timezone_window.latest_end_local", lambda v: bool(re.fullmatch(r"\d{2}:\d{2}", str(v))), "HH:MM")
    c.need("scoring.surface_threshold", _number(1, 10), "1 to 10")
    tiers, disabled = c.at("platforms.tiers") or {}, tuple(c.at("platforms.disabled") or ())
    c.wrong += [f"platforms.tiers: {t} is not 1, 2 or 3 with a list" for t, names in tiers.items() if t not in (1, 2, 3) or not isinstance(names, list)]
    lists = {t: names for t, names in tiers.items() if isinstance(names, list)}
    known = {p.name for p in platforms}
    c.wrong += [f"platforms: {n} is not in the catalog" for n in dict.fromkeys([*(n for names in lists.values() for n in names), *disabled]) if n not in known]
    c.wrong += [f"platforms: {e}" for e in coverage_errors(platforms, lists, c.at("search.stream") or "", disabled)]
    if not c.at("dry_run") and not c.at("output.notion.dry_run"):
        for table in ("tracker", "passed_seen"):
            c.need(f"output.notion.{table}.data_source_id", lambda v: len(str(v or "").replace("-", "")) == 32, "32 characters")
        c.need("output.notion.pinned_pages.runs", bool, "a page")
    return c.wrong


def catalog_errors(platforms: list[dict]) -> list[str]:
    """Names once each, a tier for what is active, and nothing active that is not verified."""
    names = [p.get("slug") for p in platforms]
    wrong = [f"platform {i + 1}: no name" for i, n in enumerate(names) if not n] + [f"{n}: named twice" for n in dict.fromkeys(names) if n and names.count(n) > 1]
    for p in platforms:
        if p.get("active") and p.get("tier_default") not in (1, 2, 3):
            wrong.append(f"{p.get('slug')}: active without a tier")
        if p.get("status") not in (None, "verified", "unverified"):
            wrong.append(f"{p.get('slug')}: status {p['status']}")
        if p.get("status") == "unverified" and p.get("active"):
            wrong.append(f"{p.get('slug')}: active and not verified")
    return wrong


@dataclass(frozen=True)
class Profile:
    keywords: tuple[str, ...]
    languages: tuple[str, ...] = ("en",)
    bands: tuple[str, ...] = ()
    employment: tuple[str, ...] = ()
    work_model: tuple[str, ...] = ()
    location_terms: tuple[str, ...] = ()
    hard_drop_terms: tuple[str, ...] = ()
    exclusion_terms: tuple[str, ...] = ()
    tool_lockin: tuple[str, ...] = ()
    country: str = ""
    citizenship: tuple[str, ...] = ()
    latest_end_local: str | None = None
    #: travel, clearance, grind_culture, closed_location_list, work_arrangement, employment_mismatch, language_mismatch
    modes: dict[str, str] = field(default_factory=dict)
    floor: Floor = Floor()
    freshness_hours: int = 48
    read_cap: int = 60
    surface_threshold: float = 7.0
    full_sweep: bool = False
    exempt_platform: str | None = None
    #: Names of registered detectors (functions/detectors.py) that are noted beside the built-in ones.
    detectors: tuple[str, ...] = ()

    def check(self) -> "Profile":
        wrong = []
        if not [k for k in self.keywords if k.strip()]:
            wrong.append("keywords: at least one")
        wrong += [f"bands: {b}" for b in self.bands if b not in BANDS]
        wrong += [f"work_model: {m}" for m in self.work_model if m not in WORK_MODELS]
        wrong += [f"employment: {m}" for m in self.employment if m not in EMPLOYMENT_TYPES]
        if "any" in self.employment and len(set(self.employment)) > 1:
            wrong.append("employment: any stands alone")
        wrong += [f"languages: {x}" for x in self.languages if x not in LANGUAGE_CODES]
        wrong += [f"modes: {k}={v}" for k, v in self.modes.items() if v not in FILTER_MODES.get(k, ())]
        if self.latest_end_local is not None and not re.fullmatch(r"\d{2}:\d{2}", self.latest_end_local):
            wrong.append("latest_end_local: HH:MM")
        wrong += [f"detectors: {d} is not registered" for d in self.detectors if d not in REGISTRY]
        if self.freshness_hours <= 0 or self.read_cap < 0:
            wrong.append("freshness_hours and read_cap: not negative")
        if wrong:
            raise ConfigError("\n".join(wrong))
        return self

    @staticmethod
    def of(config: dict) -> "Profile":
        """From a nested configuration that config_errors found nothing wrong with."""
        at = Checks(config).at
        hard, floor = at("hard_filters") or {}, at("compensation.floor")
        more = {} if floor is None else {"floor": Floor(floor["amount"], floor["currency"], floor["period"], floor["basis"], at("compensation.gross_net_ratio") or 1.0, at("compensation.fte_fraction"))}
        if at("caps.max_full_reads_per_run") is not None:
            more["read_cap"] = int(at("caps.max_full_reads_per_run"))
        return Profile(
            keywords=tuple([*at("search.keywords.core"), *(at("search.keywords.expanded") or [])]),
            languages=tuple(at("search.languages") or ("en",)),
            bands=tuple(at("search.target_seniority.bands") or ()),
            employment=tuple(at("search.employment_type.accept") or ()),
            work_model=tuple(at("search.work_model") or ()),
            location_terms=tuple(at("candidate.location_match_terms") or ()),
            hard_drop_terms=tuple(hard.get("role_hard_drop_terms") or ()),
            exclusion_terms=tuple(hard.get("role_exclusion_terms") or ()),
            tool_lockin=tuple(hard.get("tool_lockin_drop") or ()),
            country=at("candidate.location.country") or "",
            citizenship=tuple(at("candidate.citizenship") or ()),
            latest_end_local=at("hard_filters.timezone_window.latest_end_local"),
            modes={k: hard[k] for k in FILTER_MODES if k in hard},
            freshness_hours=at("schedule.freshness_window_h") or 48,
            surface_threshold=at("scoring.surface_threshold") or 7.0,
            **more,
        ).check()

    def rules(self) -> Rules:
        """The patterns that this profile asks for; terms are taken literally. Who lives in the US is not barred by US-only
        postings, who may work in the EU not by its citizenship, who lives in Latin America not by its payrolls; the rest goes
        by mode."""
        slug = lambda s: re.sub(r"[^a-z0-9]+", "_", s.lower()).strip("_")
        one = lambda s: rf"(?i)\b({re.escape(s.lower())})\b"
        country = self.country.lower()
        drops = {
            "us_only": country not in US_NAMES,
            "clearance": self.modes.get("clearance", "drop") == "drop",
            "travel": self.modes.get("travel", "none") == "none",
            "grind_culture": self.modes.get("grind_culture", "drop") == "drop",
        }
        flagged = {
            "timezone": bool(self.latest_end_local),
            "eu_citizenship": not set(self.citizenship) & set(EU_CITIZENSHIPS),
            "latam_payroll": country not in {c.lower() for c in LATAM_COUNTRIES},
        }
        flags = {k: p for k, p in FLAGS.items() if flagged[k]}
        if self.tool_lockin:
            tools = [t.lower() for t in self.tool_lockin]
            whole = [re.escape(t) for t in tools if " " in t]
            first = sorted({re.escape(t.split()[0]) for t in tools})
            flags["tool_lockin"] = rf"(?i)\b({'|'.join([*whole, f'({"|".join(first)}) ({"|".join(TOOL_ROLES)})'])})\b"
        flags |= {f"excl_{slug(t)}": one(t) for t in (*self.exclusion_terms, *self.hard_drop_terms)}
        return Rules(
            title_drop={f"harddrop_{slug(t)}": one(t) for t in self.hard_drop_terms},
            auto_drop={k: p for k, p in AUTO_DROP.items() if drops[k]},
            flags=flags,
            must_include=self.location_terms,
            closed_list=self.modes.get("closed_location_list", "drop_if_absent") == "drop_if_absent",
        )
