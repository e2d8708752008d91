"""Pay: parsing the first mention, and comparing it with a floor in one unit: gross a month in the floor's currency."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import match_windows

#: How a mention is written, periods, and rates to EUR.
AMOUNT = r"(?:\d{1,3}(?:[,.\s]\d{3})+|\d+(?:\.\d+)?)\s*[kK]?"
CODES = "EUR|USD|GBP|PLN|CHF|CZK|SEK|NOK|DKK|CAD|AUD|MXN|BRL"
MENTION = rf"(?iU)([€$£])?\s*({AMOUNT})(?:\s*[-–—to]+\s*([€$£])?\s*({AMOUNT}))?\s*({CODES})?\s*(?:/|\bper\b|\ba\b)?\s*(hour|hr|day|month|mo|year|yr|annum|annually|monthly|daily|hourly)?"
PERIODS = {"hour": "hour", "hr": "hour", "hourly": "hour", "day": "day", "daily": "day", "month": "month", "mo": "month", "monthly": "month", "year": "year", "yr": "year", "annum": "year", "annually": "year"}
SYMBOLS = {"€": "EUR", "$": "USD", "£": "GBP"}
TO_MONTH = {"hour": 160.0, "day": 20.0, "month": 1.0, "year": 0.08333}
TO_EUR = {"EUR": 1.0, "USD": 0.92, "GBP": 1.17, "CHF": 1.05, "PLN": 0.235, "CZK": 0.041, "SEK": 0.088, "NOK": 0.086, "DKK": 0.134, "CAD": 0.67, "AUD": 0.60, "MXN": 0.050, "BRL": 0.17}
MARGIN = 0.10


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def num(c: Column) -> Column:
    """3,000 and 3.500 and 3.5 and 65k as a number; null where it can't be read."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?U)\s*[kK]$", ""), "[, ]", "")
    value = F.regexp_replace(s, r"^(\d+)\.(\d{3})$", "$1$2").try_cast("double")
    return F.when(F.trim(c).rlike("[kK]$"), value * 1000).otherwise(value)


def parse(c: Column) -> Column:
    """struct(amount_min, amount_max, currency, period, period_stated, basis) of the first mention with a currency or a period
    and at least 5; null if there is none."""
    # One pass over the text gives each mention's groups; of bare numbers no more is read.
    windows = match_windows(c, rf"(?:{MENTION})", 60, 60, groups=6, keep=lambda m: F.concat(*(m["groups"][k] for k in (0, 2, 4, 5))) != "")

    def read(m: Column) -> Column:
        g = lambda k: F.nullif(m["groups"][k - 1], F.lit(""))
        currency = F.coalesce(F.upper(g(5)), lookup(SYMBOLS, F.coalesce(g(1), g(3))))
        period = lookup(PERIODS, F.lower(g(6)))
        return F.struct(num(m["groups"][1]).alias("first"), F.when(m["groups"][3] != "", num(m["groups"][3])).alias("second"), currency.alias("currency"), period.alias("period"), m["window"].alias("window"))

    def said(r: Column) -> Column:
        low, high = r["first"], F.coalesce(r["second"], r["first"])
        basis = F.when(F.lower(r["window"]).rlike(r"(?U)\b(net|netto)\b"), "net").otherwise("gross")
        return F.struct(
            F.least(low, high).alias("amount_min"), F.greatest(low, high).alias("amount_max"), F.coalesce(r["currency"], F.lit("USD")).alias("currency"), r["period"].alias("period"),
            r["period"].isNotNull().alias("period_stated"), basis.alias("basis"),
        )

    good = F.filter(F.transform(windows, read), lambda r: (r["currency"].isNotNull() | r["period"].isNotNull()) & (F.greatest(r["first"], r["second"]) >= 5))
    return F.get(F.transform(F.slice(good, 1, 1), said), F.lit(0))


def infer_period(amount: Column, currency: Column, to_eur: dict = TO_EUR) -> Column:
    """By magnitude in EUR; null for an unknown currency."""
    eur = amount * lookup(to_eur, currency)
    return F.when(eur >= 30000, "year").when(eur >= 1200, "month").when(eur >= 150, "day").when(eur.isNotNull(), "hour")


def to_canonical(amount: Column, currency: Column, period: Column, basis: Column, target: Column, ratio: float, to_eur: dict = TO_EUR, to_month: dict = TO_MONTH) -> Column:
    monthly = amount * lookup(to_month, period)
    return F.when(basis == "net", monthly / ratio).otherwise(monthly) * lookup(to_eur, currency) / lookup(to_eur, target)


@dataclass(frozen=True)
class Floor:
    """The least pay sought; without an amount nothing is compared."""

    amount: float | None = None
    currency: str = "EUR"
    period: str = "month"
    basis: str = "gross"
    gross_net_ratio: float = 0.75
    fte_fraction: float | None = None

    def canonical(self) -> float | None:
        if not self.amount or self.currency not in TO_EUR or self.period not in TO_MONTH:
            return None
        monthly = self.amount * TO_MONTH[self.period]
        monthly = monthly / self.gross_net_ratio if self.basis == "net" else monthly
        return round(monthly * (self.fte_fraction if self.fte_fraction is not None else 1.0), 2)


def assess(parsed: Column, floor: Floor, margin: float = MARGIN) -> Column:
    """clears, below_floor, borderline or unparseable."""
    least = floor.canonical()
    if least is None:
        return F.lit("unparseable")
    period = F.coalesce(parsed["period"], infer_period(parsed["amount_max"], parsed["currency"]))
    share = to_canonical(parsed["amount_max"], parsed["currency"], period, parsed["basis"], F.lit(floor.currency), floor.gross_net_ratio) / F.lit(least)
    return F.when(share.isNull(), "unparseable").when(share >= 1 + margin, "clears").when(share <= 1 - margin, "below_floor").otherwise("borderline")


def explained(parsed: Column, floor: Floor, margin: float = MARGIN) -> Column:
    """struct(status, detail): what assess says, and the figures behind it in words."""
    status = assess(parsed, floor, margin)
    least = floor.canonical()
    if least is None:
        return F.struct(status.alias("status"), F.lit("no parseable salary; apply estimation heuristics").alias("detail"))
    period = F.coalesce(parsed["period"], infer_period(parsed["amount_max"], parsed["currency"]))
    month = to_canonical(parsed["amount_max"], parsed["currency"], period, parsed["basis"], F.lit(floor.currency), floor.gross_net_ratio)
    whole = lambda x: F.format_number(F.bround(x, 0), 0)
    stated = F.when(parsed["period_stated"], F.lit("")).otherwise(F.lit(" [period inferred]"))
    figures = F.concat(
        F.lit("range max ≈ "), whole(month), F.lit(f" {floor.currency} gross/month vs floor "), whole(F.lit(least)), F.lit(" (parsed "), whole(parsed["amount_max"]), F.lit(" "), parsed["currency"], F.lit(" "), parsed["basis"], F.lit("/"), period, stated, F.lit(")")
    )
    after = F.when(status == "below_floor", " — verify before dropping").when(status == "borderline", " — borderline, verify").otherwise("")
    unread = F.when(parsed.isNull(), F.lit("no parseable salary; apply estimation heuristics")).otherwise(F.concat(F.lit("unknown currency "), parsed["currency"]))
    return F.struct(status.alias("status"), F.coalesce(F.concat(figures, after), unread).alias("detail"))
