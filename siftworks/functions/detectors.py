"""Detectors by name: what a user adds to the triage without changing it, from Python or from SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The parts of a posting that a detector may ask for.
PARTS = ("title", "place", "body", "pay")


@dataclass(frozen=True)
class Detector:
    name: str
    make: Callable[..., Column]
    parts: tuple[str, ...]
    flags: bool


REGISTRY: dict[str, Detector] = {}


def register_detector(name: str, make: Callable[..., Column], parts: tuple[str, ...] = ("body",), flags: bool = True) -> Detector:
    """A detector for `Profile(detectors=(name, ...))`. make takes the parts as Columns, in that order. For rows that stay the triage
    notes what it finds as note_<name>, and flags the row by that name if it found something; null, false, an empty text and an
    empty array are nothing. flags=False leaves the note alone. A later detector of a name takes the place of an earlier one."""
    if not name.isidentifier() or name != name.lower():
        raise ValueError(f"{name}: lower-case letters, digits and _")
    if wrong := [p for p in parts if p not in PARTS]:
        raise ValueError(f"{name}: no such part: {', '.join(wrong)}")
    REGISTRY[name] = Detector(name, make, tuple(parts), flags)
    return REGISTRY[name]


def register_sql_detector(spark: SparkSession, name: str, expression: str, parts: tuple[str, ...] = ("body",), returns: str = "string", flags: bool = True) -> Detector:
    """The same from an SQL expression over the parts' names. It is also a temporary function of this session, name(parts...),
    which Spark puts into the plan as the expression itself."""
    detector = register_detector(name, lambda *c: F.call_function(name, *c), parts, flags)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{p} STRING' for p in parts)}) RETURNS {returns} RETURN {expression}")
    return detector


def build(name: str, **columns: Column) -> Column:
    detector = REGISTRY[name]
    return detector.make(*(columns[p] for p in detector.parts))


def flagged(found: Column) -> Column:
    """Whether a note says anything, whatever its type."""
    return ~F.to_json(F.struct(found.alias("v"))).isin("{}", '{"v":false}', '{"v":""}', '{"v":[]}')
