"""File names to (stim, depth, name, date): ordered rules, first match wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NameRule:
    """A layout: a regular expression and the groups that hold the fields (0 = absent)."""

    pattern: str
    stim: int = 0
    depth: int = 0
    name: int = 0
    date: int = 0


# fixed values: recorded layouts and accepted object angles and odour orders
MEC_RULES = (NameRule(r"^([^-_]+(?:-[^-_]+)?)_([0-9]{8})-[0-9]{1,2}-[^-]+-([^-]+)-[^-]+$", depth=3, name=1, date=2),)
LC_RULES = (NameRule(r"^([^-]+)-([0-9]{8})-(?:[^-]+-)*?([^-]*?)[uU][mM](?:-.*)?$", depth=3, name=1, date=2),)
TRACK_RULES = (NameRule(r"^([^-_]+)_(?:[^-_]+_){6}([0-9]{6})_([^-_]+?)um[^-]*$", depth=3, name=1, date=2),)
LEC_RULES = (
    NameRule(r"^([^_]+)_([0-9]{8})-(?:[^-]+-)*position([^-]+)$", stim=3, name=1, date=2),
    NameRule(r"^([^_]+)_([0-9]{8})-([0-9]+)(?:banana|set|APPLE)$", stim=3, name=1, date=2),
    NameRule(r"^([^_]+)_([0-9]{8})-(?:[^-]+-)*([^-]+)$", stim=3, name=1, date=2),
)
ANGLES = {
    "0": "0", "90": "90", "180": "180", "270": "270", "NO": "NO",
    "noobject": "NO", "no": "NO", "NO2": "NO", "no2": "NO", "NOobject": "NO", "NO_1": "NO", "NO_2": "NO",
    "zero": "0", "0_1": "0", "0_2": "0", "0banana": "0", "position0": "0",
    "90_1": "90", "90_2": "90", "position90": "90",
    "180_1": "180", "180_2": "180", "position180": "180",
    "270_1": "270", "270_2": "270", "position270": "270",
}
ODOURS = ("xab", "xba", "abx", "axb", "bxa", "bax")


def parse_name(c: Column, rules) -> Column:
    """Struct (rule, stim, depth, name, date) of the first matching layout, or null."""
    def fields(k, r):
        get = lambda g: F.regexp_extract(c, r.pattern, g) if g else F.lit(None).cast("string")
        return F.struct(F.lit(k).alias("rule"), get(r.stim).alias("stim"), get(r.depth).alias("depth"), get(r.name).alias("name"), get(r.date).alias("date"))

    out = F.lit(None)
    for k, r in reversed(list(enumerate(rules))):
        out = F.when(c.rlike(r.pattern), fields(k, r)).otherwise(out)
    return out


def object_angle(stim: Column) -> Column:
    """Normalised object angle, null if it is not an accepted one."""
    table = F.create_map(*[F.lit(v) for kv in ANGLES.items() for v in kv])
    return F.element_at(table, stim)


def odour_order(stim: Column) -> Column:
    return F.when(F.lower(stim).isin(*ODOURS), stim)


def is_cylinder(path: Column) -> Column:
    return path.rlike("cylinder|round|circle|CYLINDER|ROUND|CIRCLE|Cylinder|Round|Circle")


def is_rotated(path: Column) -> Column:
    return F.lower(path).rlike("evening|rotated")


def recording_date(text: Column) -> Column:
    """Dates written year first or month first."""
    return F.coalesce(F.try_to_date(text, "yyyyMMdd"), F.try_to_date(text, "MMddyyyy"))
