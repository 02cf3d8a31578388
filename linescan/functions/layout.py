"""Key prefixes of hours: bucket layouts as Column expressions."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layout of a path by year, month, day and hour, in the notation that names a fixed instant.
YMDH = "2006/01/02/15"


def checked_date(dt: Column) -> Column:
    """``dt`` itself; a date that isn't 8 characters long is an error when the query runs."""
    return F.when(F.length(dt) == 8, dt).otherwise(F.raise_error(F.concat(F.lit("not a date of 8 characters: "), F.coalesce(dt, F.lit("null")))))


def hive(dt: Column, hour: Column, hour_name: str = "hour", around: str = "") -> Column:
    return F.concat(F.lit(f"{around}dt="), dt, F.lit(f"/{hour_name}="), hour)


def hive_short(dt: Column, hour: Column, around: str = "") -> Column:
    return hive(dt, hour, "h", around)


def by_path(dt: Column, hour: Column, around: str = "") -> Column:
    dt = checked_date(dt)
    return F.concat(F.lit(around), F.concat_ws("/", F.substring(dt, 1, 4), F.substring(dt, 5, 2), F.substring(dt, 7, 2), hour))


def literal(template: str) -> Column:
    return F.lit(template)


def date_part(template: str, dt: Column, hour: Column) -> Column:
    """The prefix part that a date template stands for.

    A template with percent signs is filled in where they stand (%Y %m %d %H).
    Otherwise one of: an example such as ``dt=20240101/hour=00`` or ``.../h=00``,
    or ``2006/01/02/15``; text around the example goes in front of the result. Any
    other template is used as it is, with a warning.
    """
    if "%" in template:
        date = checked_date(dt)
        known = {"%Y": F.substring(date, 1, 4), "%m": F.substring(date, 5, 2), "%d": F.substring(date, 7, 2), "%H": hour}
        return F.concat(*(known.get(p, F.lit(p)) for p in re.split(r"(%[YmdH])", template) if p))
    for name in ("hour", "h"):
        if "dt=" in template and f"/{name}=" in template:
            return hive(dt, hour, name, re.sub(rf"dt=.*/{name}=\d\d", "", template))
    if YMDH in template:
        return by_path(dt, hour, template.replace(YMDH, ""))
    warnings.warn(f"no date layout in {template!r}; every hour has the same prefix", stacklevel=2)
    return literal(template)


@dataclass
class Bucket:
    """A bucket's name, its path parts as (kind, text) with kind ``static`` or ``date``, and
    patterns of which one must match the key behind the prefix (none: all keys)."""

    name: str
    path: list[tuple[str, str]]
    patterns: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, config: dict) -> Bucket:
        """From a mapping with ``bucket``, ``path`` (each part ``static_path`` or ``datefmt``) and ``only_prefix_patterns``."""
        parts = [("date", p["datefmt"]) if "datefmt" in p else ("static", p["static_path"]) for p in config["path"]]
        return cls(config["bucket"], parts, list(config.get("only_prefix_patterns") or []))

    def prefix(self, dt: Column, hour: Column) -> Column:
        """Non-empty parts joined by ``/``; one slash at the end of a static part counts as the joint."""
        parts = [date_part(t, dt, hour) if kind == "date" else F.lit(t.removesuffix("/")) for kind, t in self.path]
        return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/")


def check_buckets(buckets: list[Bucket]) -> list[Bucket]:
    """The buckets; an empty list is refused, and so is a bucket without a date part, since all of it would be listed."""
    if not buckets:
        raise ValueError("no buckets are given")
    for b in buckets:
        if not any(kind == "date" for kind, _ in b.path):
            raise ValueError(f"bucket {b.name!r} has no date part in its path")
    return buckets
