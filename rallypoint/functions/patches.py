"""Public patches: resolution from build versions, order, ages and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (year, build major, public major); minors run from 1 to 99.
RULES = ((2026, 16, 26),)
_VERSION = r"^(\d+)\.(\d+)(?:\.\d+)*$"


def resolve(version: Column, created: Column) -> Column:
    """struct(public_patch, patch_status) of a build version and a creation time (a timestamp, read in UTC).

    Numbers too long for an integer belong to no rule.
    """
    ok = F.coalesce(version.rlike(_VERSION), F.lit(False))
    major = F.when(ok, F.regexp_extract(version, _VERSION, 1).try_cast("int"))
    minor = F.when(ok, F.regexp_extract(version, _VERSION, 2).try_cast("int"))
    year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(created.cast("timestamp")) / 86_400).cast("int")))
    public, known_year = F.lit(None).cast("int"), F.lit(False)
    for rule_year, build, shown in RULES:
        public = F.when((year == rule_year) & (major == build) & minor.between(1, 99), shown).otherwise(public)
        known_year = known_year | (year == rule_year)
    status = F.when(~ok, "malformed").when(~F.coalesce(known_year, F.lit(False)), "unsupported_year")
    status = status.when(public.isNull(), "unsupported_api_patch").otherwise("resolved")
    return F.struct(F.when(ok & public.isNotNull(), F.concat_ws(".", public, minor)).alias("public_patch"), status.alias("patch_status"))


def major(patch: Column) -> Column:
    return F.split_part(patch, F.lit("."), F.lit(1)).cast("int")


def minor(patch: Column) -> Column:
    return F.split_part(patch, F.lit("."), F.lit(2)).cast("int")


def order(patch: Column) -> Column:
    """A struct that sorts patches by number, not by text."""
    return F.struct(major(patch).alias("major"), minor(patch).alias("minor"))


def age(patch: Column, target: Column) -> Column:
    """Minors behind the target; null across majors."""
    return F.when(major(patch) == major(target), minor(target) - minor(patch))


def at_age(target: Column, years: Column) -> Column:
    """The patch so many minors behind the target; a minor below zero is an error."""
    behind = minor(target) - years
    return F.when(behind < 0, F.raise_error(F.lit("no patch so far behind"))).otherwise(F.concat_ws(".", major(target), behind))


def window(target: Column, size: int) -> Column:
    """The newest `size` patches up to the target, newest first, never below minor 1."""
    lowest = F.greatest(F.lit(1), minor(target) - (size - 1))
    return F.transform(F.sequence(minor(target), lowest, F.lit(-1)), lambda m: F.concat_ws(".", major(target), m))
