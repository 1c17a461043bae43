"""Pseudonyms, fingerprints and hash orders, all from sha-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pseudonym(value: Column, namespace: str, prefix: str = "player_") -> Column:
    """prefix and 32 hex digits; blank values stay null."""
    text = value.cast("string")
    digest = F.sha2(F.concat(F.lit(namespace), F.char(F.lit(0)), text), 256)
    return F.when(F.trim(text) != "", F.concat(F.lit(prefix), F.substring(digest, 1, 32)))


def set_fingerprint(value: Column, separator: str = "\n") -> Column:
    """An aggregate: sha-256 over the distinct values in order.

    The digest is over one text of all values, so one task holds a group's values;
    meant for ids of a patch or a fold, not for groups beyond some ten million.
    """
    return F.sha2(F.array_join(F.sort_array(F.collect_set(value.cast("string"))), separator), 256)


def hash_order(seed: int, value: Column) -> Column:
    """Text that orders values as their salted digests do."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), value.cast("string")), 256)
