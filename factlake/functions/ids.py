"""Written forms of item ids and page titles, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the prefix under which items are also written.
ENTITY_PREFIX = "http://kb.example/entity/"
#: Fixed value: an entity id, a letter and digits.
ENTITY_ID = r"^[QqPp][0-9]+$"
_SPACE = r"[\s\u00a0\ufeff\u2000-\u200b\u202f\u3000]+"


def outer_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_SPACE}|{_SPACE}$", "")


def plain_id(c: Column, prefix: str = ENTITY_PREFIX) -> Column:
    """`q12 `, `http://.../Q12` -> `Q12`. Null stays null; anything else is only trimmed and put in capitals."""
    other = F.upper(F.regexp_replace(outer_trim(c), "(?i)^" + prefix.replace(".", r"\."), ""))
    return F.when(c.rlike("^[QPL][0-9]+$"), c).otherwise(other)  # most are plain already


def plain_title(c: Column) -> Column:
    """`mount_X` -> `Mount X`. Null stays null, empty stays empty."""
    t = F.trim(F.translate(c, "_", " "))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))


def decoded_title(c: Column) -> Column:
    """plain_title of a percent-encoded title; `+` is no space, and what can't be decoded stays as written."""
    return plain_title(F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c))


def is_entity_id(c: Column) -> Column:
    """Q or P in either case and at least one ASCII digit, nothing else; false for null."""
    return F.coalesce(c.rlike(ENTITY_ID), F.lit(False))


def id_number(c: Column) -> Column:
    """The number of an id; null where there is none."""
    return F.when(c.rlike("^[A-Za-z][0-9]+$"), F.substring(c, 2, 1 << 30)).try_cast("bigint")
