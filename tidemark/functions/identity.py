"""Human and agent identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed_values as fv


def is_agent(email: Column, name: Column | None = None) -> Column:
    """``[bot]`` in either field or a known hint in the e-mail; never a bare name."""
    mail = F.lower(email)
    hit = F.lit(False)
    for hint in fv.AGENT_EMAIL_HINTS:
        hit = hit | F.contains(mail, F.lit(hint))
    if name is not None:
        hit = hit | F.contains(F.lower(name), F.lit("[bot]"))
    return hit


def is_human(email: Column, name: Column | None = None) -> Column:
    return F.contains(email, F.lit("@")) & ~is_agent(email, name)


def any_coauthor_agent(coauthors: Column) -> Column:
    """The bracketed e-mail of any co-author, or the whole value without brackets."""

    def address(value: Column) -> Column:
        inside = F.regexp_extract(value, "<([^>]+)>", 1)
        return F.when(inside != "", inside).otherwise(F.trim(value))

    return F.exists(coauthors, lambda c: (F.trim(c) != "") & is_agent(address(c)))
