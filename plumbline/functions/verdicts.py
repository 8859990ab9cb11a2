"""Three-valued verdicts: good, bad, and could-not-look, which is never a pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GOOD, BAD, COULD_NOT_LOOK = "good", "bad", "could_not_look"

#: Words that say why a check could not look.
REASON_WORDS = ("missing", "unreadable", "name_not_found")


def word(ok: Column) -> Column:
    """The word of a nullable boolean; null is could-not-look."""
    return F.when(ok.isNull(), COULD_NOT_LOOK).when(ok, GOOD).otherwise(BAD)


def worst_of(verdict: Column, order: list[str]) -> Column:
    """Aggregate: of a group's words the one that comes first in `order` (the worst first).

    An unknown word counts as could-not-look; the rank tables of the roll-ups
    differ, so each names its own.
    """
    known = F.when(verdict.isin(*order), verdict).otherwise(COULD_NOT_LOOK)
    ranks = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    return F.min_by(known, F.coalesce(ranks[known], F.lit(len(order))))
