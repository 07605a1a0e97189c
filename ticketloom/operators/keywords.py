"""Keyword baseline: substring votes per department."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketloom.taxonomy import DEPARTMENT_KEYWORDS, FALLBACK_DEPARTMENT


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur as substrings of the lower-cased text."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for word in keywords:
        total = total + F.contains(lowered, F.lit(word.lower())).cast("int")
    return total


def keyword_department(text: Column, keywords: dict[str, list[str]] = DEPARTMENT_KEYWORDS) -> Column:
    """Department with most votes; the earlier one wins a tie, no vote at all is feedback."""
    votes = F.array(
        *[
            F.struct(keyword_hits(text, words).alias("hits"), F.lit(-i).alias("neg_ord"), F.lit(d).alias("department"))
            for i, (d, words) in enumerate(keywords.items())
        ]
    )
    best = F.array_max(votes)
    return F.when(best["hits"] > 0, best["department"]).otherwise(FALLBACK_DEPARTMENT)
