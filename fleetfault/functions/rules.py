"""Ordered first-match classification as one CASE expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``result`` is a struct; all rules of a catalogue share its fields."""

    when: Column
    result: Column


def first_match(rules: Sequence[Rule]) -> Column:
    chain = F.when(rules[0].when, rules[0].result)
    for rule in rules[1:]:
        chain = chain.when(rule.when, rule.result)
    return chain


def summarise(text: Column, forms: Sequence[tuple[str, str]], fallback: str) -> Column:
    """First form whose pattern is found, its groups put into the template."""
    from fleetfault.functions.text import fill

    chain = None
    for pattern, template in forms:
        groups = [F.regexp_extract(text, pattern, i + 1) for i in range(template.count("{}"))]
        filled = fill(template, *groups) if groups else F.lit(template)
        chain = F.when(text.rlike(pattern), filled) if chain is None else chain.when(text.rlike(pattern), filled)
    return F.lit(fallback) if chain is None else chain.otherwise(F.lit(fallback))
