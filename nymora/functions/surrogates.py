"""Surrogates by type and number: placeholders, realistic fakes, or a caller's own function."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


class Placeholders:
    """``template`` takes {type} and {n}."""

    def __init__(self, template: str = fixed.PLACEHOLDER):
        if "{n}" not in template:
            raise ValueError("a template needs {n}")
        self.template = template

    def column(self, type_: Column, original: Column, n: Column) -> Column:
        parts = re.split(r"(\{type\}|\{n\})", self.template)
        return F.concat(*[type_ if p == "{type}" else n.cast("string") if p == "{n}" else F.lit(p) for p in parts if p])

    @property
    def delimited(self) -> bool:
        """Can a surrogate not be part of another? True if the number ends at a sign that isn't a letter or digit."""
        last = self.template.rpartition("{n}")[2][:1]
        return bool(last) and not last.isalnum()


class Realistic:
    """Fakes of the right shape for names, organisations, mailboxes, phones and cards; placeholders otherwise or past a pool's end."""

    delimited = False

    def __init__(self, fallback: Placeholders | None = None):
        self.fallback = fallback or Placeholders()

    def column(self, type_: Column, original: Column, n: Column) -> Column:
        def pick(values: list[str], i: Column) -> Column:
            return F.element_at(F.array(*map(F.lit, values)), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))

        def over(size: int) -> Column:
            return F.floor(n / size)

        people, orgs, phones = len(fixed.FIRST_NAMES) * len(fixed.LAST_NAMES), len(fixed.ORG_WORDS) * len(fixed.ORG_SUFFIXES), 100 * len(fixed.AREA_CODES)
        person = F.concat_ws(" ", pick(fixed.FIRST_NAMES, n), pick(fixed.LAST_NAMES, over(len(fixed.FIRST_NAMES))))
        org = F.concat_ws(" ", pick(fixed.ORG_WORDS, n), pick(fixed.ORG_SUFFIXES, over(len(fixed.ORG_WORDS))))
        email = F.concat(F.lit("user"), n.cast("string"), F.lit("@"), pick(fixed.EXAMPLE_DOMAINS, n))
        phone = F.concat(pick(fixed.AREA_CODES, over(100)), F.lit("-555-01"), F.lpad(F.pmod(n, F.lit(100)).cast("string"), 2, "0"))
        brand = F.pmod(n, F.lit(len(fixed.CARD_PREFIXES)))
        cards = [fake_card(n, prefix, size) for _, prefix, size in fixed.CARD_PREFIXES]
        card = F.element_at(F.array(*cards), (brand + 1).cast("int"))
        return (
            F.when((type_ == "PERSON") & (n <= people), person)
            .when((type_ == "ORG") & (n <= orgs), org)
            .when((type_ == "PHONE") & (n <= phones), phone)
            .when(type_ == "EMAIL", email)
            .when(type_ == "CARD", card)
            .otherwise(self.fallback.column(type_, original, n))
        )


def fake_card(n: Column, prefix: str, size: int) -> Column:
    """Prefix, the number filled with zeros, and the Luhn digit that completes them."""
    body = size - len(prefix) - 1
    partial = F.concat(F.lit(prefix), F.lpad(F.pmod(n, F.lit(10**body)).cast("string"), body, "0"))
    return F.concat(partial, luhn_digit(partial))


def luhn_digit(partial: Column) -> Column:
    digits = F.transform(F.split(F.reverse(partial), ""), lambda c, i: F.when(i % 2 == 0, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(digits, F.lit(0), lambda a, d: a + d), F.lit(10)).cast("string")


class Custom:
    """A function (type, original, n) -> str, run as an Arrow function."""

    delimited = False

    def __init__(self, make: Callable[[str, str, int], str]):
        self.make = make

    def column(self, type_: Column, original: Column, n: Column) -> Column:
        make = self.make

        @F.pandas_udf("string")
        def made(t: pd.Series, o: pd.Series, i: pd.Series) -> pd.Series:
            return pd.Series([make(*x) for x in zip(t, o, i, strict=True)], dtype=object)

        return made(type_, original, n)
