"""Seniority, sector and validity of job titles."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .values import any_of, bind, blank, has_words, js_trim


_WORD = re.compile("[a-z0-9_]+")


def _matches(text: Column, words: Column, pattern: str) -> Column:
    """Whether an alternative of ``pattern`` stands between word boundaries in a lower-case text.

    Single words are looked up in the text's words. Phrases are tried by their own pattern, and only in a
    text that holds their literal parts. A leading ~ marks alternatives of which only {braced} ones need boundaries.
    """
    loose = pattern.startswith("~")
    parts = pattern.removeprefix("~").split("|")
    single = [p.strip("{}") for p in parts if _WORD.fullmatch(p.strip("{}"))]
    found = [F.arrays_overlap(words, F.array(*map(F.lit, single)))] if single else []
    for phrase in (p for p in parts if not _WORD.fullmatch(p.strip("{}"))):
        literal = [text.contains(x) for x in re.split(r"\.\??", phrase)]
        found.append(reduce(and_, literal) if loose else reduce(and_, [*literal, has_words(text, phrase)]))
    return reduce(or_, found)


def _first(text: Column, rules, otherwise: Column) -> Column:
    """The name of the first rule that fits, the text lowered and split once."""

    def choose(t: Column) -> Column:
        words = F.array_distinct(F.split(t, "[^a-z0-9_]+"))
        return bind(words, lambda w: reduce(lambda acc, r: acc.when(_matches(t, w, r[1]), r[0]), rules[1:], F.when(_matches(t, w, rules[0][1]), rules[0][0])).otherwise(otherwise))

    return bind(text, choose)


def infer_level(title: Column) -> Column:
    """First level whose words occur; none: the default; null or empty: null."""
    return F.when(title.isNull() | (title == ""), F.lit(None).cast("string")).otherwise(_first(F.lower(title), R.LEVELS, F.lit(R.DEFAULT_LEVEL)))


def infer_sector(title: Column, department: Column) -> Column:
    """First sector whose words occur in title and department; none, or no title: null."""
    text = F.concat(F.lower(title), F.lit(" "), F.lower(F.coalesce(department, F.lit(""))))
    none = F.lit(None).cast("string")
    return F.when(title.isNull() | blank(title), none).otherwise(_first(text, R.SECTORS, none))


def valid_title(title: Column) -> Column:
    """At least three characters, no navigation text, and no short title that begins with one."""

    def judge(low: Column) -> Column:
        return low.isin(*R.JUNK_TITLES) | ((F.length(low) < 40) & any_of(low.startswith(j) for j in R.JUNK_TITLES))

    return F.coalesce((F.length(title) >= 3) & ~bind(js_trim(F.lower(title)), judge), F.lit(False))
