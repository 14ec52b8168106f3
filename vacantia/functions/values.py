"""Value helpers whose semantics differ from the built-in defaults."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trims away at both ends (tab, line breaks, no-break space, byte order mark).
_BLANK = r"[\s ﻿]+"


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_BLANK}|{_BLANK}$", "")


def blank(c: Column) -> Column:
    """Nothing is left when trimmed; stops at the first character that stays."""
    return ~c.rlike(f"[^{_BLANK[1:-2]}]")


def nonempty(c: Column) -> Column:
    """Empty text counts as missing."""
    return F.when(c != "", c)


def first_of(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(nonempty(c) for c in cols))


def any_of(conditions) -> Column:
    """Disjunction; no condition at all is false."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def words_pattern(alternatives: str) -> str:
    """Alternatives between ASCII word boundaries, in the form that all regex dialects read alike."""
    return f"(^|[^a-z0-9_])({alternatives})($|[^a-z0-9_])"


def has_words(c: Column, alternatives: str) -> Column:
    return c.rlike(words_pattern(alternatives))


def alternatives(terms) -> str:
    """Literal terms as an alternation."""
    return "|".join(re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", t) for t in terms)


def contains_any(c: Column, terms) -> Column:
    return c.rlike(alternatives(terms))


def ilike_any(cols, terms) -> Column:
    """Some column contains some term, any case; % and _ in a term stay wildcards."""
    return any_of(c.ilike(f"%{t}%") for t in terms for c in cols)


def bind(value: Column, make) -> Column:
    """``make`` of a value that is computed once, however often ``make`` names it (branches of a CASE are not shared otherwise)."""
    return F.element_at(F.transform(F.array(value), make), 1)


def cut(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)
