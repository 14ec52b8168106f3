"""Board tokens: validity, plausibility, similarity, variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .values import js_trim, nonempty


def normalize_token(c: Column) -> Column:
    return F.regexp_replace(F.lower(js_trim(c)), "/+$", "")


def _core(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalize_token(c), r"^[_\-]+|[_\-]+$", ""), r"[_\-\s]+", "")


def is_invalid(c: Column) -> Column:
    """Missing, too short, only digits, a generic word, or a hash."""
    k = _core(c)
    bad = (F.length(k) < 2) | k.rlike("^[0-9]+$") | k.isin(*R.INVALID_TOKENS) | k.rlike("^[a-f0-9]{8,}$")
    return F.coalesce(bad, F.lit(True))


def is_plausible(c: Column) -> Column:
    k = _core(c)
    return F.coalesce(F.length(k).between(2, 50) & k.rlike("[a-z]"), F.lit(False))


def similarity(token: Column, name: Column) -> Column:
    """10: equal or contained; 5: near length and 60 % shared characters; else 0."""
    t, n = normalize_token(token), F.regexp_replace(normalize_token(name), "[^a-z0-9]", "")
    shared = F.size(F.filter(F.split(t, ""), lambda c: (c != "") & F.contains(n, c)))
    close = (F.abs(F.length(t) - F.length(n)) <= 3) & (shared >= F.greatest(F.length(t), F.length(n)) * 0.6)
    missing = nonempty(token).isNull() | nonempty(name).isNull()
    return F.when(missing, 0).when((t == n) | F.contains(n, t) | F.contains(t, n), 10).when(close, 5).otherwise(0)


def variants(token: Column) -> Column:
    """Distinct valid spellings of a token, in order."""
    t = normalize_token(token)
    dashed = F.regexp_replace(t, r"[\s_]+", "-")
    all_ = F.array(t, dashed, F.regexp_replace(t, "[-_]?[0-9]+$", ""), F.regexp_replace(dashed, "[-_]?[0-9]+$", ""), F.regexp_replace(t, "[0-9]+$", ""))
    clean = F.transform(all_, lambda v: F.regexp_replace(normalize_token(v), "[-_]+$", ""))
    return F.array_distinct(F.filter(clean, lambda v: (v != "") & ~is_invalid(v)))


def clean_cell(c: Column) -> Column:
    """A spreadsheet cell: byte order marks and mis-decoded dashes repaired, placeholders to null."""
    t = js_trim(F.regexp_replace(F.regexp_replace(c, "﻿", ""), "â€”", "-"))
    return F.when(~F.lower(t).isin("", "-", "__", "n/a", "na"), t)


def slugs(name: Column, website_host: Column) -> Column:
    """Candidate tokens from a company's name and host, in order, without short and generic ones."""
    low = F.lower(js_trim(name))
    slug = lambda c: F.regexp_replace(c, "[^A-Za-z0-9-]", "")
    root = F.substring_index(F.regexp_replace(website_host, r"^www\.", ""), ".", 1)
    all_ = F.array(slug(F.regexp_replace(low, r"\s+", "")), slug(F.regexp_replace(low, r"\s+", "-")), slug(F.regexp_replace(F.initcap(low), r"\s+", "")), slug(F.substring_index(low, " ", 1)), slug(root), slug(F.initcap(root)))
    return F.array_distinct(F.filter(all_, lambda v: (F.length(v) > 2) & ~F.lower(v).isin(*R.INVALID_TOKENS)))
