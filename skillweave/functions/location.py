"""Place scores: remote keywords, comma-parted places, proximity, blending."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from skillweave.functions.text import collapse, strip_accents


@dataclass(frozen=True)
class LocationConfig:
    alpha: float = 0.10
    remote: tuple[str, ...] = ("remote", "work from home", "wfh", "fully remote")
    onsite: tuple[str, ...] = ("hybrid", "onsite", "on-site")
    cv_missing: float = 0.85
    base: float = 0.60
    country: float = 0.80
    province: float = 0.90


def norm_place(x: Column | str) -> Column:
    return strip_accents(F.lower(collapse(x)))


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def is_remote(x: Column | str, cfg: LocationConfig = LocationConfig()) -> Column:
    return _mentions(norm_place(x), cfg.remote)


def is_onsite_or_hybrid(x: Column | str, cfg: LocationConfig = LocationConfig()) -> Column:
    return _mentions(norm_place(x), cfg.onsite)


def parse_place(x: Column | str) -> Column:
    """STRUCT<city, province, country>: first, second ('' if none) and last part between commas."""
    parts = F.filter(F.transform(F.split(norm_place(x), ","), lambda p: F.trim(p)), lambda p: p != "")
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\b(?:city|province|state|district)\b", ""), r"\s+", " "))
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return F.struct(strip(at(0)).alias("city"), strip(at(1)).alias("province"), last.alias("country"))


def proximity(a: Column, b: Column, cfg: LocationConfig = LocationConfig()) -> Column:
    same = lambda f: (a[f] != "") & (a[f] == b[f])
    return F.when(same("city"), 1.0).when(same("province"), cfg.province).when(same("country"), cfg.country).otherwise(cfg.base)


def score_pair(jd_text: Column | str, jd_place: Column | str, cv_place: Column | str, cfg: LocationConfig = LocationConfig()) -> Column:
    """1 if the post is remote or has no place; neutral without a candidate's place; else proximity."""
    return (
        F.when(is_remote(jd_text, cfg) | is_remote(jd_place, cfg), 1.0)
        .when(norm_place(jd_place) == "", 1.0).when(norm_place(cv_place) == "", cfg.cv_missing)
        .otherwise(proximity(parse_place(jd_place), parse_place(cv_place), cfg))
    )


def blend(base: Column | str, place: Column | str, alpha: float = 0.10) -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return (1 - alpha) * c(base) + alpha * c(place)
