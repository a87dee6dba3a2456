"""Boxes (x1, y1, x2, y2) and the rules that decide whether a text canvas is usable."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*(c.cast("int").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)))


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0)) * F.greatest(b["y2"] - b["y1"], F.lit(0))


def intersection(a: Column, b: Column) -> Column:
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of the first box that the second covers."""
    return intersection(a, b) / F.greatest(area(a), F.lit(1))


def expanded(b: Column, share: float, width: Column, height: Column) -> Column:
    dx, dy = F.bround((b["x2"] - b["x1"]) * share), F.bround((b["y2"] - b["y1"]) * share)
    return box(F.greatest(b["x1"] - dx, F.lit(0)), F.greatest(b["y1"] - dy, F.lit(0)), F.least(b["x2"] + dx, width), F.least(b["y2"] + dy, height))


def first_box(*candidates: Column) -> Column:
    """The first candidate ``array<int>`` of exactly four numbers, as a box."""
    found = F.coalesce(*(F.when(F.size(c) == 4, c) for c in candidates))
    return F.when(found.isNotNull(), box(*(F.get(found, i) for i in range(4))))


def body_zone(face: Column, width: Column, height: Column, x_scale: float = 2.8, y_offset: float = -0.15, y_scale: float = 4.5) -> Column:
    """The torso below a face, clipped to the image; null if nothing is left. Rounds half to even."""
    w, h = F.greatest(face["x2"] - face["x1"], F.lit(1)), F.greatest(face["y2"] - face["y1"], F.lit(1))
    middle, reach = (face["x1"] + face["x2"]) / 2.0, w * x_scale / 2.0
    low = lambda x: F.greatest(F.bround(x), F.lit(0))
    zone = box(low(middle - reach), low(face["y2"] + h * y_offset), F.least(F.bround(middle + reach), width), F.least(F.bround(face["y2"] + h * y_scale), height))
    return F.when((zone["x2"] > zone["x1"]) & (zone["y2"] > zone["y1"]), zone)


@dataclass(frozen=True)
class CanvasRules:
    """Limits; the defaults let everything with a letter or digit through."""

    min_alnum: int = 1
    max_alnum: int = 10_000
    max_words: int = 10_000
    max_other_share: float = 1.0
    min_letter_share: float = 0.0
    max_consonants: int = 10_000
    reject_numbers: bool = False
    reject_short_lower: bool = False
    short_length: int = 4
    min_short_upper_share: float = 0.0
    reject_edges: bool = False
    edge_margin: float = 0.0
    max_short_area: float = 1.0
    max_area_per_character: float = 1.0


def longest_consonant_run(text: Column) -> Column:
    runs = F.regexp_extract_all(F.upper(text), F.lit(r"[\p{L}&&[^AEIOUY]]+"), 0)
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def _ascii(text: Column, keep: str) -> Column:
    return F.regexp_replace(text, f"[^{keep}]", "")


def text_is_valid(text: Column, rules: CanvasRules = CanvasRules()) -> Column:
    """The lexical half of the canvas rules."""
    tidy = F.trim(F.regexp_replace(text, r"\s+", " "))
    alnum, letters, solid = _ascii(tidy, "A-Za-z0-9"), _ascii(tidy, "A-Za-z"), F.regexp_replace(tidy, r"\s+", "")
    n = F.length(alnum)
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    upper = share(F.length(_ascii(letters, "A-Z")), F.length(letters))
    return (
        n.between(rules.min_alnum, rules.max_alnum)
        & (F.size(F.regexp_extract_all(tidy, F.lit("[A-Za-z0-9]+"), 0)) <= rules.max_words)
        & (1 - share(n, F.length(solid)) <= rules.max_other_share)
        & (share(F.length(letters), n) >= rules.min_letter_share)
        & (longest_consonant_run(letters) <= rules.max_consonants)
        & ~(F.lit(rules.reject_numbers) & alnum.rlike("^[0-9]+$"))
        & ~(F.lit(rules.reject_short_lower) & (n <= rules.short_length) & (F.lower(tidy) == tidy) & tidy.rlike(r"\p{Ll}"))
        & ~((n <= rules.short_length + 2) & (upper < rules.min_short_upper_share))
    )


def canvas_is_valid(text: Column, b: Column, width: Column, height: Column, rules: CanvasRules = CanvasRules()) -> Column:
    """Lexical rules, distance from the image's edges, and size for the number of characters."""
    n = F.length(_ascii(text, "A-Za-z0-9"))
    margin = F.greatest(F.bround(F.least(width, height) * rules.edge_margin), F.lit(1))
    inside = (b["x1"] > margin) & (b["y1"] > margin) & (b["x2"] < width - margin) & (b["y2"] < height - margin)
    share = area(b) / F.greatest(width * height, F.lit(1))
    small = ~((n <= rules.short_length) & (share > rules.max_short_area)) & (share / F.greatest(n, F.lit(1)) <= rules.max_area_per_character)
    return text_is_valid(text, rules) & small & (inside if rules.reject_edges else F.lit(True))


def joint_text_score(isolation: Column, canvas_score: Column, text: Column, b: Column) -> Column:
    """Isolation times canvas score, with a bonus for texts near four characters in compact boxes."""
    n = F.length(_ascii(F.coalesce(text, F.lit("")), "A-Za-z0-9"))
    size = F.greatest(b["x2"] - b["x1"], F.lit(1)) * F.greatest(b["y2"] - b["y1"], F.lit(1))
    bonus = (1 + 1.0 / (F.abs(n - 4) + 1.0)) * (1 + canvas_score / size)
    return isolation * canvas_score * F.when(n > 0, bonus).otherwise(1.0)


def size_is_fair(width: Column, height: Column, least: int = 180, aspect: float = 3.2) -> Column:
    return (F.least(width, height) >= least) & (F.greatest(width, height) / F.least(width, height) <= aspect)
