"""What a model answered, as typed columns: JSON in noisy text, and labelled lines compared with a plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenant.functions.text import labelled_line, outer_json

# What may be said for a planned colour or region.
PLAN_COLORS = {
    "red": ("red", "crimson", "scarlet", "maroon"), "orange": ("orange", "amber"), "yellow": ("yellow", "gold", "mustard"), "green": ("green", "lime", "olive", "emerald"),
    "blue": ("blue", "navy", "azure", "cobalt"), "purple": ("purple", "violet", "lavender"), "pink": ("pink", "magenta", "fuchsia", "rose"), "white": ("white", "ivory", "cream"),
    "black": ("black",), "teal": ("teal", "turquoise", "cyan"),
}
PLAN_REGIONS = {
    "upper left": ("upper left", "top left", "top-left", "upper-left"), "upper right": ("upper right", "top right", "top-right", "upper-right"),
    "lower left": ("lower left", "bottom left", "bottom-left", "lower-left"), "lower right": ("lower right", "bottom right", "bottom-right", "lower-right"),
    "center": ("center", "middle", "central"),
}
# End of fixed values.


@dataclass(frozen=True)
class Field:
    """``path`` into the object (``$.a.b``), its SQL type, the most characters of a string, whether it must be there, and the values it may have."""

    path: str
    kind: str = "string"
    width: int | None = None
    required: bool = True
    allowed: tuple[str, ...] | None = None
    lower: bool = False


def typed(raw: Column, **fields: Field) -> Column:
    """A struct of the fields of the JSON object in a noisy text, and ``error``.

    The object is what :func:`~provenant.functions.text.outer_json` finds. It is
    parsed once, as a VARIANT. ``error`` is null where all is well, else the first
    of: ``empty`` (no text), ``no_object``, ``malformed``, and for each field in
    order ``<name>:missing``, ``<name>:type`` (it cannot be cast) or
    ``<name>:value`` (not allowed). Strings are trimmed, then cut to their width.
    Fields that could be read are given beside an error too.
    """
    found = outer_json(raw)
    tree = F.try_parse_json(found)
    columns, errors = [], [F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "empty"), F.when(found == "", "no_object"), F.when(tree.isNull(), "malformed")]
    for name, f in fields.items():
        value = F.try_variant_get(tree, f.path, f.kind)
        whole = F.try_variant_get(tree, f.path, "variant")
        if f.kind == "string":
            value = F.trim(F.lower(value) if f.lower else value)
            value = F.substring(value, 1, f.width) if f.width else value
        there = whole.isNotNull() & ~F.coalesce(F.is_variant_null(whole), F.lit(False))
        if f.required:
            errors.append(F.when(~there, f"{name}:missing"))
        errors.append(F.when(there & value.isNull(), f"{name}:type"))
        if f.allowed is not None:
            errors.append(F.when(value.isNotNull() & ~value.isin(*f.allowed), f"{name}:value"))
        columns.append(value.alias(name))
    return F.struct(*columns, F.coalesce(*errors).alias("error"))


def _any_in(text: Column, aliases: dict[str, tuple[str, ...]], key: Column, squeeze: bool = False) -> Column:
    """Whether a text holds any alias of the key, or the key itself where it has none; blanks may be left out."""
    known = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    words = F.coalesce(F.try_element_at(known, key), F.array(key))
    held = F.exists(words, lambda a: F.contains(text, a))
    bare = F.replace(text, F.lit(" "), F.lit(""))
    return held | F.exists(words, lambda a: F.contains(bare, F.replace(a, F.lit(" "), F.lit("")))) if squeeze else held


def compared(response: Column, color: Column, thing: Column, region: Column) -> Column:
    """A labelled answer (``object:``, ``color:``, ``location:``, ``plausible:`` lines) against the plan.

    Struct of color_hit, object_hit, position_hit, color_object_hit, strict_hit
    and plausible. An answer that leaves out one of the first three, or says
    ``none`` or ``n/a`` there, hits nothing. Words of three letters and more of
    the planned object count each.
    """
    said = {k: F.regexp_replace(F.element_at(F.split(labelled_line(F.coalesce(response, F.lit("")), k), "\n"), 1), r"^[ .]+|[ .]+$", "") for k in ("object", "color", "location", "plausible")}
    fine = ~(said["object"].isin("none", "", "n/a") | said["color"].isin("none", "", "n/a") | said["location"].isin("none", "", "n/a"))
    words = F.filter(F.split(F.lower(thing), r"[\s_\-]+"), lambda w: F.length(w) >= 3)
    c, p = fine & _any_in(said["color"], PLAN_COLORS, F.lower(color)), fine & _any_in(said["location"], PLAN_REGIONS, F.lower(region), squeeze=True)
    o = fine & F.exists(words, lambda w: F.contains(said["object"], w))
    yes = F.contains(said["plausible"], F.lit("yes")) | F.contains(said["plausible"], F.lit("true"))
    hits = [x.alias(n) for n, x in (("color_hit", c), ("object_hit", o), ("position_hit", p), ("color_object_hit", c & o), ("strict_hit", c & o & p), ("plausible", yes))]
    return F.struct(*(F.coalesce(h, F.lit(False)).alias(n) for h, n in zip(hits, ("color_hit", "object_hit", "position_hit", "color_object_hit", "strict_hit", "plausible"), strict=True)))
