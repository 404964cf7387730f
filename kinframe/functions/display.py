"""Step functions and badges of maps, houses and entries, as expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinframe.functions import rules
from kinframe.functions.text import escape_html

OTHER_COLOR = "#5a5248"


def category_color(cat: Column) -> Column:
    chain = None
    for key, _, color, *_ in (*rules.CATEGORIES, rules.UNTITLED):
        chain = F.when(cat == key, color) if chain is None else chain.when(cat == key, color)
    return chain.otherwise(OTHER_COLOR)


def category_label(cat: Column) -> Column:
    """Short label of a category; unknown ones capitalised."""
    key, chain = F.lower(F.coalesce(cat, F.lit("untitled"))), None
    for k, label in (("royal", "Royalty"), ("noble", "Nobility"), ("military", "Military"), ("official", "Civic"), ("untitled", "Untitled"), ("clergy", "Clergy"), ("indigenous", "Indigenous")):
        chain = F.when(key == k, label) if chain is None else chain.when(key == k, label)
    return chain.otherwise(F.initcap(key))


def marker_radius(cat: Column, mult: Column) -> Column:
    """Size of a map marker: by category, larger for people found often."""
    base = F.when(cat == "royal", 7.0).when(cat == "noble", 5.5).when(cat == "military", 5.0).otherwise(4.0)
    return base + F.when(mult > 100, 2).when(mult > 10, 1).otherwise(0)


def age_opacity(age: Column) -> Column:
    return F.when(age < 8, 0.95).when(age < 20, 0.80).when(age < 40, 0.65).when(age < 60, 0.50).otherwise(0.35)


def stage_region(year: Column) -> Column:
    """Where the ancestors live at a year of the time line."""
    return F.when(year > 1821, "Mexico").when(year > 1492, "Iberia + New Spain").when(year > 1200, "Iberia + France").otherwise("Iberia")


def house_type(n_royal: Column, n_noble: Column, n_military: Column) -> Column:
    """Types of a house, joined by commas."""
    kinds = F.array_compact(F.array(F.when(n_royal > 0, "Royal"), F.when(n_noble > 0, "Noble"), F.when(n_military > 0, "Military")))
    return F.when(F.size(kinds) > 0, F.array_join(kinds, ",")).otherwise("Untitled")


def badge(text: Column, kind: Column) -> Column:
    """A span with a class; empty for empty texts."""
    return F.when(text == "", "").otherwise(F.concat(F.lit('<span class="badge '), kind, F.lit('">'), escape_html(text), F.lit("</span>")))


def destination_color(destination: Column, colors: Mapping[str, str], otherwise: str = "#444") -> Column:
    chain = None
    for name, color in colors.items():
        chain = F.when(destination == name, color) if chain is None else chain.when(destination == name, color)
    return F.lit(otherwise) if chain is None else chain.otherwise(otherwise)
