"""Text functions on Columns: accents, the four normal forms, slugs, years, labels."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(1)
def _accent_table() -> tuple[str, str]:
    """Letters that NFD splits into one base letter and marks, and those base letters."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        whole = chr(code)
        bare = "".join(c for c in unicodedata.normalize("NFD", whole) if unicodedata.category(c) != "Mn")
        if len(bare) == 1 and bare != whole:
            pairs.append((whole, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c: Column) -> Column:
    """NFD without combining marks, for Latin, Greek and Cyrillic; letters that don't split stay."""
    return F.regexp_replace(F.translate(c, *_accent_table()), r"\p{Mn}+", "")


def _single(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm(c: Column) -> Column:
    """Matching form of outlines and merges: no accents, a-z0-9 words, single blanks."""
    return _single(F.regexp_replace(F.lower(strip_accents(c)), r"[^a-z0-9 ]+", " "))


def norm_gedcom(c: Column) -> Column:
    """Matching form of GEDCOM names: ASCII only, punctuation kept, single blanks."""
    return _single(F.lower(F.regexp_replace(strip_accents(c), r"[^\x00-\x7F]+", "")))


def norm_review(c: Column) -> Column:
    """Matching form of the duplicate review: accents kept."""
    return _single(F.lower(c))


def norm_voyage(c: Column) -> Column:
    """Matching form of passenger entries: no accents, blanks kept."""
    return F.trim(F.lower(strip_accents(c)))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def file_slug(path: Column, suffix: str = "-lineage.html") -> Column:
    """The expected output name of a source file: slug of its stem and a suffix."""
    return F.concat(slug(F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)), F.lit(suffix))


def trim_chars(c: Column, chars: str) -> Column:
    inside = "".join("\\" + x if x in r"\]^-" else x for x in chars)
    return F.regexp_replace(c, f"^[{inside}]+|[{inside}]+$", "")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def vital_at(raw: Column) -> Column:
    """Where the first `` b. `` or `` d. `` of an outline entry begins, behind a blank in front; else 0."""
    return F.regexp_instr(F.concat(F.lit(" "), raw), F.lit(r"\s[bd]\.\s"))


def split_vitals(raw: Column, at: Column | None = None) -> tuple[Column, Column, Column]:
    """Name, birth and death segment of an outline entry; ``at`` is ``vital_at(raw)`` if it is known.

    The first `` b. `` or `` d. `` ends the name. A ``d.`` inside the rest ends the
    birth segment; a rest that begins with ``d.`` is the death segment alone.
    """
    at = vital_at(raw) if at is None else at
    cut = F.greatest(at - 2, F.lit(0))  # characters of raw before the mark
    name = F.when(at == 0, F.trim(raw)).otherwise(trim_chars(F.substring(raw, F.lit(1), cut), " ,;"))
    vital = F.trim(F.substring(raw, cut + 1, F.length(raw)))
    died = F.regexp_instr(vital, F.lit(r"\bd\.\s"))
    begins_born = vital.startswith("b.")
    birth = F.when((at > 0) & begins_born, F.when(died > 0, F.substring(vital, F.lit(1), died - 1)).otherwise(vital)).otherwise("")
    death = F.when(at == 0, "").when(begins_born, F.when(died > 0, F.substring(vital, died, F.length(vital))).otherwise("")).otherwise(vital)
    clean = lambda c, mark: trim_chars(F.regexp_replace(c, rf"^\s*{mark}\.\s*", ""), " ,;")
    return name, clean(birth, "b"), clean(death, "d")


def parse_year(segment: Column, lowest: int = 300, highest: int = 2025) -> Column:
    """The first standalone number of three or four digits that is a plausible year."""
    numbers = F.transform(F.regexp_extract_all(segment, F.lit(r"\b(\d{3,4})\b"), F.lit(1)), lambda x: x.cast("int"))
    return F.get(F.filter(numbers, lambda y: y.between(lowest, highest)), F.lit(0))


def first_year(date: Column, digits: str = "4") -> Column:
    """The first number of exactly 4 (or ``"3,4"``) digits of a date text."""
    return F.regexp_extract(date, rf"\b(\d{{{digits}}})\b", 1).try_cast("int")


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def relation_label(gen: Column) -> Column:
    """What an ancestor ``gen`` generations back is called."""
    return (
        F.when(gen == 0, "you").when(gen == 1, "parent").when(gen == 2, "grandparent").when(gen == 3, "great-grandparent")
        .otherwise(F.concat((gen - 2).cast("string"), F.lit("th great-grandparent")))
    )


def era_label(first: Column, last: Column) -> Column:
    """Span of the known birth years."""
    return F.when(first.isNull(), "dates unknown").otherwise(F.concat(F.lit("c. "), first.cast("string"), F.lit("–"), last.cast("string"), F.lit(" AD")))


def name_variants(names: Column, given: Column, married: Column, surname: Column) -> Column:
    """Distinct candidate names of a GEDCOM individual, in order of preference."""
    pair = lambda a, b: F.when((a != "") & (b != ""), F.concat_ws(" ", a, b))
    return F.array_distinct(F.array_compact(F.concat(F.filter(names, lambda n: n != ""), F.array(pair(given, married), pair(given, surname)))))


# fixed values: words that carry no content in names, and marks of annotations
NAME_PARTICLES = "de del la el los las y e a o von van le di da do das dos san santa".split()
ANNOTATIONS = ("(", "8th", "ggm", "el viejo", "alferez", "capitan")


def best_name(variants: Column, names: Column) -> Column:
    """The longest variant without annotations and repeated words; ties by value."""

    def content(n: Column) -> Column:
        return F.filter(F.split(F.lower(_single(n)), " "), lambda w: ~w.isin(NAME_PARTICLES))

    def clean(n: Column) -> Column:
        ok = F.size(content(n)) == F.size(F.array_distinct(content(n)))
        for mark in ANNOTATIONS:
            ok = ok & ~F.contains(F.lower(n), F.lit(mark))
        return ok

    ranked = F.array_sort(F.transform(F.filter(variants, clean), lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n"))))
    return _single(F.coalesce(F.get(ranked, F.lit(0))["n"], F.get(names, F.lit(0)), F.lit("")))


def first_word(name: Column) -> Column:
    return F.split_part(norm_gedcom(name), F.lit(" "), F.lit(1))


def build_region(state: Column, city: Column, place: Column) -> Column:
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(state), filled(city), F.trim(F.split_part(place, F.lit(","), F.lit(1))), F.lit(""))


def spanish_date(day: Column, month: Column, year: Column) -> Column:
    """Day, month name and year of a passenger entry, as far as they are known."""
    months = F.array(*(F.lit(m) for m in "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()))
    name = F.when(month.between(1, 12), F.try_element_at(months, month))
    known = (day > 0) & name.isNotNull() & (year > 0)
    return F.when(known, F.concat_ws(" ", day.cast("string"), name, year.cast("string"))).otherwise(F.coalesce(F.when(year > 0, year.cast("string")), F.lit("—")))


def elided_path(path: Column, ends: int = 7) -> Column:
    """A path of more than twice ``ends`` steps, cut to its first and last ones."""
    return F.when(F.size(path) > 2 * ends, F.concat(F.slice(path, 1, ends), F.slice(path, -ends, ends))).otherwise(path)
