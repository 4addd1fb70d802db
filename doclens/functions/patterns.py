"""Patterns of standards, quantities, sections and requirement words.

Families, units and words are parameters of the operators; these are the seeds.
Units end where no letter or digit follows, so that `mm2` isn't read as `mm`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAMILIES = ("EN", "IS", "IEC", "BS", "ISO", "NFPA", "NEK", "HD", "IEEE")
UNITS = {"kV": "voltage", "V": "voltage", "mA": "current", "A": "current", "kW": "power", "W": "power", "mm2": "area", "mm": "length", "m": "length", "lux": "illuminance", "Hz": "frequency", "dB": "sound"}
#: Word, strength; the longer phrase stands first.
REQUIREMENTS = (("shall not", "prohibited"), ("must not", "prohibited"), ("shall", "mandatory"), ("must", "mandatory"), ("required", "mandatory"), ("should", "recommended"), ("may", "optional"))
SECTION_KINDS = ("Section", "Clause", "Article", "Annex", "Table", "Figure")

STANDARD = r"\b(?:" + "|".join(FAMILIES) + r")[ -]?[0-9]{2,6}(?:-[0-9]+)*"
QUANTITY = r"([0-9]+(?:[.,][0-9]+)?) ?(" + "|".join(UNITS) + r")(?:[^A-Za-z0-9]|$)"
SECTION = r"(" + "|".join(SECTION_KINDS) + r") ([0-9]+(?:\.[0-9]+)*|[A-Z])"
PHRASE = r"(?:according to|in accordance with|as specified in|per|see|supersedes) ((?:" + "|".join(FAMILIES) + "|" + "|".join(SECTION_KINDS) + r")[ -]?[0-9][0-9.\-]*[0-9]|(?:" + "|".join(SECTION_KINDS) + r") [0-9A-Z])"


def canonical(reference: Column) -> Column:
    """One key for a standard however it is spaced or cased."""
    return F.upper(F.regexp_replace(reference, "[ -]", ""))


def standards(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(STANDARD), F.lit(0))


def quantities(text: Column) -> Column:
    """(value, unit, kind) of each quantity in order."""
    from .text import number

    values, units = F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(1)), F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(2))
    kinds = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.zip_with(values, units, lambda v, u: F.struct(number(v).alias("value"), u.alias("unit"), F.element_at(kinds, u).alias("kind")))


def strength(sentence: Column) -> Column:
    """The strength of the first phrase of REQUIREMENTS that occurs as words; null if none does."""
    low = F.lower(sentence)
    out = F.lit(None).cast("string")
    for word, kind in reversed(REQUIREMENTS):
        out = F.when(low.rlike(rf"\b{word}\b"), kind).otherwise(out)
    return out


def sentences(text: Column) -> Column:
    """Sentences of ten characters and more, cut after a stop and a blank or at a line's end."""
    return F.filter(F.transform(F.split(text, r"[.!?] |[.!?]$|\n"), lambda s: F.trim(s)), lambda s: F.length(s) >= 10)
