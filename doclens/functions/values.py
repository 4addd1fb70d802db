"""Typed values in texts: thirty kinds of parameters with their guards, and what a value describes.

The tables are fixed values; the rules on them are columns.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern of each parameter type, in order. Case doesn't count.
VALUE_PATTERNS = {
    "temperature": r"(\d+(?:\.\d+)?)\s*°?C",
    "voltage": r"(\d+(?:\.\d+)?)\s*V(?:olts?)?",
    "current": r"(\d+(?:\.\d+)?)\s*A(?:mps?)?",
    "power": r"(\d+(?:\.\d+)?)\s*(?:kW|MW|W|VA|kVA|MVA)",
    "resistance": r"(\d+(?:\.\d+)?)\s*(?:Ω|ohms?)",
    "impedance": r"(\d+(?:\.\d+)?)\s*(?:Ω|ohms?)(?:/km)?",
    "cable_size": r"(\d+(?:\.\d+)?)\s*mm[²2]",
    "frequency": r"(\d+(?:\.\d+)?)\s*Hz",
    "pressure": r"(\d+(?:\.\d+)?)\s*(?:bar|psi|kPa|MPa|Pa)",
    "flow_rate": r"(\d+(?:\.\d+)?)\s*(?:l/s|L/s|m³/h|m3/h|l/min|L/min|gpm|cfm)",
    "speed": r"(\d+(?:\.\d+)?)\s*(?:rpm|RPM|rev/min)",
    "torque": r"(\d+(?:\.\d+)?)\s*(?:Nm|N\.m|kNm)",
    "diameter": r"(\d+(?:\.\d+)?)\s*(?:mm|cm|inch|in|\")\s*(?:dia|diameter|Ø|ø)?",
    "thickness": r"(\d+(?:\.\d+)?)\s*(?:mm|cm)\s*(?:thick|thickness)?",
    "weight": r"(\d+(?:\.\d+)?)\s*(?:kg|ton|tonne|lb|lbs)",
    "volume": r"(\d+(?:\.\d+)?)\s*(?:m³|m3|litre|liter|L|gallon)",
    "capacity": r"(\d+(?:\.\d+)?)\s*(?:kW|BTU|BTU/h|tons?|TR)",
    "u_value": r"(\d+(?:\.\d+)?)\s*W/m[²2]K",
    "r_value": r"(\d+(?:\.\d+)?)\s*m[²2]K/W",
    "noise_level": r"(\d+(?:\.\d+)?)\s*(?:dB|dBA)",
    "lux_level": r"(\d+(?:\.\d+)?)\s*(?:lux|lx)",
    "air_quality": r"(\d+(?:\.\d+)?)\s*(?:ppm|μg/m³|mg/m³)",
    "energy_consumption": r"(\d+(?:\.\d+)?)\s*(?:kWh|MWh|GJ)",
    "carbon_emission": r"(\d+(?:\.\d+)?)\s*(?:kgCO2|tCO2|kgCO2e)",
    "water_consumption": r"(\d+(?:\.\d+)?)\s*(?:m³/day|L/day|gallon/day)",
    "cop": r"(\d+(?:\.\d+)?)\s*(?:COP|EER|SEER)",
    "percentage": r"(\d+(?:\.\d+)?)\s*%",
    "area": r"(\d+(?:\.\d+)?)\s*(?:m²|m2|sq\.?m|ft²|sq\.?ft)",
    "length": r"(\d+(?:\.\d+)?)\s*(?:m|mm|km)",
    "time": r"(\d+(?:\.\d+)?)\s*(?:ms|s|sec|min|hours?|hrs?)",
}
# What the unit of each type can begin with, three characters at most, in lower case: a type is only looked for where a number is followed by one of these.
HEADS = {
    "temperature": ("°c", "c"), "voltage": ("v",), "current": ("a",), "power": ("kw", "mw", "w", "va", "kva", "mva"), "resistance": ("ω", "ohm"), "impedance": ("ω", "ohm"), "cable_size": ("mm²", "mm2"), "frequency": ("hz",),
    "pressure": ("bar", "psi", "kpa", "mpa", "pa"), "flow_rate": ("l/s", "l/m", "m³/", "m3/", "gpm", "cfm"), "speed": ("rpm", "rev"), "torque": ("nm", "n.m", "knm"), "diameter": ("mm", "cm", "in", '"'), "thickness": ("mm", "cm"),
    "weight": ("kg", "ton", "lb"), "volume": ("m³", "m3", "l", "gal"), "capacity": ("kw", "btu", "ton", "tr"), "u_value": ("w/m",), "r_value": ("m²k", "m2k"), "noise_level": ("db",), "lux_level": ("lux", "lx"), "air_quality": ("ppm", "μg/", "mg/"),
    "energy_consumption": ("kwh", "mwh", "gj"), "carbon_emission": ("kgc", "tco"), "water_consumption": ("m³/", "l/d", "gal"), "cop": ("cop", "eer", "see"), "percentage": ("%",), "area": ("m²", "m2", "sq", "ft²"), "length": ("m", "km"), "time": ("m", "s", "h"),
}
# Least and greatest value of some types.
RANGES = {"temperature": (-50, 500), "voltage": (None, 50000), "current": (None, 1000), "cable_size": (None, 1000), "percentage": (None, 100), "time": (None, 1000), "length": (None, 5000)}
# Units to show.
UNITS_SHOWN = {"temperature": "°C", "voltage": "V", "current": "A", "power": "W", "resistance": "Ω", "impedance": "Ω", "cable_size": "mm²", "length": "m", "percentage": "%", "time": "s", "frequency": "Hz"}
# Standards whose numbers aren't values, prefixes near a number of 1,000 or more, years.
NUMBERED_STANDARD = r"\b(?:IS|EN|IEC|BS|NFPA|IEEE|ISO|ASTM|DIN)[\s-]?\d+(?:[-/:]\d+)*(?:\s*[:\(]\d{4}[:\)])?"
STANDARD_CONTEXT = r"\b(?:IS|EN|IEC|BS|NFPA|IEEE|ISO|ASTM|DIN)[\s-]?\d+[-/:0-9]*"
PREFIXES = ("en ", "en-", "bs ", "bs-", "is ", "is-", "iec ", "iec-", "iso ")
_PREFIX = "|".join(PREFIXES)
YEAR = r"\b(19[89]\d|20[0-3]\d)\b"
# Patterns of what a value describes, by type, and words that are taken otherwise.
SUBJECTS = {
    "length": (
        r"(cable|conductor|wire|core|run|route|trench|duct|conduit|pipe|branch|main)\s+(?:length|run|distance)",
        r"(maximum|minimum|min|max)\s+(?:length|distance|run)",
        r"(depth|height|width|spacing|clearance|distance)",
        r"(?:length|distance|run)\s+of\s+(\w+)",
    ),
    "cable_size": (
        r"(cable|conductor|wire|core)\s+(?:size|cross.?section|area|csa)",
        r"(minimum|maximum|min|max)\s+(?:size|cross.?section|csa)",
        r"(\d+)\s*mm[²2]?\s*(cable|conductor|wire)?",
    ),
    "current": (
        r"(rated|nominal|maximum|minimum|full.?load|fault)\s+current",
        r"(breaker|fuse|mcb|rcbo|rcd)\s+(?:rating|current)",
        r"current\s+(?:rating|capacity)",
    ),
    "voltage": (
        r"(rated|nominal|supply|operating|system)\s+voltage",
        r"(low|medium|high)\s+voltage",
        r"voltage\s+(?:rating|drop|level)",
    ),
    "temperature": (r"(ambient|operating|maximum|minimum)\s+temperature", r"temperature\s+(?:rating|range|limit)"),
    "percentage": (r"(voltage|power|load)\s+(?:drop|factor|efficiency)", r"(minimum|maximum)\s+(?:fill|capacity|efficiency)"),
    "time": (r"(response|reaction|clearing|operating)\s+time", r"(delay|duration|period)"),
}
TECHNICAL_WORDS = ("cable", "conductor", "wire", "core", "duct", "conduit", "trunking", "breaker", "fuse", "mcb", "rcd", "rcbo", "panel", "board", "socket", "outlet", "lighting", "motor", "transformer", "trench", "depth", "height", "spacing", "clearance", "maximum", "minimum", "rated", "nominal", "operating")
CONTEXT_WORDS = (
    "cable conductor wire core armour sheath insulation duct conduit trunking tray ladder basket socket outlet switch breaker fuse mcb rcbo rcd panel board switchgear distribution mcc transformer motor generator ups inverter lighting luminaire lamp lux emergency "
    "earthing grounding bonding lightning protection trench excavation backfill sand bedding voltage current power factor frequency temperature ambient rating derating size diameter thickness depth width"
).split()
RELATED = (
    ("cable", "conductor", "wire", "core"),
    ("duct", "conduit", "pipe", "trunking"),
    ("trench", "excavation", "depth", "backfill"),
    ("breaker", "mcb", "fuse", "rcbo", "rcd", "protection"),
    ("socket", "outlet", "receptacle"),
    ("panel", "board", "switchgear", "distribution"),
    ("maximum", "max", "minimum", "min"),
    ("length", "distance", "run"),
    ("size", "cross-section", "area", "csa"),
)
MANDATORY = r"(?i)\b(?:shall|must|required|mandatory|compulsory|essential)\b"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def places(text: str, pattern: str) -> str:
    """(start, match) of each match of a pattern in a text column, from 0, as SQL; the pattern is compiled once and the text cut once.

    Matches stand between two marks, which in the text itself become blanks; a piece is a
    match, its mark, and what stands before the next one.
    """
    marked = f"regexp_replace(translate({text}, '\\u0001\\u0002', '  '), {_quoted(pattern)}, '\\u0001$0\\u0002')"
    step = "named_struct('at', acc.at + length(piece) - 1, 'found', concat(acc.found, array(named_struct('start', acc.at, 'match', substring_index(piece, '\\u0002', 1)))))"
    begin = "named_struct('at', length(pieces[0]), 'found', CAST(array() AS array<struct<start:int,match:string>>))"
    return f"transform(array(split({marked}, '\\u0001', -1)), pieces -> aggregate(slice(pieces, 2, size(pieces)), {begin}, (acc, piece) -> {step}, acc -> acc.found))[0]"


def _subject(kind: str) -> str:
    """What a value describes, as SQL: the first pattern of its type in the context c, else the first technical word with the type, else the type."""
    named = [f"nullif(lower(trim(regexp_substr(c, {_quoted('(?i)' + p)}))), '')" for p in SUBJECTS.get(kind, ())]
    technical = "regexp_substr(c, " + _quoted(r"\b(?:" + "|".join(w for w in TECHNICAL_WORDS if len(w) > 3) + r")\b") + ")"
    return f"coalesce({', '.join([*named, f'concat({technical}, {_quoted(" " + kind.replace("_", " "))})', _quoted(kind)])})"


_NUMBER = "^[0-9]+(?:[.][0-9]+)?"


def _kept(text: str, kind: str, pattern: str) -> str:
    """The values of one type, as SQL, from `x`: the cleaned text, its spots and their heads, and the taboo numbers that are none."""
    low, high = RANGES.get(kind, (None, None))
    around = lambda before, after: f"lower(substr({text}, greatest(v.start - {before}, 0) + 1, v.start + length(v.original) + {after} - greatest(v.start - {before}, 0)))"
    unit = pattern.split(r"\s*", 1)[1]
    if any(c in unit for c in "0123456789"):
        # such a unit can hold the number of the next spot
        found = f"transform({places('x.clean', '(?i)' + pattern)}, p -> named_struct('start', p.start, 'original', p.match, 'value', CAST(regexp_extract(p.match, {_quoted(_NUMBER)}, 0) AS double)))"
    else:
        found = f"transform(filter(x.spots, s -> s.piece RLIKE {_quoted('(?i)^' + pattern)}), s -> named_struct('start', s.start, 'original', regexp_extract(s.piece, {_quoted('(?i)^' + pattern)}, 0), 'value', s.value))"
    standard = f"(v.value = floor(v.value) AND v.value BETWEEN 1000 AND 99999 AND {around(25, 10)} RLIKE {_quoted(_PREFIX)})"
    inside = [f"v.value >= {low}"] * (low is not None) + [f"v.value <= {high}"] * (high is not None)
    valid = " AND ".join([f"NOT array_contains(x.taboo, v.value) AND NOT {standard}", *inside])
    # the context is cut out once
    named = f"transform(array({around(60, 20)}), c -> {_subject(kind)})[0]"
    described = f"named_struct('type', {_quoted(kind)}, 'value', v.value, 'original', v.original, 'start', v.start, 'subject', {named})"
    here = " OR ".join(f"contains(x.heads, concat('\\u0001', {_quoted(h)}))" for h in HEADS[kind])
    return f"CASE WHEN {here} THEN transform(filter({found}, v -> {valid}), v -> {described}) ELSE {_NOTHING} END"


_NOTHING = "CAST(array() AS array<struct<type:string,value:double,original:string,start:int,subject:string>>)"
_FAMILIES = ("IS", "EN", "IEC", "BS", "NFPA", "IEEE", "ISO", "ASTM", "DIN")


def typed(text: str) -> Column:
    """All values of a text column, by its name, as (type, value, original, start, subject), by type in order, then place.

    Left out are numbers that stand in a standard's number or are years of the
    text, those of 1,000 and more near a standard's prefix, and those outside the
    range of their type.  The text is cut once at its spots, the numbers that something
    follows; a type is looked for where the start of its unit follows one, and at the
    spots only.  The rule stands in the plan once for each type, so that its patterns are
    constants.  It is SQL as text, because a column of some ten thousand calls takes
    longer to build than to run.
    """
    digits = lambda pattern: f"flatten(transform(regexp_extract_all({text}, {_quoted(pattern)}, 0), s -> regexp_extract_all(s, '[0-9]+', 0)))"
    none = "CAST(array() AS array<string>)"
    family = " OR ".join(f"contains({text}, '{f}')" for f in _FAMILIES)
    numbered = f"CASE WHEN {family} THEN concat({digits(NUMBERED_STANDARD)}, {digits(STANDARD_CONTEXT)}) ELSE {none} END"
    years = f"CASE WHEN contains({text}, '19') OR contains({text}, '20') THEN regexp_extract_all({text}, {_quoted(YEAR)}, 0) ELSE {none} END"
    taboo = f"transform(concat({numbered}, {years}), n -> CAST(n AS double))"
    clean = f"translate({text}, '\\u0001\\u0002', '  ')"
    spot = _quoted(r"[0-9]+(?:[.][0-9]+)?(?=\s*[^0-9\s.])")
    cut = f"split(regexp_replace({clean}, {spot}, '\\u0001$0'), '\\u0001', -1)"
    step = f"named_struct('at', acc.at + length(piece), 'spots', concat(acc.spots, array(named_struct('start', acc.at, 'piece', piece, 'value', CAST(regexp_extract(piece, {_quoted(_NUMBER)}, 0) AS double)))))"
    begin = "named_struct('at', length(pieces[0]), 'spots', CAST(array() AS array<struct<start:int,piece:string,value:double>>))"
    spots = f"aggregate(slice(pieces, 2, size(pieces)), {begin}, (acc, piece) -> {step}, acc -> acc.spots)"
    ahead = _quoted(r"[0-9](?=\s*([^0-9\s.]\S{0,2}))")
    heads = f"concat('\\u0001', lower(array_join(regexp_extract_all({clean}, {ahead}, 1), '\\u0001')))"
    each = ", ".join(_kept(text, kind, p) for kind, p in VALUE_PATTERNS.items())
    found = f"transform(array(named_struct('clean', {clean}, 'spots', {spots}, 'heads', {heads}, 'taboo', {taboo})), x -> flatten(array({each})))[0]"
    return F.expr(f"CASE WHEN {text} RLIKE '[0-9]' THEN transform(array({cut}), pieces -> CASE WHEN size(pieces) > 1 THEN {found} ELSE {_NOTHING} END)[0] ELSE {_NOTHING} END")


def subjects_related(a: Column, b: Column) -> Column:
    """Whether two subjects describe one thing: equal, one in the other, a word of three letters in common, or words of one related group."""
    words = lambda s: F.regexp_extract_all(F.lower(s), F.lit(r"\b\w{3,}\b"), F.lit(0))
    shared = lambda x, y: F.arrays_overlap(x, y) | reduce(or_, [F.arrays_overlap(x, g) & F.arrays_overlap(y, g) for g in (F.array(*[F.lit(w) for w in ws]) for ws in RELATED)])
    # the words are cut out once
    found = F.element_at(F.transform(F.array(F.struct(words(a).alias("x"), words(b).alias("y"))), lambda w: shared(w["x"], w["y"])), 1)
    x, y = F.lower(a), F.lower(b)
    return F.contains(x, y) | F.contains(y, x) | found


def spaced_words(text: Column) -> Column:
    """Distinct lower-case runs between white space."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"\s+")), "")


def _context(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), r"[^a-z\s]+", "")
    return F.array_intersect(F.split(bare, r"\s+"), F.array(*[F.lit(w) for w in CONTEXT_WORDS]))


def context_words(text: Column) -> Column:
    """Technical context words of a text, sorted."""
    return F.array_sort(_context(text))


def context_bits(text: Column) -> Column:
    """Technical context words of a text as bits of one number; CONTEXT_WORDS are at most 63."""
    at = lambda w: F.array_position(F.array(*[F.lit(c) for c in CONTEXT_WORDS]), w) - 1
    bits = F.aggregate(_context(text), F.lit(0).cast("long"), lambda bits, w: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at(w).cast("int"))))
    return F.coalesce(bits, F.lit(0).cast("long"))


def topic(sentence: Column) -> Column:
    """The first three capitalised phrases of a sentence, else its first fifty characters."""
    phrases = F.slice(F.regexp_extract_all(sentence, F.lit(r"\b[A-Z][a-z]+(?:\s+[a-z]+)*\b"), F.lit(0)), 1, 3)
    return F.when(F.size(phrases) > 0, F.array_join(phrases, " ")).otherwise(F.substr(sentence, F.lit(1), F.lit(50)))


def chunk_topic(title: Column, text: Column) -> Column:
    """Topic of a chunk: its title, else the first capitalised phrase (four words at most) of its first hundred characters, else the first fifty."""
    phrase = F.regexp_extract(F.substr(text, F.lit(1), F.lit(100)), r"[A-Z][a-z]+(?:\s+[A-Za-z]+){0,3}", 0)
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(phrase, F.lit("")), F.substr(text, F.lit(1), F.lit(50)))
